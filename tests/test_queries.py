"""A sample of the registered queries against their SQL on the small files."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_oracle as C

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["indicator_ranking", "features_trend", "features_ema_macd", "quality_gate_rows", "dataset_alignment", "features_regime", "classification_metrics", "drift_report",
         "trading_metrics", "universe_combined", "mention_top", "first_exits", "pattern_analogs", "trade_setups", "model_registry_best"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in C.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert C.rows(df.columns, df.collect()) == C.rows(cols, cur.fetchall())


def test_every_sql_has_a_query():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and len(q) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """Python workers started outside the repository still run the helpers."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from marketloom.session import build_session\n"
            "s = build_session(master='local[2]', partitions=2)\n"
            "from marketloom.operators.dedupe import signature_udf\n"
            "from pyspark.sql import functions as F\n"
            "d = s.range(3).select(F.array(F.col('id')).alias('h'))\n"
            "print('rows', d.select(signature_udf(0.9)('h')).count())\n"
            "from marketloom.operators.risk import RiskConfig, screen_orders\n"
            "o = s.sql(\"select 1L order_id, 'a' account, 'X' symbol, 'buy' side, 5.0D qty, 10.0D price, 1.0D atr, 'calm' regime, array('x') event_flags, timestamp'2024-01-02' timestamp\")\n"
            "h = s.sql(\"select 'a' account, 'Y' symbol, 1.0D qty, 1.0D price, 'z' sector\")\n"
            "print('qty', screen_orders(o, h, s.sql(\"select 'a' account, 1000.0D equity\")).first()['approved_qty'])\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "rows 3" in out.stdout and "qty 5.0" in out.stdout, out.stderr[-2000:]
