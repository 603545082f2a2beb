"""Journal tables: append-only rows, keep-latest views and statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import div, tags_array
from ..functions.text import tokenize
from ..session import cut_lineage
from .series import latest, top_per_key

# The tables, their columns, and the key that makes a row unique.
TABLES = {
    "portfolio_snapshots": ("id bigint, timestamp timestamp, total_value double, cash double, invested double, daily_pnl double, total_pnl double, metrics string", ["id"]),
    "positions": ("id bigint, symbol string, quantity double, entry_price double, current_price double, entry_date timestamp, strategy string, status string, exit_price double, exit_date timestamp, pnl double", ["id"]),
    "trades": ("id bigint, symbol string, action string, quantity double, entry_price double, exit_price double, entry_date timestamp, exit_date timestamp, strategy string, pnl double, pnl_percent double, tags string, lessons string, thesis string", ["id"]),
    "memories": ("id bigint, category string, content string, importance double, created_at timestamp, last_accessed timestamp", ["id"]),
    "watchlist": ("symbol string, priority int, thesis string, added_at timestamp, removed boolean", ["symbol"]),
    "alerts": ("id bigint, symbol string, alert_type string, threshold double, status string, created_at timestamp, triggered_at timestamp", ["id"]),
    "market_snapshots": ("id bigint, timestamp timestamp, indices string, sectors string, vix double, regime string", ["id"]),
    "models": ("model_name string, version string, metrics string, path string, is_active boolean, created_at timestamp", ["model_name", "version"]),
    "predictions": ("id bigint, model_name string, symbol string, prediction double, confidence double, actual double, predicted_at timestamp, target_date date", ["id"]),
    "performance": ("date date, portfolio_value double, daily_return double, trades_count int, win_rate double, recorded_at timestamp", ["date"]),
    "conversations": ("id bigint, role string, content string, context string, created_at timestamp", ["id"]),
    "goals": ("id bigint, start_value double, current_value double, target_value double, recorded_at timestamp", ["id"]),
}


def schema(table: str) -> str:
    return TABLES[table][0]


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def current(df: DataFrame, keys: list[str], order: list[str], tombstone: str | None = None) -> DataFrame:
    """Newest row per key; rows whose newest state is removed disappear."""
    d = latest(df, keys, order)
    return d.filter(~F.coalesce(tombstone, F.lit(False))) if tombstone else d


def trade_stats(trades: DataFrame, keys: list[str] = []) -> DataFrame:
    """Counts, averages and profit factor of closed trades."""
    p = F.col("pnl")
    win, lose = p > 0, p <= 0
    g = trades.filter(p.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.count_if(win).alias("winning_trades"), F.count_if(lose).alias("losing_trades"), F.avg(p).alias("avg_pnl"),
        F.avg(F.when(win, p)).alias("avg_win"), F.avg(F.when(lose, p)).alias("avg_loss"), F.sum(p).alias("total_pnl"), F.max(p).alias("best_trade"), F.min(p).alias("worst_trade"))
    return g.withColumns({"win_rate": F.coalesce(div("winning_trades", "total_trades") * 100.0, F.lit(0.0)), "profit_factor": F.abs(div("avg_win", "avg_loss"))})


def close_rows(rows: DataFrame, exits: DataFrame, keys: list[str] = ["id"]) -> DataFrame:
    """Result of closed positions; a short uses the same sign as a long."""
    d = rows.join(exits, keys)
    return d.withColumns({"pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("quantity"), "pnl_percent": (F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1.0) * 100.0})


def since(df: DataFrame, time: str, now, days: int) -> DataFrame:
    return df.filter(F.col(time) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))).orderBy(time)


def recent(df: DataFrame, time: str, n: int, where=None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Newest n rows, optionally filtered."""
    d = df if where is None else df.filter(where)
    return d.orderBy(F.col(time).desc_nulls_last(), *ties).limit(n)


def recent_in_order(df: DataFrame, time: str, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Newest n rows, shown oldest first."""
    return recent(df, time, n, ties=tuple(f"{t}" for t in ties)).orderBy(time, *ties)


def memories(df: DataFrame, category: str | None = None, least: float = 0.0, n: int | None = None) -> DataFrame:
    """Most important first; all of them without `n`."""
    d = df.filter(F.col("importance") >= least)
    d = d.filter(F.col("category") == category) if category else d
    out = d.orderBy(F.desc("importance"), F.col("last_accessed").desc_nulls_last())
    return out if n is None else out.limit(n)


def recall_symbol(df: DataFrame, symbol: str, n: int = 50) -> DataFrame:
    return df.filter(F.contains(F.upper("content"), F.lit(symbol.upper()))).orderBy(F.desc("importance"), "id").limit(n)


def goal_progress(df: DataFrame) -> DataFrame:
    return df.withColumn("progress_pct", F.coalesce(div(F.col("current_value") - F.col("start_value"), F.col("target_value") - F.col("start_value")) * 100.0, F.lit(0.0)))


def triggered_alerts(quotes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Active alerts met by the newest quote of their symbol."""
    a = alerts.filter("status = 'active'")
    q = quotes.join(a.select("symbol").distinct(), "symbol", "left_semi")
    j = a.join(q, "symbol")
    return j.filter(((F.col("alert_type") == "above") & (F.col("price") > F.col("threshold"))) | ((F.col("alert_type") == "below") & (F.col("price") < F.col("threshold"))))


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    d = positions.filter("status = 'open'").join(prices.select("symbol", "price"), "symbol", "left")
    px = F.coalesce("price", "current_price")
    return d.withColumns({"current_price": px, "unrealized_pnl": (px - F.col("entry_price")) * F.col("quantity"), "unrealized_pct": (F.try_divide(px, F.col("entry_price")) - 1.0) * 100.0})


def signal_id_of(tags) -> F:
    """The id behind a `signal_id:` tag."""
    hit = F.filter(tags_array(tags), lambda t: t.startswith("signal_id:"))
    return F.when(F.size(hit) > 0, F.substr(F.element_at(hit, 1), F.lit(11)))


def outcome_events(trades: DataFrame) -> DataFrame:
    """Outcome rows of closed trades that carry a signal id."""
    d = trades.filter(F.col("pnl").isNotNull()).withColumn("signal_id", signal_id_of("tags")).filter("signal_id is not null")
    return d.select("signal_id", F.col("exit_date").alias("outcome_timestamp"), "pnl", (F.col("pnl_percent") / 100.0).alias("realized_return"))


def trade_lessons(trades: DataFrame) -> DataFrame:
    """Two memory rows per closed trade."""
    p, pc = F.col("pnl"), F.coalesce("pnl_percent", F.lit(0.0))
    s = F.coalesce("strategy", F.lit("unknown"))
    th, le = F.coalesce("thesis", F.lit("")), F.coalesce("lessons", F.lit(""))
    row = lambda cat, text, imp: F.struct(F.lit(cat).alias("category"), text.alias("content"), imp.cast("double").alias("importance"))
    won = F.array(row("success_pattern", F.format_string("%s on %s was profitable (%.1f%%). Thesis: %s. Lessons: %s", s, F.col("symbol"), pc, th, le), F.least(F.lit(0.8), 0.5 + F.abs(pc) / 100.0)),
                  row("strategy_performance", F.format_string("%s strategy: WIN on %s (%.1f%%)", s, F.col("symbol"), pc), F.lit(0.6)))
    lost = F.array(row("mistake_pattern", F.format_string("%s on %s lost (%.1f%%). Thesis: %s. What went wrong: %s", s, F.col("symbol"), pc, th, le), F.least(F.lit(0.9), 0.5 + F.abs(pc) / 50.0)),
                   row("strategy_performance", F.format_string("%s strategy: LOSS on %s (%.1f%%)", s, F.col("symbol"), pc), F.lit(0.7)))
    return trades.filter(p.isNotNull()).select(F.col("id").alias("trade_id"), F.inline(F.when(p > 0, won).otherwise(lost)))


def strategy_rankings(mem: DataFrame, least: int = 3) -> DataFrame:
    """Wins and losses per strategy, read from performance memories."""
    c = F.col("content")
    d = mem.filter((F.col("category") == "strategy_performance") & F.contains(c, F.lit("strategy:")))
    d = d.withColumns({"strategy": F.trim(F.element_at(F.split(c, "strategy:"), 1)), "w": F.contains(c, F.lit("WIN")), "l": F.contains(c, F.lit("LOSS"))})
    g = d.groupBy("strategy").agg(F.count_if("w").alias("wins"), F.count_if(F.col("l") & ~F.col("w")).alias("losses"))
    g = g.withColumn("total_trades", F.col("wins") + F.col("losses")).filter(F.col("total_trades") >= least)
    return g.withColumn("win_rate", F.col("wins") / F.col("total_trades") * 100.0)


def category_counts(mem: DataFrame, categories: list[str]) -> DataFrame:
    """Count per fixed category, zero where none."""
    cats = mem.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return cats.join(mem.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("count"))


def top_insights(mem: DataFrame, n: int = 5) -> DataFrame:
    return mem.orderBy(F.desc("importance"), "id").limit(n).select("id", "content", "importance")


def token_set(text: str) -> Column:
    """The different lower-case words of a text, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.split(F.lower(F.trim(F.col(text))), r"\s+"), lambda t: F.length(t) > 0)))


#: At most so many token ranks are sent to the tasks; the tokens below them count as equally rare.
RANKED = 1 << 20
#: Longs of the bit signature of a set.
WORDS = 16
#: Sets of so many tokens fill that signature; they get one that grows with them.
LARGE = 64 * WORDS
#: Bytes of signatures in a tile of large sets.
TILE = 1 << 20
#: At most so many ids are sent to the tasks to pick the sets that are compared whole.
PICKED = 1 << 20


def prefix_udf(hashes, counts):
    """(prefix, bits) of a hashed set: its `first` rarest tokens, and the parity of its tokens in each of 64 * WORDS classes."""

    @F.pandas_udf("prefix array<bigint>, bits array<bigint>")
    def prefix(sets: pd.Series, first: pd.Series) -> pd.DataFrame:
        known, df = hashes.value, counts.value
        heads, bits = [], []
        for h, n in zip(sets, first):
            h = np.asarray(h, dtype=np.int64)
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            rank = np.where(known[at] == h, df[at], 0) if len(known) else np.zeros(len(h), dtype=np.int64)
            heads.append(h[np.lexsort((h, rank))[:n]])
            odd = np.bincount(h & (64 * WORDS - 1), minlength=64 * WORDS) & 1
            bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        return pd.DataFrame({"prefix": heads, "bits": bits})

    return prefix


def signature_udf():
    """Parity of a hashed set of n tokens in 2n to 4n classes, a power of two of at least 64."""

    @F.pandas_udf("binary")
    def signature(sets: pd.Series) -> pd.Series:
        out = []
        for h in sets:
            m = max(64, 2 << len(h).bit_length())
            odd = np.bincount(np.asarray(h, dtype=np.int64) & (m - 1), minlength=m) & 1
            out.append(np.packbits(odd.astype(np.uint8)).tobytes())
        return pd.Series(out)

    return signature


def compare_tiles(threshold: float, least: int, same: bool):
    """(l, r) of the rows of a cell whose signatures differ in no more bits than similar sets may; the larger one has at least `least` tokens."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == "l"], rows[rows["side"] == "r"].sort_values("size")
        found_l, found_r = [], []
        if len(a) and len(b):
            words = min(len(x) for x in rows["sig"]) // 8

            def folded(d):
                return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0) for x in d["sig"]])

            bits, sizes, ids = folded(b), b["size"].to_numpy(np.int64), b["sid"].to_numpy()
            for own, size, sig in zip(a["sid"], a["size"], folded(a)):
                lo, hi = np.searchsorted(sizes, threshold * size - 1.0), np.searchsorted(sizes, size / threshold + 1.0, "right")
                other = sizes[lo:hi]
                need = np.ceil(threshold * np.maximum(other, size) - 1e-9)
                apart = np.bitwise_count(bits[lo:hi] ^ sig).sum(axis=1, dtype=np.int64)
                near = (np.minimum(other, size) >= need) & (np.maximum(other, size) >= least) & (apart <= other + size - 2 * need)
                if same:
                    near &= (ids[lo:hi] != own) & ((rows["i"].iat[0] != rows["j"].iat[0]) | (rows["lb"].iat[0] != rows["rb"].iat[0]) | (ids[lo:hi] > own))
                hit = ids[lo:hi][near]
                found_l.append(np.full(len(hit), own, dtype=ids.dtype))
                found_r.append(hit)
        join = lambda xs: np.concatenate(xs) if xs else np.array([], dtype=np.int64)
        return pd.DataFrame({"l": join(found_l), "r": join(found_r)})

    return compare


def large_pairs(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(l, r): pairs of one category that may be similar and of which the larger set has LARGE tokens or more; without `right`, each pair of `left` one way.

    Rows are (category, sid, size, hs). Any two of these sets share rare tokens,
    so no prefix tells them apart. Sets lie in bands of size, of which a similar
    pair meets the same or the next one, and in tiles of TILE bytes of
    signatures; every two tiles that can meet are one cell, compared in numpy.
    """
    same, step = right is None, 1e-6 - math.log(threshold)
    sign = signature_udf()

    def tiled(d: DataFrame) -> tuple[DataFrame, DataFrame]:
        d = d.filter(F.col("size") >= math.ceil(threshold * LARGE - 1e-9))
        d = cut_lineage(d.select("category", "sid", "size", F.floor(F.log(F.col("size")) / F.lit(step)).cast("int").alias("band"), sign("hs").alias("sig")))
        n = d.groupBy("category", "band").agg(F.ceil(F.sum(F.length("sig")) / F.lit(TILE)).cast("int").alias("n"))
        return d, n

    def on(d: DataFrame, n: DataFrame, band: str) -> DataFrame:
        n = n.select(F.col("category").alias("_c"), F.col("band").alias("_b"), "n")
        return d.join(n, d["category"].eqNullSafe(n["_c"]) & (d[band] == n["_b"])).drop("_c", "_b")

    def placed(d: DataFrame, n: DataFrame, band: str, tile: str) -> DataFrame:
        return on(d.withColumnRenamed("band", band), n, band).withColumn(tile, F.pmod(F.xxhash64("sid"), F.col("n")).cast("int")).drop("n")

    def met(d: DataFrame, n: DataFrame, own: str, band: str, tile: str, steps: tuple[int, ...]) -> DataFrame:
        d = d.withColumn(band, F.explode(F.array(*[F.col(own) + k for k in steps])))
        return on(d, n, band).withColumn(tile, F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")

    ld, ln = tiled(left)
    rd, rn = (ld, ln) if same else tiled(right)
    a = met(placed(ld, ln, "lb", "i"), rn, "lb", "rb", "j", (0, 1) if same else (-1, 0, 1)).withColumn("side", F.lit("l"))
    b = met(placed(rd, rn, "rb", "j"), ln, "rb", "lb", "i", (0, -1) if same else (-1, 0, 1)).withColumn("side", F.lit("r"))
    cells = a.unionByName(b)
    if same:
        cells = cells.filter((F.col("lb") != F.col("rb")) | (F.col("i") <= F.col("j")))
    kind = left.schema["sid"].dataType.simpleString()
    return cells.groupBy("category", "lb", "i", "rb", "j").applyInPandas(compare_tiles(threshold, LARGE, same), f"l {kind}, r {kind}")


def set_join(left: DataFrame, right: DataFrame, threshold: float = 0.8, best: str | None = None) -> DataFrame:
    """(l, r): all pairs of one category whose sets overlap in at least `threshold` of the larger one.

    `left` and `right` have (category, sid, toks) with different sets only. Tokens
    are ordered by how many sets hold them, those too rare to be ranked first. A
    set of n tokens can lack at most n - ceil(threshold * n) of them, so a pair
    shares one of the first n - ceil(threshold * n) + 1 of each: only these are
    joined on. Each token turns one bit of its set's signature; two signatures differ
    in no more bits than the sets in tokens, so pairs that differ in too many are
    left out inside the join, and only near ones are written and compared whole.
    Sets of LARGE tokens or more fill that signature and share rare tokens with
    most others; they are found by longer signatures (`large_pairs`).
    With `best`, a column of `right` that differs in each of its sets, only the
    partner that is first by it is kept; the first ones are compared first, in
    rounds of 1, 8, 64, ... a set, until every set has one or none is left.
    """
    same = left.sameSemantics(right)
    hashed = lambda d: d.select("category", "sid", F.size("toks").alias("size"), F.transform("toks", lambda t: F.xxhash64("category", t)).alias("hs"))
    both = hashed(left) if same else hashed(left).unionByName(hashed(right))
    held = both.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    total = both.agg(F.sum("size")).first()[0] or 0
    ranked = held.filter(F.col("df") >= max(2, math.ceil(total / RANKED))).toArrow()  # at most RANKED rows
    known, df = ranked["h"].to_numpy(), ranked["df"].to_numpy()
    order = np.argsort(known)
    sc = left.sparkSession.sparkContext
    prefix = prefix_udf(sc.broadcast(known[order]), sc.broadcast(df[order]))

    def marked(sets: DataFrame) -> DataFrame:
        need = F.ceil(F.lit(threshold) * F.col("size") - 1e-9).cast("int")
        return cut_lineage(hashed(sets).filter(F.col("size") < LARGE).withColumn("p", prefix("hs", F.col("size") - need + 1)).drop("hs"))

    def prefixes(marks: DataFrame) -> DataFrame:
        return marks.select(F.explode("p.prefix").alias("h"), "category", "sid", "size", *[F.col("p.bits")[i].alias(f"b{i}") for i in range(WORDS)])

    at = lambda side, name: F.col(f"{side}.{name}")
    least = F.ceil(F.lit(threshold) * F.greatest("l.size", "r.size") - 1e-9)
    apart = sum((F.bit_count(at("l", f"b{i}").bitwiseXOR(at("r", f"b{i}"))) for i in range(WORDS)), F.lit(0))
    near = (F.least("l.size", "r.size") >= least) & (apart <= at("l", "size") + at("r", "size") - 2 * least) & at("l", "category").eqNullSafe(at("r", "category"))
    near = near & (at("l", "sid") < at("r", "sid")) if same else near
    marks = marked(left)
    l = prefixes(marks)
    r = l if same else prefixes(marked(right))  # of one table, both sides read one exchange
    pairs = l.alias("l").join(r.alias("r"), (at("l", "h") == at("r", "h")) & near).select(at("l", "sid").alias("l"), at("r", "sid").alias("r")).distinct()
    pairs = pairs.unionByName(large_pairs(hashed(left), None if same else hashed(right), threshold))
    two_way = lambda d: d.select(F.explode(F.array(F.struct("l", "r"), F.struct(F.col("r").alias("l"), F.col("l").alias("r")))).alias("p")).select("p.l", "p.r")
    own = left.filter(F.size("toks") > 0).select(F.col("sid").alias("l"))
    a, b = left.select(F.col("sid").alias("l"), F.col("toks").alias("_a")), right.select(F.col("sid").alias("r"), F.col("toks").alias("_b"))

    def whole(some: DataFrame) -> DataFrame:
        few = some.count() <= PICKED
        picked = lambda d, side: d.join(F.broadcast(some.select(side).distinct()), side, "left_semi") if few else d
        alike = F.size(F.array_intersect("_a", "_b")) >= F.lit(threshold) * F.greatest(F.size("_a"), F.size("_b")) - 1e-9
        return some.join(picked(a, "l"), "l").join(picked(b, "r"), "r").filter(alike).drop("_a", "_b")

    if best is None:  # of one table found one way; a set is its own partner
        alike = whole(cut_lineage(pairs))
        return two_way(alike).unionByName(own.select("l", F.col("l").alias("r"))) if same else alike
    order = right.select(F.col("sid").alias("r"), F.col(best).alias("_best"))
    rest = (two_way(pairs) if same else pairs).join(order, "r")
    if same:  # nothing after the set itself can be first
        rest = rest.join(order.select(F.col("r").alias("l"), F.col("_best").alias("_own")), "l").filter(F.col("_best") < F.col("_own")).drop("_own")
    rest, found, n = cut_lineage(rest.select("l", "r", "_best")), None, 1
    while not rest.isEmpty():
        tried = cut_lineage(top_per_key(rest, ["l"], [F.col("_best")], n).drop("_rank"))
        first = cut_lineage(whole(tried).groupBy("l").agg(F.min_by("r", "_best").alias("r")))
        found = first if found is None else found.unionByName(first)
        rest = cut_lineage(rest.join(tried.select("l", "r"), ["l", "r"], "left_anti").join(first.select("l"), "l", "left_anti"))
        n *= 8
    found = rest.select("l", "r") if found is None else found
    return own.join(found, "l", "left").select("l", F.coalesce("r", "l").alias("r")) if same else found


def similar_memory(new: DataFrame, stored: DataFrame, threshold: float = 0.8, pool: int | None = None) -> DataFrame:
    """The most important stored memory of the same category that is similar to each new one (smallest id of equal ones), if any.

    All stored rows are searched; with `pool`, only so many most important ones
    of each category. Equal texts are one set, so copies are compared once. The
    sets are written once to the checkpoint folder and numbered there.
    """
    rows = stored.select("category", "id", "importance", token_set("content").alias("toks"))
    if pool is not None:
        rows = top_per_key(rows, ["category"], [F.desc("importance"), F.col("id")], pool).drop("_rank")
    key = F.unhex(F.sha2(F.concat_ws("\u0001", F.col("category").cast("string"), F.array_join("toks", "\u0002")), 256)).alias("key")
    better = F.struct(F.col("importance").isNull().alias("none"), (-F.col("importance")).alias("low"), F.col("id").alias("id"))
    real = F.col("category").isNotNull() & (F.size("toks") > 0)
    numbered = lambda g, *more: cut_lineage(g.agg(F.any_value("toks").alias("toks"), *more).withColumn("sid", F.monotonically_increasing_id()))
    kept = numbered(rows.filter(real).select("category", key, "toks", better.alias("best")).groupBy("category", "key"), F.min("best").alias("best"))
    asked = new.select("category", F.col("id").alias("new_id"), token_set("content").alias("toks"))
    sets = kept if pool is None and new.sameSemantics(stored) else numbered(asked.filter(real).select("category", key, "toks").groupBy("category", "key"))
    found = set_join(sets, kept, threshold, best="best")
    hit = found.join(kept.select(F.col("sid").alias("r"), "best"), "r").join(sets.select(F.col("sid").alias("l"), "key"), "l").select("key", "best")
    return asked.select("new_id", "category", key).join(hit, "key", "left").select("new_id", "category", F.col("best.id").alias("existing_id"))


def scan_page(results: DataFrame, status: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """Scored rows first, best score first."""
    d = results.filter(F.col("status") == status) if status else results
    return d.orderBy(F.col("primary_score").isNull(), F.desc("primary_score"), "ticker").offset((page - 1) * size).limit(size)


def status_counts(results: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    g = results.groupBy(*keys).agg(F.count("*").alias("total"), *[n(s) for s in ("queued", "running", "completed", "failed")], F.max("primary_score").alias("max_score"))
    return g.withColumn("progress_pct", F.coalesce(div(F.col("completed") + F.col("failed"), "total") * 100.0, F.lit(0.0)))


def scan_runs(runs: DataFrame, status: str | None = None, n: int = 50) -> DataFrame:
    d = runs.filter(F.col("status") == status) if status else runs
    stamps = [c for c in ("updated_at", "completed_at", "started_at", "created_at") if c in runs.columns]
    return d.orderBy(F.coalesce(*stamps).desc_nulls_last(), "run_id").limit(n)


def last_analysis(requested: DataFrame, reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest report per requested symbol, else the newest run naming it; of equal stamps the largest id."""
    r = reports.groupBy("symbol").agg(F.max("created_at").alias("_rep"), F.max_by("report_id", F.struct("created_at", "report_id")).alias("report_id"))
    named = runs.select(F.explode("tickers").alias("symbol"), "run_id", "completed_at")
    u = named.groupBy("symbol").agg(F.max("completed_at").alias("_run"), F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id"))
    d = requested.join(r, "symbol", "left").join(u, "symbol", "left")
    return d.select("symbol", "report_id", F.when(F.col("report_id").isNull(), F.col("run_id")).alias("run_id"), F.coalesce("_rep", "_run").alias("analysis_date"))


def alert_shortlist(scored: DataFrame, least: float = 0.70, n: int = 5) -> DataFrame:
    """Confident, directional rows among the n best."""
    best = scored.orderBy(F.desc("confidence"), "symbol").limit(n)
    return best.filter((F.col("confidence") >= least) & (F.col("bias") != "NO_TRADE"))
