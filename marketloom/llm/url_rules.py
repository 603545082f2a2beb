"""URL filtering as a sort-merge range join between rules and urls.

A host becomes its labels in reverse order, each followed by a dot, so a rule
for a host is the interval of all keys that start with the rule's key. Urls and
rules are sorted together; one sweep keeps the stack of rules whose interval is
still open (intervals of prefixes are nested), and each url is judged by the
longest open rule whose path starts the url's path.

The sweep runs on every range partition by itself. Rules that are open at the
start of a partition are found by a hash join of the partition's first key,
cut into its ancestors, with the rules; so neither the rules nor a hot host are
held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or without `://`; only A-Z of the host are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """`a.example.net` -> `net.example.a.`; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, key, urls last): a stack of [key, {path: (rule, verdict)}]."""
    part, stack = None, []
    for b in batches:
        rows, rule_out, verdict_out = [], [], []
        for i, (p, key, kind, path, rule, verdict) in enumerate(zip(b["part"], b["key"], b["kind"], b["path"], b["rule"], b["verdict"], strict=True)):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                old = stack[-1][1].get(path)
                if old is None or verdict == "block":
                    stack[-1][1][path] = (rule, verdict)
                continue
            best = None
            for host, paths in stack:
                for n in {len(x) for x in paths}:
                    found = paths.get(path[:n]) if n <= len(path) else None
                    if found and (best is None or (len(host) + n, len(host)) > best[0]):
                        best = ((len(host) + n, len(host)), found)
            rows.append(i)
            rule_out.append(best[1][0] if best else None)
            verdict_out.append(best[1][1] if best else None)
        out = b.iloc[rows][["row_id", "host", "path"]].copy()
        out["rule"], out["verdict"] = pd.Series(rule_out, index=out.index, dtype=object), pd.Series(verdict_out, index=out.index, dtype=object)
        yield out


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `pages`.

    `rules` has host, path and verdict (`allow` or `block`). A rule fits its
    host and all subdomains if the url's path starts with the rule's path; the
    longest (host and path together, then host) wins; of two verdicts for the
    same rule, block wins. A rule with an empty host fits every url. Urls that no
    rule fits get `default` and a null rule. Null urls and urls without `://`
    have an empty host and path. Repeated rows and null ids are judged one by
    one. An empty table gives an empty result.
    """
    host, path = split_url(col(url_col))
    urls = pages.select(col(id_col).alias("row_id"), host.alias("host"), path.alias("path"))
    id_type = urls.schema["row_id"].dataType.simpleString()
    urls = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "row_id", "host")
    r = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "path", F.concat("host", "path").alias("rule"), "verdict", F.lit(None).cast(id_type).alias("row_id"), "host")

    ranged = r.unionByName(urls).repartitionByRange("key", "kind", F.xxhash64("row_id", "path")).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "url-ranges")
    first = ranged.groupBy("part").agg(F.min("key").alias("first"))
    # The first key's ancestors: '' and each prefix that ends with a dot.
    up = first.select("part", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("first", r"\.")) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("first"), F.lit("."), n), F.lit("."))))).alias("key"))
    carried = up.join(r, "key").select("part", *r.columns)
    merged = ranged.unionByName(carried).repartition("part").sortWithinPartitions("part", "key", "kind")
    schema = f"row_id {id_type}, host string, path string, rule string, verdict string"
    out = merged.select("part", "key", "kind", "path", "rule", "verdict", "row_id", "host").mapInPandas(sweep, schema)
    return out.select(F.col("row_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict)."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
