from collections import defaultdict

import pytest

from marketloom.llm.exact_dedup import drop_copies, mark_copies
from marketloom.llm.url_rules import judge_urls, rule_frame


@pytest.mark.parametrize("bits", [128, 1 << 20])  # a filter that is full passes every row to the exact part
def test_copies(odd_docs, bits):
    rows = mark_copies(odd_docs, filter_bits=bits).collect()
    assert len(rows) == odd_docs.count()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r)
    for text, g in groups.items():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert {r.group_size for r in g} == {len(g)} and {r.keep_id for r in g} == {max(ids) if ids else None}
        assert sum(r.kept for r in g) == 1, text[:20]
    assert {"_h", "key", "bucket", "rid"} <= set(rows[0].asDict())


def test_names_that_are_used_inside(spark):
    rows = [(1, "a", 1, 2, 3, 4, 5, 6), (2, "a", 1, 2, 3, 4, 5, 6), (2, "a", 1, 2, 3, 4, 5, 6), (3, "b", 1, 2, 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id int, text string, _keep int, _size int, _kept int, _sha int, _tie int, _top int")
    got = mark_copies(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r._keep, r._tie) for r in got) == [(1, 2, 3, 1, 5), (2, 2, 3, 1, 5), (2, 2, 3, 1, 5), (3, 3, 1, 1, 5)] and sum(r.kept for r in got) == 2
    assert drop_copies(df).columns == df.columns


def test_drop_copies_keeps_columns(odd_docs, no_docs):
    kept = drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.selectExpr("coalesce(text, '') t").distinct().count()
    assert mark_copies(no_docs).count() == 0 and drop_copies(no_docs).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/bad", "block"), ("com", "/", "allow"), ("a.com", "", "block"), ("a.com", "", "allow"), ("", "/x", "block")]


def judged(url):
    """The longest fitting rule, tried one by one."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0] if rest[cut:cut + 1] == "/" else ""
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in RULES if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://net/", "https://x.example.net/en/1?q", "https://example.net/en/bad/1", "ftp://sub.example.net/de#f", "http://a.com", "http://b.a.com?x://y", "http://aa.com/", "http://m.org/x/y",
            "http://m.org/y", "x://y://z/", "http://example.net.org/en/", "http://a..com/", "http://.com/", "http://ÄB.com/Ä"]
    urls += [f"http://h{i % 7}.hot.net/en/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "clash", 0) for i, u in enumerate(urls)] + [(None, "http://net/", "clash", 0)], "page_id long, url string, host string, part int").repartition(5)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rule_frame(spark, RULES)).collect()}
    assert got.pop(None) == judged("http://net/")
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), rule_frame(spark, RULES)).count() == 0
    assert {r.verdict for r in judge_urls(pages, rule_frame(spark, RULES).limit(0)).collect()} == {"allow"}
