from llm_samples import prose

from marketloom.llm.decontaminate import drop_leaks, find_leaks

ITEM = "A train leaves Berlin at 9 and drives 300 km to Hamburg, how many km per hour does the train drive if Anna meets it after 3 hours at Hamburg station"


def leaked(spark, docs):
    bench = spark.createDataFrame([(1, ITEM, 0), (2, prose(400, 30), 0), (3, None, 0), (4, "", 0), (5, "the cat sat on mats", 0), (6, "too short", 0)], "item_id long, text string, hits int")
    return bench, spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item string")


def test_leaks(spark):
    renamed = ITEM.replace("Berlin", "Prague").replace("300 km", "450 miles").replace("Hamburg", "Vienna").replace("Anna", "Boris").replace("300", "450")
    docs = [
        "before it " + ITEM + " and behind it", ITEM.upper(), prose(1, 40) + " " + renamed + " " + prose(2, 40), ITEM.replace("Hamburg station", "Rome station"), prose(400, 30), prose(7, 20) + " " + " ".join(prose(400, 30).split()[5:22]),
        " ".join(prose(400, 30).split()[:10]), prose(8, 500), None, "", "It rains. The cat sat on mats, and", "too short", ITEM,
    ]
    bench, df = leaked(spark, docs)
    found = {(r.doc_id, r.item_id): r.exact for r in find_leaks(df, bench).collect()}
    # 3: one value of the item stands for two of the text; 6: ten words are not enough.
    assert {k for k in found if k[0] not in (1, 3)} == {(0, 1), (2, 1), (4, 2), (5, 2), (10, 5), (12, 1)}
    assert (3, 1) not in found and found[0, 1] and not found[2, 1]
    kept = drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in found}


def test_odd_texts(spark, odd_docs, no_docs):
    bench, _ = leaked(spark, [""])
    assert find_leaks(odd_docs, bench).count() == 0 and drop_leaks(odd_docs, bench).count() == odd_docs.count()
    assert find_leaks(no_docs, bench).count() == 0 and find_leaks(odd_docs, bench.limit(0)).count() == 0
    assert drop_leaks(odd_docs, bench.limit(0)).columns == odd_docs.columns
    own = odd_docs.filter("doc_id = 10").selectExpr("1L as item_id", "text")
    assert sorted(r.doc_id for r in find_leaks(odd_docs, own).collect()) == [10, 11]


def test_near_verbatim(spark):
    """One occurrence of a repeated name changed, other case, two values that fall on one."""
    upper_head = " ".join(w.upper() if i < 20 else "other" for i, w in enumerate(ITEM.split()))
    docs = [ITEM.replace("Hamburg station", "Rome station"), ITEM.upper(), ITEM.lower(), ITEM.title(), upper_head, " ".join(ITEM.split()[:12]), prose(8, 500)]
    bench, df = leaked(spark, docs)
    found = {r.doc_id for r in find_leaks(df, bench, verbatim=True).collect()}
    assert found == {0, 1, 2, 3, 4}
    assert {r.doc_id for r in drop_leaks(df, bench, verbatim=True).collect()} == {5, 6}
    merged = ITEM.replace("at 9", "at 4").replace("3 hours", "4 hours").replace("300", "700")
    bench, df = leaked(spark, [merged])
    assert [r.doc_id for r in find_leaks(df, bench).collect()] == [0]


def test_canonical_placeholders(spark):
    """Names at the start of a sentence or quote, numbers with separators, names of several words."""
    item = "Tom has 3 apples in his old basket. Tom buys 5 more at the market. Tom eats 2 of them, now how many are left?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    lead = "Well then, New York is far away. "
    docs = [item.replace("Tom", "Anna"), item.replace("3", "2.5").replace("5 more", "1,000 more").replace("eats 2", "eats 1.5"), item.replace("Tom", "Anna Maria Berg"), lead + '"' + item.replace("Tom", "Anna Berg").replace("3", "12.5"), prose(8, 500)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r.doc_id: r for r in find_leaks(df, bench).collect()}
    assert set(found) == {0, 1, 2, 3} and not any(r.exact for r in found.values())
    assert found[0]["shift"] == 0 and found[3]["shift"] == len(lead.split())


def test_very_long_runs(spark):
    """A million separators or capitals in a row, and a very long word."""
    bench, _ = leaked(spark, [""])
    runs = [c * 1_000_000 for c in (" ", "-", ".", "\n", "A", ",")] + ["Ab " * 100_000, "1." * 200_000, "é" * 100_000]
    df = spark.createDataFrame([(i, r + " " + ITEM) for i, r in enumerate(runs)] + [(100 + i, r) for i, r in enumerate(runs)], "doc_id long, text string")
    assert {r.doc_id for r in find_leaks(df, bench, verbatim=True).collect()} == set(range(len(runs)))
