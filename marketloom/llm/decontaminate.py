"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders, so a question that was
re-parameterised keeps its template. Windows of `WINDOW` template words of all
texts are hash-joined with those of the benchmark. Hits on one diagonal (the
same shift between item and text) are counted, and on the few that are long
enough the placeholders are compared: a value of the item must stand for one
value of the text and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, let, maybe_broadcast, stored, text_of

#: Template words in a window, hits needed on one diagonal (13 words in a row), and the shortest item that is searched for.
WINDOW, HITS, MIN_WORDS = 8, 6, 5
NAME, UNIT, RUN, DOT, COMMA = "\u0002", "\u0003", "\u0004", "\u0005", "\u0006"
#: Fixed list of unit words that may follow a number.
UNITS = (
    "km", "m", "cm", "mm", "mi", "ft", "in", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "h", "hr", "hrs", "hour", "hours", "min", "minutes", "s", "sec", "seconds", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "mph", "kmh", "hz", "khz", "mhz", "w", "kw", "v", "j", "kj", "kb", "mb", "gb", "tb", "usd", "eur", "gbp", "dollar", "dollars", "cent", "cents", "euro", "euros",
    "percent", "degrees", "meters", "metres", "miles", "feet", "inches", "kilometers", "kilograms", "grams", "pounds", "liters", "litres",
)


def marked_units(text: Column) -> Column:
    """The text with a mark before each unit (behind a number). Characters that serve as marks are blanks."""
    marks = (NAME, UNIT, RUN, DOT, COMMA)
    has = F.contains(text, F.lit(marks[0]))
    for m in marks[1:]:
        has = has | F.contains(text, F.lit(m))
    bare = F.when(has, F.translate(text, "".join(marks), " " * len(marks))).otherwise(text)
    return F.regexp_replace(bare, rf"(\p{{N}}) ?((?i:{'|'.join(UNITS)}))(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")


def _cut(text: Column, extra: str) -> Column:
    """The runs of letters, digits and these marks. One class of characters: no pattern repeats a group, so runs of any length are cut without recursion."""
    return F.array_remove(F.split(text, rf"[^\p{{L}}\p{{N}}{extra}]+"), "")


def tokens(marked: Column) -> Column:
    """The words of a text with marked units, in order; names (capitalised inside a sentence) and units carry a mark as first character."""
    named = F.regexp_replace(marked, r" (?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{Ll})", f" {NAME}")
    return _cut(named, NAME + UNIT)


def canonical(units: Column) -> Column:
    """As `tokens`, but every capitalised word is a name, at the start of a sentence too, a run of names is one word, and so is a number with its separators."""
    marked = F.regexp_replace(units, rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{UNIT}]\p{{Lu}})(?=\p{{Ll}})", f"{NAME}$0")
    runs = F.replace(F.regexp_replace(marked, rf"({NAME}[\p{{L}}\p{{N}}]+) (?={NAME})", f"$1{RUN}"), F.lit(RUN + NAME), F.lit(RUN))
    for sign, mark in ((r"\.", DOT), (",", COMMA)):
        runs = F.regexp_replace(runs, rf"{sign}(?<=\p{{N}}{sign})(?=\p{{N}})", mark)
    return _cut(runs, NAME + UNIT + RUN + DOT + COMMA)


def n_words(words: Column, n: Column) -> Column:
    """How many words, as `tokens` counts them, the first `n` of `words` hold."""
    return F.aggregate(F.slice(words, F.lit(1), n), F.lit(0), lambda s, w: s + F.size(F.split(w, rf"[{RUN}{DOT}{COMMA}]+")))


def slot(word: Column) -> Column:
    """1 name, 2 unit, 3 number, 0 a plain word."""
    first = F.substring(word, 1, 1)
    return F.when(first > "9", 0).when(first >= "0", 3).when(first == NAME, 1).when(first == UNIT, 2).otherwise(0)


def template(words: Column) -> Column:
    """A hash for each word; all names are alike, all units, and all numbers."""
    def one(w: Column) -> Column:
        first = F.substring(w, 1, 1)
        return F.when(first > "9", F.xxhash64(F.lower(w))).when(first >= "0", F.lit(3).cast("long")).when(first == NAME, F.lit(1).cast("long")).when(first == UNIT, F.lit(2).cast("long")).otherwise(F.xxhash64(F.lower(w)))

    return F.transform(words, one)


def windows(hashes: Column, length: int) -> Column:
    """The hashes of all windows of `length` words, made by doubling: a window of 8 is two of 4. Empty for shorter texts."""
    def joined(a: Column, b: Column, shift: int) -> Column:
        return F.zip_with(a, F.slice(b, F.lit(shift + 1), F.greatest(F.size(b) - shift, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def grow(part: Column, have: int, built: Column | None, total: int, rest: int, words: Column) -> Column:
        """`part` are windows of `have` words, `built` of the `total` words that are done; `rest` counts what is left in units of `have`."""
        if rest & 1:
            if built is None:
                built, total = part, have
            else:
                return let(joined(built, part, total), lambda b: grow(part, have, b, total + have, rest - 1, words))
        if rest > 1:
            return let(joined(part, part, have), lambda p: grow(p, 2 * have, built, total, rest >> 1, words))
        return F.slice(built, F.lit(1), F.greatest(F.size(words) - length + 1, F.lit(0)))

    return let(hashes, lambda h: grow(h, 1, None, 0, length, h))


def folded(marked: Column) -> Column:
    """The words of `tokens` without marks and without case."""
    return _cut(F.lower(F.upper(F.replace(marked, F.lit(UNIT), F.lit(" ")))), "")


def verbatim_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


#: How a text with marked units is read: its words, their hashes, and whether some of them are placeholders.
READINGS = {"template": (tokens, template, True), "canonical": (canonical, template, True), "verbatim": (folded, verbatim_hashes, False)}


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, hits: int = HITS, min_words: int = MIN_WORDS, verbatim: bool = False) -> DataFrame:
    """(t1, t2, item_id, shift, hits, n_windows, exact): the texts, by their 128-bit hash, that hold an item's template.

    A text is contaminated by an item if at least `hits` of the item's windows
    (all, if it has fewer) lie on one diagonal and each value of the item under
    them stands for one value of the text. Items of fewer than `window` words are
    searched as one window of their own length, items under `min_words` words are
    not searched for: they would be found in clean texts. Windows with more
    placeholders than words count only in items that have no other. Null texts
    count as empty.

    With `verbatim`, as many windows on one diagonal that are equal word for word,
    case aside, are enough whatever the values elsewhere, and only values that
    were changed have to be changed alike.
    """
    readings = {k: READINGS[k] for k in READINGS if verbatim or k != "verbatim"}
    items, wins, lengths = {}, None, {}
    for kind, (words, hashes, typed) in readings.items():
        its = benchmark.select(col(item_col).alias("item"), words(marked_units(text_of(item_text))).alias("words"))
        its = its.filter(F.size("words") >= min_words).withColumn("hashes", hashes(F.col("words"))).withColumn("len", F.least(F.size("words"), F.lit(window)))
        items[kind] = its = stored(its, "benchmark-words")
        lengths[kind] = sorted(r[0] for r in its.select("len").distinct().collect())  # at most `window` values
        for n in lengths[kind]:
            w = its.filter(F.col("len") == n).select("item", "len", "words", F.posexplode(windows(F.col("hashes"), n)).alias("ipos", "win"))
            plain = 2 * F.size(F.filter(F.slice("words", F.col("ipos") + 1, n), lambda x: slot(x) == 0)) >= n if typed else F.lit(True)
            w = w.select(F.lit(kind).alias("kind"), "item", "len", "ipos", "win", plain.alias("plain"))
            wins = w if wins is None else wins.unionByName(w)
    if wins is None:
        return docs.select(*_digest(text_of(text_col)), F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("n_windows"), F.lit(False).alias("exact")).limit(0)
    per_item = wins.groupBy("kind", "item").agg(F.max("plain").alias("any_plain"))
    wins = wins.join(per_item, ["kind", "item"]).filter(F.col("plain") | ~F.col("any_plain"))
    wins = stored(wins.select("kind", "item", "len", "ipos", "win"), "benchmark-windows")
    needed = wins.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n_windows"))
    n_wins = wins.count()

    text = text_of(text_col)
    base = docs.select(*_digest(text), marked_units(text).alias("marked"))  # once for all readings
    read = [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("len"), windows(hashes(words(F.col("marked"))), n).alias("wins")) for kind, (words, hashes, _) in readings.items() for n in lengths[kind]]
    found = base.select("t1", "t2", F.explode(F.array(*read)).alias("r")).select("t1", "t2", "r.kind", "r.len", F.posexplode("r.wins").alias("pos", "win"))
    found = found.join(maybe_broadcast(wins, n_wins), ["win", "kind", "len"]).select("kind", "t1", "t2", "item", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos")
    lines = (
        found.distinct().groupBy("kind", "t1", "t2", "item", "shift").agg(F.count(F.lit(1)).alias("hits"), F.min("ipos").alias("lo"), F.max("ipos").alias("hi"))
        .join(needed, ["kind", "item"]).filter(F.col("hits") >= F.least(F.col("n_windows"), F.lit(hits)))
    )
    lines = stored(lines, "template-hits")

    # The words behind the hits: only texts with a long enough diagonal are read again.
    typed_lines = lines.filter(F.col("kind") != "verbatim")
    texts = typed_lines.select("t1", "t2").distinct()
    n_texts = texts.count()
    held = docs.select(*_digest(text), text.alias("text")).join(maybe_broadcast(texts, n_texts), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.any_value("text").alias("text"))
    held = stored(held, "hit-texts")
    # Verbatim lines have nothing to compare; they are exact if no window between the first and the last is missing.
    accepted = lines.filter(F.col("kind") == "verbatim").select("t1", "t2", "item", "shift", "hits", "n_windows", (F.col("hits") == F.col("hi") - F.col("lo") + 1).alias("exact"))
    for kind, (words, _, typed) in readings.items():
        if typed:
            accepted = accepted.unionByName(_consistent(typed_lines.filter(F.col("kind") == kind), items[kind], held.select("t1", "t2", words(marked_units(F.col("text"))).alias("dwords")), verbatim))
    out = accepted.groupBy("t1", "t2", "item").agg(F.max(F.struct("hits", F.negative("shift").alias("back"), "exact", "n_windows")).alias("m"))
    return stored(out.select("t1", "t2", F.col("item").alias("item_id"), F.negative("m.back").alias("shift"), "m.hits", "m.n_windows", "m.exact"), "leaks")


def _consistent(lines: DataFrame, items: DataFrame, held: DataFrame, changed_only: bool) -> DataFrame:
    """The lines under which each value of the item stands for one value of the text; values that stayed count unless `changed_only`."""
    lined = stored(lines.join(items.select("item", "words", "len"), "item"), "hit-items").join(held, ["t1", "t2"])
    size = F.col("hi") - F.col("lo") + F.col("len")
    pair = F.arrays_zip(F.slice("words", F.col("lo") + 1, size).alias("i"), F.slice("dwords", F.col("lo") + F.col("shift") + 1, size).alias("d"))
    lined = lined.withColumn("pairs", F.transform(pair, lambda p: F.struct(slot(p["i"]).alias("k"), F.lower(p["i"]).alias("i"), slot(p["d"]).alias("dk"), F.lower(p["d"]).alias("d"))))
    counted = (lambda p: p["i"] != p["d"]) if changed_only else (lambda p: F.lit(True))
    slots = F.array_distinct(F.transform(F.filter("pairs", lambda p: (p["k"] > 0) & (p["k"] == p["dk"]) & counted(p)), lambda p: F.struct(p["k"].alias("k"), p["i"].alias("i"), p["d"].alias("d"))))
    lined = lined.withColumn("slots", slots)
    one_value = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["k"].alias("k"), s["i"].alias("v"))))) == F.size("slots")
    exact = F.forall("pairs", lambda p: p["i"].eqNullSafe(p["d"]))
    shift = n_words(F.col("dwords"), F.col("lo") + F.col("shift")) - n_words(F.col("words"), F.col("lo"))
    return lined.filter(one_value).select("t1", "t2", "item", shift.alias("shift"), "hits", "n_windows", exact.alias("exact"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id, shift, hits, n_windows, exact) for every row of `docs` that an item contaminates.

    `shift` is the place of the item's first word among the text's words; `exact`
    tells a verbatim copy from a re-parameterised one. Repeated rows and null ids
    are each reported. Without documents or items the result is empty.
    """
    found = leaks(docs, benchmark, text_col, **options)
    keyed = docs.select(col(id_col).alias("_row"), *_digest(text_of(text_col)))
    return keyed.join(found, ["t1", "t2"]).select(F.col("_row").alias(id_col), "item_id", "shift", "hits", "n_windows", "exact")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that no item contaminates, with their columns."""
    t1, t2 = fresh(docs, "_t1", "_t2")
    found = leaks(docs, benchmark, text_col, **options).select(F.col("t1").alias(t1), F.col("t2").alias(t2)).distinct()
    a, b = _digest(text_of(text_col))
    return docs.withColumn(t1, a).withColumn(t2, b).join(stored(found, "leaked-texts"), [t1, t2], "left_anti").drop(t1, t2)
