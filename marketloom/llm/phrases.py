"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation and into words. A piece is parsed into
overlapping chunks: a window of three words whose hash is a multiple of MODULUS
ends a chunk and begins the next one, so equal stretches of text are cut alike
wherever they stand. The different chunks are the dictionary, with the number of
times each is parsed. A phrase of up to four words lies whole in one chunk; the
few that lie in the overlap of two are counted in the first of them. So phrases
are counted inside the different chunks, weighted by the chunk's frequency, and
copies of a text cost nothing beyond their parse.

A phrase can only be frequent if its parts are. Before phrases are counted as
text, their hashes are counted level by level, each level only over phrases
whose parts passed the level before; the hashes that are frequent travel as a
filter of bits. Hashes decide what is left out only where a sum of counts proves
that it is too rare, so the counts that are returned are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, release, stored
from .dart_minhash import GOLD, MIX2, mix

#: Words of a trigger, which is the overlap of two chunks, and of the longest phrase.
OVERLAP, LONGEST = 3, 4
#: One window of words in so many is a trigger.
MODULUS = 16
#: The least count of a phrase, the share of its count (in percent) from which a longer one covers it, the scale of scores, and the phrases returned for each language.
LEAST, COVER, SCALE, TOP = 30, 80, 2_000_000, 2_000
#: Bits for each frequent hash, and the most bits of a filter (16 MB); past that more rare phrases are counted, with the same result.
BITS_EACH, BITS_MOST = 16, 1 << 27
#: Characters parsed, and words of chunks counted, in one numpy step.
STEP_CHARS, STEP_WORDS = 8_000_000, 1_000_000
UNKNOWN = "und"
#: A-Z lower-cased, the piece separators . , ; : ! ? and U+000A to U+000D as line feeds, tab as blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def _hashed(coded: pa.DictionaryArray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(coded.dictionary):
        return np.empty(0, dtype=np.uint64)
    return pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy()]


def _ends(starts: np.ndarray) -> np.ndarray:
    """For each word the place where its piece or chunk ends. `starts` has one entry more than pieces."""
    return np.repeat(starts[1:], np.diff(starts))


def chunks(pieces: list[bytes], counts: list[int]) -> tuple[list[bool], list[bytes], list[int]]:
    """The chunks of these pieces, and how often each is parsed; an inner chunk begins with the overlap. A chunk of several pieces may be listed several times."""
    lists = pc.split_pattern(pa.array(pieces, pa.string()), " ")
    starts = lists.offsets.to_numpy().astype(np.int64)
    h = _hashed(lists.flatten().dictionary_encode())
    n = len(h)
    at = np.arange(max(0, n - OVERLAP))
    trigger = at[(at + OVERLAP < _ends(starts)[at]) & (at > np.repeat(starts[:-1], np.diff(starts))[at])]
    window = h[trigger]
    for i in range(1, OVERLAP):
        window = mix(window * GOLD + h[trigger + i])
    trigger = trigger[mix(window) % np.uint64(MODULUS) == 0]
    low, high = np.searchsorted(trigger, starts[:-1]), np.searchsorted(trigger, starts[1:])
    whole = np.flatnonzero(low == high).tolist()
    out: Counter = Counter()
    for p in np.flatnonzero(low < high).tolist():
        words, inner, begin = pieces[p].split(b" "), False, 0
        for t in (trigger[low[p]:high[p]] - starts[p]).tolist():
            out[inner, b" ".join(words[begin:t + OVERLAP])] += counts[p]
            inner, begin = True, t
        out[inner, b" ".join(words[begin:])] += counts[p]
    return [False] * len(whole) + [k[0] for k in out], [pieces[p] for p in whole] + [k[1] for k in out], [counts[p] for p in whole] + list(out.values())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, inner, chunk, n."""
    for b in batches:
        langs = b.column(0)
        for lang in pc.unique(langs).to_pylist():
            texts = b.column(1).filter(pc.equal(langs, lang)).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= STEP_CHARS):
                    size += len(texts[j])
                    j += 1
                raw = Counter("\n".join(texts[i:j]).encode().translate(TABLE).split(b"\n"))
                pieces: Counter = Counter()
                for p, n in raw.items():
                    if clean := b" ".join(p.split()):
                        pieces[clean] += n
                i = j
                if pieces:
                    inner, text, n = chunks(list(pieces), list(pieces.values()))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(inner, pa.bool_()), pa.array(text, pa.string()), pa.array(n, pa.int64())], ["lang", "inner", "chunk", "n"])


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold: two bits each."""
    mask = np.uint64(len(bits) * 64 - 1)
    one, two = h & mask, (h >> np.uint64(32)) * GOLD >> np.uint64(20) & mask
    bit = lambda x: bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)
    return (bit(one) & bit(two)) == 1


def _places(bits: int, h: np.ndarray) -> np.ndarray:
    """The two bits of each hash in a filter of so many bits (see `_has`)."""
    mask = np.uint64(bits - 1)
    return np.concatenate([h & mask, (h >> np.uint64(32)) * GOLD >> np.uint64(20) & mask])


class Windows:
    """The phrases of one step's chunks: hashes and places by number of words, as far as the filters let them through."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        lists = pc.split_pattern(batch.column(2), " ")
        self.starts = lists.offsets.to_numpy().astype(np.int64)
        self.starts = self.starts - self.starts[0]
        self.words = lists.flatten()
        coded = self.words.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        lens = np.diff(self.starts)
        langs = batch.column(0).dictionary_encode()
        self.lang = np.repeat(langs.indices.to_numpy(), lens)
        self.lang_names = langs.dictionary.to_pylist()
        salt = pd.util.hash_array(np.array([f"lang {x}" for x in self.lang_names], dtype=object), categorize=False)
        self.one = mix(_hashed(coded) * MIX2 + salt[self.lang])
        self.n = np.repeat(batch.column(3).to_numpy(), lens)
        self.end = _ends(self.starts)
        #: The first place where a phrase may end (exclusive) to be counted in its chunk.
        self.from_ = np.repeat(self.starts[:-1] + np.where(batch.column(1).to_numpy(zero_copy_only=False), OVERLAP, 0), lens)

    def level(self, k: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the phrases of k words whose parts pass the filters (of 1 to k - 1 words)."""
        at, h = np.arange(len(self.one)), self.one
        for size in range(2, k + 1):
            good = _has(filters[size - 2], h)
            at, h = at[good], h[good]
            # Both parts of size - 1 words passed: their places follow each other in one chunk.
            pair = np.flatnonzero((at[1:] == at[:-1] + 1) & (at[:-1] + size <= self.end[at[:-1]])) if len(at) else np.empty(0, dtype=np.int64)
            at, h = at[pair], mix(h[pair] * GOLD + self.one[at[pair] + size - 1])
        good = at + k > self.from_[at]
        return at[good], h[good]


def _stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about STEP_WORDS words together, put together from smaller batches."""
    held, size = [], 0
    for b in batches:
        words = np.cumsum(pc.binary_length(b.column(2)).to_numpy()) // 6
        cuts = [0, *(np.flatnonzero(np.diff(words // STEP_WORDS)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
                size += int(words[hi - 1] - (words[lo - 1] if lo else 0))
                if size >= STEP_WORDS:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums by hash: (hashes, sums, the order that sorts by hash, where each hash begins in it)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, dtype=np.int64)
    return s[first], np.add.reduceat(n[order], first) if len(s) else n[:0], order, first


def _hash_counts(k: int, shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [f.value for f in shared]
        for b in _stepped(batches):
            w = Windows(b)
            at, h = w.level(k, filters)
            h, n, _, _ = _summed(h, w.n[at])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return run


def _phrase_counts(shared: list):
    """lang, inner, chunk, n -> lang, k, phrase, n: all phrases that pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [f.value for f in shared]
        for b in _stepped(batches):
            w = Windows(b)
            for k in range(1, LONGEST + 1):
                at, h = w.level(k, filters)
                if k <= len(filters):
                    good = _has(filters[k - 1], h)
                    at, h = at[good], h[good]
                if not len(at):
                    continue
                _, n, order, first = _summed(h, w.n[at])
                at = at[order]
                head = np.repeat(at[first], np.diff(np.append(first, len(at))))
                same = w.lang[at] == w.lang[head]
                for i in range(k):
                    same &= w.codes[at + i] == w.codes[head + i]
                if same.all():
                    lead = at[first]
                else:  # two phrases with one hash: every place stands for itself
                    lead, n = at, w.n[at]
                parts = [w.words.take(pa.array(lead + i)) for i in range(k)]
                phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
                names = pa.array(w.lang_names, pa.string()).take(pa.array(w.lang[lead]))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(lead), k, dtype=np.int32)), phrase, pa.array(n, pa.int64())], ["lang", "k", "phrase", "n"])

    return run


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Hashes -> words of 64 bits that they set."""
    for b in batches:
        place = _places(bits, b.column(0).to_numpy().view(np.uint64))
        word, which = np.unique(place >> np.uint64(6), return_inverse=True)
        mask = np.zeros(len(word), dtype=np.uint64)
        np.bitwise_or.at(mask, which, np.uint64(1) << (place & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])


def frequent_filter(spark: SparkSession, counts: DataFrame, least: int):
    """The hashes of (h, n) that are counted at least so often, as broadcast words of bits; at most BITS_MOST bits come to the driver."""
    kept = stored(counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h"), "frequent-hashes")
    n, bits = kept.count(), 1 << 12
    while bits < BITS_EACH * n and bits < BITS_MOST:
        bits *= 2
    words = kept.mapInArrow(lambda batches: _bits(batches, bits), "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    release(kept)
    return spark.sparkContext.broadcast(out)


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of every phrase of 1 to 4 words that stands at least `least` times in its language, and (lang, n) of all words. `least` is 1 or more."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    parsed = rows.mapInArrow(_parsed, "lang string, inner boolean, chunk string, n bigint")
    dictionary = stored(parsed.groupBy("lang", "inner", "chunk").agg(F.sum("n").alias("n")), "chunk-dictionary")
    own = F.length("chunk") - F.length(F.translate("chunk", " ", "")) + 1 - F.when(F.col("inner"), OVERLAP).otherwise(0)
    totals = stored(dictionary.groupBy("lang").agg(F.sum(F.col("n") * own).alias("n")), "language-words")
    filters: list = []
    for k in range(1, LONGEST):
        filters.append(frequent_filter(spark, dictionary.mapInArrow(_hash_counts(k, filters), "h bigint, n bigint"), least))
    counted = dictionary.mapInArrow(_phrase_counts(filters), "lang string, k int, phrase string, n bigint")
    out = stored(counted.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "phrases")
    release(dictionary)
    return out, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the strongest phrases of 2 to 4 words of each language.

    Everything is counted for each language apart; null is the language `und`,
    null texts count as empty. `a` counts the phrase; of its cuts into two parts
    (counted `l` and `r`) the one of the lowest floor(SCALE * a / (l + r)) gives
    the score, the earliest of equal ones. A phrase inside a longer one that is
    counted at least `cover` percent as often is left out. Ranked by score and
    count, largest first, then by phrase in byte order. Repeated rows count each;
    other columns do not matter. Texts and pieces may have any length. Empty
    tables, and languages without a frequent phrase, give no rows.
    """
    found, totals = phrases(docs, lang_col, text_col, least)
    words = F.split("phrase", " ", -1)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    longer = found.filter("k >= 2").withColumn("w", words)
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    one, two = (found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    cuts = cuts.join(one, ["lang", "left"]).join(two, ["lang", "right"])
    cuts = cuts.withColumn("product", F.lit(SCALE).cast("decimal(10,0)") * _wide(F.col("a"))).withColumn("below", _wide(F.col("l")) + _wide(F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("product div below").alias("score"), "cut", "l", "r")).alias("m"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda a: F.array_join(F.slice("w", a, n), " "))))
    inside = longer.filter("k >= 3").select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("over").isNull() | (_wide(F.col("over")) * 100 < _wide(F.col("a")) * cover))
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")
