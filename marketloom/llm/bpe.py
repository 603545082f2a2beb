"""Byte-level BPE encoding and decoding: the distinct words of a corpus are folded once each.

A text is cut into words by the tokenizer's pattern. Every distinct word of the
corpus is an array of bytes, and its ids come from a fold with Spark's
higher-order functions: the state is the array of ids so far and the array of
ranks of their neighbours; each step takes the leftmost pair of the smallest
rank, puts the joined id in its place (an id is its rank), and looks up the two
ranks that changed. The ranks are a literal map of pairs of ids, in small
buckets, so a lookup does not grow with the vocabulary. Only the plan over the
distinct words holds it.

Texts are put together from the ids of their words; decoding concatenates the
binary pieces of the ids. Up to TABLE_WORDS counted words every task gets the ids
of all words as a compact table of at most about 100 MB. Beyond that documents
are dealt over shards of bounded size, and a shard receives the ids of the words
that its documents hold. Both ways give the same.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytelevel import PatternTokens, PreTokens, pattern_classes, steps
from .common import col, fresh, let, release, stored

#: Spreads the pairs over the places of the rank map.
SPREAD = 7_919
#: Distinct words whose ids are sent to every task, and the UTF-8 bytes of text in a shard where they are more.
TABLE_WORDS, SHARD_BYTES = 4_000_000, 64 << 20
#: Characters of text in a batch that is returned.
OUT_CHARS = 3_000_000
#: Words whose ids are laid out together in the table.
STEP_WORDS = 65_536
#: Words of more bytes are folded with a heap: the fold copies its state at each merge, so its work grows with the square of a word.
LONG_WORD = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank, which is the id, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def joins(ranks: dict[bytes, int]) -> list[dict[int, int]]:
    """By left id: the right ids it can be joined with, and the id of both together."""
    out: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 1)]
    for piece, i in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                out[left][right] = i
    return out


def heap_fold(word: bytes, singles: list[int], pairs: list[dict[int, int]]) -> list[int]:
    """The same merges as the fold, in a time of n log n: for very long words."""
    ids = [singles[b] for b in word]
    n = len(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs[ids[i]].get(ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or ids[i] != left or ids[j] != right:
            continue  # one of the two has been joined since
        ids[i], ids[j] = rank, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := pairs[rank].get(ids[k])) is not None:
                heapq.heappush(heap, (r, i, rank, ids[k]))
        if (h := before[i]) >= 0 and (r := pairs[ids[h]].get(rank)) is not None:
            heapq.heappush(heap, (r, h, ids[h], rank))
    return [i for i in ids if i >= 0]


class BytePairs:
    """A vocabulary of byte pieces: encodes words, and decodes ids, as columns."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks have no piece for the bytes {missing}")
        self.ranks = ranks
        self.singles = [ranks[bytes([b])] for b in range(256)]
        self.pairs = joins(ranks)
        #: Pieces that merges do not lead to; as whole words they are one id nevertheless.
        self.odd = {p: i for p, i in ranks.items() if heap_fold(p, self.singles, self.pairs) != [i]}
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for p, i in ranks.items():
            self.pieces[i] = p

    def _literal(self, values: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)

    def fold(self, word: Column) -> Column:
        """The ids of one word's bytes (a binary column), by ranked merges over the literal rank map."""
        size, wide = 1, 65_536
        while 2 * size < sum(len(p) for p in self.pairs):
            size *= 2
        while wide < len(self.pieces):
            wide *= 2
        # A bucket is [null, pair, rank, pair, rank, ...]: the element behind a pair's place is its rank, and at 0 stands what a missing pair has. Pairs are larger than ranks.
        buckets: list[list[int | None]] = [[None] for _ in range(size)]
        for left, rights in enumerate(self.pairs):
            for right, rank in rights.items():
                buckets[(left * SPREAD + right) & (size - 1)] += [(left + 1) * wide + right, rank]
        literal = lambda x: F.lit(x).cast("long")
        tables = F.struct(self._literal(buckets, "array<array<bigint>>").alias("pair"), self._literal(self.singles, "array<bigint>").alias("single"), literal(size - 1).alias("mask"), literal(wide).alias("wide"))
        folded = let(tables, lambda t: self._fold(word, t))
        if not self.odd:
            return folded
        odd = F.create_map(*[x for p, i in self.odd.items() for x in (F.lit(bytearray(p)), F.array(F.lit(i)))])
        return F.coalesce(F.try_element_at(odd, word), folded)

    @staticmethod
    def _fold(word: Column, tables: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            place = (left * SPREAD + right).bitwiseAND(tables["mask"]).cast("int")
            return let(tables["pair"][place], lambda b: b[F.array_position(b, (left + 1) * tables["wide"] + right).cast("int")])

        none = F.array().cast("array<bigint>")
        ids = F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda b: tables["single"][F.ascii(b)])  # one character for each byte

        def start(t: Column) -> Column:
            r = F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), rank)
            return F.struct(t.alias("t"), r.alias("r"), F.array_min(r).alias("low"))

        def step(acc: Column, _: Column) -> Column:
            return F.when(acc["low"].isNull(), acc).otherwise(let(F.array_position(acc["r"], acc["low"]).cast("int"), lambda i: merge(acc, i)))

        def merge(acc: Column, i: Column) -> Column:
            t, r, low = acc["t"], acc["r"], acc["low"]
            left = F.when(i > 1, F.array(rank(t[i - 2], low))).otherwise(none)
            right = F.when(i + 1 < F.size(t), F.array(rank(low, t[i + 1]))).otherwise(none)
            toks = F.concat(F.slice(t, F.lit(1), i - 1), F.array(low), F.slice(t, i + 2, F.size(t)))
            ranks = F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(r)))
            return let(ranks, lambda x: F.struct(toks.alias("t"), x.alias("r"), F.array_min(x).alias("low")))

        return F.when(F.octet_length(word) == 0, none).otherwise(let(ids, lambda t: let(start(t), lambda s: F.aggregate(t, s, step)))["t"]).cast("array<int>")

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: the pieces one after the other (as raw strings, which keeps the concatenation linear)."""
        pieces = F.from_json(F.lit(json.dumps([base64.b64encode(p).decode() for p in self.pieces])), "array<binary>")
        return let(pieces, lambda p: F.array_join(F.transform(ids, lambda i: p[i].cast("string")), "")).cast("binary")


def listed(ids: Column) -> Column:
    """The ids in decimal, joined by commas (an array's own text form, without brackets and blanks)."""
    return F.coalesce(F.translate(ids.cast("string"), "[] ", ""), F.lit(""))


class Splitter:
    """Cuts texts into words by the tokenizer's pattern: the public one on whole batches, others text by text."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.classes = pattern, pattern_classes(pattern)

    def __call__(self, texts: list[str]) -> PreTokens | PatternTokens:
        return PatternTokens(texts, self.pattern) if self.classes is None else PreTokens(texts, np.frombuffer(self.classes, dtype=np.uint8))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about OUT_CHARS characters together, so that few texts are Python strings at a time."""
    size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // OUT_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    return ((lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo)


def _words(splitter):
    """shard, text -> shard, word: the different words of each shard in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter.value
        for b in batches:
            shard = b.column(0).to_numpy()
            for s in np.unique(shard).tolist():
                column = b.column(1).filter(pa.array(shard == s))
                seen: set[bytes] = set()
                for lo, hi in _slices(column):
                    texts = column.slice(lo, hi - lo).to_pylist()
                    for i, j in steps(texts):
                        seen.update(split(texts[i:j]).raw_words)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(seen), pa.int32()), pa.array(list(seen), pa.binary())], ["shard", "word"])

    return run


def _long(shared):
    """Long words -> their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles, pairs, odd = shared.value
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[odd[w]] if w in odd else heap_fold(w, singles, pairs) for w in words], pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _spread(lens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of all elements of the stretches that begin at `starts` and have these lengths."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


class Assembler:
    """Puts the ids and the bytes of whole texts together from those of their words."""

    def __init__(self, splitter: Splitter, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.split, (self.piece_bytes, self.piece_at, self.piece_len) = splitter, pieces

    def __call__(self, texts: list[str], flat: np.ndarray, places) -> tuple[pa.Array, pa.Array]:
        """`places` gives, for a list of words, where their ids start in `flat` and how many they are."""
        all_ids, sizes, all_bytes, lengths = [], [], [], []
        for i, j in steps(texts):
            p = self.split(texts[i:j])
            start, size = places(p.raw_words)
            lens = size[p.which]
            got = flat[_spread(lens, start[p.which])]
            upto = np.concatenate([[0], np.cumsum(lens)])[p.first]  # ids before each text
            wide = self.piece_len[got]
            before = np.concatenate([[0], np.cumsum(wide)])[upto]
            all_ids.append(got.astype(np.int32))
            sizes.append(np.diff(upto))
            all_bytes.append(self.piece_bytes[_spread(wide, self.piece_at[got])])
            lengths.append(np.diff(before))
        at = lambda parts: pa.array(np.concatenate([[0], np.cumsum(np.concatenate(parts))]).astype(np.int32)) if parts else pa.array([0], pa.int32())
        whole = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, dtype=kind)
        ids = pa.ListArray.from_arrays(at(sizes), pa.array(whole(all_ids, np.int32)))
        return ids, pa.Array.from_buffers(pa.binary(), len(texts), [None, at(lengths).buffers()[1], pa.py_buffer(whole(all_bytes, np.uint8))])


def _by_table(splitter, pieces, table, names: list[str], text: str, ids: str, decoded: str):
    """Documents -> with ids and decoded bytes, by the table of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put, words = Assembler(splitter.value, pieces.value), table.value
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            for lo, hi in _slices(texts):
                part = b.slice(lo, hi - lo)
                got = put(["" if t is None else t for t in texts.slice(lo, hi - lo).to_pylist()], words.flat, words.of)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), *got], [*names, ids, decoded])

    return run


def _by_shard(splitter, pieces, names: list[str], text: str, ids: str, decoded: str):
    """The documents and the words of one shard -> documents with ids and decoded bytes."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        place = {w: i for i, w in enumerate(known["word"].to_pylist())}
        lists = known["ids"].combine_chunks()
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)

        def places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            rows = np.array([place[w] for w in words], dtype=np.int64)
            return offsets[rows], offsets[rows + 1] - offsets[rows]

        got = Assembler(splitter.value, pieces.value)(["" if t is None else t for t in docs[text].to_pylist()], flat, places)
        return pa.Table.from_arrays([*(docs[c] for c in names), *got], [*names, ids, decoded])

    return run


def word_hash(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, dtype=np.uint64)


def _packed(kind: str):
    """word, ids -> the word's hash, and the ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            values = np.ascontiguousarray(lists.flatten().to_numpy(), dtype=kind)
            at = (lists.offsets.to_numpy() - lists.offsets[0].as_py()) * values.itemsize
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([pa.array(word_hash(b.column(0).to_pylist()).view(np.int64)), packed], ["h", "ids"])

    return run


class WordTable:
    """The ids of counted distinct words, in the order of the words' hashes (which all differ)."""

    def __init__(self, h: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> None:
        order = np.argsort(h)
        sizes = np.diff(offsets)[order]
        self.h, self.flat = h[order], np.empty(int(sizes.sum()), dtype=flat.dtype)
        self.at = np.zeros(len(h) + 1, dtype=np.uint32)
        np.cumsum(sizes, out=self.at[1:])
        for i in range(0, len(h), STEP_WORDS):  # the places of all ids at once would take many times the table
            j = min(i + STEP_WORDS, len(h))
            self.flat[self.at[i]:self.at[j]] = flat[_spread(sizes[i:j], offsets[order[i:j]])]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word start, and how many they are."""
        place = np.searchsorted(self.h, word_hash(words))
        start = self.at[place].astype(np.int64)
        return start, self.at[place + 1].astype(np.int64) - start


def word_table(known: DataFrame, kind: str) -> WordTable | None:
    """The table of (word, ids); None if two words have one hash. The caller has counted the rows; `kind` is the numpy type that holds every id."""
    got = known.mapInArrow(_packed(kind), "h bigint, ids binary").toArrow()
    if not got.num_rows:
        return WordTable(np.empty(0, dtype=np.uint64), np.empty(0, dtype=kind), np.zeros(1, dtype=np.int64))
    h = got["h"].to_numpy().view(np.uint64)
    offsets = np.zeros(len(h) + 1, dtype=np.int64)
    np.cumsum(pc.binary_length(got["ids"]).to_numpy() // np.dtype(kind).itemsize, out=offsets[1:])
    flat = np.concatenate([_values(c, kind) for c in got["ids"].chunks])
    del got  # its memory is free before the table is laid out
    table = WordTable(h, flat, offsets)
    return None if (table.h[1:] == table.h[:-1]).any() else table


def _values(chunk: pa.Array, kind: str) -> np.ndarray:
    """All bytes of a binary column as numbers, without an object for each row."""
    at = np.frombuffer(chunk.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
    return np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[at[0]:at[-1]].view(kind) if at[-1] > at[0] else np.empty(0, dtype=kind)


def encode_words(words: DataFrame, coder: BytePairs) -> DataFrame:
    """(word, ids) of distinct words (a binary column), each folded once."""
    short = words.filter(F.octet_length("word") <= LONG_WORD).select("word", coder.fold(F.col("word")).alias("ids"))
    shared = words.sparkSession.sparkContext.broadcast((coder.singles, coder.pairs, coder.odd))  # the vocabulary, whatever the input
    return short.unionByName(words.filter(F.octet_length("word") > LONG_WORD).mapInArrow(_long(shared), "word binary, ids array<int>"))


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded", table_words: int = TABLE_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`docs` with the ids of each text and the bytes that these decode to.

    Texts are encoded whole, without special tokens; each match of the pattern is
    merged by itself. Null and empty texts have no ids and decode to no bytes.
    Repeated rows get the same each; an empty table stays empty. Columns of
    `docs` named like `ids` or `decoded` are replaced. A text is put together in
    one task whatever its length. Words over LONG_WORD bytes are merged with a
    heap, in about 2 seconds a million bytes; their ids are the same.
    """
    spark = docs.sparkSession
    coder = BytePairs(load_ranks(ranks_path))
    keep = [c for c in docs.columns if c.lower() not in (ids.lower(), decoded.lower())]
    base = docs.select(*[col(c) for c in dict.fromkeys([*keep, text_col])])
    text = F.coalesce(col(text_col), F.lit("")).alias("text")
    splitter = spark.sparkContext.broadcast(Splitter(pattern))
    lens = np.array([len(p) for p in coder.pieces], dtype=np.int64)
    pieces = spark.sparkContext.broadcast((np.frombuffer(b"".join(coder.pieces), dtype=np.uint8), np.cumsum(lens) - lens, lens))
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{ids}` array<int>", f"`{decoded}` binary"])
    out = (splitter, pieces)

    words = docs.select(F.lit(0).alias("shard"), text).mapInArrow(_words(splitter), "shard int, word binary").select("word").distinct()
    words = stored(words, "distinct-words")
    known = stored(encode_words(words, coder), "word-ids")
    release(words)
    table = word_table(known, "u2" if len(coder.pieces) <= 65_536 else "i4") if known.count() <= table_words else None
    if table is not None:
        return base.mapInArrow(_by_table(*out, spark.sparkContext.broadcast(table), keep, text_col, ids, decoded), schema)
    # Copies of a text go to different shards: the whole row decides.
    (shard,) = fresh(docs, "_shard")
    size = docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    number = F.pmod(F.xxhash64(*[col(f.name) for f in base.schema if "map<" not in f.dataType.simpleString()]), F.lit(shards)).cast("int")
    held = base.select(number.alias("shard"), text).mapInArrow(_words(splitter), "shard int, word binary").distinct()
    right = held.join(known, "word").select(F.col("shard").alias(shard), "word", "ids").groupBy(shard)
    return base.withColumn(shard, number).groupBy(shard).cogroup(right).applyInArrow(_by_shard(*out, keep, text_col, ids, decoded), schema)
