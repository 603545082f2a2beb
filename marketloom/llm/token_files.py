"""Token-id files: documents as one stream of ids in ascending id order, range-coded in blocks.

A file set is a folder of Parquet files whose rows are blocks. A block holds
BLOCK ids of the stream (the last of a part fewer): a binary with the magic
bytes, the number of ids, their checksum and the range-coded ids (range_coder),
and an index of the documents in it. Parts follow each other in ascending order
of the documents' ids; every block can be read by itself.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import bytelevel, range_coder
from .common import col, text_of
from .token_counts import MEMORY, load_config

MAGIC, BLOCK, LANES, END = b"TRC1", 8192, 512, 0
HEAD = "<4sIII"  # magic, ids, crc32 of the ids, size of the vocabulary
SCHEMA = "part int, block int, n_ids int, data binary, doc_no array<bigint>, doc_id array<{id}>, doc_len array<int>"


class Encoder:
    """Texts to arrays of ids, as the library gives them; each different pre-token is asked once."""

    def __init__(self, config: str, table: bytes | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(config)
        self.special = [a.content for a in self.lib.get_added_tokens_decoder().values()]
        self.table = None if table is None else np.frombuffer(table, dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, starts of each text and the end)."""
        if self.table is None or any(s in x for x in texts for s in self.special):
            each = [np.array(e.ids, dtype=np.int32) for e in self.lib.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([*each, np.empty(0, dtype=np.int32)]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        pre = bytelevel.PreTokens(texts, self.table)
        if len(self.number) > MEMORY:
            self.forget()
        new = [w for w in pre.words if w not in self.number]
        if new:
            got = [e.ids for e in self.lib.encode_batch(new, add_special_tokens=False)]
            for w in new:
                self.number[w] = len(self.number)
            self.flat = np.concatenate([self.flat, np.array([i for g in got for i in g], dtype=np.int32)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(g) for g in got])])
        word = np.array([self.number[w] for w in pre.words], dtype=np.int64)[pre.which] if len(pre.which) else np.empty(0, dtype=np.int64)
        size = self.start[word + 1] - self.start[word] if len(word) else np.empty(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(self.start[word], size)
        return self.flat[place], ends[pre.first]


def _write(config: str, table: bytes | None, vocab: int, end: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = Encoder(config, table), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []  # not yet written
        docs: list[tuple[int, object, int]] = []  # (number, id, ids left) of the documents in them
        held, number, block = 0, 0, 0

        def flush(every: bool) -> pa.RecordBatch:
            nonlocal ids, docs, held, block
            stream = np.concatenate([*ids, np.empty(0, dtype=np.int32)])
            cut = len(stream) if every else len(stream) // BLOCK * BLOCK
            blocks = [stream[i:min(i + BLOCK, cut)] for i in range(0, cut, BLOCK)]
            ids, held = [stream[cut:]], len(stream) - cut
            coded = range_coder.encode(blocks, vocab)
            rows: dict[str, list] = {k: [] for k in ("part", "block", "n_ids", "data", "doc_no", "doc_id", "doc_len")}
            k = 0
            for b, c in zip(blocks, coded, strict=True):
                nos, names, lens, left = [], [], [], len(b)
                while left:
                    no, name, n = docs[k]
                    take = min(n, left)
                    nos.append(no)
                    names.append(name)
                    lens.append(take)
                    left -= take
                    docs[k] = (no, name, n - take)
                    k += take == n
                for key, v in zip(rows, (part, block, len(b), struct.pack(HEAD, MAGIC, len(b), zlib.crc32(b.astype("<u4").tobytes()), vocab) + c, nos, names, lens), strict=True):
                    rows[key].append(v)
                block += 1
            docs = docs[k:]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(id_type), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))

        for b in batches:
            names, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
            for i, j in bytelevel.steps(texts):
                flat, starts = enc.encode(texts[i:j])
                # The end id behind every document.
                whole = np.full(len(flat) + j - i, end, dtype=np.int32)
                shift = np.repeat(np.arange(j - i), np.diff(starts))
                whole[np.arange(len(flat)) + shift] = flat
                ids.append(whole)
                held += len(whole)
                for name, n in zip(names[i:j], np.diff(starts).tolist(), strict=True):
                    docs.append((number, name, n + 1))
                    number += 1
                if held >= BLOCK * LANES:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Write the ids of all texts, in ascending order of the documents' ids, with `end` after each, to the folder `path`.

    Null and empty texts are the end id alone. Null ids come first; rows that
    repeat an id are all written, ordered by a hash of their text. Without rows a
    folder without blocks is written.
    """
    from tokenizers import Tokenizer

    config = load_config(tokenizer_json)
    t = Tokenizer.from_str(config)
    table = bytelevel.class_table(t.pre_tokenizer) if bytelevel.is_plain(config) else None
    rows = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    run = _write(config, table, t.get_vocab_size(with_added_tokens=True), end, to_arrow_type(id_type))
    ordered.mapInArrow(run, SCHEMA.format(id=id_type.simpleString())).write.parquet(path)


def read_block(data: bytes) -> tuple[int, int, int, bytes]:
    magic, n, crc, vocab = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    return n, crc, vocab, data[struct.calcsize(HEAD):]


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """The ids of blocks; an error if one does not hold what its checksum says."""
    heads = [read_block(d) for d in data]
    out: list[np.ndarray] = []
    for i in range(0, len(heads), LANES):
        part = heads[i:i + LANES]
        out += range_coder.decode([h[3] for h in part], [h[0] for h in part], part[0][2])
    for ids, (_, crc, _, _) in zip(out, heads, strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of token ids is damaged")
    return out


def crc32_join(one: int, two: int, size: int) -> int:
    """The crc32 of two byte strings after each other, from those of both and the second one's size."""
    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, x) for x in step]
    while size:
        if size & 1:
            one = times(step, one)
        step = [times(step, x) for x in step]
        size >>= 1
    return one ^ two


def _pieces(id_type: pa.DataType):
    """For every document in a block: its number, id, place in the part, ids and their crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []

        def done() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(6)]
            for r, ids in zip(waiting, decode_blocks([r["data"] for r in waiting]), strict=True):
                raw, at = ids.astype("<u4"), 0
                for no, name, n in zip(r["doc_no"], r["doc_id"], r["doc_len"], strict=True):
                    for c, v in zip(cols, (r["part"], no, name, r["block"] * BLOCK + at, n, zlib.crc32(raw[at:at + n].tobytes())), strict=True):
                        c.append(v)
                    at += n
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "doc_no", "id", "at", "n", "crc"])

        for b in batches:
            for r in b.to_pylist():
                waiting.append(r)
                if len(waiting) == LANES:
                    yield done()
        if waiting:
            yield done()

    return run


@F.pandas_udf(LongType())
def _joined(pieces: pd.Series) -> pd.Series:
    out = []
    for p in pieces:
        crc = p[0]["crc"]
        for q in p[1:]:
            crc = crc32_join(crc, q["crc"], 4 * q["n"])
        out.append(crc)
    return pd.Series(out, dtype="int64")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone.

    All blocks are decoded and checked. `start` counts the ids of all documents
    before it, `n_tokens` its own with the end id.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = spark.read.parquet(path)
    id_type = blocks.schema["doc_id"].dataType.elementType
    pieces = blocks.mapInArrow(_pieces(to_arrow_type(id_type)), f"part int, doc_no bigint, id {id_type.simpleString()}, at bigint, n bigint, crc bigint")
    docs = pieces.groupBy("part", "doc_no").agg(F.min("id").alias("id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("p"))
    crc = F.when(F.size("p") == 1, F.col("p")[0]["crc"]).otherwise(_joined("p"))
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row for each part: as many as the writing stage had tasks
    earlier = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(earlier), "part").select("id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), crc.alias("ids_crc32"))
