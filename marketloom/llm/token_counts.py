"""Token counts with the whole-token shortcut.

Offline, each string of the vocabulary is encoded alone, and those that come out
as one token are proven: a pre-token equal to one of them is one token, since
merging never looks beyond a pre-token. Such pre-tokens are counted at once; only
the others are merged, each different one once in a task's memory.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytelevel
from .common import col, text_of

#: Different pre-tokens that a task remembers, beside the proven ones.
MEMORY = 400_000


def load_config(path: str) -> str:
    """The tokenizer.json as text, read on the driver and sent with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def whole_tokens(tokenizer) -> list[str]:
    """The vocabulary's strings that the library encodes, alone, as one token."""
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    texts = [t for t in texts if t and "�" not in t]
    return [t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1]


def _counter(config: str, proven: list[str], table: bytes | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(config)
        special = [a.content for a in t.get_added_tokens_decoder().values()]
        classes = None if table is None else np.frombuffer(table, dtype=np.uint8)
        base = dict.fromkeys(proven, 1)
        known = dict(base)
        for b in batches:
            texts = list(b["text"])
            counts = np.zeros(len(texts), dtype=np.int64)
            # Texts with the string of an added token are left to the library, which cuts them there.
            asked = [i for i, x in enumerate(texts) if classes is None or any(s in x for s in special)]
            for i in asked:
                counts[i] = len(t.encode(texts[i], add_special_tokens=False).ids)
                texts[i] = ""
            for i, j in bytelevel.steps(texts) if classes is not None else ():
                pre = bytelevel.PreTokens(texts[i:j], classes)
                new = [w for w in pre.words if w not in known]
                if len(known) + len(new) > len(base) + MEMORY:
                    known = dict(base)
                    new = [w for w in pre.words if w not in known]
                for w, e in zip(new, t.encode_batch(new, add_special_tokens=False), strict=True):
                    known[w] = len(e.ids)
                each = np.array([known[w] for w in pre.words], dtype=np.int64)
                total = np.concatenate([[0], np.cumsum(each[pre.which])])
                counts[i:j] += total[pre.first[1:]] - total[pre.first[:-1]]
            yield pd.DataFrame({"id": b["id"], "n_bytes": b["n_bytes"], "n_tokens": counts})

    return run


def count_tokens(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row: the library's count for the whole text.

    Nothing is added, cut off or padded; the strings of added tokens are found
    inside texts as the library finds them. Null and empty texts have 0 bytes and
    0 tokens. Repeated rows and null ids are counted one by one. An empty table
    gives an empty result.
    """
    from tokenizers import Tokenizer

    config = load_config(tokenizer_json)
    t = Tokenizer.from_str(config)
    plain = bytelevel.is_plain(config)
    text = text_of(text_col)
    base = docs.select(col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    run = _counter(config, whole_tokens(t) if plain else [], bytelevel.class_table(t.pre_tokenizer) if plain else None)
    out = base.mapInPandas(run, f"id {base.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
