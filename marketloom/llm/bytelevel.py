"""Byte-level pre-tokens of many texts at once (numpy), for tokenizers of the tokenizers library.

The code points of a batch are classed as letter, number, white space or other
by a table that the library's own pre-tokenizer fills, and token borders follow
from the classes: runs of one class; a single space joins the token behind it;
the last of several white-space characters stands alone or joins likewise; an
apostrophe with s, t, m, d, re, ve or ll is a token of its own. Each different
token of a batch is then looked at once.
"""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Fixed value: the public pattern that the classes below stand for.
PUBLIC_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that one numpy step works on.
STEP = 1_500_000


def is_plain(config: str) -> bool:
    """Whether the fast path holds for this tokenizer.json; other tokenizers are asked text by text."""
    c = json.loads(config)
    pre, model = c.get("pre_tokenizer") or {}, c["model"]
    pre_ok = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    model_ok = model.get("type") == "BPE" and not model.get("dropout") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return bool(pre_ok and model_ok and not c.get("normalizer") and not c.get("truncation") and not c.get("padding"))


def class_table(pre_tokenizer) -> bytes:
    """One class for each code point, asked from the library: about a megabyte whatever the input."""
    table = bytearray(0x110000)
    size = lambda s: len(pre_tokenizer.pre_tokenize_str(s))
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        table[c] = OTHER if size("!" + ch) == 1 else LETTER if size("a" + ch) == 1 else NUMBER if size("1" + ch) == 1 else SPACE
    return bytes(table)


def pattern_classes(pattern: str) -> bytes | None:
    """The class table for the public pattern, as tiktoken's own regular expressions have the classes; None for other patterns."""
    if pattern != PUBLIC_PATTERN:
        return None
    import tiktoken

    table = bytearray(0x110000)
    for cls, kind in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        # What the pattern does not match is left out, so the bytes that come back are those of the class.
        one = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for low in range(0, 0x110000, 0x4000):
            for ch in bytes(one.encode_ordinary("".join(chr(c) for c in range(low, low + 0x4000) if not 0xD800 <= c < 0xE000))).decode():
                table[ord(ch)] = cls
    return bytes(table)


def token_starts(cps: np.ndarray, text_starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sorted places where tokens begin. `text_starts` are the places where (non-empty) texts begin."""
    n = len(cps)
    cls = table[cps]
    opens = np.zeros(n + 1, dtype=bool)  # a text begins here
    opens[text_starts] = True
    opens[n] = True
    start = opens.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    # The last white space before another class in the same text.
    last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~opens[1:n])
    start[last] = True
    start[last[cps[last] == 32] + 1] = False
    p = np.flatnonzero((cps == 39) & start[:n])
    p = p[p + 1 < n]
    p = p[~opens[p + 1] & (cls[p + 1] == LETTER)]
    if len(p):
        c1, c2 = cps[p + 1], cps[np.minimum(p + 2, n - 1)]
        two = (p + 2 < n) & ~opens[np.minimum(p + 2, n)] & (((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108))
        one = (c1 == 115) | (c1 == 116) | (c1 == 109) | (c1 == 100)
        start[p[one | two] + 1] = False
        start[p[one] + 2] = True
        start[p[two & ~one] + 3] = True
    return np.flatnonzero(start[:n])


class PreTokens:
    """The different pre-tokens of a batch of texts, and which of them stands where."""

    def __init__(self, texts: list[str], table: np.ndarray) -> None:
        joined = "".join(texts)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(lens)])
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = token_starts(cps, begin[:-1][lens > 0], table) if len(cps) else np.empty(0, dtype=np.int64)
        #: Tokens of text i are at first[i] to first[i + 1].
        self.first = np.searchsorted(starts, begin)
        if not len(starts):
            self.raw_words, self.which = [], np.empty(0, dtype=np.int64)
            return
        raw = joined.encode("utf-8", "surrogatepass")
        at = starts
        if len(raw) > len(cps):  # bytes before each character
            wide = (cps >= 0x80).astype(np.int32)
            wide += cps >= 0x800
            wide += cps >= 0x10000
            at = starts + np.concatenate([[0], np.cumsum(wide)])[starts]
        offsets = np.append(at, len(raw)).astype(np.int64)
        tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        self.which = tokens.indices.to_numpy()
        #: The different tokens as UTF-8.
        self.raw_words: list[bytes] = tokens.dictionary.to_pylist()

    @cached_property
    def words(self) -> list[str]:
        return [w.decode("utf-8", "surrogatepass") for w in self.raw_words]


class PatternTokens:
    """As `PreTokens`, for any pattern: the regex module finds the matches text by text."""

    def __init__(self, texts: list[str], pattern: str) -> None:
        import regex

        seen: dict[str, int] = {}
        found = [[seen.setdefault(m.group(), len(seen)) for m in regex.finditer(pattern, t) if m.group()] for t in texts]
        self.words = list(seen)
        self.raw_words = [w.encode() for w in seen]
        self.which = np.array([w for one in found for w in one], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(one) for one in found])]).astype(np.int64)


def steps(texts: list[str]):
    """Slices (from, to) of at most STEP characters together, or of one longer text."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= STEP):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j
