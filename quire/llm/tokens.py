"""Sizes of whole texts in tokens of a public byte-level tokenizer, exact, and hashed vectors of their pieces.

The tokenizer splits a text into pieces and merges bytes within each piece only, so a text's size is the sum of its
pieces' sizes. Pieces are found for many texts at once by array operations; each different piece is encoded once
per task. A null text has no size, an empty one the size 0.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer splits a text before its merges; the array operations below do the same.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 400_000
DIMENSIONS = 4
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4


def classes() -> np.ndarray:
    """Letter, number, white space or other, for the basic plane."""
    table = np.full(1 << 16, OTHER, dtype=np.int8)
    for i in range(1 << 16):
        c = chr(i)
        k = unicodedata.category(c)
        table[i] = LETTER if k[0] == "L" else NUMBER if k[0] == "N" else BLANK if c.isspace() and not 0x1C <= i <= 0x1F else OTHER
    return table


def class_of(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    kind = table[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        k = unicodedata.category(chr(points[i]))[0]
        kind[i] = LETTER if k == "L" else NUMBER if k == "N" else OTHER
    return kind


def piece_starts(points: np.ndarray, kind: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character; `last` marks the last character of each text."""
    n = len(points)
    first = np.concatenate([[True], last[:-1]])
    before = np.concatenate([[BLANK], kind[:-1]])
    run = first | (kind != before)
    blank = kind == BLANK
    end = last | np.concatenate([kind[1:] != kind[:-1], [True]])  # last of its run
    at_text_end = np.zeros(n, dtype=bool)
    runs = np.flatnonzero(run)
    stop = np.concatenate([runs[1:] - 1, [n - 1]])
    at_text_end[runs] = last[stop]
    run_of = np.cumsum(run) - 1
    open_blank = blank & ~at_text_end[runs[run_of]]  # in white space that a text goes on after
    tail = open_blank & end
    starts = run.copy()
    starts[tail] = True  # the last white space before a word leaves the run
    joins = np.flatnonzero(tail & (points == 32)) + 1
    starts[joins] = False  # and a space joins the word
    # contractions
    quote = np.flatnonzero((points == 39) & starts)
    for suffix in ("s", "t", "re", "ve", "m", "ll", "d"):
        q = quote[quote + len(suffix) < n]
        hit = np.ones(len(q), dtype=bool)
        for k, c in enumerate(suffix, 1):
            hit &= (points[q + k] == ord(c)) & ~last[q + k - 1]
        q = q[hit]
        starts[q + 1] = False
        inner = q + len(suffix)
        more = inner[~last[inner]] + 1
        starts[more[kind[more] == LETTER]] = True
        quote = quote[~np.isin(quote, q)]
    return starts


def spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


class Sizer:
    """Sizes and vectors of texts; keeps the sizes of the pieces it has met."""

    def __init__(self, ranks: str = RANKS):
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.table = classes()
        self.known: dict[int, int] = {}

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens per text, and the projected vector of its pieces, of some texts that are not empty."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        last = np.zeros(len(points), dtype=bool)
        last[ends - 1] = True
        starts = piece_starts(points, class_of(points, self.table), last)
        at = np.flatnonzero(starts)
        place = np.arange(len(points)) - at[np.cumsum(starts) - 1]
        hashes = np.add.reduceat(spread(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), at)
        kinds, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        until = np.concatenate([at[1:], [len(points)]])
        counts = np.empty(len(kinds), dtype=np.int64)
        for i, (h, w) in enumerate(zip(kinds.tolist(), where.tolist())):
            c = self.known.get(h)
            if c is None:
                c = self.known[h] = len(self.encoding.encode_ordinary(joined[at[w] : until[w]]))
                if len(self.known) > 1_000_000:
                    self.known.clear()
            counts[i] = c
        text_at = np.searchsorted(at, ends - sizes)
        tokens = np.add.reduceat(counts[inverse], text_at)
        pieces = np.diff(np.concatenate([text_at, [len(at)]]))
        bits = spread(hashes)
        vector = np.stack([np.add.reduceat(1.0 - 2.0 * ((bits >> np.uint64(40 + d)) & np.uint64(1)), text_at) for d in range(DIMENSIONS)], axis=1)
        return tokens, vector / np.sqrt(np.maximum(pieces, 1))[:, None]


def sized_texts(docs: DataFrame, key: str, text: str, keep: list[str] | None = None, ranks: str = RANKS) -> DataFrame:
    """(key, kept columns, n_tokens, v0..v3) of each row whose key and text are not null; the path of ranks is a parameter."""
    keep = keep or []
    types = dict(docs.dtypes)
    vectors = [f"v{d}" for d in range(DIMENSIONS)]
    schema = ", ".join([f"{c} {types[c]}" for c in [key, *keep]] + ["n_tokens bigint"] + [f"{v} double" for v in vectors])

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizer = Sizer(ranks)
        for batch in batches:
            texts = batch[text].tolist()
            tokens = np.zeros(len(texts), dtype=np.int64)
            vector = np.zeros((len(texts), DIMENSIONS))
            filled = [i for i, t in enumerate(texts) if t]
            at = 0
            while at < len(filled):
                end, chars = at, 0
                while end < len(filled) and (chars == 0 or chars + len(texts[filled[end]]) < CHUNK):
                    chars += len(texts[filled[end]])
                    end += 1
                some = filled[at:end]
                tokens[some], vector[some] = sizer.measure([texts[i] for i in some])
                at = end
            out = {c: batch[c] for c in [key, *keep]} | {"n_tokens": tokens}
            yield pd.DataFrame(out | {v: vector[:, d] for d, v in enumerate(vectors)})

    wanted = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, *keep, text)
    return wanted.mapInPandas(size, schema)
