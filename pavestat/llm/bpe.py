"""Byte-level BPE by a priority queue of merge ranks over a doubly linked symbol list.

``encode`` and ``decode`` are DataFrame operators; ``ByteBpe`` is the tokenizer.

Defined results: a null text encodes like the empty one (no ids); a text that holds
the string of a special token gets that token's id there, as the tokenizers library
does it; repeated rows repeat; further columns pass through untouched; an empty table
gives an empty table. Ids are a binary column of little-endian unsigned 32-bit
integers, which costs four bytes an id and needs no per-id objects.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, claim, trim

#: White space as the Unicode property has it; ``\s`` of Python's engines has more.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: How byte-level BPE cuts a text before merging.
CUT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Pieces kept per worker, and the longest piece that is kept: bounds of memory only.
KEPT, KEPT_CHARS = 350_000, 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: Latin-1's visible characters stand for
    themselves, the others get the code points from 256 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class ByteBpe(dict):
    """A cache from piece to encoded ids that fills itself by merging."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        back = {s: bytes([b]) for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
            self.rank[vocab[a] << 32 | vocab[b]] = k
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = b"".join(back[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: pop the lowest rank (leftmost on ties); an entry is stale
        when its two symbols are no longer the neighbours it was pushed for."""
        symbol = [self.first[b] for b in piece]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, left, right, made = self.rank.get, self.left, self.right, self.made
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbol[i] != left[r] or symbol[j] != right[r]:
                continue
            symbol[i], symbol[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank(symbol[i] << 32 | symbol[k])) is not None:
                    heapq.heappush(queue, q << 32 | i)
            h = before[i]
            if h >= 0 and (q := rank(symbol[h] << 32 | symbol[i])) is not None:
                heapq.heappush(queue, q << 32 | h)
        return [s for s in symbol if s >= 0]

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if self.split is not None and self.split.search(text):
            out = []
            for k, part in enumerate(self.split.split(text)):
                if k % 2:
                    out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                else:
                    out.extend(map(self.__getitem__, CUT.findall(part)))
            return b"".join(out)
        return b"".join(map(self.__getitem__, CUT.findall(text)))

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, joined; bytes that are no UTF-8 become
        replacement characters, as in the library."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One tokenizer per worker and vocabulary file; the path must exist on executors."""
    return ByteBpe(path)


def _with(batch: pa.RecordBatch, at: int, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with column ``at`` replaced by ``columns``."""
    arrays, names = list(batch.columns), list(batch.schema.names)
    arrays[at : at + 1], names[at : at + 1] = columns.values(), columns.keys()
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _replaced(df: DataFrame, column: str, fields: list[T.StructField]) -> tuple[DataFrame, int, T.StructType]:
    """``df`` without columns that are named like ``fields``, the place of ``column`` in it, and
    its schema with ``fields`` there."""
    df = df.drop(*({f.name for f in fields} - {column}))
    at = df.columns.index(column)
    kept = list(df.schema.fields)
    return df, at, T.StructType(kept[:at] + fields + kept[at + 1 :])


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def encode(df: DataFrame, path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``text`` replaced by ``ids`` (binary) and ``n_tokens`` (long), and, with a name for
    ``decoded``, by what these ids decode to: in the same worker, as two chained Python
    steps would keep twice as many workers. Other columns of these names give way."""
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decoded is not None:
        fields.append(T.StructField(decoded, T.StringType()))
    df, at, schema = _replaced(df, text, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for batch in small_batches(batches):
            ids = [bpe.encode(x or "") for x in batch.column(at).to_pylist()]
            more = {} if decoded is None else {decoded: pa.array([bpe.decode(x) for x in ids], pa.string())}
            yield _with(batch, at, ids=pa.array(ids, pa.binary()), n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()), **more)
        trim()

    return arrow_map(df, run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``ids`` replaced by the decoded ``text``; null ids decode to a null text. Another
    column ``text`` gives way."""
    df, at, schema = _replaced(df, ids, [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for batch in small_batches(batches):
            texts = [None if x is None else bpe.decode(x) for x in batch.column(at).to_pylist()]
            yield _with(batch, at, text=pa.array(texts, pa.string()))
        trim()

    return arrow_map(df, run, schema)
