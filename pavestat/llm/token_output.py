"""Token-id output: word-aligned Simple-8b segments in ascending document order.

``encode_words`` gives ids by the tokenizers library, ``write`` stores them,
``read`` gives documents back with their running starts.

The file format: Spark part files in the shared folder (so that a commit is atomic and
lost executors are survived) whose rows are segments. A segment's ``payload`` is one
self-describing little-endian binary: the header ``HEADER``; then the documents' ids
(int64), null marks (uint8) and lengths (uint32); the blocks' word offsets (uint32)
and escape marks (uint8); the Simple-8b words (uint64); last a crc32 of all before it.
Documents are whole within a segment; a segment closes once it holds ``SEGMENT_IDS``.

Defined results: a null text is an empty document, which still gets its end id; a null
``doc_id`` sorts first and is read back as null; repeated ids are written side by side
in the order of a hash of their texts, then of the texts; extra columns are not stored; an empty table reads back
as an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category, is_normalized, normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .bpe import KEPT_CHARS, SPACE, small_batches
from .common import arrow_map, claim, input_bytes, new_path
from .shingles import lanes_of, words_at

MAGIC = b"S8B1"
#: magic, documents, ids, blocks, words
HEADER = struct.Struct("<4sIQIQ")
SEGMENT_IDS = 1 << 18
#: Bytes of stored input for each task that encodes.
TASK_BYTES = 64 << 20
#: Slots of the word table and pieces kept per worker: bounds of memory only.
SLOTS, KEPT_PIECES = 1 << 22, 500_000
#: Bytes that are looked up at once: a word takes two, so that half the slots hold them.
PART_BYTES = SLOTS
#: Bytes between words for the table; other white space is left to ``CUT``.
BREAK = np.zeros(256, bool)
BREAK[[10, 32]] = True
#: How the word vocabulary cuts normalised text.
CUT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")


class WordIds:
    """A table from words to ids in front of a tokenizer of the library whose pieces are
    coded one by one: NFC, lower case, ``CUT``, white space dropped. Only pieces not met
    before go to the library, already normalised and cut.

    The table is of numpy arrays, with open addressing by a 64-bit hash of the word. A
    slot also has the word's length and bytes, in lanes of eight, and holds only if all of
    them agree: a word whose hash is that of another goes to the library by itself. No
    Python object is made of a word that is known.

    Texts with a symbol that Python's Unicode tables do not know go to the library whole,
    as its tables may be of another version.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.library, self.model):
            t.no_truncation()
            t.no_padding()
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        self.assigned: set[str] = set()
        self.clear()

    def clear(self) -> None:
        self.words, self.filled = 0, 0
        self.key, self.head = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.begin, self.size = np.zeros(SLOTS, np.int32), np.full(SLOTS, -1, np.int32)
        # bytes of each word, and where the lanes after its first one are
        self.length, self.rest = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int64)
        self.pool, self.lanes, self.laned = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.uint64), 0

    def normal(self, text: str) -> str | None:
        """None: the text holds a special token's string, or a symbol of unknown kind, and
        goes to the library whole."""
        if any(s in text for s in self.special):
            return None
        if not text.isascii():
            new = set(text).difference(self.assigned)
            if any(category(c) == "Cn" for c in new):
                return None
            self.assigned |= new
            if not is_normalized("NFC", text):
                text = normalize("NFC", text)
            text = text.replace("Σ", "σ")  # by itself: lower() minds the word's end
        return text.lower()

    def code(self, words: list[str]) -> list[bytes]:
        """Ids of whole words, by their pieces."""
        cut = [CUT.findall(w) for w in words]
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        new = list(set().union(*cut).difference(self.pieces))
        coded = self.model.encode_batch_fast(new, add_special_tokens=False)
        self.pieces.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(new, coded, strict=True))
        get = self.pieces.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for p in new:
            if len(p) > KEPT_CHARS:
                del self.pieces[p]
        return out

    def _slots(self, key: np.ndarray, head: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each word's slot: its own, or the free one where it belongs. Words agree here by
        hash, first eight bytes and length."""
        slot = (key >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        open_ = np.arange(len(key))
        while True:
            s = slot[open_]
            other = (self.size[s] >= 0) & ((self.key[s] != key[open_]) | (self.head[s] != head[open_]) | (self.length[s] != length[open_]))
            open_ = open_[other]
            if not len(open_):
                return slot
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)

    def _pooled(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids into the pool: where they begin, and how many they are."""
        size = np.array([len(x) // 4 for x in ids], np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        begin = self.filled + np.cumsum(size) - size
        self.filled += len(flat)
        return begin, size

    def _learn(self, key: np.ndarray, head: np.ndarray, length: np.ndarray, lanes: np.ndarray, words: list[str]) -> None:
        """Different words into the table, which has room for them. ``lanes`` has those
        after the first of each word, one word after another."""
        begin, size = self._pooled(self.code(words))
        more = np.maximum((length + 7) // 8 - 1, 0)
        while self.laned + len(lanes) > len(self.lanes):
            self.lanes = np.concatenate([self.lanes, np.zeros_like(self.lanes)])
        self.lanes[self.laned : self.laned + len(lanes)] = lanes
        place = self.laned + np.cumsum(more) - more
        self.laned += len(lanes)
        self.words += len(words)
        rest = np.arange(len(key))
        while len(rest):  # words that meet in one free slot: the first takes it
            slot = self._slots(key[rest], head[rest], length[rest])
            _, first = np.unique(slot, return_index=True)
            now, at = rest[first], slot[first]
            self.key[at], self.head[at], self.length[at], self.rest[at] = key[now], head[now], length[now], place[now]
            self.begin[at], self.size[at] = begin[now], size[now]
            rest = np.delete(rest, first)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of whole texts. Normalised texts go to the table in
        parts of ``PART_BYTES``, a longer text in several of its own, cut at breaks."""
        out: list[list[bytes]] = [[] for _ in texts]
        part: list[tuple[int, bytes]] = []
        room = PART_BYTES

        def coded() -> None:
            nonlocal room
            for (k, _), ids in zip(part, self._encode([x for _, x in part]), strict=True):
                out[k].append(ids)
            part.clear()
            room = PART_BYTES

        for k, text in enumerate(texts):
            normal = self.normal(text)
            if normal is None:
                out[k].append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            raw, at = normal.encode(), 0
            while at < len(raw):
                end = len(raw)
                if end - at > PART_BYTES:  # at the last break, or the next one after a word as long
                    end = 1 + max(raw.rfind(b" ", at, at + PART_BYTES), raw.rfind(b"\n", at, at + PART_BYTES))
                    if not end:
                        found = [x for x in (raw.find(b" ", at + PART_BYTES), raw.find(b"\n", at + PART_BYTES)) if x >= 0]
                        end = 1 + min(found) if found else len(raw)
                if part and end - at >= room:
                    coded()
                part.append((k, raw[at:end]))
                room -= end - at + 1  # and the break after it
                at = end
        if part:
            coded()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _encode(self, raw: list[bytes]) -> list[bytes]:
        """Ids of normalised texts of at most ``PART_BYTES`` together, or of one word."""
        length = np.array([len(x) + 1 for x in raw])
        data = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(8), np.uint8)
        starts = np.cumsum(length) - length
        text = data[:-8]
        key, first, begins = words_at(text, starts, BREAK)
        counts = np.zeros(len(raw), np.int64)
        flat = np.zeros(0, "<u4")
        if len(key):
            # ends: the next break; the text ends with one
            breaks = np.flatnonzero(BREAK[text])
            ends = breaks[np.searchsorted(breaks, begins)]
            length = ends - begins
            lanes, place, lane = lanes_of(data, begins, length)
            head, later = lanes[lane], place > 0
            if self.words + len(key) > SLOTS // 2:
                self.clear()
            slot = self._slots(key, head, length)
            new = np.flatnonzero(self.size[slot] < 0)
            buffer = text.tobytes()

            def spelled(some: np.ndarray) -> list[str]:
                return [buffer[a:b].decode() for a, b in zip(begins[some].tolist(), ends[some].tolist(), strict=True)]

            if len(new):
                _, one = np.unique(np.stack([key[new], head[new], length[new].astype(np.uint64)]), axis=1, return_index=True)
                once = np.sort(new[one])
                own = np.zeros(len(key), bool)
                own[once] = True
                self._learn(key[once], head[once], length[once], lanes[later & np.repeat(own, (length + 7) >> 3)], spelled(once))
                slot[new] = self._slots(key[new], head[new], length[new])
            begin, size = self.begin[slot].astype(np.int64), self.size[slot].astype(np.int64)
            word = np.repeat(np.arange(len(key)), (length + 7) >> 3)[later]
            differ = np.unique(word[self.lanes[self.rest[slot[word]] + place[later] - 1] != lanes[later]])
            if len(differ):  # another word of the same hash is in the slot
                begin[differ], size[differ] = self._pooled(self.code(spelled(differ)))
            total = np.concatenate([[0], np.cumsum(size)])
            flat = self.pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
            counts = total[first[1:]] - total[first[:-1]]
        stored, ends = flat.tobytes(), np.cumsum(counts).tolist()
        return [stored[4 * (e - n) : 4 * e] for e, n in zip(ends, counts.tolist(), strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pack_segment(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offset, escaped = simple8b.encode(ids)
    body = b"".join(
        [
            HEADER.pack(MAGIC, len(docs), len(ids), len(offset), len(words)),
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            np.array([d is None for d in docs], "u1").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            offset.astype("<u4").tobytes(),
            escaped.astype("u1").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids; a damaged segment raises."""
    body = memoryview(payload)[:-4]
    if zlib.crc32(body) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("segment checksum differs")
    magic, n_docs, n_ids, n_blocks, n_words = HEADER.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at, found = HEADER.size, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_blocks), ("u1", n_blocks), ("<u8", n_words)):
        found.append(np.frombuffer(body, kind, n, at))
        at += found[-1].nbytes
    if at != len(body):
        raise ValueError("segment length differs from its header")
    docs, null, lengths, offset, escaped, words = found
    ids = simple8b.decode(words.astype(np.uint64), offset, escaped.astype(bool), n_ids)
    return [None if z else int(d) for d, z in zip(docs, null, strict=True)], lengths, ids


def write(df: DataFrame, path: str, vocabulary: str, end_id: int, partitions: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Documents, range-partitioned and sorted by id, encoded and written to ``path``.
    ``part`` is a segment's partition and ``before`` the ids of that partition before it.
    Without ``partitions`` their number comes from the bytes that are read. An id that
    many rows have is cut by a hash of their texts."""
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // TASK_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_output", word_ids.cache_clear)
        part, before, coder = TaskContext.get().partitionId(), 0, word_ids(vocabulary)
        docs: list[int | None] = []
        parts: list[bytes] = []

        def segment() -> pa.RecordBatch:
            nonlocal before
            lengths = [len(x) // 4 for x in parts]
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = {"part": [part], "before": [before], "n_ids": [len(ids)], "payload": [pack_segment(docs, lengths, ids)]}
            before += len(ids)
            docs.clear()
            parts.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        held = 0
        for batch in small_batches(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                docs.append(doc)
                parts.append(ids + end)
                held += len(parts[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield segment()
                    held = 0
        if docs:
            yield segment()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    # Payloads are packed already; Parquet need not compress them again.
    arrow_map(ordered, run, "part int, before long, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids``; ``start`` counts the ids of all documents
    before. To the driver goes one count per partition, no more."""
    stored = spark.read.schema("part int, before long, n_ids long, payload binary").parquet(path)
    totals = sorted((r[0], r[1]) for r in stored.groupBy("part").agg(F.sum("n_ids")).collect())
    base, total = {}, 0
    for part, n in totals:
        base[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            for part, before, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, lengths, ids = unpack_segment(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = pa.py_buffer(ids.astype("<u4"))
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype("<i4"))
                column = pa.Array.from_buffers(pa.binary(), len(docs), [None, offsets, raw])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(base[part] + before + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), column],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return arrow_map(stored.select("part", "before", "payload"), run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(df: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Written to the shared folder and read back."""
    path = new_path(df.sparkSession, "tokens")
    write(df, path, vocabulary, end_id)
    return read(df.sparkSession, path)
