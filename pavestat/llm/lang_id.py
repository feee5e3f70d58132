"""Language identification of mixed text.

The script of a word narrows the languages it may be in; each word gets a log score per
language from its character n-grams; Viterbi with a switching penalty labels the words,
so a text falls into spans. A text's language is the one with most letters. A span's
scores, summed, give how probable its language is against the others; ``score`` is the
share of the text's letters in the language, each counted by that probability, and
``certainty`` the same over the languages of all spans.

The model is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, the least by a
hash of their ids). Viterbi runs over all texts of a batch side by side: texts are cut
into chunks, a chunk's best scores from each state to each are found, then chained.

Defined results: null texts and texts without a letter are ``und`` with score 0 and no
spans; without labelled rows all are ``und``; a word in a script no language was seen
in speaks for none and lowers the scores (a text of such words alone has the first
language, with score 0); ties go to the language first in order; rows that repeat are
labelled alike; extra columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import small_batches
from .common import arrow_map, claim, trim
from .shingles import mix

TRAIN_ROWS = 8_192
#: Buckets that n-grams are hashed to, longest n-gram, smoothing, and what a switch costs.
BUCKETS, LONGEST, SMOOTHING, SWITCH = 1 << 17, 4, 0.1, 12.0
#: Share of a language's words that a script must have to count for it; what a word
#: in another script costs.
SCRIPT_SHARE, FOREIGN = 0.001, 30.0
#: Words kept per worker: a bound of memory only.
KEPT = 250_000
#: Words whose n-grams are held at once.
AT_ONCE = 1 << 14
CHUNK = 64
WORD = regex.compile(r"\p{L}+")

#: First code points of script ranges, in order, and the number of the script there.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x40000, "other"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])
_U = np.uint64


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the n-grams of words (with their ends marked): word number and bucket; and
    each word's script by its first letter."""
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(code))  # symbols up to the word's end
    owners, buckets, rolled = [], [], np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        shifted = np.zeros(len(code), np.uint64)
        shifted[: len(code) - n + 1] = code[n - 1 :]
        rolled = mix(rolled + shifted + _U(n))
        fits = left >= n
        owners.append(word[fits])
        buckets.append((rolled[fits] & _U(BUCKETS - 1)).astype(np.int64))
    whole = mix(np.add.reduceat(mix(code + (np.arange(len(code)) - np.repeat(start, size)).astype(np.uint64) * _U(1 << 21)), start))
    owners.append(np.arange(len(words)))
    buckets.append((whole & _U(BUCKETS - 1)).astype(np.int64))
    script = _SCRIPT[np.maximum(np.searchsorted(_STARTS, code[start + 1], "right") - 1, 0)]
    return np.concatenate(owners), np.concatenate(buckets), script


@dataclass
class Model:
    """Languages in order, log probabilities ``(buckets, languages)`` and the scripts
    that each language uses ``(scripts, languages)``."""

    languages: list[str]
    log: np.ndarray
    uses: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores by language, the best 0, and whether a word's script is known."""
        owner, bucket, script = _grams(words)
        out = np.stack([np.bincount(owner, self.log[bucket, k], len(words)) for k in range(len(self.languages))], axis=1)
        uses = self.uses[script]
        out -= np.where(uses, 0.0, FOREIGN)
        out[~uses.any(axis=1)] = 0.0
        return (out - out.max(axis=1, keepdims=True)).astype(np.float32), uses.any(axis=1)


class _Words(dict):
    """Word to row of a growing score table, filled in batches."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.new, self.table = model, [], np.zeros((1 << 12, len(model.languages)), np.float32)
        self.known = np.zeros(1 << 12, bool)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self) > KEPT:
            self.clear()
        out = [np.array(list(map(self.__getitem__, t)), dtype=np.int64) for t in texts]
        if self.new:
            first = len(self) - len(self.new)
            while len(self.table) < len(self):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            for k in range(0, len(self.new), AT_ONCE):
                some = self.new[k : k + AT_ONCE]
                at = slice(first + k, first + k + len(some))
                self.table[at], self.known[at] = self.model.scores(some)
            self.new = []
        return out


_held: dict[str, _Words] = {}


def _cache(model: Model) -> _Words:
    if model.key not in _held:
        _held.clear()
        _held[model.key] = _Words(model)
    return _held[model.key]


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of the words of all texts: ``scores`` has their words one after
    another. A switch between neighbours costs ``penalty``; ties stay, then go first."""
    states, chunks = scores.shape[1], -(-lengths // CHUNK)
    total = int(chunks.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(chunks) - chunks  # of each text
    begin = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), chunks)
    inside = np.arange(total) - first[text]
    base = begin[text] + inside * CHUNK
    held = np.minimum(CHUNK, lengths[text] - inside * CHUNK)
    place = base[:, None] + np.arange(CHUNK)
    live = np.arange(CHUNK) < held[:, None]
    grid = np.where(live[:, :, None], scores[np.where(live, place, 0)], np.float32(0)).astype(np.float64)
    far = np.where(np.eye(states, dtype=bool), 0.0, -np.inf)
    move = np.repeat(far[None], total, axis=0)  # (chunk, from, to)
    for t in range(CHUNK):
        move = grid[:, t, None, :] + np.maximum(move, move.max(axis=2, keepdims=True) - penalty)
    enter = np.zeros((total, states))
    order = [np.flatnonzero(inside == k) for k in range(int(chunks.max()))]
    for a, b in zip(order, order[1:], strict=False):
        enter[b] = (enter[b - 1][:, :, None] + move[b - 1]).max(axis=1)
    back = np.empty((CHUNK, total, states), np.int32)
    value = enter
    for t in range(CHUNK):
        top = value.max(axis=1, keepdims=True) - penalty
        stay = value >= top
        back[t] = np.where(stay, np.arange(states), value.argmax(axis=1)[:, None])
        value = grid[:, t] + np.maximum(value, top)
    label = np.empty((CHUNK, total, states), np.int32)  # by the state a chunk ends in
    state = np.repeat(np.arange(states, dtype=np.int32)[None], total, axis=0)
    for t in range(CHUNK - 1, -1, -1):
        label[t] = state
        state = np.take_along_axis(back[t], state.astype(np.int64), axis=1)
    ends = value.argmax(axis=1)
    for a, b in zip(order[::-1][1:], order[::-1], strict=False):
        ends[b - 1] = state[b, ends[b]]
    best = label[:, np.arange(total), ends].T
    return best[live].astype(np.int64)


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """A model from rows with text and language: those of ``rows`` ids, chosen by hash; rows
    without an id do not teach. Counts go to the driver summed, at most ``BUCKETS`` (and
    the scripts) for each language."""
    known = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    ids = known.select("k").where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(rows)
    sample = known.join(F.broadcast(ids), "k", "left_semi").select("l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lang_id", _held.clear)
        for batch in small_batches(batches):
            by: dict[str, list[str]] = {}
            for lang_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang_, []).extend(WORD.findall(t.lower()))
            for lang_, words in by.items():
                counts = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
                for k in range(0, len(words), AT_ONCE):
                    for count, values in zip(counts, _grams(words[k : k + AT_ONCE])[1:], strict=True):
                        count += np.bincount(values, minlength=len(count))
                for kind, count in enumerate(counts):
                    at = np.flatnonzero(count)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(at)), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(count[at])], names=["l", "kind", "at", "n"])
        trim()

    found = arrow_map(sample, run, "l string, kind int, at long, n long").groupBy("l", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["l"].unique().tolist())
    count, script = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPT_NAMES), len(languages)))
    for k, name in enumerate(languages):
        for table, kind in ((count, 0), (script, 1)):
            own = found[(found["l"] == name) & (found["kind"] == kind)]
            table[own["at"].to_numpy(), k] = own["n"].to_numpy()
    log = np.log((count + SMOOTHING) / (count.sum(axis=0) + SMOOTHING * BUCKETS))
    return Model(languages, log.astype(np.float32), script >= SCRIPT_SHARE * np.maximum(script.sum(axis=0), 1))


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("lang", T.StringType())]))


RESULT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("certainty", T.DoubleType()), T.StructField("spans", SPANS)]


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score``, ``certainty`` and ``spans`` (first and last
    word, counted from 0, and language) at the end."""
    if text in [f.name for f in RESULT]:
        df, text = df.withColumnRenamed(text, "__text"), "__text"
    df = df.drop(*[f.name for f in RESULT])
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *RESULT])
    shared, arrow = df.sparkSession.sparkContext.broadcast(model), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lang_id", _held.clear)
        own = shared.value
        cache, names = _cache(own), own.languages
        for batch in small_batches(batches, 256):
            texts = [WORD.findall((t or "").lower()) if names else [] for t in batch.column(at).to_pylist()]
            n, lengths = len(texts), np.array(list(map(len, texts)), np.int64)
            rows = np.concatenate([np.zeros(0, np.int64), *cache.rows(texts)])
            scores = cache.table[rows] if len(rows) else np.zeros((0, max(len(names), 1)), np.float32)
            label = viterbi(scores, lengths, SWITCH)
            letters = np.fromiter((len(w) for t in texts for w in t), np.float64, len(rows))
            of = np.repeat(np.arange(n), lengths)
            begin = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(label) != 0))) if len(rows) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(rows)))
            sums = np.add.reduceat(scores.astype(np.float64), begin) if len(begin) else np.zeros((0, scores.shape[1]))
            sums = np.exp(sums - sums.max(axis=1, keepdims=True, initial=-np.inf))
            sure = sums[np.arange(len(begin)), label[begin]] / sums.sum(axis=1)
            weight = letters * cache.known[rows] * np.repeat(sure, size)
            by = np.bincount(of * scores.shape[1] + label, letters, n * scores.shape[1]).reshape(n, -1)
            best = by.argmax(axis=1)
            whole = np.maximum(letters_of := np.bincount(of, letters, n), 1)
            told = np.bincount(of, weight * (label == best[of]), n) / whole
            clear = np.bincount(of, weight, n) / whole
            first = np.cumsum(lengths) - lengths
            spans: list[list[dict]] = [[] for _ in texts]
            for t, a, k, z in zip(of[begin].tolist(), (begin - first[of[begin]]).tolist(), size.tolist(), label[begin].tolist(), strict=True):
                spans[t].append({"first": a, "last": a + k - 1, "lang": names[z]})
            pred = [names[b] if any_ else "und" for b, any_ in zip(best.tolist(), (letters_of > 0).tolist(), strict=True)]
            found = [pa.array(pred, pa.string()), pa.array(np.minimum(told, 1.0)), pa.array(np.minimum(clear, 1.0)), pa.array(spans, arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *[f.name for f in RESULT]])
        trim()

    out = arrow_map(df, run, schema)
    return out.drop("__text") if text == "__text" else out
