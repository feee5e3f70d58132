"""Exact top-k search by BM25: an inverted index in parts of like documents, pruned and
scored by parts in each shard, merged exactly under global statistics.

The index is written once, a row per shard of ``SHARD_BYTES`` of text: its terms in order,
where the postings of each begin, their documents and counts, ids and lengths. Queries are
gathered in groups of bounded number and bytes, equal texts once; each group is sent to the
shards, and every task carries its best answers on from shard to shard. Global counts
(documents, words, documents per term) come from the shards, so that a score does not depend
on the sharding. Impacts are whole numbers (``SCALE`` to one, 1 at least), so sums are exact
in any order and ties are true ties.

In a shard, documents are ordered by likeness of their frequent terms (languages, mostly) and
by length, and cut into parts; queries are ordered alike and taken in batches. A query leaves
out a part whose bound, the sum over its terms of the part's largest impact, is under its k-th
best score so far. The other scores of a batch and a part are one product of matrices in
float32 over the terms that many of both hold, and sums over the postings of the others; what
a term costs either way decides where it goes. As float32 errs by a known share at most,
whatever could reach the k-th best score is found and summed anew in whole numbers. Likeness
bears on cost only.

Defined results: null and empty texts match nothing and find nothing; a query finds
documents that share a term, itself included; equal scores are ranked by id; of rows
that repeat a query's id the least text asks, and rows that repeat a document's id are
one answer, with the best score; rows with a null id are not answers, though they count
in the statistics; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import arrow_map, claim, input_bytes, text_or_empty, trim, written
from .license_scan import _PLAIN
from .shingles import _words

K1, B, SCALE = 1.2, 0.75, 1 << 20
SHARD_BYTES, SHARD_DOCS = 32 << 20, 12288
#: Queries of a batch; postings summed at once; cells of a part's rows for the product.
BATCH, PAIRS, CELLS = 256, 1 << 16, 4 << 20
#: A posting costs as much as so many cells of the product; a row for it is kept for terms in
#: one of ``DENSE`` documents of the part or more.
POSTING, DENSE = 200, 256
#: Kinds of like documents, terms that tell them apart, and the fewest documents of a part.
KINDS, TELLING, PART_DOCS = 8, 512, 512
_NONE = np.iinfo(np.int64).max
#: Bytes of text that are cut into terms at once.
AT_ONCE = 1 << 20
#: Queries of a group, and bytes of their texts: a bound on what is broadcast.
QUERIES, QUERY_BYTES = 8192, 16 << 20
#: Bytes of stored input for a task that searches.
TASK_BYTES = 512 << 20


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_terms``, over about ``AT_ONCE`` bytes of text at a time."""
    out, first, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE or k + 1 == len(texts):
            doc, *rest = _terms(texts[first : k + 1])
            out.append((doc + first, *rest))
            first, size = k + 1, 0
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none.astype(np.uint64), none, none)


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, term and count for each term of each text, and text lengths in
    words. Words are runs of ASCII letters, digits and non-ASCII characters."""
    size = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.cumsum(size) - size
    words, first = _words(np.where(_PLAIN[data], np.uint8(32), data), starts)
    length = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), length)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        words[a:b].sort()
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (words[1:] != words[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[new], words[new], np.diff(np.append(new, len(doc))), length


def kinds(doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """A kind for each of ``n`` documents, by the frequent ones among its (numbered) terms."""
    df = np.bincount(term) if len(term) else np.zeros(1, np.int64)
    telling = np.argsort(-df, kind="stable")[:TELLING]
    telling = telling[(df[telling] * 16 >= n) & (df[telling] < n)]
    if n < 2 or not len(telling):
        return np.zeros(n, np.int64)
    row = np.full(len(df), -1)
    row[telling] = np.arange(len(telling))
    pick = row[term] >= 0
    x = np.zeros((n, len(telling)), np.float32)
    x[doc[pick], row[term[pick]]] = np.log(n / df[term[pick]])
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    # centres are documents of a few, each the one that brings most documents nearer
    like = x @ x[np.random.default_rng(0).choice(n, min(n, 64), replace=False)].T
    near, chosen = np.zeros(n, np.float32), []
    while len(chosen) < KINDS:
        gain = np.maximum(like - near[:, None], 0).sum(axis=0)
        if gain.max() < 0.02 * n:
            break
        chosen.append(int(gain.argmax()))
        near = np.maximum(near, like[:, chosen[-1]])
    if len(chosen) < 2:
        return np.zeros(n, np.int64)
    kind = like[:, chosen].argmax(axis=1)
    for _ in range(3):
        centre = np.stack([x[kind == c].sum(axis=0) for c in range(len(chosen))])
        centre /= np.maximum(np.sqrt((centre * centre).sum(axis=1, keepdims=True)), 1e-9)
        kind = (x @ centre.T).argmax(axis=1)
    return kind


def _parts(kind: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents by kind and length, and where parts begin, with their number at the end:
    a kind each, and lengths of about the same size if that leaves enough documents."""
    order = np.lexsort((length, kind))
    kind, size = kind[order], np.log2(length[order] + 1).astype(np.int64) // 2
    new = np.flatnonzero((kind[1:] != kind[:-1]) | (size[1:] != size[:-1])) + 1
    begins = [0]
    for k in new.tolist():
        if kind[k] != kind[k - 1] or k - begins[-1] >= PART_DOCS:
            begins.append(k)
    return order, np.array([*begins, len(order)] if len(order) else [0])


#: A shard: ids, which of them are null, lengths, where parts begin; terms, where their postings
#: begin; documents and counts of the postings. All little-endian.
SHARD = "ids binary, known binary, lengths binary, parts binary, terms binary, begins binary, docs binary, counts binary"


class Shard:
    """The arrays of a row of the index."""

    def __init__(self, row: dict[str, bytes]) -> None:
        kinds = {"ids": "<i8", "known": "u1", "lengths": "<u4", "parts": "<u4", "terms": "<u8", "begins": "<u4", "docs": "<u2", "counts": "<u4"}
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row[name], kind))

    @classmethod
    def pack(cls, ids: list[int | None], texts: list[bytes]) -> dict[str, bytes]:
        doc, found, count, length = terms(texts)
        order = np.argsort(found)
        found, doc, count = found[order], doc[order], count[order]
        first = np.append(True, found[1:] != found[:-1])[: len(found)]
        new = np.flatnonzero(first)
        rows, parts = _parts(kinds(doc, np.cumsum(first) - 1, len(ids)), length)
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        doc = place[doc]
        return {
            "ids": np.array([d or 0 for d in ids], "<i8")[rows].tobytes(), "known": np.array([d is not None for d in ids], "u1")[rows].tobytes(), "lengths": length[rows].astype("<u4").tobytes(), "parts": parts.astype("<u4").tobytes(),
            "terms": found[new].astype("<u8").tobytes(), "begins": np.append(new, len(found)).astype("<u4").tobytes(), "docs": doc.astype("<u2").tobytes(), "counts": count.astype("<u4").tobytes(),
        }


def index(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as a written index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("topk", lambda: None)
        ids, texts, size = [], [], 0

        def shard() -> pa.RecordBatch:
            row = Shard.pack(ids, texts)
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row.values()], names=list(row))

        for batch in small_batches(batches):
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(d)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield shard()
                    size = 0
        if ids:
            yield shard()
        trim()

    return written(arrow_map(docs.select("doc_id", "text"), run, SHARD), "index")


def _counts(shards: DataFrame) -> DataFrame:
    """Term and documents that have it; the term 0 counts documents, -1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            for row in batch.to_pylist():
                length, begins = np.frombuffer(row["lengths"], "<u4"), np.frombuffer(row["begins"], "<u4").astype(np.int64)
                value = np.concatenate([np.array([0, -1]), np.frombuffer(row["terms"], "<i8")])
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.concatenate([[len(length), length.sum(dtype=np.int64)], np.diff(begins)]))], names=["term", "n"])

    return arrow_map(shards.select("lengths", "begins", "terms"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Queries:
    """Queries by number, in ``batches`` of like ones: their terms among ``vocabulary`` with
    counts in the query. ``owners`` are the ids that ask each."""

    def __init__(self, ids: list[int] | list[list[int]], texts: list[str]) -> None:
        own = [i if isinstance(i, list) else [i] for i in ids]
        self.owners = np.array([i for o in own for i in o], np.int64)
        self.owned = np.cumsum([0, *map(len, own)])
        query, found, count, length = terms([t.encode() for t in texts])
        self.vocabulary, term = np.unique(found, return_inverse=True)
        order = np.lexsort((length, kinds(query, term, len(own))))
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        place = place[query]
        by = np.lexsort((term, place // BATCH))
        term, place, count = term[by].astype(np.int32), place[by], count[by].astype(np.int32)
        # a batch: its queries, their terms in order, and of each the queries and counts
        self.batches, cut = [], np.searchsorted(place // BATCH, np.arange(-(-len(own) // BATCH) + 1))
        for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            first = np.flatnonzero(np.append(True, term[a + 1 : b] != term[a : b - 1])[: b - a])
            self.batches.append((order[k * BATCH : (k + 1) * BATCH], term[a:b][first], np.append(first, b - a), (place[a:b] - k * BATCH).astype(np.int16), count[a:b]))
        self.idf = np.zeros(len(self.vocabulary))
        self.mean = 1.0

    def __len__(self) -> int:
        return len(self.owned) - 1

    def weigh(self, term: np.ndarray, n: np.ndarray, documents: int, words: int) -> None:
        at = np.searchsorted(self.vocabulary, term)
        df = np.zeros(len(self.vocabulary))
        df[at] = n
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        self.mean = max(words, 1) / max(documents, 1)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    size = end - begin
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


class Best:
    """The best ``k`` answers of each query so far: whole-number scores and ids, by
    falling score and rising id; score 0 is no answer."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.score = k, np.zeros((queries, k))
        self.id = np.full((queries, k), _NONE)

    def merge(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """For the queries ``at``, scores of the documents ``ids``, a row each."""
        values = np.concatenate([self.score[at], score], axis=1)
        names = np.concatenate([self.id[at], ids], axis=1)
        names = np.where(values > 0, names, _NONE)
        top = np.lexsort((names, -values), axis=1)[:, : self.k]
        found = np.take_along_axis(names, top, 1)
        sorted_ = np.sort(found, axis=1)
        twice = ((sorted_[:, 1:] == sorted_[:, :-1]) & (sorted_[:, 1:] != _NONE)).any(axis=1)
        self.score[at], self.id[at] = np.take_along_axis(values, top, 1), found
        for r in np.flatnonzero(twice).tolist():  # an id in several rows: its best counts
            order = np.lexsort((names[r], -values[r]))
            _, first = np.unique(names[r][order], return_index=True)
            keep = order[np.sort(first)]
            keep = keep[names[r][keep] != _NONE][: self.k]
            self.score[at[r]], self.id[at[r]] = 0, _NONE
            self.score[at[r], : len(keep)], self.id[at[r], : len(keep)] = values[r][keep], names[r][keep]


    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores above 0 of documents for queries, in any order; an id may repeat."""
        order = np.lexsort((-score, ids, at))
        at, score, ids = at[order], score[order], ids[order]
        keep = np.append(True, (at[1:] != at[:-1]) | (ids[1:] != ids[:-1]))[: len(at)]
        at, score, ids = at[keep], score[keep], ids[keep]
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        size = np.diff(np.append(first, len(at)))
        row, rank = np.repeat(np.arange(len(first)), size), np.arange(len(at)) - np.repeat(first, size)
        top = rank < self.k
        values, names = np.zeros((len(first), self.k)), np.full((len(first), self.k), _NONE)
        values[row[top], rank[top]], names[row[top], rank[top]] = score[top], ids[top]
        self.merge(at[first], values, names)


def _add(total: np.ndarray, cell: np.ndarray, times: np.ndarray | None, start: np.ndarray, size: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
    """Adds runs of postings to ``total``: ``size`` of them from ``start`` on, at ``cell`` and
    their document, so many times. About ``PAIRS`` at once, which caches hold."""
    end = np.cumsum(size)
    off, first = start - (end - size), 0
    while first < len(cell):
        before = int(end[first] - size[first])
        last = max(int(np.searchsorted(end, before + PAIRS, "right")), first + 1)
        s = size[first:last]
        p = np.repeat(off[first:last], s)
        p += np.arange(before, int(end[last - 1]))
        c, x = np.repeat(cell[first:last], s), impact.take(p)
        c += doc.take(p)
        if times is not None:
            x *= np.repeat(times[first:last], s)
        np.add.at(total, c, x)
        first = last


def search_shard(shard: Shard, queries: Queries, best: Best) -> None:
    """One shard's answers into ``best``, whose floors prune from the start."""
    if not len(queries.vocabulary) or not len(shard.terms):
        return
    at = np.minimum(np.searchsorted(queries.vocabulary, shard.terms), len(queries.vocabulary) - 1)
    own = np.flatnonzero(queries.vocabulary[at] == shard.terms)
    first, last = (shard.begins[own + k].astype(np.int64) for k in (0, 1))
    p = _ranges(first, last)
    doc, term = shard.docs[p], np.repeat(at[own].astype(np.int32), last - first)
    part = np.repeat(np.arange(len(shard.parts) - 1).astype(np.uint16), np.diff(shard.parts.astype(np.int64)))[doc]
    keep = np.argsort(part, kind="stable")  # within a part postings stay by term
    cut = np.searchsorted(part[keep], np.arange(len(shard.parts)))
    keep, cut = (keep, cut) if shard.known.all() else (keep[(known := shard.known[doc[keep]] != 0)], np.append(0, np.cumsum(known))[cut])
    p, term = p[keep], term[keep]
    del keep, part, doc, own, at, first, last
    doc, impact = shard.docs[p].astype(np.int64), shard.counts[p].astype(np.float64)
    del p
    # in place, as these are the largest arrays of a task. Unpickled arrays have a type object of
    # their own, with which np.add.at is 20 times slower: ``impact`` must not begin as one
    norm = (K1 * (1 - B + B * shard.lengths.astype(np.float64) / queries.mean))[doc]
    norm += impact
    impact *= queries.idf[term]
    impact *= K1 + 1
    impact /= norm
    del norm
    impact *= SCALE
    np.maximum(np.rint(impact, out=impact), 1, out=impact)
    # long documents first: they raise the floors
    for k in sorted(range(len(shard.parts) - 1), key=lambda k: -int(shard.lengths[shard.parts[k + 1] - 1])):
        a, b = int(shard.parts[k]), int(shard.parts[k + 1])
        own = slice(cut[k], cut[k + 1])
        if cut[k] < cut[k + 1]:
            _search_part(shard.ids[a:b], doc[own] - a, term[own], impact[own], queries, best)


def _search_part(ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, queries: Queries, best: Best) -> None:
    """The answers of a part's documents, from its postings by term."""
    n = len(ids)
    df = np.bincount(term, minlength=len(queries.vocabulary))
    begin = np.cumsum(df) - df
    most = np.zeros(len(df))
    there = np.flatnonzero(df)
    most[there] = np.maximum.reduceat(impact, begin[there])
    often = there[(df[there] * DENSE >= n) & (df[there] > 1)]
    often = np.sort(often[np.argsort(-df[often], kind="stable")][: max(CELLS // n, 1)])
    row_of = np.full(len(df), -1, np.int32)
    row_of[often] = np.arange(len(often))
    x = np.repeat(row_of[there] >= 0, df[there]).nonzero()[0]
    dense = np.zeros(len(often) * n, np.int32)  # whole numbers of at most 27 bits
    dense[np.repeat(np.arange(len(often)) * n, df[often]) + doc[x]] = impact[x]
    dense = dense.reshape(len(often), n)
    alone = np.sort(np.unique(ids, return_index=True)[1])  # a row for each id
    for at, terms, starts, query, count in queries.batches:
        floor = best.score[at, -1]
        here = np.flatnonzero(df[terms])
        t, uses = terms[here], starts[here + 1] - starts[here]
        x = _ranges(starts[here], starts[here + 1]) if 4 * len(here) < 3 * len(terms) else np.repeat(df[terms] > 0, np.diff(starts))
        q, w, m = query[x], count[x], len(at)
        bound = np.bincount(q, w * np.repeat(most[t], uses), m)
        ask = np.flatnonzero((bound >= floor) & (bound > 0))
        if not len(ask):
            continue
        if 2 * len(ask) < m:
            name = np.full(m, -1, np.int16)
            name[ask] = np.arange(len(ask))
            q = name[q]
            uses = np.bincount(np.repeat(np.arange(len(t)), uses)[q >= 0], minlength=len(t))
            q, w, at, floor, m = q[q >= 0], w[q >= 0], at[ask], floor[ask], len(ask)
        # a term goes where it costs less: into the product, or posting by posting
        size = df[t]
        large = (row_of[t] >= 0) & (uses * size * POSTING >= m * n)
        block = dense[row_of[t[large]]]
        pick = np.repeat(large, uses)
        weight = np.zeros((m, len(block)), np.float32)
        weight[q[pick], np.repeat(np.arange(len(block)), uses[large])] = w[pick]
        score = weight @ block.astype(np.float32)
        rest = np.zeros(m * n)
        pick = np.flatnonzero(~pick)
        q, w = q[pick].astype(np.int64) * n, w[pick]
        start, size = (np.repeat(x[t[~large]], uses[~large]) for x in (begin, df))
        for own, times in ((np.flatnonzero(w == 1), False), (np.flatnonzero(w != 1), True)):
            _add(rest, q[own], w[own] if times else None, start[own], size[own], doc, impact)
        rest = rest.reshape(m, n)
        score += rest
        # the share by which float32 may err, with room
        err = (len(block) + 8) * 2.0**-22
        low = np.maximum(floor * (1 - err), 0.5)
        found = score >= low[:, None].astype(np.float32)
        crowded = np.flatnonzero(found.sum(axis=1) > 4 * best.k)
        if len(crowded) and len(alone) > best.k:
            some = score[crowded] if len(alone) == n else score[crowded][:, alone]
            kth = np.partition(some, some.shape[1] - best.k, axis=1)[:, some.shape[1] - best.k]
            low[crowded] = np.maximum(low[crowded], kth.astype(np.float64) * (1 - err) ** 2)
            found[crowded] = score[crowded] >= low[crowded, None].astype(np.float32)
        r, c = np.divmod(np.flatnonzero(found), n)
        step = max(4 * PAIRS // max(len(block), 1), 64)
        for k in range(0, len(r), step):
            i, j = r[k : k + step], c[k : k + step]
            exact = rest[i, j] + np.einsum("ij,ji->i", weight[i].astype(np.float64), block[:, j].astype(np.float64))
            keep = exact >= floor[i]
            if keep.any():
                best.offer(at[i[keep]], exact[keep], ids[j[keep]])


def search(df: DataFrame, asks: Column, k: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score`` of the ``k`` best documents for each row where
    ``asks`` holds."""
    spark = df.sparkSession
    asked = df.where(asks).select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).where("doc_id is not null")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    asked = asked.groupBy("doc_id").agg(F.min("text").alias("text"))
    asked = written(asked.groupBy("text").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")), "queries")
    total, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(-(-total // QUERIES), -(-(size or 0) // QUERY_BYTES))
    shards = index(docs)
    counts = written(_counts(shards), "terms")
    special = dict(counts.where("term in (0, -1)").groupBy("term").agg(F.sum("n")).collect())
    # few long tasks: each carries its floors on, and gives k answers a query
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-input_bytes(docs) // TASK_BYTES))
    found = None
    for g in range(groups):
        # one group of queries, bounded in number and bytes, at a time
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).orderBy(F.col("ids")[0]).collect()
        queries = Queries([r.ids for r in rows], [r.text for r in rows])
        wanted = spark.createDataFrame(pa.table({"term": queries.vocabulary.view(np.int64)}))
        df_ = counts.join(F.broadcast(wanted), "term").toArrow()  # no more rows than the queries' terms
        queries.weigh(df_["term"].to_numpy().view(np.uint64), df_["n"].to_numpy(), special.get(0, 0), special.get(-1, 0))
        shared = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            claim("topk", lambda: None)
            own = shared.value
            best = Best(len(own), k)
            for batch in small_batches(batches, 1):
                for row in batch.to_pylist():
                    search_shard(Shard(row), own, best)
            q, c = np.nonzero(best.score)
            by = _ranges(own.owned[q], own.owned[q + 1])  # an answer for each id that asks
            q, c = (np.repeat(x, own.owned[q + 1] - own.owned[q]) for x in (q, c))
            yield pa.RecordBatch.from_arrays([pa.array(own.owners[by]), pa.array(best.id[q, c]), pa.array(best.score[q, c].astype(np.int64))], names=["query_id", "doc_id", "points"])
            trim()

        hits = arrow_map(shards.coalesce(tasks), run, "query_id long, doc_id long, points long")
        hits = written(hits, "hits")  # a group is done when its broadcast may go
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "query_id long, doc_id long, points long")
    # k answers from each task at most for a query
    once = found.groupBy("query_id", "doc_id").agg(F.max("points").alias("points"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("points"), "doc_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", (F.col("points") / SCALE).alias("score"))
