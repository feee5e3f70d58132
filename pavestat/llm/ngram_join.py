"""N-gram Jaccard self-join with vertical partitioning.

A document is the set of its word shingles. All shingles stand in one global order, the
rarer ones by hash first, the frequent ones last by their counts over the whole corpus.
The order is cut into fragments, partial overlaps of pairs are counted in each fragment by
itself and summed per pair, and the sum decides exactly. What is counted is kept small in
exact steps:

1. Documents with the same set form one class; only its representative (least id)
   goes on, so that thousands of copies cost one.
2. Prefix filter: two sets that link share one of their first ``n - ceil(t n) + 1``
   shingles in the global order. (Which shingles count as frequent changes costs only:
   any one order is right.)
3. Within the documents of one prefix shingle, sizes and odd sketches (a bit per hash
   residue, toggled by each shingle) bound the symmetric difference from below and
   discard pairs that cannot link. What is left joins documents into *neighbourhoods*,
   connected by pairs that may link; no link leaves a neighbourhood. Only a star of each
   connected part is passed on, a row per document, never the pairs.
4. The shuffle key of the counting is (neighbourhood, fragment): each document sends the
   shingles that it has in a fragment, and all pairs of the neighbourhood get their
   partial overlap there. Partial overlaps travel as one packed row per neighbourhood and
   fragment, are summed per pair, and give links per document and stars of linked ones.

A prefix shingle or a neighbourhood with many documents or shingles is cut by size of set
(classes a factor of the threshold wide, so that only neighbouring classes meet), then
dealt in blocks by hash, and the pairs of blocks are tasks: no task holds an unbounded
group. The pairs compared within such a group still grow with the square of its *different*
sets: links between them are what is asked for. Shingles are 64-bit hashes of their words.

Defined results: a null or wordless text has ``n_shingles`` 0 and links with nothing;
a null id gets its count but a null component; rows that repeat an id are one vertex
with the links of all its rows, and each row is returned; extra columns are not
returned; an empty table gives an empty table. Links are counted between rows with an id,
those of equal sets and of one id included.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import arrow_map, claim, sized_broadcast, trim, written
from .components import components
from .shingles import mix, sets_of

#: Shingles that are ordered by frequency: a bound on what is collected and broadcast.
FREQUENT = 1 << 19
#: Shingle occurrences that one local count covers.
LOCAL = 1 << 20
#: Documents, and shingles of documents, that are compared in one block.
BLOCK_DOCS, BLOCK_VALUES = 256, 1 << 21
#: Pairs that are compared at once in a worker, and shingles that are held for it.
PAIRS, VALUES = 1 << 18, 1 << 20
#: Parts of the order of the rarer and of the frequent shingles.
RARE_CUTS, FREQUENT_CUTS = 2, 2
#: Documents of one shingle whose pairs are listed; beyond them they are multiplied out.
LISTED = 24
#: Ids broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
_U = np.uint64


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent shingles, sorted by hash; their place in the order, rarest first; the
    places that cut them into ``FREQUENT_CUTS`` parts of as many occurrences. Each task
    reports what repeats within ``LOCAL`` occurrences; reports are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join", lambda: None)
        held: list[np.ndarray] = []
        n = 0

        def report() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count > 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(count[keep])], names=["h", "c"])

        for batch in small_batches(batches):
            for found in sets_of(batch.column(0), words):
                held.append(found)
                n += len(found)
                if n >= LOCAL:
                    yield report()
                    n = 0
        if held:
            yield report()
        trim()

    summed = arrow_map(docs.select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counted = written(summed.withColumn("bin", F.floor(8 * F.log2("c")).cast("int")), "counts")
    least, n = 1 << 30, 0
    for bin_, rows in sorted(((r[0], r[1]) for r in counted.groupBy("bin").count().collect()), reverse=True):
        if (n := n + rows) > FREQUENT:
            break
        least = bin_
    top = counted.where(F.col("bin") >= least).select("h", "c").toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    by_hash = np.argsort(h)
    place = np.empty(len(h), np.int64)
    order = np.lexsort((h, c))
    place[order] = np.arange(len(h))
    run = np.cumsum(c[order], dtype=np.float64)
    cuts = np.searchsorted(run, np.arange(1, FREQUENT_CUTS) * (run[-1] / FREQUENT_CUTS)) if len(h) else np.zeros(FREQUENT_CUTS - 1, np.int64)
    return h[by_hash], place[by_hash], cuts


class _Order:
    """The global order of shingles."""

    def __init__(self, frequent: np.ndarray, place: np.ndarray, cuts: np.ndarray) -> None:
        self.frequent, self.place, self.cuts = frequent, place, cuts

    def split(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rarer ones, in order; the frequent ones, in order, and their places."""
        if not len(self.frequent):
            return found, found[:0], self.place[:0]
        at = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
        common = self.frequent[at] == found
        place = self.place[at[common]]
        by_place = np.argsort(place)
        return found[~common], found[common][by_place], place[by_place]

    def prefix(self, found: np.ndarray, length: int) -> np.ndarray:
        rare, common, _ = self.split(found)
        return rare[:length] if len(rare) >= length else np.concatenate([rare, common[: length - len(rare)]])

    def fragments(self, found: np.ndarray) -> list[np.ndarray]:
        """The shingles by fragment of the order, sorted by hash in each."""
        rare, common, place = self.split(found)
        cuts = np.searchsorted(rare, (np.arange(1, RARE_CUTS, dtype=np.float64) * 2.0**64 / RARE_CUTS).astype(np.uint64))
        return [*np.split(rare, cuts), *np.split(common, np.searchsorted(place, self.cuts))]


def _sketch(found: np.ndarray) -> bytes:
    bits = max(1024, 1 << int(len(found) - 1).bit_length()) if len(found) else 1024
    at = (found & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _key(found: np.ndarray) -> int:
    return int(mix(found).sum(dtype=np.uint64).view(np.int64))


def _profiles(docs: DataFrame, words: int, num: int, den: int, order: Broadcast) -> DataFrame:
    """Per row: id, set size, two hashes of the set, its sketch and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join", lambda: None)
        own = order.value
        row = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches):
            sizes, first, second, sketches, prefixes = [], [], [], [], []
            for found in sets_of(batch.column(1), words):
                n = len(found)
                sizes.append(n)
                first.append(_key(found))
                second.append(_key(found ^ _U(0x9E3779B97F4A7C15)))
                sketches.append(_sketch(found))
                prefix = own.prefix(found, n - -(-num * n // den) + 1 if n else 0)
                prefixes.append(prefix.view(np.int64))
            n_rows = batch.num_rows
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n_rows)),
                    batch.column(0),
                    pa.array(sizes, pa.int32()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                ],
                names=["row", "doc_id", "n", "k1", "k2", "sketch", "prefix"],
            )
            row += n_rows
        trim()

    schema = "row long, doc_id long, n int, k1 long, k2 long, sketch binary, prefix array<long>"
    return written(arrow_map(docs.select("doc_id", "text"), run, schema), "profiles")


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the least vertex that it is connected with."""
    least = np.arange(n)
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
        open_ = least[a] != least[b]
        a, b = a[open_], b[open_]
    return least


def _distance(sketches: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits of the sketches of row pairs, the longer one folded, and the bits
    compared."""
    size = np.array([len(s) for s in sketches])
    apart, bits = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for sa, sb in {*zip(size[a].tolist(), size[b].tolist(), strict=True)}:
        pick = np.flatnonzero((size[a] == sa) & (size[b] == sb))
        step = max(1, (1 << 23) // max(sa, sb))
        for k in range(0, len(pick), step):
            some, sides = pick[k : k + step], []
            for rows, s in ((a[some], sa), (b[some], sb)):
                own, back = np.unique(rows, return_inverse=True)
                m = np.frombuffer(b"".join([sketches[r] for r in own]), np.uint8).reshape(len(own), s)
                while m.shape[1] > min(sa, sb):
                    m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
                sides.append(np.ascontiguousarray(m).view(np.uint64)[back])
            apart[some] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
            bits[some] = 8 * min(sa, sb)
    return apart, bits


class _Groups:
    """Whole groups of rows that are sorted by ``keys``, from Arrow batches: an iterator of
    slabs ``(columns, begin)`` of at least one group each. A slab ends before the ``cost`` of
    its groups, a function of their sizes and of the values in their rows, is over ``most``."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int, cost: Callable[[np.ndarray, np.ndarray], np.ndarray], heavy: str) -> None:
        self.batches, self.keys, self.most, self.cost, self.heavy = batches, keys, most, cost, heavy

    def _slabs(self, rows: pa.RecordBatch | pa.Table, last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Slabs of the whole groups; the rest stays in ``self.rest``."""
        n = rows.num_rows
        change = np.zeros(n, bool)
        for k in self.keys:
            c = rows.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        begin = np.concatenate([[0], np.flatnonzero(change)]) if n else np.zeros(0, np.int64)
        whole = len(begin) if last else max(len(begin) - 1, 0)
        bounds = np.append(begin, n)
        weight = np.concatenate([[0], np.cumsum(pc.binary_length(rows.column(self.heavy)).to_numpy())])
        total = np.concatenate([[0], np.cumsum(self.cost(np.diff(bounds), np.diff(weight[bounds])))])
        k = 0
        while k < whole:
            end = min(whole, max(k + 1, int(np.searchsorted(total, total[k] + self.most, "right")) - 1))
            yield rows.slice(bounds[k], bounds[end] - bounds[k]), begin[k:end] - begin[k]
            k = end
        self.rest = rows.slice(bounds[whole], n - bounds[whole])

    def __iter__(self) -> Iterator[tuple[pa.Table, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        self.rest = None
        for batch in self.batches:
            if not batch.num_rows:
                continue
            same = bool(held) and all(held[-1].column(k)[-1] == batch.column(k)[-1] for k in self.keys)
            held.append(batch)
            if same:  # still inside the group that the last batch ended with
                continue
            yield from self._slabs(pa.Table.from_batches(held).combine_chunks(), False)
            held = self.rest.to_batches()
        if held:
            yield from self._slabs(pa.Table.from_batches(held).combine_chunks(), True)


def _pairs_within(begin: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each group, about ``most`` at a time."""
    for s in np.unique(size[size > 1]).tolist():
        starts = begin[size == s]
        if s * (s - 1) // 2 <= most:
            i, j = np.triu_indices(s, 1)
            step = max(1, most // len(i))
            for k in range(0, len(starts), step):
                some = starts[k : k + step, None]
                yield (some + i).ravel(), (some + j).ravel()
            continue
        rows = max(1, most // s)
        for start in starts.tolist():
            for k in range(0, s - 1, rows):
                i, j = np.triu_indices(s - k, 1, s - k)
                keep = i < rows
                yield start + k + i[keep], start + k + j[keep]


def _stars(num: int, den: int) -> Callable:
    """Rows ``key, block, side, row, n, sketch``, sorted by ``key, block``, to ``a, b``: in
    each group the rows that pairs which may link connect, each with the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _Groups(batches, ["key", "block"], PAIRS, lambda size, _: size * (size - 1) // 2, "sketch"):
            row, n, side = (rows.column(c).to_numpy() for c in ("row", "n", "side"))
            n = n.astype(np.int64)
            sketches = rows.column("sketch").to_pylist()
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a, b in _pairs_within(begin, np.diff(np.append(begin, len(row))), PAIRS):
                keep = (num * np.maximum(n[a], n[b]) <= den * np.minimum(n[a], n[b])) & ((side[a] == 0) | (side[a] != side[b]))
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                apart, _ = _distance(sketches, a, b)
                near = apart <= (n[a] + n[b]) * (den - num) // (den + num)
                found.append((a[near], b[near]))
            least = _least(len(row), *(np.concatenate(x) for x in zip(*found, strict=True)))
            out = np.flatnonzero(least != np.arange(len(row)))
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(row[out]), pa.array(row[least[out]])], names=["a", "b"])
        trim()

    return run


def _met(prefix: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """``prefix(key, row, n)`` by the written ``sizes(key, size)`` to those rows that share a
    key, without documents that no other of the same shingle is near to in size: of sizes in
    order, a neighbour's is the nearest. Shingles that are compared in several blocks are
    told apart before any shuffle by shingle and stay whole, so that no task gets all of
    a large group; there are at most rows / ``BLOCK_DOCS`` of them."""
    large = sized_broadcast(sizes.where(F.col("size") > BLOCK_DOCS).select("key"), BROADCAST_IDS)
    small = prefix.join(large, "key", "left_anti").join(sizes.where(F.col("size") <= BLOCK_DOCS).select("key"), "key")
    order = Window.partitionBy("key").orderBy("n")
    small = small.withColumn("before", F.lag("n").over(order)).withColumn("after", F.lead("n").over(order))
    near = (F.col("n") * num <= F.col("before") * den) | (F.col("after") * num <= F.col("n") * den)
    return small.where(near).select("key", "row", "n").unionByName(prefix.join(large, "key", "left_semi").select("key", "row", "n"))


def _dealt(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Written ``rows(key, row, n)`` with ``block`` and ``side``: any two rows of a key whose
    sizes may link meet in one block, once; where ``side`` is not 0, only rows of different
    sides are a pair. A key of few rows is one block. Others are cut into classes of size, a
    little wider than the threshold, so that a row meets its own class and the two beside it;
    classes are dealt into blocks by hash, and pairs of blocks are blocks."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("values"))
    large = sized_broadcast(written(sizes.where((F.col("size") > BLOCK_DOCS) | (F.col("values") > BLOCK_VALUES)).select("key"), "large"), BROADCAST_IDS)
    small = rows.join(large, "key", "left_anti").select("*", F.lit(0).cast("long").alias("block"), F.lit(0).alias("side"))
    width = math.log(den / num * 1.0001) if num < den else 1.0
    wide = rows.join(large, "key", "left_semi").withColumn("class", F.floor(F.log("n") / width).cast("int"))
    share = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_VALUES)).cast("int")
    beside = Window.partitionBy("key").orderBy("class")
    counts = wide.groupBy("key", "class").agg(share.alias("c"))
    here = lambda f, d: F.when(f("class").over(beside) == F.col("class") + d, f("c").over(beside)).otherwise(0)
    counts = counts.select("key", "class", "c", here(F.lag, -1).alias("low"), here(F.lead, 1).alias("high"))
    wide = wide.join(sized_broadcast(written(counts, "dealt"), BROADCAST_IDS), ["key", "class"])
    wide = wide.withColumn("own", F.pmod(F.xxhash64("row", "key"), F.col("c")).cast("int"))

    def blocks(count: Column, make: Callable[[Column], Column]) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(F.array().cast("array<struct<block: bigint, side: int>>"))

    def block(low: Column, cross: int, i: Column, j: Column, side: Column) -> Column:
        number = ((low.cast("long") * 2 + cross) * (1 << 24) + i) * (1 << 16) + j + 1
        return F.struct(number.cast("long").alias("block"), side.cast("int").alias("side"))

    at, own = F.col("class"), F.col("own")
    every = F.concat(
        blocks(F.col("c"), lambda o: block(at, 0, F.least(own, o), F.greatest(own, o), F.when(own == o, 0).when(own < o, 1).otherwise(2))),
        blocks(F.col("high"), lambda o: block(at, 1, own, o, F.lit(1))),
        blocks(F.col("low"), lambda o: block(at - 1, 1, o, own, F.lit(2))),
    )
    return small.unionByName(wide.select("key", "row", "n", F.inline(every)))


def _neighbourhoods(single: DataFrame, num: int, den: int) -> DataFrame:
    """``id, component`` of rows that pairs which may link connect."""
    prefix = single.select(F.explode("prefix").alias("key"), "row", "n")
    # two documents of sizes too far apart to link need not meet
    shared = prefix.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    shared = shared.where((F.col("size") > 1) & ((F.col("size") > 2) | (F.col("high") * num <= F.col("low") * den))).select("key", "size")
    rows = written(_met(prefix, written(shared, "sizes"), num, den), "met")
    dealt = _dealt(rows, num, den).join(single.select("row", "sketch"), "row")
    sorted_ = dealt.select("key", "block", "side", "row", "n", "sketch").repartition("key", "block").sortWithinPartitions("key", "block")
    return components(arrow_map(sorted_, _stars(num, den), "a long, b long").distinct())


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, block, fragment, side, row, n, size, doc_id, part``, sorted by the first
    three and ``row``, to a row per group: the members, and the overlaps of their pairs."""
    for rows, begin in _Groups(batches, ["key", "block", "fragment"], VALUES, lambda size, weight: size * size + weight // 8, "part"):
        row = rows.column("row").to_numpy()
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(row))))
        kept = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])))  # copies of one class
        table = rows.take(pa.array(kept))
        group, members = group[kept], np.bincount(group[kept], minlength=len(begin))
        first = np.cumsum(members) - members
        cell = np.cumsum(members**2) - members**2  # of each group's square of counts
        local = np.arange(len(kept)) - first[group]
        parts = [np.frombuffer(x, np.uint64) for x in table.column("part").to_pylist()]
        value = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(kept)), [len(x) for x in parts])
        order = np.lexsort((owner, value, group[owner]))
        value, owner = value[order], owner[order]
        change = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (group[owner[1:]] != group[owner[:-1]]))) if len(value) else np.zeros(0, np.int64)
        size = np.diff(np.append(change, len(value)))
        overlap = np.zeros(int((members**2).sum()), np.int64)
        few = size <= LISTED
        for a, b in _pairs_within(change[few], size[few], 1 << 21):
            x, y = owner[a], owner[b]
            overlap += np.bincount(cell[group[x]] + local[x] * members[group[x]] + local[y], minlength=len(overlap))
        many = np.flatnonzero(~few)
        of = group[owner[change[many]]] if len(many) else many
        for g in np.unique(of).tolist():
            m, own = int(members[g]), many[of == g]
            total = np.zeros((m, m))
            for k in range(0, len(own), 2048):
                some = own[k : k + 2048]
                has = np.zeros((m, len(some)), np.float32)
                for c, r in enumerate(some.tolist()):
                    has[local[owner[change[r] : change[r] + size[r]]], c] = 1
                total += has @ has.T
            overlap[cell[g] : cell[g] + m * m] += np.triu(total, 1).ravel().astype(np.int64)
        at = np.flatnonzero(overlap)
        which = np.searchsorted(cell, at, "right") - 1
        # groups of one member have a cell too, and it is the last of equal starts
        inside = at - cell[which]
        packed = np.stack([inside // members[which], inside % members[which], overlap[at]], axis=1).astype("<u4")
        cut = np.searchsorted(at, np.append(cell, len(overlap)))
        columns = [np.asarray(table.column(c).to_numpy(), np.int64) for c in ("row", "doc_id", "n", "size", "side")]
        about = np.stack(columns, axis=1)
        keys = [table.column(c).to_numpy()[first] for c in ("key", "block")]
        yield pa.RecordBatch.from_arrays(
            [
                *map(pa.array, keys),
                pa.array([about[a : a + m].tobytes() for a, m in zip(first.tolist(), members.tolist(), strict=True)], pa.binary()),
                pa.array([packed[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
            ],
            names=["key", "block", "members", "overlaps"],
        )
    trim()


def _summed(num: int, den: int) -> Callable:
    """Partial overlaps, sorted by ``key, block``, summed per pair to ``row, doc_id, others,
    root``: of each member that links in a block, the rows it links with there, and the
    least id that links connect it with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _Groups(batches, ["key", "block"], VALUES, lambda _, weight: weight, "overlaps"):
            members, overlaps = rows.column("members").to_pylist(), rows.column("overlaps").to_pylist()
            end = np.append(begin, len(members))[1:]
            out = []
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                about = np.frombuffer(members[a], np.int64).reshape(-1, 5)
                m = len(about)
                found = np.frombuffer(b"".join(overlaps[a:b]), "<u4").reshape(-1, 3).astype(np.int64)
                if not len(found):
                    continue
                pair, back = np.unique(found[:, 0] * m + found[:, 1], return_inverse=True)
                both = np.bincount(back, found[:, 2]).astype(np.int64)
                x, y = pair // m, pair % m
                n, size, side = about[:, 2], about[:, 3], about[:, 4]
                linked = (both * den >= num * (n[x] + n[y] - both)) & ((side[x] == 0) | (side[x] != side[y]))
                x, y = x[linked], y[linked]
                if not len(x):
                    continue
                others = np.bincount(x, size[y], m) + np.bincount(y, size[x], m)
                # vertices in the order of their ids, so that the least is the least id
                by_id = np.argsort(about[:, 1], kind="stable")
                at = np.empty(m, np.int64)
                at[by_id] = np.arange(m)
                least = _least(m, at[x], at[y])
                has = np.flatnonzero(others)
                out.append(np.stack([about[has, 0], about[has, 1], others[has].astype(np.int64), about[by_id[least[at[has]]], 1]], axis=1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T.copy()], names=["row", "doc_id", "others", "root"])
        trim()

    return run


def _fragments(docs: DataFrame, words: int, order: Broadcast) -> DataFrame:
    """Per row: id, set size and hash, and its shingles by fragment of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join", lambda: None)
        own = order.value
        for batch in small_batches(batches):
            sizes, keys, parts = [], [], []
            for found in sets_of(batch.column(1), words):
                sizes.append(len(found))
                keys.append(_key(found))
                parts.append([x.tobytes() for x in own.fragments(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), pa.array(parts, pa.list_(pa.binary()))], names=["doc_id", "n", "k1", "parts"])
        trim()

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n int, k1 long, parts array<binary>")


def join(df: DataFrame, words: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_shingles, component_id, class_id, n_links``.
    Two documents link when ``den * intersection >= num * union``; a component's id is its
    least id, a class's the least id of the documents with the same set; ``n_links`` are the
    other rows that a row links with."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = df.sparkSession.sparkContext.broadcast(_Order(*_frequent(docs, words)))
    profiles = _profiles(docs, words, num, den, order)
    real = profiles.where("n > 0 and doc_id is not null")
    key = ["k1", "k2", "n"]
    classes = written(real.groupBy(*key).agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("size")).select(*key, F.col("first.doc_id").alias("rep"), F.col("first.row").alias("rep_row"), "size"), "classes")
    several = sized_broadcast(classes.where("size > 1").drop("size"), BROADCAST_IDS)
    member = written(real.select("doc_id", "row", *key).join(several, key).select("doc_id", "row", "rep", "rep_row"), "members")
    copies = sized_broadcast(member.where("row <> rep_row").select("row"), BROADCAST_IDS)
    single = real.join(copies, "row", "left_anti")

    near = written(_neighbourhoods(single, num, den), "near")
    rows = classes.join(near.select(F.col("id").alias("rep_row"), F.col("component").alias("key")), "rep_row")
    rows = written(rows.select("key", F.col("rep_row").alias("row"), "n", "k1", F.col("rep").alias("doc_id"), "size"), "near_rows")
    wanted = docs.join(sized_broadcast(rows.select("doc_id").distinct(), BROADCAST_IDS), "doc_id", "left_semi")
    dealt = _dealt(rows.select("key", "row", "n"), num, den).join(rows.select("row", "k1", "doc_id", "size"), "row")
    parts = dealt.join(_fragments(wanted, words, order), ["doc_id", "n", "k1"])
    parts = parts.select("key", "block", "side", "row", F.col("n").cast("long").alias("n"), "size", "doc_id", F.posexplode("parts").alias("fragment", "part"))
    group = ["key", "block"]
    parts = parts.repartition(*group, "fragment").sortWithinPartitions(*group, "fragment", "row")
    partial = arrow_map(parts, _partial, "key long, block long, members binary, overlaps binary")
    partial = partial.repartition(*group).sortWithinPartitions(*group)
    linked = written(arrow_map(partial, _summed(num, den), "row long, doc_id long, others long, root long"), "linked")

    # rows of one id with different sets are one vertex
    repeated = real.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    same = member.where("rep <> doc_id").join(repeated, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels = components(linked.select(F.col("doc_id").alias("a"), F.col("root").alias("b")).where("a <> b").distinct().unionByName(same))

    out = profiles.select("row", "doc_id", "n").join(member.select("row", "rep", "rep_row"), "row", "left")
    out = out.withColumn("rep", F.coalesce("rep", "doc_id")).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    copies = classes.where("size > 1").select("rep_row", (F.col("size") - 1).alias("others"))
    per_class = linked.select(F.col("row").alias("rep_row"), "others").unionByName(copies).groupBy("rep_row").agg(F.sum("others").alias("n_links"))
    out = out.withColumn("rep_row", F.coalesce("rep_row", "row")).join(per_class, "rep_row", "left")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("class_id"), n_links.alias("n_links"))
