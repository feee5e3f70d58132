"""SimHash near duplicates by anchor points of a covering code.

A fingerprint has 64 bits: bit k is set if it is set in over half of the XXH64 hashes of a
text's word shingles, repeats included. Two fingerprints link if at most ``distance`` bits
differ.

Anchors: the 64 bits are cut into three parts of 22, 21 and 21 bits. Of ``distance`` < 6
differing bits at most one falls into some part, so each part is searched with threshold
one. A part's anchors are the words whose lowest 15 bits are a codeword of the perfect
Hamming code (covering radius one; the other bits stay as they are): every part is within
one bit of exactly one anchor, its *home*. A fingerprint is sent to its home and to all
anchors within radius plus threshold that are the home of some word one bit away (at
most 8 by the code, and one for each other bit). So if two parts differ in one bit at
most, each fingerprint reaches the home of the other, and they meet: a visit goes only to
anchors below the own home, so that they meet once. At an anchor, homes are compared with
all that came, by exclusive or and a count of bits.

Only different fingerprints travel: thousands of copies are one. An anchor with many
members (``HOT``) is dealt in blocks: homes and visitors by hash, a pair of blocks is a
task's group, so none is unbounded, and no member is left out. Of the links of a group a
spanning forest leaves the task, a row per member at most, never all pairs; components
of it are those of the links. The number of comparisons still grows with the square of
the different fingerprints, by one in 6,500.

Defined results: a null, empty or wordless text has fingerprint zero, which links like
any other; a text of fewer words than a shingle has its whole sequence as the one shingle.
A null id gets its fingerprint and a null component and links with nothing. Rows that
repeat an id are one vertex with the links of all of them; each row is returned. Extra
columns are not returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, claim, sized_broadcast, text_or_empty, trim, written
from .components import components

SEED = 42
#: Where the parts of a fingerprint begin, and how many bits each has.
PARTS = ((0, 22), (22, 21), (43, 21))
CODED = 15
MOST_DISTANCE = 5
#: Members of an anchor that are compared in one group; beyond them they are dealt in blocks.
HOT = 8192
#: Pairs that are compared at once, members that are held for it, and shingles that are counted.
PAIRS, HELD, SHINGLES = 1 << 20, 1 << 16, 1 << 16
#: Rows broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
_U = np.uint64


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of a text, unsigned. Counts of bits are added a slice of shingles
    at a time, so that a long text needs little more than its words."""
    found = text.lower().split()  # of bytes: A to Z, and the white space 0x20 and 0x09 to 0x0D
    if not found:
        return 0
    whole = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(whole, SEED)
    length = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    ends, n = ends[words - 1 :], len(found) - words + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES):
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts[k : min(k + SHINGLES, n)].tolist(), ends[k : k + SHINGLES].tolist(), strict=True)]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash", lambda: None)
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
        trim()

    return arrow_map(df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("t")), run, "doc_id long, fp long")


def _code() -> tuple[np.ndarray, np.ndarray]:
    """For each word of ``CODED`` bits its codeword; and the codewords of the words within
    one bit of it (its own first), eight at most, the rest -1. The code's check of a word is the
    exclusive or of the numbers, from 1, of its set bits; it names the bit to change."""
    word = np.arange(1 << CODED)
    check = np.zeros_like(word)
    for bit in range(CODED):
        check ^= np.where(word >> bit & 1, bit + 1, 0)
    home = np.where(check, word ^ (1 << np.maximum(check - 1, 0)), word)
    near = np.sort(np.stack([home, *(home[word ^ (1 << bit)] for bit in range(CODED))]), axis=0)
    near[1:][near[1:] == near[:-1]] = 1 << CODED
    near = np.sort(near, axis=0)[:8].T
    return home, np.where(near == 1 << CODED, -1, near)


def anchors(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Homes, then visits, of fingerprints: their places, the anchors, and whether these are
    their homes. An anchor is a number: the part, its bits beyond the code, the codeword."""
    home, near = _code()
    every = np.arange(len(prints))
    for part, (start, bits) in enumerate(PARTS):
        value = (prints >> _U(start)).astype(np.int64) & ((1 << bits) - 1)
        low, high = value & ((1 << CODED) - 1), value >> CODED
        base = part << 22
        own = base + (high << CODED) + home[low]
        yield every, own, True
        for column in near[low].T:
            there = base + (high << CODED) + column
            ok = (column >= 0) & (there < own)
            yield every[ok], there[ok], False
        for bit in range(bits - CODED):
            there = base + ((high ^ (1 << bit)) << CODED) + home[low]
            ok = there < own
            yield every[ok], there[ok], False


def _sent(classes: DataFrame) -> DataFrame:
    """``classes(fp)`` to ``(anchor, visits, fp)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash", lambda: None)
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for place, there, home in anchors(prints):
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(place), not home)), pa.array(prints[place].view(np.int64))], names=["anchor", "visits", "fp"])

    return arrow_map(classes.select("fp"), run, "anchor int, visits boolean, fp long")


def _dealt(sent: DataFrame) -> DataFrame:
    """``(anchor, i, j, visits, fp)``: members of hot anchors in blocks. There, home block i
    meets visitor block j; a home is a visitor of all home blocks as well."""
    counts = sent.groupBy("anchor").agg(F.count_if(~F.col("visits")).alias("homes"), F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = counts.select("anchor", F.ceil(2 * F.col("homes") / HOT).cast("int").alias("hb"), F.ceil(2 * F.col("n") / HOT).cast("int").alias("vb"))
    hot = written(hot.where("hb > 0"), "hot-anchors")
    zero = F.lit(0)
    if hot.isEmpty():
        return sent.select("anchor", zero.alias("i"), zero.alias("j"), "visits", "fp")
    hot = sized_broadcast(hot, BROADCAST_ROWS)
    few = sent.join(hot, "anchor", "left_anti").select("anchor", zero.alias("i"), zero.alias("j"), "visits", "fp")
    many = sent.join(hot, "anchor")
    own = F.xxhash64("fp")
    blocks = lambda n: F.sequence(zero, F.col(n) - 1)
    homes = many.where(~F.col("visits")).select("anchor", F.pmod(own, F.col("hb")).cast("int").alias("i"), F.explode(blocks("vb")).alias("j"), "visits", "fp")
    visitors = many.select("anchor", F.explode(blocks("hb")).alias("i"), F.pmod(own, F.col("vb")).cast("int").alias("j"), F.lit(True).alias("visits"), "fp")
    return few.unionByName(homes).unionByName(visitors)


def forest(group: np.ndarray, homes: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and all members of their groups, as places.
    Members stand by group, homes first."""
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    which = np.cumsum(np.append(False, group[1:] != group[:-1]))
    first, count = begins[which], np.add.reduceat(homes.astype(np.int64), begins)[which]
    every = np.arange(len(group))
    count = np.minimum(count, every - first)  # homes that stand before
    done = np.append(0, np.cumsum(count))
    label, k = every.copy(), 0
    while k < len(group):
        end = max(k + 1, int(np.searchsorted(done, done[k] + PAIRS, "right")) - 1)
        left = np.repeat(every[k:end], count[k:end])
        right = first[left] + np.arange(len(left)) - (done[left] - done[k])
        near = np.bitwise_count(prints[left] ^ prints[right]) <= distance
        left, right = left[near], right[near]
        while True:
            a, b = label[left], label[right]
            apart = a != b
            if not apart.any():
                break
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        k = end
    moved = np.flatnonzero(label != every)
    return moved, label[moved]


def _links(dealt: DataFrame, distance: int) -> DataFrame:
    """``(a, b)``: a spanning forest of the links, fingerprints as vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash", lambda: None)
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> pa.RecordBatch:
            key = np.stack([table[c].to_numpy() for c in ("anchor", "i", "j")], axis=1)
            group = np.cumsum(np.append(0, (key[1:] != key[:-1]).any(axis=1)))
            prints = table["fp"].to_numpy().view(np.uint64)
            a, b = forest(group, ~table["visits"].to_numpy(), prints, distance)
            apart = prints[a] != prints[b]
            return pa.RecordBatch.from_arrays([pa.array(prints[x][apart].view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < HELD:
                continue
            table = pa.Table.from_batches(held)
            key = [table[c].to_numpy() for c in ("anchor", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in key]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield found(pa.Table.from_batches(held))
        trim()

    keys = ["anchor", "i", "j"]
    return arrow_map(dealt.repartition(*keys).sortWithinPartitions(*keys, "visits"), run, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``df``."""
    if not 0 <= distance <= MOST_DISTANCE:
        raise ValueError(f"distance from 0 to {MOST_DISTANCE}")
    prints = written(fingerprints(df, words, doc_id, text), "prints")
    real = prints.where("doc_id is not null")
    classes = written(real.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    links = _links(_dealt(_sent(classes)), distance)
    several = real.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("last")).where("b <> last").select("doc_id", "b")
    same = real.join(sized_broadcast(written(several, "repeated-ids"), BROADCAST_ROWS), "doc_id").select(F.col("fp").alias("a"), "b")
    linked = components(links.unionByName(same).where("a <> b").distinct())
    named = written(classes.join(linked.withColumnRenamed("id", "fp"), "fp", "left").where("n > 1 or component is not null").select("fp", F.coalesce("component", "fp").alias("component"), "least"), "named")
    firsts = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "firsts")
    moved = written(named.join(sized_broadcast(firsts, BROADCAST_ROWS), "component").select("fp", "component_id"), "moved")
    found = prints.join(sized_broadcast(moved, BROADCAST_ROWS), "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
