"""SimHash fingerprints by the plain rule, and components by all pairs."""

import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pavestat.llm import simhash
from pavestat.llm.queries import op12_simhash

SPACES = " \t\n\x0b\x0c\r"


def plain(text, words=4):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACES:
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[k : k + words]) for k in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    """Rows of (id, fingerprint) to the rows with the least id reachable."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    real = sorted({r for r in rows if r[0] is not None})
    prints = np.array([f for _, f in real], np.uint64)
    for k, (a, f) in enumerate(real):
        for j in np.flatnonzero(np.bitwise_count(prints[:k] ^ np.uint64(f)) <= distance):
            x, y = root(a), root(real[j][0])
            up[max(x, y)] = min(x, y)
    return collections.Counter((a, f"{f:016x}", None if a is None else root(a)) for a, f in rows)


def check(df, rows, distance=4):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert collections.Counter(map(tuple, df.collect())) == brute(rows, distance)


def test_code_is_perfect():
    home, near = simhash._code()
    assert len(set(home.tolist())) == 1 << 11
    assert (np.bitwise_count(home ^ np.arange(1 << 15)) <= 1).all()
    for word in random.Random(1).sample(range(1 << 15), 50):
        assert {x for x in near[word].tolist() if x >= 0} == {int(home[word])} | {int(home[word ^ (1 << b)]) for b in range(15)}


def test_near_fingerprints_meet_at_an_anchor():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for bits in range(1, 5):
        other = base.copy()
        for k in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(b)
        met, homes, visits = set(), collections.defaultdict(set), collections.defaultdict(set)
        both = np.concatenate([base, other])
        for place, there, home in simhash.anchors(both):
            for p, a in zip(place.tolist(), there.tolist(), strict=True):
                (homes if home else visits)[a].add(p)
        for a, h in homes.items():
            for x in h:
                met |= {(min(x, y), max(x, y)) for y in h | visits[a] if x != y}
        assert all((k, k + 300) in met for k in range(300))


@pytest.mark.parametrize("hot", [8192, 6])
def test_components_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "PAIRS", 64)
    monkeypatch.setattr(simhash, "HELD", 50)
    rng, rows = random.Random(hot), [(None, 0), (None, 7), (5, 0), (5, 0), (9, 3)]
    for base in range(12):
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            rows.append((rng.randrange(400) if base % 3 else 1000 + len(rows), value))
            if rng.random() < 0.8:
                value ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])))
    rows += [(2000 + k, 0xFFFF << 40 ^ 1 << (k % 21)) for k in range(30)]
    signed = [(a, f - (1 << 64) if f >> 63 else f) for a, f in rows]
    stored = spark.createDataFrame(signed, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: stored)
    check(simhash.near_duplicates(stored), rows)


def test_hubs_of_components(spark, monkeypatch):
    from pavestat.llm import components

    monkeypatch.setattr(components, "HUB", 4)
    edges = [(k, 1000) for k in range(30)] + [(k, k + 1) for k in range(2000, 2040)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in [*range(30), 1000]} | {k: 2000 for k in range(2000, 2041)}


def test_texts(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(simhash.SHINGLES + 5000))
    texts = [None, "", " \t\x0b", "One", "one", "one two THREE four", "one\ntwo three  four", "é è É ÀB", "one two three four five", "a " * 50, long, long + " end", "x y z"]
    rows = [(k if k != 3 else None, t) for k, t in enumerate(texts)] + [(4, "a " * 51)]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fp string, component_id long")
    check(simhash.near_duplicates(df), [(a, plain(t)) for a, t in rows])
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(df, distance=6)


def test_hash_is_that_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c é")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("a b c é".encode(), simhash.SEED)


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(op12_simhash(spark, sf), [(r.doc_id, plain(r.text)) for r in docs])
