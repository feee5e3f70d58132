"""Coverage samples against the loop that they stand for, and ingestion by keyed state."""

import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pavestat.operators.sampling import coverage_sample
from pavestat.streaming.ingest import ingest, ingested

SCHEMA = "name string, id long, tags array<string>, ok boolean"


def loop(rows, wanted, seed, per_tag, total, patience, cap, chunk, done=()):
    out = {}
    for name in {r[0] for r in rows}:
        before = [r for r in done if r[0] == name]
        gone = {r[1] for r in before}
        pool = sorted((r for r in rows if r[0] == name and r[1] not in gone), key=lambda r: (hashlib.md5(f"{seed}:{r[1]}".encode()).hexdigest(), r[1]))
        counts = collections.Counter(t for r in before for t in set(r[2] or []))
        n = at = len(before)
        i, drawn = 0, []
        while True:
            met = all(counts[t] >= per_tag for t in wanted)
            reason = "coverage" if n >= total and met else "stalled" if n >= total and n - at >= patience else "cap" if n >= cap else "pool_exhausted" if i >= len(pool) else None
            if reason:
                break
            for r in pool[i : i + chunk]:
                drawn.append((r[1], i // chunk, bool(r[3])))
                if not r[3]:
                    continue
                n += 1
                for t in set(r[2] or []) & set(wanted):
                    counts[t] += 1
                    if counts[t] == per_tag:
                        at = n
            i += chunk
        for d in drawn:
            out[name, d[0]] = (*d[1:], reason)
    return out


@pytest.mark.parametrize(("per_tag", "total", "patience", "cap", "chunk"), [(3, 20, 30, 60, 7), (1, 1, 5, 1000, 1), (40, 50, 1000, 120, 10), (1000, 10, 2000, 5000, 50)])
@pytest.mark.parametrize("earlier", [False, True])
def test_samples_equal_the_loop(spark, per_tag, total, patience, cap, chunk, earlier):
    rng = random.Random(cap)
    wanted = ["a", "b", "c"]
    rows = [(rng.choice(["x", "y", None]), k, rng.choice([["a"], ["b", "a"], ["a", "z"], [], None, ["c"] if k % 9 == 0 else ["a", "a"]]), rng.choice([True, True, True, False, None])) for k in range(500)]
    done = [r for r in rows if r[1] % 5 == 0 and r[3]] if earlier else []
    df = spark.createDataFrame(rows, SCHEMA)
    first = spark.createDataFrame(done, SCHEMA) if earlier else None
    got = coverage_sample(df, "name", "id", "tags", F.col("ok"), wanted, 3, per_tag, total, patience, cap, chunk, first).collect()
    assert {(r.dataset, r.key): (r.chunk, r.readable, r.reason) for r in got} == loop(rows, wanted, 3, per_tag, total, patience, cap, chunk, done)
    assert len({(r.dataset, r.key) for r in got}) == len(got)
    assert coverage_sample(df.limit(0), "name", "id", "tags", F.col("ok"), wanted).count() == 0


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows) + '{"broken\n')


def test_batches_look_up_their_own_keys_only(spark, tmp_path):
    source, sink, progress = (tmp_path / x for x in ("in", "out", "progress"))
    args = (spark, str(source), "sample_id string, v int", str(sink), str(progress))
    read = lambda: sorted(map(tuple, ingested(spark, args[2], args[3]).collect()))
    seen = []

    def run():
        found = ingest(*args)
        found.awaitTermination(90)
        seen.append([(p.numInputRows, p.stateOperators[0].numRowsTotal, p.stateOperators[0].numRowsUpdated) for p in found.recentProgress if p.numInputRows])

    put(source, "1.json", [{"sample_id": f"k{k}", "v": 1} for k in range(200)] * 2)
    run()
    put(source, "2.json", [{"sample_id": "k7", "v": 2}, {"sample_id": "new", "v": 2}, {"v": 5}])
    run()
    want = [*sorted((f"k{k}", 1) for k in range(200)), ("new", 2)]
    assert read() == want
    # a batch whose commit is lost is done again and adds nothing
    last = max((progress / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    put(source, "3.json", [{"sample_id": "new", "v": 3}, {"sample_id": "k9", "v": 3}])
    run()
    assert read() == want
    inputs = [n for batch in seen for n, _, _ in batch]
    assert inputs[0] >= 400 and all(n <= 5 for n in inputs[1:])
    assert [(total, new) for batch in seen for _, total, new in batch][:2] == [(200, 200), (201, 1)]
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest(*args[:4], str(tmp_path / "other"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
