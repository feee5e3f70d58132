"""Elements of JSON arrays, whatever the cuts, against the json module."""

import json
import random

import pytest

from pavestat.sources.json_array import elements

TRICKY = ['} , {', '"', "\\", 'a "quoted" } \\" {', "[[[", "]}", "", "é ü\n\t", '\\"}', "{\"samples\": [{", "x" * 300]


def made(rng, deep=0):
    kind = rng.randrange(7 if deep < 3 else 4)
    if kind < 2:
        return rng.choice(TRICKY)
    if kind < 4:
        return rng.choice([None, True, 1, -2.5e-7])
    if kind == 4:
        return [made(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "samples", "}", "polylines", "é"]) + str(k): made(rng, deep + 1) for k in range(rng.randrange(4))}


def sample(rng, k):
    return {"sample_id": f"s{k}", "samples": [{"x": 1}], "meta": made(rng), "empty": {}, "points": [[1, 2], [{"x": rng.choice(TRICKY)}]], "other": made(rng)}


def documents():
    rng = random.Random(6)
    own = [sample(rng, k) for k in range(300)]
    return {
        "object": {"metadata": {"dataset": "d", "samples": [{"no": 1}]}, "classes": [{"c": 1}, {"c": 2}], "samples": own[:120], "after": [{"z": 3}, {}], "n": 5},
        "first": {"samples": own[120:140]},
        "bare": own[140:260],
        "empty": {"samples": [], "classes": [{"c": 1}]},
        "none": {"classes": [{"c": 1}], "nested": {"a": {}, "samples": [{"c": 1}]}},
        "last": {"text": 'the "samples": [{ of a string', "numbers": [1, [2]], "samples": own[260:]},
        "nothing": [],
    }


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_", [True, False])
def test_elements_equal_the_json_module(spark, tmp_path, indent, ascii_):
    want = {}
    for name, doc in documents().items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_))
        own = doc if isinstance(doc, list) else doc.get("samples", [])
        want |= {(name, k): e for k, e in enumerate(own)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = elements(spark, str(tmp_path)).collect()
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path / "object.json")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {(r.file.rsplit("/", 1)[1][:-5], r.position): json.loads(r.element) for r in found}
    assert len(got) == len(found) and got == want
    assert tasks > 4
