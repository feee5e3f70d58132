"""Queries without SQL against plain versions on whole tables: op5, op9, op10."""

import re
import zlib

import numpy as np
import pytest

from pavestat.llm import lang_id, license_scan, quality, queries
from pavestat.llm.common import fold_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def walk(trees, row):
    """The score of a row by following each tree from its root, node by node."""
    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
        total += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_quality_query(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), labels.where(fold_of("doc_id", 5) != 0))
    got = queries.op5_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    right = []
    for r in got:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3)
        assert r.score == pytest.approx(walk(model, quality.statistics(docs[r.doc_id].text)), abs=1e-9)
        if r.held_out and r.doc_id in known:
            right.append((r.score >= 0.5) == (known[r.doc_id] == 1))
    assert len(right) > 40 and np.mean(right) >= 0.95


def test_language_query(spark, docs):
    got = queries.op10_lang_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    right = []
    for r in got:
        text = docs[r.doc_id].text
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.held_out and docs[r.doc_id].lang is not None:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert len(right) > 150 and np.mean(right) >= 0.97


def test_language_spans_of_mixed_texts(spark, docs):
    """Passages of two languages, one after the other: labels by the spans they stand in."""
    model = lang_id.train(spark.read.parquet(f"{SF}/documents.parquet").where(fold_of("doc_id", 4) != 2))
    by = {}
    for r in docs.values():
        words = re.findall(r"\S+", r.text or "")
        if fold(r.doc_id, 4) == 2 and r.lang in model.languages and len(words) > 120:
            by.setdefault(r.lang, []).append(" ".join(words[:60]))
    rows = [(k, a[k % len(a)] + " " + b[k % len(b)], x, y) for k, (x, y) in enumerate([(x, y) for x in by for y in by if x != y] * 3) for a, b in [(by[x], by[y])]]
    found = {r.id: r.spans for r in lang_id.identify(spark.createDataFrame(rows, "id int, text string, first string, second string"), model).collect()}
    told = [(found[k][0].lang == x) and (found[k][-1].lang == y) for k, _, x, y in rows]
    assert len(told) >= 12 and np.mean(told) >= 0.9


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def shingles(found):
    k = min(license_scan.WORDS, len(found))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set()


def test_license_query(spark, docs):
    """Every hit has its containment in the words it names, and no text that holds a template
    word by word is missed."""
    templates = license_scan.TEMPLATES | license_scan.texts()
    plain = {name: words(text) for name, text in templates.items()}
    hits = queries.op9_license_scan(spark, SF).collect()
    assert len(hits) > 10
    for r in hits:
        here = shingles(words(docs[r.doc_id].text)[r.first_word : r.last_word + 1])
        own = shingles(plain[r.license])
        assert r.containment == pytest.approx(len(own & here) / len(own)) and r.containment >= license_scan.CONTAINMENT
    found = {(r.doc_id, r.license) for r in hits}
    joined = {name: " " + " ".join(w) + " " for name, w in plain.items()}
    whole = {(d, name) for d, r in docs.items() if r.text for line in [" " + " ".join(words(r.text)) + " "] for name, t in joined.items() if t in line}
    assert whole and whole <= found
