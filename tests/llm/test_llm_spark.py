"""Operators on Spark: edge cases, and brute force where SQL cannot express them."""

import collections
import hashlib
import sys
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pavestat.llm import audio, bpe, lang_id, license_scan, mixing, ngram_join, quality, token_output, topk, warc
from pavestat.llm.components import components
from pavestat.llm.queries import vocabulary
from pavestat.llm.shingles import sets_of

DOCS = "doc_id long, text string, score string, ids string"
ROWS = [(3, "the cat sat on the mat", "a", None), (1, None, None, None), (2, "", "b", "x"), (7, "the cat sat on the mat", "a", None), (7, "the cat sat on the mat", "a", None), (None, "b c d e", None, None), (9, "word " * 3000, "", "")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_files_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, start = Tokenizer.from_file(path), 0
    got = token_output.round_trip(docs, path, 1).orderBy("start").collect()
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(want)
    for row, (doc, text, *_) in zip(got, want, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (row.doc_id, row.start, row.n_tokens, zlib.crc32(row.ids)) == (doc, start, len(ids), zlib.crc32(raw))
        start += len(ids)
    assert token_output.round_trip(none, path, 1).count() == 0


def brute_components(rows, words, num, den):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    sets = [set(s.tolist()) for s in sets_of(pa.array([r[1] for r in rows], pa.string()), words)]
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and None not in (rows[i][0], rows[j][0]) and den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = root(rows[i][0]), root(rows[j][0])
                up[max(a, b)] = min(a, b)
    return collections.Counter((r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("words", "num"), [(3, 9), (5, 8)])
def test_ngram_join_equals_brute_force(spark, docs, none, monkeypatch, words, num):
    import random

    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)  # so that blocks are paired
    rng, rows = random.Random(words), [(r[0], r[1]) for r in ROWS]
    for base in range(4):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 40, 90]))]
        for _ in range(rng.choice([3, 30])):
            own = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(300)}"
            rows.append((100 + len(rows), " ".join(own)))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), words, num, 10).select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(map(tuple, got.collect())) == brute_components(rows, words, num, 10)
    assert ngram_join.join(none, words, num, 10).count() == 0


@pytest.mark.parametrize("ids", ["different", "repeated"])
def test_ngram_join_counts_every_link(spark, none, monkeypatch, ids):
    import random

    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)  # so that blocks are paired
    rng, rows = random.Random(11), [(r[0], r[1]) for r in ROWS]
    for _ in range(2):
        text = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(25):  # near copies, most of them linked with each other
            own = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(300)}"
            rows.append(((100 + len(rows)) // (1 if ids == "different" else 3), " ".join(own)))
    sets = [frozenset(s.tolist()) for s in sets_of(pa.array([r[1] for r in rows], pa.string()), 3)]
    real = [k for k, s in enumerate(sets) if s and rows[k][0] is not None]
    links, least = collections.Counter(), {}
    for i in real:
        least[sets[i]] = min(rows[i][0], least.get(sets[i], rows[i][0]))
        for j in real:
            both = len(sets[i] & sets[j])
            links[i] += i != j and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both)
    want = collections.Counter((r[0], len(sets[k]), least.get(sets[k], r[0]) if k in real else r[0], None if r[0] is None else links[k]) for k, r in enumerate(rows))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 8, 10)
    found = got.collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in found) == want
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 3, 8, 10)
    assert max(links.values()) > 10
    assert ngram_join.join(none, 3, 8, 10).count() == 0


def test_tables_between_steps_are_released(spark, docs):
    from pavestat.llm import common

    common.release(spark)
    kept = spark.conf.get("spark.checkpoint.dir", None)
    assert ngram_join.join(docs.select("doc_id", "text"), words=3, num=90, den=100).count() == len(ROWS)
    paths = list(common._made[spark.sparkContext.applicationId])
    assert all(Path(x.removeprefix("file://")).exists() for x in paths) and paths
    assert common.release(spark) == len(paths) and not any(Path(x.removeprefix("file://")).exists() for x in paths)
    assert common.release(spark) == 0 and (kept is None or spark.conf.get("spark.checkpoint.dir") == kept)


def test_components_of_a_long_path_and_of_nothing(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901)], "a long, b long")
    got = dict(components(edges).collect())
    assert {got[k] for k in range(301)} == {0} and got[901] == 900
    assert components(edges.limit(0)).count() == 0


def brute_mix(rows, weights, share, epochs, seed):
    """The rows that mixing should take, by sorting each leaf whole."""
    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[r[1], r[2]].append((r[0], len((r[3] or "").split())))
    sums = {k: sum(n for _, n in v) for k, v in leaves.items()}
    plan = mixing.budgets(sums, weights, int(share * sum(sums.values())), epochs)
    out = collections.Counter()
    for leaf, own in leaves.items():
        left, epoch = plan[leaf], 0
        while sums[leaf] and left >= sums[leaf]:
            out.update((d, epoch, n) for d, n in own)
            left, epoch = left - sums[leaf], epoch + 1
        for d, n in sorted(own, key=lambda x: int(hashlib.md5(f"{seed}:{epoch}:{x[0]}".encode()).hexdigest()[:15], 16)):
            if n > left or not left:
                break
            out[d, epoch, n] += 1
            left -= n
        else:
            continue
    return out


def test_mixing_takes_prefixes_of_seeded_passes(spark, none, monkeypatch):
    rows = [(k, ("a", "b")[k % 4 == 0], f"s{k % 3}" if k % 5 else None, "w " * (1 + k % 7)) for k in range(900)]
    weights = {("a",): 1.0, ("b",): 3.0}
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, lang string, source string, text string, mix_epoch string, __whole int")
    want = brute_mix(rows, weights, 0.9, 2, 3)
    for most in (mixing.BROADCAST_LEAVES, 1):  # more leaves than that: joined by a shuffle
        monkeypatch.setattr(mixing, "BROADCAST_LEAVES", most)
        out = mixing.mix(df, ["lang", "source"], weights, share=0.9, epochs=2, seed=3)
        assert out.columns == ["doc_id", "lang", "source", "text", "__whole", "mix_epoch", "mix_tokens"]
        assert collections.Counter((r.doc_id, r.mix_epoch, r.mix_tokens) for r in out.collect()) == want
    again = spark.createDataFrame([*rows, *[(1, "b", "s1", None)] * 3, *[(None, "b", "s1", "w w")] * 3], "doc_id long, lang string, source string, text string")
    taken = mixing.mix(again, ["lang", "source"], weights, share=0.9, epochs=2, seed=3).agg(F.sum("mix_tokens")).first()[0]
    assert sum(n * k for (_, _, n), k in want.items()) - 20 < taken and mixing.mix(none, ["score"], {}).count() == 0


def test_warc_marks_copies(spark):
    rows = [(5, "http://a", "<p>x</p>" * 40), (2, None, "<p>x</p>" * 40), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>" * 40), (8, "http://é\r\n", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == 6 and got[2].record_type == got[8].record_type == got[3].record_type == "response"
    assert (got[5].refers_to, got[None].refers_to, got[4].refers_to, got[2].refers_to) == (2, 2, 3, None)
    assert all(got[p].payload_bytes == len((h or "").encode()) and got[p].payload_digest == warc.digest((h or "").encode()) for p, _, h in rows)
    least = {r.page_id: r.record_type for r in warc.round_trip(df, 10).collect()}
    assert least[4] == "response" and least[5] == "revisit"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_files_of_a_folder_and_revisits_without_a_response(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(warc.pack([warc.record(1, "http://u", b"<p>", None), warc.record(2, None, b"<p>", 1)]))
    got = warc.read_files(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [(r.record_type, r.target_uri, bytes(r.payload)) for r in got] == [("response", "http://u", b"<p>"), ("revisit", None, b"")]
    rows = [(1, 3, "X", "response", None), (2, 3, "X", "revisit", 1), (4, 3, "Y", "revisit", 1)]
    records = spark.createDataFrame(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert [r.page_id for r in warc.unmatched(records).collect()] == [4]


@pytest.mark.parametrize("name", ["op2_ngram_join", "op4_warc", "op8_topk"])
def test_query_equals_its_sql(spark, name):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from oracle import compare, connect

    from pavestat.llm import queries

    sf = "/root/testdata/sf0.001"
    compare(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


def test_scores_keep_rows_and_clashing_columns(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (9, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs.select("doc_id", "text", F.col("score").alias("lang")), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none.select("doc_id", "text"), quality.train(none, labels)).count() == 0
    # an id that repeats counts once a label, whatever the number and order of its rows
    more = docs.union(spark.createDataFrame([(9, "other text", None, None)] * 50, DOCS))
    assert quality.train(docs.union(docs), labels.union(labels)).base == model.base == quality.train(more, labels).base


def test_scores_and_codes_with_columns_of_their_own_names(spark):
    path = vocabulary("byte_bpe_50k.json")
    clash = spark.createDataFrame([(1, "abc", 0.5, "s", b"i", 3, "b"), (2, None, None, None, None, None, None)], "doc_id long, text string, score double, statistics string, ids binary, n_tokens int, back string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    scored = quality.score(clash, quality.train(clash, labels))
    assert scored.columns == ["doc_id", "score", "statistics", "ids", "n_tokens", "back"] and scored.count() == 2
    coded = bpe.encode(clash, path, decoded="back")
    assert coded.columns == ["doc_id", "ids", "n_tokens", "back", "score", "statistics"]
    assert [r.back for r in coded.orderBy("doc_id").collect()] == ["abc", ""]
    told = bpe.decode(coded.withColumn("text", F.lit("old")), path)
    assert told.columns == ["doc_id", "text", "n_tokens", "back", "score", "statistics"]
    assert [r.text for r in told.orderBy("doc_id").collect()] == ["abc", ""]


def test_mixing_of_leaves_without_tokens_and_any_names(spark):
    schema = "doc_id long, lang string, n long, row string, __mix_n int, branch_0 string, text string"
    rows = [(k, "en", 1, "r", 2, "b", "w w") for k in range(20)] + [(100, "fr", 1, "r", 2, "b", None), (101, "fr", None, None, None, None, ""), (None, "fr", 1, "r", 2, "b", " ")]
    out = mixing.mix(spark.createDataFrame(rows, schema), ["lang"], {}, share=0.5)
    assert out.columns == [*(c.split()[0] for c in schema.split(", ")), "mix_epoch", "mix_tokens"]
    got = out.collect()
    assert sum(r.mix_tokens for r in got) == 20 and sorted(str(r.doc_id) for r in got if r.lang == "fr") == ["100", "101", "None"]


def test_mixing_of_rows_that_are_alike(spark):
    """Of rows that are alike in all as many are taken as fit."""
    rows = [(1, "en", "w w w")] * 40 + [(None, "en", "w")] * 9 + [(2, "fr", "w w")] * 7 + [(3, "fr", "")] * 3
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    for share in (0.1, 0.35, 0.6, 0.99):
        got = mixing.mix(df, ["lang"], {}, share=share, seed=5).collect()
        plan = mixing.budgets({("en",): 129, ("fr",): 14}, {}, int(share * 143), 1)
        for lang in ("en", "fr"):
            taken = sum(r.mix_tokens for r in got if r.lang == lang)
            assert plan[lang,] - 3 < taken <= plan[lang,]
        again = mixing.mix(df.repartition(2), ["lang"], {}, share=share, seed=5).collect()
        assert collections.Counter(got) == collections.Counter(again)


@pytest.mark.parametrize("languages", [127, 128, 129, 300])
def test_viterbi_labels_many_languages(languages):
    import numpy as np

    want = np.array([languages - 1] * 70 + [0] * 5 + [languages // 2] * 70)
    scores = np.full((len(want), languages), -9.0, np.float32)
    scores[np.arange(len(want)), want] = 0
    assert lang_id.viterbi(scores, np.array([75, 70]), 12.0).tolist() == want.tolist()


def test_bpe_and_audio_round_trips(docs):
    path = vocabulary("byte_bpe_50k.json")
    got = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path).collect()
    assert sorted(r.text for r in got) == sorted(r[1] or "" for r in ROWS)
    assert sorted(r.back for r in bpe.encode(docs.select("text"), path, decoded="back").collect()) == sorted(r[1] or "" for r in ROWS)
    rows = audio.features(audio.store(docs.select("doc_id", "text"))).collect()
    assert sorted(hashlib.sha256(r.payload).hexdigest() for r in rows) == sorted(hashlib.sha256(audio.padded((t or "").encode())).hexdigest() for _, t, *_ in ROWS)


def test_audio_of_edge_cases_and_clashing_columns(spark, docs, none):
    clash = spark.createDataFrame([(1, "abc", 5, "m", "p", 1), (2, None, None, None, None, None)], "doc_id long, text string, n_bytes long, media string, payload string, frames long")
    got = audio.features(audio.store(clash).withColumn("payload", F.lit("old"))).orderBy("doc_id")
    assert got.columns == ["doc_id", "n_bytes", "media", "payload", "tensors", "frames", "segments"]
    assert [(r.n_bytes, bytes(r.payload), r.frames) for r in got.collect()] == [(3, b"abc" + bytes(61), 1), (0, bytes(64), 1)]
    assert audio.features(audio.store(none.select("doc_id", "text"))).count() == 0
    twice = audio.features(audio.store(docs.select("text").where("text like 'the%'"))).distinct().count()
    assert twice == 1  # equal texts, equal values


def test_audio_query_rows_equal_brute_force(spark):
    from pavestat.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op6_audio(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        own = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(own), len(own) + 44)
        assert r.payload_sha256 == hashlib.sha256(own).hexdigest() and r.tail_crc32 == zlib.crc32(own[-64:])
        assert r.media_sha256 == hashlib.sha256(audio.to_wav(own)).hexdigest()


def test_languages_and_their_spans(spark, docs):
    rows = [(k, " ".join(["the house and the tree with water"] * 5), "en") for k in range(30)] + [(100 + k, " ".join(["das haus und der baum mit wasser"] * 5), "de") for k in range(30)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "the tree and the house with water " * 3 + "der baum und das haus mit wasser " * 2), (2, None), (3, "123 !"), (4, "haus"), (5, "слово")]
    got = {r.doc_id: r for r in lang_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [(s.lang, s.first, s.last) for s in got[1].spans] == [("en", 0, 20), ("de", 21, 34)] and got[1].lang_pred == "en"
    assert [got[k].lang_pred for k in (2, 3, 4)] == ["und", "und", "de"] and got[2].score == 0
    assert got[5].score == got[5].certainty == 0 and got[1].certainty > 0.99 > got[1].score > 0.5
    clash = lang_id.identify(spark.createDataFrame([("haus", "x", 3)], "text string, lang_pred string, spans long"), model)
    assert clash.columns == ["text", "lang_pred", "score", "certainty", "spans"] and clash.first().lang_pred == "de"
    assert lang_id.identify(spark.createDataFrame([("haus",)], "score string"), model, "score").first().lang_pred == "de"
    assert lang_id.identify(docs.select("doc_id", "text"), lang_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_search_and_license_scan_edge_cases(docs, none, spark, monkeypatch):
    got = topk.search(docs, F.col("doc_id") % 3 == 0, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.doc_id) for r in got] == [(3, 1, 3), (3, 2, 7), (9, 1, 9)]
    assert topk.search(none, F.col("doc_id") == 0).count() == 0
    whole = topk.search(docs, F.col("doc_id").isNotNull(), 3).collect()
    monkeypatch.setattr(topk, "QUERY_BYTES", 4000)  # several groups
    assert sorted(topk.search(docs, F.col("doc_id").isNotNull(), 3).collect()) == sorted(whole) and whole
    rows = spark.createDataFrame([(1, "x " * 50 + "Released under the MIT License. " + "y " * 50), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in license_scan.scan(rows).collect()] == [(1, "MIT-notice")]


def test_equal_queries_are_searched_once(spark, monkeypatch):
    texts = ["one two three four", "two three four five", "six"]
    rows = spark.createDataFrame([(k, texts[k % 3]) for k in range(90)], "doc_id long, text string")
    monkeypatch.setattr(topk, "QUERY_BYTES", 100)
    passes, written = [], topk.written
    monkeypatch.setattr(topk, "written", lambda df, name, *a: passes.append(name) or written(df, name, *a))
    got = topk.search(rows, F.lit(True), 2).collect()
    assert passes.count("hits") == 1  # the index is read once for 39 bytes of unlike texts
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == [(k, j, k % 3 + 3 * (j - 1)) for k in range(90) for j in (1, 2)]


def test_duplicates_stage_equals_brute_force(spark):
    import corpus_pipeline as p

    base = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    near = [b.rsplit(" ", 1)[0] + " other" for b in base]
    rows = [(k, b) for k, b in enumerate(base)] + [(10 + k, b) for k, b in enumerate(near[:3])] + [(1, base[5]), (2, "two unlike texts under one id"), (2, base[2]), (None, base[4]), (None, "alone without an id"), (7, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in p.duplicates_stage(spark, docs, "").collect())
    sets = [set(s.tolist()) for s in sets_of(pa.array([t for _, t in rows], pa.string()), 5)]
    up = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                up = [up[j] if u == up[i] else u for u in up]
    least = {}
    for (d, t), u in zip(rows, up, strict=True):
        least[u] = min(least.get(u, (True, 0)), (d is None, d or 0))
    assert sum(got.values()) == len(set(up)) and got[7, ""] == 2 and got[2, "two unlike texts under one id"] == 1
    assert sorted((d is None, d or 0) for (d, _), n in got.items() for _ in range(n)) == sorted(least.values())


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
        assert k == 4 or docs.columns == p.COLUMNS
    assert 200 > sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0
