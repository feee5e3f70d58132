"""Kernels against brute force, without Spark."""

import itertools
import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pavestat.llm import audio, bpe, lang_id, license_scan, mixing, ngram_join, quality, shingles, simple8b, token_output, topk, warc
from pavestat.llm.queries import vocabulary

TEXTS = st.text(st.sampled_from("ab 'streVÀ\t\n\r\x0b\x1c\x1f\x85\xa0 　ééΣσİı漢字12٣!?…🙂‍﻿\x00"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70000), st.integers(0, 2**64 - 1), st.just(0)), max_size=400))
def test_simple8b_round_trip(values):
    x = np.array(values, np.uint64)
    assert (simple8b.decode(*simple8b.encode(x), len(x)) == x).all()


def test_simple8b_packs_sixty_bits_in_a_word():
    words, offset, _ = simple8b.encode(np.ones(120, np.uint64))
    assert len(words) == 2 and offset.tolist() == [0]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.sampled_from(["", "<|endoftext|>", "<|startoftext|>"]))
def test_tokenizers_agree_with_the_library(libraries, text, special):
    text = text[:7] + special + text[7:]
    library, own = libraries["byte_bpe_50k.json"], bpe.tokenizer(vocabulary("byte_bpe_50k.json"))
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)
    words = token_output.word_ids(vocabulary("word_bpe_49k.json")).encode([text])[0]
    assert np.frombuffer(words, "<u4").tolist() == libraries["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids


def test_a_very_long_word_merges_like_the_library(libraries):
    text = "abracadabra" * 3000
    assert np.frombuffer(bpe.tokenizer(vocabulary("byte_bpe_50k.json")).encode(text), "<u4").tolist() == libraries["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids


def test_segment_detects_damage():
    payload = token_output.pack_segment([3, None, 9], [2, 1, 0], np.array([5, 6, 7], np.uint32))
    docs, lengths, ids = token_output.unpack_segment(payload)
    assert docs == [3, None, 9] and lengths.tolist() == [2, 1, 0] and ids.tolist() == [5, 6, 7]
    with pytest.raises(ValueError):
        token_output.unpack_segment(payload[:30] + b"x" + payload[31:])


def test_token_ids_of_more_words_than_the_table_holds():
    coder = token_output.word_ids(vocabulary("word_bpe_49k.json"))
    n = token_output.SLOTS // 4 + 1000
    one, two = coder.encode(["a b", "b"])
    assert coder.encode(["x", "a b " * n, "", "b"]) == [coder.encode(["x"])[0], one * n, b"", two]
    assert b"".join(coder.encode(["b"] * (2 * n))) == two * (2 * n)


@pytest.mark.parametrize("size", [1, 2, 7, 30])
def test_token_ids_by_parts_are_those_of_whole_texts(monkeypatch, size):
    coder = token_output.word_ids(vocabulary("word_bpe_49k.json"))
    rng = random.Random(size)
    texts = ["", "a", " ", "\n", "x" * 90, *("".join(rng.choices("ab's é漢 \n\t1!", k=rng.randrange(80))) for _ in range(60)), coder.special[0] + " a"]
    monkeypatch.setattr(token_output, "PART_BYTES", size)
    want = [np.array(coder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder.encode(texts) == want


def _alike(n):
    """Two words of ``n`` letters whose letters a polynomial in any odd base cannot tell apart."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_mirrored_letters_differ(libraries, n):
    a, b = _alike(n)
    assert len(next(shingles.sets_of(pa.array([f"{a} x y {b} x y"]), 3))) == 4
    text = f"{a} {b} {a}x {b[:-1]}"
    got = token_output.word_ids(vocabulary("word_bpe_49k.json")).encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == libraries["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids


def test_words_of_one_hash_and_symbols_of_unknown_kind(libraries, monkeypatch):
    real = token_output.words_at

    def poor(data, starts, breaks):
        key, first, at = real(data, starts, breaks)
        return key & np.uint64(0x3F00000), first, at

    monkeypatch.setattr(token_output, "words_at", poor)
    own = token_output.WordIds(vocabulary("word_bpe_49k.json"))
    texts = ["supercalifragilistic supercalifragilistie supercalifragilistia " + " ".join(f"longer word{k}of{k}" for k in range(200)), "a\u0558b \u1c89 x"]
    for got, text in zip(own.encode(texts) * 2, texts * 2, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == libraries["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB \t\ncé"), max_size=30), max_size=6), st.integers(1, 5))
def test_shingles_are_sets_of_word_runs(texts, k):
    found = list(shingles.sets_of(pa.array(texts, pa.string()), k))
    names = {}
    for text, own in zip(texts, found, strict=True):
        words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        want = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
        assert len(want) == len(own) and (np.diff(own.astype(object)) > 0).all()
        names[frozenset(want)] = own.tobytes()
    assert len(set(names.values())) == len(names)


def test_warc_archive_round_trip_and_checks():
    pages = [(k, f"http://x/{k} é", f"<html>{'word ' * 50}{k % 7}</html>".encode(), None if k % 3 else k - 1) for k in range(40)]
    records = [warc.record(*p) for p in pages]
    archive = warc.pack(records)
    assert int.from_bytes(archive[:4], "little") == warc.DICTIONARY_FRAME
    back = list(warc.unpack(archive))
    assert [f["warc-type"] for f, _ in back] == ["revisit" if p[3] is not None else "response" for p in pages]
    assert [x for _, x in back] == [b"" if p[3] is not None else p[2] for p in pages]
    for bad in (archive[:-3], archive + b"junk"):
        with pytest.raises((ValueError, warc.zstandard.ZstdError)):
            list(warc.unpack(bad))
    with pytest.raises(ValueError):
        list(warc.unpack(warc.pack([records[0].replace(b"Content-Length: ", b"Content-Length: 1", 1)])))
    assert list(warc.unpack(warc.pack([]))) == []


def _foreign(kind, block, *headers):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Length: {len(block)}", *headers]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_archives_of_other_writers():
    page, zstd = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>", warc.zstandard
    digest, bad = f"WARC-Payload-Digest: sha1:{warc.digest(b'<p>')}", f"WARC-Block-Digest: sha1:{'A' * 32}"
    records = [_foreign("warcinfo", b"software: x\r\n"), _foreign("request", b"GET / HTTP/1.1\r\n\r\n"), _foreign("response", page), _foreign("response", page, digest, "X-Long: a", " b"), _foreign("metadata", b""), _foreign("resource", b"<p>", digest.replace(warc.digest(b"<p>"), __import__("hashlib").sha1(b"<p>").hexdigest()))]
    streamed = zstd.ZstdCompressor(write_content_size=False)
    skipped = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"xyz"
    archive = skipped.join(streamed.stream_reader(r).read() for r in records)
    got = list(warc.unpack(archive))
    assert [(f["warc-type"], p) for f, p in got] == [("warcinfo", b"software: x\r\n"), ("request", b""), ("response", b"<p>"), ("response", b"<p>"), ("metadata", b""), ("resource", b"<p>")]
    assert got[3][0]["x-long"] == "a b"
    for damaged in (_foreign("response", page, bad), _foreign("response", page.replace(b"<p>", b"<q>"), digest), _foreign("revisit", page)):
        with pytest.raises(ValueError):
            list(warc.unpack(zstd.compress(damaged)))


def test_audio_store_is_lossless_and_tensors_have_a_fixed_shape():
    for payload in (b"", b"x", bytes(64), bytes(range(256)) * 300):
        own = audio.padded(payload)
        assert len(own) % 64 == 0 and len(own) > 0 and own.startswith(payload)
        assert audio.from_wav(audio.to_wav(own)) == (own, audio.RATE_IN)
    t = np.arange(32000) / 16000
    tone = np.where((t > 0.5) & (t < 1.5), np.sin(2 * np.pi * 1000 * t), 0).astype(np.float32)
    slow = audio.resample(tone, 16000, 8000)
    assert len(slow) == 16000
    assert np.abs(slow[6000:10000] - np.sin(2 * np.pi * 1000 * np.arange(6000, 10000) / 8000)).max() < 0.02
    back = audio.resample(slow, 8000, 12000)
    assert np.abs(back[9000:15000] - np.sin(2 * np.pi * 1000 * np.arange(9000, 15000) / 12000)).max() < 0.02
    mel, energy = audio.log_mel(slow, 8000)
    (a, b), = audio.segments(energy)
    assert abs(a * audio.HOP / 8000 - 0.5) < 0.05 and abs(b * audio.HOP / 8000 - 1.5) < 0.05
    table = audio.tensors(audio._tensors(mel, 8000))
    assert table.schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.FRAMES, audio.MELS))
    assert table["start"][0].as_py() == 0 and sum(table["valid"].to_pylist()) == len(mel)
    assert audio.segments(np.full(5, -100.0)) == []


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 384, 385, 128 * 40 + 7, 128 * 41 + 128])
def test_spectra_by_pieces_are_those_of_the_whole(monkeypatch, n):
    x = np.random.default_rng(n).normal(size=n).astype(np.float32)
    whole = audio.log_mel(x, 8000)
    monkeypatch.setattr(audio, "PIECE", 7)
    for a, b in zip(whole, audio.log_mel(x, 8000), strict=True):
        assert a.shape == b.shape and np.allclose(a, b, atol=1e-5)
    assert len(whole[0]) == max(1, -(-(n - 256) // 128) + 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), min_size=1, max_size=4), st.integers(2, 3), st.integers(0, 10**6), st.floats(0, 3))
def test_viterbi_is_the_textbook_one(lengths, states, seed, penalty):
    rng = np.random.default_rng(seed)
    scores = rng.normal(size=(sum(lengths), states)).astype(np.float32)
    got, at = lang_id.viterbi(scores, np.array(lengths), penalty), 0
    for n in lengths:
        s, label = scores[at : at + n].astype(float), got[at : at + n]
        value = s[0].copy()
        for row in s[1:]:
            value = row + np.maximum(value, value.max() - penalty)
        mine = s[np.arange(n), label].sum() - penalty * (np.diff(label) != 0).sum()
        assert abs(mine - value.max()) < 1e-6
        at += n


def test_scripts_narrow_candidates():
    log = np.zeros((lang_id.BUCKETS, 2), np.float32)
    uses = np.zeros((len(lang_id.SCRIPT_NAMES), 2), bool)
    uses[lang_id.SCRIPT_NAMES.index("latin"), 0] = uses[lang_id.SCRIPT_NAMES.index("greek"), 1] = True
    scores, known = lang_id.Model(["en", "el"], log, uses).scores(["word", "λόγος", "слово"])
    assert known.tolist() == [True, True, False]
    assert scores.argmax(axis=1)[:2].tolist() == [0, 1] and scores[2].tolist() == [0, 0]


def test_trees_learn_an_interaction_and_flat_walk_agrees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    score = model.score(x[2000:])
    assert ((score > 0.5) == y[2000:]).mean() > 0.93
    nodes = model.feature.shape[1]
    raw = model.base
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
        k = 0
        while k < nodes:
            k = 2 * k + 1 + (x[2000, f[k]] > t[k])
        raw += leaf[k - nodes]
    assert abs(1 / (1 + np.exp(-raw)) - score[0]) < 1e-12
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit(x[:9], np.ones(9)).score(x[:2]) > 0.9).all()
    assert len(quality.statistics(None)) == len(quality.statistics("a | B!\n\n1")) == len(quality.FEATURES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 50)), min_size=1, max_size=6), st.integers(0, 300))
def test_fill_deals_all_that_fits(children, budget):
    weights, capacity = [float(w) for w, _ in children], [c for _, c in children]
    dealt = mixing.fill(budget, weights, capacity)
    assert sum(dealt) == min(budget, sum(capacity)) and all(0 <= d <= c for d, c in zip(dealt, capacity, strict=True))
    for (w, c), d in zip(children, dealt, strict=True):
        if d < c and w and sum(w for w, _ in children):  # who has room got a full share at least
            assert d + 1 >= int(budget * w / sum(w for w, _ in children))


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    out = mixing.budgets(leaves, {("a",): 1.0, ("b",): 1.0}, 200, 1)
    assert out == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    out = mixing.budgets(leaves | {("a", "y"): 20}, {}, 200, 1)
    assert out == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 170}
    assert mixing.budgets({}, {}, 5, 1) == {}


def test_license_templates_are_found_in_long_texts():
    index = license_scan.Index(license_scan.TEMPLATES)
    rng = random.Random(1)
    filler = [f"w{k}" for k in range(500)]
    for name, text in license_scan.texts().items():
        words = text.split()
        for before, cut in ((0, 0), (333, len(words) // 3)):  # whole, and with other words put in
            whole = [rng.choice(filler) for _ in range(before)] + words[:cut] + [rng.choice(filler) for _ in range(before // 8)] + words[cut:]
            assert name in [m[0] for m in license_scan.Index(license_scan.TEMPLATES | license_scan.texts()).find(" ".join(whole))], name
    for name, text in license_scan.TEMPLATES.items():
        for before, after in itertools.product((0, 1, 2, 3, 57), (0, 4, 90)):
            words = [rng.choice(filler) for _ in range(before)] + [text] + [rng.choice(filler) for _ in range(after)]
            assert name in [m[0] for m in index.find(" ".join(words))], (name, before, after)
    assert index.find(None) == index.find("") == index.find(" ".join(filler)) == []


def test_license_bands_against_exact_containment():
    """Of mutated templates that the span around some window contains at 0.8, the share found."""
    index = license_scan.Index(license_scan.TEMPLATES)
    rng, found, there = random.Random(5), 0, 0
    for name, text in license_scan.TEMPLATES.items():
        k = index.names.index(name)
        for rate in (0.0, 0.02, 0.04, 0.06):
            words = [w if rng.random() >= rate else f"z{rng.randrange(99)}" for w in text.split()]
            whole = " ".join([*(f"w{j}" for j in range(rng.randrange(60))), *words, *(f"v{j}" for j in range(40))])
            here, _ = license_scan.shingles(whole)
            if np.isin(index.sets[k], here).mean() >= license_scan.CONTAINMENT:
                there += 1
                found += any(m[0].split("-notice")[0] == name.split("-notice")[0] for m in index.find(whole))
    assert there > 60 and found / there >= 0.9


def test_top_k_in_a_shard_is_exact():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefghij" * 3 + "klmnopqrstuvwxyz", k=rng.randint(0, 40))).encode() for _ in range(500)]
    ids = np.array(rng.sample(range(10**6), 500))
    asked = [t.decode() for t in texts[:40]] + [""]
    own = topk.Queries(list(range(len(asked))), asked)
    doc, found, tf, length = topk.terms(texts)
    term, n = np.unique(found, return_counts=True)
    keep = np.isin(term, own.vocabulary)
    own.weigh(term[keep], n[keep], 500, int(length.sum()))
    best = topk.Best(len(asked), 7)
    for k in range(0, 500, 170):  # shards, and rows that repeat an id
        for end in (k + 170, k + 90):
            topk.search_shard(topk.Shard(topk.Shard.pack(ids[k:end].tolist(), texts[k:end])), own, best)
    got = {k: [(float(y), int(x)) for x, y in zip(best.id[k], best.score[k], strict=True) if y] for k in range(len(asked))}
    for k, text in enumerate(asked):
        points = {}
        for i in range(500):
            words, mine = texts[i].split(), 0
            for w in text.encode().split():
                f = words.count(w)
                if f:
                    df = int(n[np.searchsorted(term, topk.terms([w])[1][0])])
                    idf = np.log1p((500 - df + 0.5) / (df + 0.5))
                    mine += max(np.rint(topk.SCALE * (idf * f * (topk.K1 + 1) / (f + topk.K1 * (1 - topk.B + topk.B * len(words) / own.mean)))), 1)
            if mine:
                points[int(ids[i])] = mine
        want = sorted(((v, -i) for i, v in points.items()), reverse=True)[:7]
        assert got[k] == [(float(v), -i) for v, i in want]


@pytest.mark.parametrize("posting", [0, 30, 1 << 40])
def test_top_k_by_parts_is_exact_whatever_goes_into_the_product(monkeypatch, posting):
    for name, value in (("POSTING", posting), ("PART_DOCS", 20), ("BATCH", 16), ("PAIRS", 50)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(posting)
    tongues = [[f"{c}{k}" for k in range(60)] for c in "abc"]
    texts = [" ".join(rng.choices(tongues[k % 3], [1 / (1 + j) for j in range(60)], k=rng.choice([3, 30, 300]))).encode() for k in range(400)]
    shard = topk.Shard(topk.Shard.pack(list(range(400)), texts))
    # a part holds texts of one tongue
    assert len(shard.parts) > 4
    for a, b in zip(shard.parts[:-1].tolist(), shard.parts[1:].tolist(), strict=True):
        assert len({int(i) % 3 for i in shard.ids[a:b]}) == 1
    own = pickle.loads(pickle.dumps(topk.Queries(list(range(50)), [t.decode() for t in texts[:50]])))
    doc, found, tf, length = topk.terms(texts)
    own.weigh(*np.unique(found[np.isin(found, own.vocabulary)], return_counts=True), 400, int(length.sum()))
    best = topk.Best(50, 5)
    topk.search_shard(shard, own, best)
    at = np.searchsorted(own.vocabulary, found)
    known = np.isin(found, own.vocabulary)
    whole = np.zeros((400, len(own.vocabulary)))
    impact = np.rint(topk.SCALE * own.idf[at[known]] * tf[known] * (topk.K1 + 1) / (tf[known] + topk.K1 * (1 - topk.B + topk.B * length[doc[known]] / own.mean)))
    whole[doc[known], at[known]] = np.maximum(impact, 1)
    times = np.zeros((50, len(own.vocabulary)))
    times[doc[known & (doc < 50)], at[known & (doc < 50)]] = tf[known & (doc < 50)]
    points = times @ whole.T
    for k in range(50):
        want = np.lexsort((np.arange(400), -points[k]))[:5]
        assert best.id[k].tolist() == want.tolist() and np.abs(best.score[k] - points[k][want]).max() <= times[k].sum()


@pytest.mark.parametrize("name", ["GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "GPL-2.0-only", "GPL-3.0-only", "BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "MPL-2.0", "Apache-2.0"])
@pytest.mark.parametrize("before", [0, 37, 200])
def test_licenses_are_told_from_their_rivals(name, before):
    index = license_scan.Index(license_scan.TEMPLATES)
    text = " ".join([*(f"w{k}" for k in range(before)), license_scan.TEMPLATES[name], *(f"v{k}" for k in range(90))])
    found = {m[0].split("-notice")[0] for m in index.find(text)} - {"BSD"}
    assert found == {name}


@pytest.mark.parametrize("name", sorted(license_scan._NOTICES))
def test_notices_of_one_family_are_told_apart(name):
    index = license_scan.Index(license_scan.TEMPLATES | license_scan.texts())
    text = " ".join([*(f"w{k}" for k in range(37)), license_scan._NOTICES[name], *(f"v{k}" for k in range(90))])
    assert {m[0].split("-notice")[0] for m in index.find(text)} == {name.split("-notice")[0]}


@pytest.mark.parametrize("listed", [1, 24])
def test_partial_overlaps_are_summed_to_links(monkeypatch, listed):
    monkeypatch.setattr(ngram_join, "LISTED", listed)
    rng, rows, sets = random.Random(listed), [], {}
    for group in range(12):
        base = [rng.randrange(10**6) for _ in range(30)]
        for k in range(rng.choice([1, 2, 3, 40])):
            own = sorted({x if rng.random() > 0.04 else rng.randrange(10**6) for x in base})
            row = 100 * group + k
            sets[row] = set(own)
            for fragment, low in enumerate((0, 500_000)):
                part = np.array([x for x in own if low <= x < low + 500_000], np.uint64).tobytes()
                rows.append((group, 7, fragment, 0 if group % 2 else 1 + k % 2, row, len(own), 1 + k % 3, 5000 - row, part))
    rows.sort()
    names = ["key", "block", "fragment", "side", "row", "n", "size", "doc_id", "part"]
    whole = pa.Table.from_pydict({c: list(x) for c, x in zip(names, zip(*rows, strict=True), strict=True)})
    partial = pa.Table.from_batches(ngram_join._partial(iter(whole.to_batches(max_chunksize=17))))
    assert partial.num_rows == 24
    found = pa.Table.from_batches(ngram_join._summed(8, 10)(iter(partial.sort_by([("key", "ascending"), ("block", "ascending")]).to_batches(max_chunksize=3)))).to_pylist()
    about = {r[4]: r for r in rows}
    want = {}
    for x, y in itertools.permutations(sets, 2):
        both, side = len(sets[x] & sets[y]), (about[x][3], about[y][3])
        if x // 100 == y // 100 and (side[0] == 0 or side[0] != side[1]) and 10 * both >= 8 * len(sets[x] | sets[y]):
            want[x] = want.get(x, 0) + about[y][6]
    assert {r["row"]: r["others"] for r in found} == want and len(want) > 40
    assert all(r["root"] <= r["doc_id"] == 5000 - r["row"] for r in found)
