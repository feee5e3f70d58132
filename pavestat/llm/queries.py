"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, conversations, lang_id, license_scan, mixing, ngram_join, quality, simhash, token_output, topk, warc, whitening
from .common import fold_of, spread, written


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_output.round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, num=90, den=100)


def branches() -> list:
    """Domain (text is alphabetical, numbered sources are dealt to three), language, source."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    domain = F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), F.pmod(number, F.lit(3)).cast("int") + 1)
    return [domain, "lang", "source"]


#: Target weights of the first two levels; sources weigh alike.
WEIGHTS = {("web",): 5.0, ("books",): 3.0, ("code",): 2.0} | {(d, lang): w for d in ("web", "books", "code") for lang, w in (("en", 4.0), ("fr", 2.0), ("de", 2.0), ("es", 2.0))}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = mixing.mix(docs, branches(), WEIGHTS, share=0.8, epochs=2, seed=7)
    return rows.select("doc_id", "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of("doc_id", 5) != 0)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = audio.features(written(audio.store(docs), "media"))
    digest = F.concat_ws(":", F.col("frames").cast("string"), F.size("segments").cast("string"), F.sha2("tensors", 256))
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), digest.alias("feature"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), decoded="back")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("back", "utf-8"), 256).alias("decoded_sha256"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 50 == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.train(docs.where(fold_of("doc_id", 4) != 2))
    found = lang_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = whitening.identity_error(rows, model)
    found = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    share = F.element_at(F.lit(model.explained), F.col("place") + 1) if model.explained else F.lit(None).cast("double")
    return found.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, distance=4)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damaged(rows), F.col("present"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_output, op2_ngram_join, op3_mixing, op4_warc, op5_quality, op6_audio, op7_bpe, op8_topk, op9_license_scan, op10_lang_id, op11_whitening, op12_simhash, op13_conversation_repair]
    return {f.__name__: f for f in found}


#: Words of whole texts, A to Z folded; the set of shingles of three; links by brute force
#: over all pairs that share a shingle; classes of equal sets; components by reach.
OP2_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
 ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM s),
 x AS (SELECT s.doc_id, n.n, unnest(s.s) AS g FROM s JOIN n ON s.doc_id = n.doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 90 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 r(id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, p.b FROM r JOIN p ON r.other = p.a),
 c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id), l AS (SELECT a, count(*) AS links FROM p GROUP BY a)
 SELECT n.doc_id AS doc_id, n.n::BIGINT AS n_shingles, component_id, class_id, coalesce(links, 0)::BIGINT AS n_links FROM n JOIN c ON n.doc_id = c.id LEFT JOIN l ON n.doc_id = l.a"""

#: Base32 from the hexadecimal SHA-1: five of its digits are four of base32.
OP4_SQL = """WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
 SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha, (5 * (k // 4) + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h"""


#: BM25 in whole numbers, by all postings: no index, no pruning.
OP8_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
 d AS (SELECT doc_id, len(w) AS n FROM w), g AS (SELECT count(*) AS docs, sum(n) AS words FROM d), t AS (SELECT doc_id, unnest(w) AS t FROM w), c AS (SELECT doc_id, t, count(*) AS tf FROM t GROUP BY 1, 2),
 f AS (SELECT t, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c, g GROUP BY t, docs),
 i AS (SELECT c.doc_id, c.t, greatest(round_even({topk.SCALE} * (f.idf * c.tf * {topk.K1 + 1} / (c.tf + {topk.K1} * (1 - {topk.B} + {topk.B} * d.n / (g.words / g.docs)))), 0), 1) AS impact FROM c JOIN f ON c.t = f.t JOIN d ON c.doc_id = d.doc_id, g),
 s AS (SELECT q.doc_id AS query_id, i.doc_id AS doc_id, sum(q.tf * i.impact) AS points FROM c q JOIN i ON q.t = i.t WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, doc_id, points / {topk.SCALE} AS score FROM r WHERE rank <= 10"""


def _edited(state: str, cost: str | int, letters: str) -> str:
    """A state of the SQL below, twelve digits of cost and then the audit, after more edits."""
    return f"(lpad((substr({state}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || '{letters}')"


def _op13_sql() -> str:
    """All ways through the lattice, a row at a time: no order of search, no heuristic. States are
    strings that compare by cost, then audit; null where there is no way. The check sum is
    worked out bit by bit."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    write = lambda state, initial: f"CASE WHEN must THEN NULL WHEN initial = '{initial}' THEN {_edited(state, 'torn', 'K')} ELSE {_edited(state, '(torn + 1)', 'R')} END"
    stepped = ", ".join([
        f"{_edited('c0', 2, 'D')} AS t0",
        f"least({_edited('c1', 2, 'D')}, CASE WHEN NOT must AND initial = 's' THEN {_edited('c0', 'torn', 'K')} END) AS t1",
        f"least({_edited('c2', 2, 'D')}, {write('c0', 'u')}, {write('c1', 'u')}, {write('c3', 'u')}) AS t2",
        f"least({_edited('c3', 2, 'D')}, {write('c2', 'a')}) AS t3",
    ])
    closed = f"t0, t1, least(t2, {_edited('t0', 5, 'I')}, {_edited('t1', 5, 'I')}, {_edited('t3', 5, 'I')}), least(t3, {_edited('t2', 5, 'I')}, {_edited('t0', 10, 'II')}, {_edited('t1', 10, 'II')})"
    return rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS k FROM conversations),
 g AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
 n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g),
 f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'o' END AS fault FROM n),
 r AS (SELECT *, fault IN ('b', 'd') AS must, CASE fault WHEN 't' THEN 5 ELSE 0 END AS torn, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
 s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts FROM r GROUP BY conv_id),
 p(conv_id, i, c0, c1, c2, c3) AS (SELECT DISTINCT conv_id, 0::BIGINT, '000000000000', NULL::VARCHAR, '000000000005I', '000000000010II' FROM conversations
  UNION ALL SELECT conv_id, i, {closed} FROM (SELECT p.conv_id, r.i, {stepped} FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i + 1)),
 e AS (SELECT p.conv_id, s.* EXCLUDE (conv_id), least(c0, c3) AS way FROM p LEFT JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id WHERE p.i = coalesce(s.n, 0)),
 a AS (SELECT *, substr(way, 13) AS audit, length(replace(substr(way, 13), 'D', '')) AS m FROM e),
 o AS (SELECT *, list_transform(list_filter(range(1, length(audit) + 1), lambda x: substr(audit, x, 1) <> 'D'), lambda x: {{'letter': substr(audit, x, 1), 'row': length(replace(substr(audit, 1, x), 'I', '')), 'place': length(replace(substr(audit, 1, x), 'D', ''))}}) AS edits FROM a)
 SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 substr(way, 1, 12)::BIGINT AS cost, audit, sha256(coalesce(array_to_string(list_transform(edits, lambda x: CASE WHEN x.letter = 'K' THEN roles[x.row] WHEN (x.place - m % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
 || ':' || CASE WHEN x.letter = 'I' THEN '' ELSE texts[x.row] END), chr(10)), '')) AS repaired_sha256 FROM o"""


OP13_SQL = _op13_sql()


def oracle_sql() -> dict[str, str]:
    """What SQL can say of whole tables; the others have brute-force tests."""
    return {"op2_ngram_join": OP2_SQL, "op4_warc": OP4_SQL, "op8_topk": OP8_SQL, "op13_conversation_repair": OP13_SQL}
