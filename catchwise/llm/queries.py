"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from catchwise.llm import audit, bpe, exact, forest, hyperplanes, language, minhash, mixing, pii, quality, secrets, shards, whitening
from catchwise.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), bpe.tokenizer_path())
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: CRC-32 of a text's bytes in SQL: a table of 256 remainders, then one step a byte.
CRC_SQL = """
rem AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r FROM range(256) AS g(i))),
hexed AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, (2 * k + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT])), 4294967295) AS text_crc32 FROM hexed, rem)"""


@query("op1_sampled_splitters", f"""
WITH {CRC_SQL},
sized AS (SELECT doc_id, md5(text) AS g, strlen(text) + 1 AS size, text_crc32 FROM summed),
placed AS (SELECT *, (sum(size) OVER ())::HUGEINT AS total, (sum(size) OVER (PARTITION BY g))::HUGEINT AS gs, (sum(size) OVER (ORDER BY g))::HUGEINT AS ge,
    (sum(size) OVER (ORDER BY g, doc_id ROWS UNBOUNDED PRECEDING))::HUGEINT AS e, row_number() OVER (ORDER BY g, doc_id) AS rank FROM sized),
dealt AS (SELECT *, least(7, (CASE WHEN gs * 1600 <= total THEN ge - gs ELSE e - size END) * 8 // total)::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM dealt""")
def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``; a null text counts as an empty one."""
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"))
    made = shards.shards(docs, F.col("text_md5"), F.col("doc_id"), F.col("size"), 8)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_subset_sum")
def op5_subset_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    made = mixing.mix(docs, "doc_id", "source", mixing.words("text"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op6_multipart_secrets")
def op6_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op2_feistel_pseudonyms")
def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), pii.DEMO_KEY)
    return made.select("doc_id", "text", "n_found", "spans")


@query("op7_viterbi_language")
def op7_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.select("doc_id", "text", "lang"), "lang", quality.fold("doc_id", 3) != 1)
    made = language.identify(docs.select("doc_id", "text"), model)
    return made.select("doc_id", F.coalesce(quality.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_byte_cnn")
def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", quality.fold("doc_id", 5) != 0)
    made = quality.classify(docs, net)
    return made.select("doc_id", F.coalesce(quality.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op3_circulant_minhash", """
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
listed AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [md5(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' ')))) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n_shingles, s FROM listed),
flat AS (SELECT doc_id, unnest(s) AS x FROM sized),
shared AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT i, j FROM shared JOIN sized p ON p.doc_id = i JOIN sized q ON q.doc_id = j WHERE 100 * c >= 80 * (p.n_shingles + q.n_shingles - c)),
sym AS (SELECT i AS a, j AS b FROM link UNION ALL SELECT j, i FROM link),
walk(a, b) AS (SELECT a, b FROM sym UNION SELECT walk.a, sym.b FROM walk JOIN sym ON sym.a = walk.b),
least_of AS (SELECT a, min(b) AS m FROM walk GROUP BY a)
SELECT doc_id, n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM sized LEFT JOIN least_of ON a = doc_id""")
def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(documents(spark, sf_dir).select("doc_id", "text"), 4, 80)


@query("op4_sign_hashing", """
WITH RECURSIVE good AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS i, b.vec_id AS j FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
walk(a, b) AS (SELECT i, j FROM link UNION SELECT walk.a, link.j FROM walk JOIN link ON link.i = walk.b),
least_of AS (SELECT a, min(b) AS m FROM walk GROUP BY a),
many AS (SELECT i, count(*) AS n FROM link GROUP BY i)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN many ON i = vec_id LEFT JOIN least_of ON a = vec_id""")
def op4_sign_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplanes.groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label", 0.93)


@query("op8_projection_forest", """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs QUALIFY rank <= 20""")
def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 8)


@query("op12_stateful_stream", """
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM normal""")
def op12_stateful_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(spark, f"{sf_dir}/documents.parquet")


@query("op13_filter_audit", """
WITH RECURSIVE split AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
failing AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS f FROM split),
counted AS (SELECT part, f, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS bad FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
ordered(o) AS (SELECT x FROM letters UNION ALL SELECT o || x FROM ordered JOIN letters ON NOT contains(o, x)),
steps AS (SELECT o AS filter_order, k::INT AS step, o[k] AS own, o[1:k - 1] AS before FROM ordered, range(1, 6) AS g(k) WHERE length(o) = 5),
judged AS (SELECT part, filter_order, step, own, f, n, good, bad, contains(f, own) AS fails, len(list_intersect(string_split(f, ''), string_split(before, ''))) > 0 AND f <> '' AND before <> '' AS gone FROM counted, steps),
summed AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM summed""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
