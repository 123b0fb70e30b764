"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    alignment, decontaminate, exact_dup, fill_in_middle, langid, near_dup, packing, rans, resharding, rule_ensemble, secrets,
    url_filter, weak_rules,
)
from .common import fresh_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=4096)


@query
def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rans.write(table(spark, sf_dir, "documents"), folder, vocabulary(), parts)
    return rans.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), similarity_percent=85)


@query
def op2_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.rate_documents(table(spark, sf_dir, "documents"))


@query
def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rule_ensemble.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


ORACLE["op10_url_filter"] = f"""
WITH rules(rule_host, rule_path, action) AS (VALUES {", ".join(map(repr, URL_RULES))}),
cut AS (
  SELECT page_id, coalesce(position('://' IN url), 0) AS colon,
         substr(url, position('://' IN url) + 3) AS rest FROM pages),
parts AS (
  SELECT page_id, CASE WHEN colon > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN colon > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM cut),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, max_by(struct_pack(r := rule_host || rule_path, a := action),
                            length(rule_host) + length(rule_path)) AS b
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL)
SELECT page_id, host, path, b.r AS rule, coalesce(b.a, 'allow') AS verdict
FROM parts LEFT JOIN best USING (host, path)"""


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_ids")


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.findings(table(spark, sf_dir, "documents"), model)
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value")


@query
def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy")


@query
def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The old layout is one by source, which a large source makes uneven.
    docs = table(spark, sf_dir, "documents").withColumn("source_shard", F.pmod(F.xxhash64("source"), F.lit(12)).cast("int"))
    made = resharding.plan(docs, "source_shard", 16)
    folder = fresh_folder(spark, "shards")
    resharding.rewrite(docs, "source_shard", made, folder)
    text = F.coalesce("text", F.lit(""))
    return resharding.reread(spark, docs, "source_shard", made, folder).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.restored(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE["op11_fill_in_middle"] = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || doc_id::VARCHAR) AS s FROM documents),
numbers AS (
  SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS h4 FROM drawn),
cuts AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""


@query
def op12_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ids are given in the order of arrival: those up to the middle are the history.
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("m")).first()["m"]
    return exact_dup.exact_duplicates(docs, F.col("doc_id") <= F.lit(middle))


ORACLE["op12_exact_dup"] = """
WITH m AS (SELECT (min(doc_id) + max(doc_id)) / 2 AS middle FROM documents),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id <= middle, false) AS old FROM documents, m),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, bool_or(old) AS known FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256, known FROM d JOIN g USING (t)"""


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    blocks = alignment.aligned_blocks(table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)
    digest = lambda d: F.when(d["groups"] == "", "").otherwise(F.sha2(d["groups"], 256))
    digests = F.transform("documents", lambda d: d.withField("groups_sha256", digest(d)).dropFields("groups"))
    folder = fresh_folder(spark, "aligned")
    blocks.withColumn("documents", digests).write.parquet(folder)
    return alignment.with_counts(spark.read.parquet(folder), keep="groups_sha256")
