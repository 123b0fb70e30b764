"""Documents to training sequences: quality, near-duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of their input, also
those that they do not know. Only ``doc_id`` and ``text`` are needed. Decisions hold for rows: a row is known by its
``doc_id`` (null is a value like any other) and the hash of its text, so a repeated id does not carry a decision over to
another text. Of rows repeated in full one stays in near_duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslint.llm import decontaminate, near_dup, packing, rule_ensemble, secrets
from corpuslint.llm.common import checked_broadcast, fresh_folder, saved, table
from corpuslint.llm.queries import vocabulary


def _matches(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (``left_semi`` or ``left_anti``) with ``rows`` (doc_id, text_hash)."""
    text_hash = F.xxhash64(F.col("d.text").cast("string"))
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (text_hash == F.col("r.text_hash"))
    return docs.alias("d").join(rows.alias("r"), same, how)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return _matches(docs, checked_broadcast(dropped.select("doc_id", "text_hash").distinct()), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rule ensemble rejects."""
    scored = rule_ensemble.score_documents(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.filter("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates."""
    rows = saved(near_dup.near_duplicates(docs, similarity_percent=80).select("doc_id", "text_hash", "stays"))
    keys = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("stays").alias("stays"))
    # A kept row and its full repeats have one key: those are reduced to one row.
    repeated = checked_broadcast(keys.filter("stays AND n > 1").select("doc_id", "text_hash"))
    dropped = keys.filter("NOT stays OR n > 1")
    once = _matches(docs, repeated, "left_semi").withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    return _without(docs, dropped).unionByName(once.dropDuplicates(["doc_id", "_hash"]).drop("_hash"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars, if there is one, follows the text."""
    model = secrets.train(secrets.labelled_findings(spark))
    clean = secrets.redacted(docs, model)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary(), capacity=4096)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secret_scan), ("packing", pack),
]
ORACLE_SQL = None  # trees, minhashes and packing are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
