"""A training corpus from raw documents: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents. The result of each is written as Parquet and read again.

A stage that drops rows judges each row by itself, whatever its doc_id: operators are given a 64-bit hash of the
whole row in place of the id, and its verdict is carried back on that. So rows without an id are judged like others,
and of rows that share an id but not a text only the bad ones go. Repeated rows have equal verdicts; the
near-duplicate stage keeps one of them. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import decontaminate, minhash, packing, quality, secret_scan
from loomlog.llm.common import by_ids, fresh, table, written


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of the whole row (but for maps and variants, which have no hash), and that column's name."""
    (name,) = fresh(docs, "row_key")
    return docs.withColumn(name, F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))), name


def without(rows: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """rows but those with a rejected key (column doc_id), without the key."""
    ids = written(rejected.select(F.col("doc_id").alias(name)).distinct(), "rejected")
    return by_ids(rows, ids, "left_anti", name).drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity bands go."""
    rows, name = keyed(docs)
    return without(rows, quality.judged(rows.select(F.col(name).alias("doc_id"), "text", "lang")).where("NOT kept"), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays (one without an id only if none has one)."""
    rows, name = keyed(docs)
    found = minhash.near_duplicates(rows.select(F.col(name).alias("doc_id"), "text")).select(F.col("doc_id").alias(name), "component_id").distinct()
    ids = rows.groupBy(name).agg(F.first("doc_id").alias("id"), F.count("*").alias("times"))
    found = written(found.join(ids, name), "components")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", name))[name].alias("doc_id"))
    kept = written(best.select("doc_id"), "kept")
    rejected = found.select(F.col(name).alias("doc_id"), "times").join(kept, "doc_id", "left_anti")
    again = written(found.where("times > 1").select(name).join(kept.withColumnRenamed("doc_id", name), name, "left_semi"), "repeated")
    if again.isEmpty():
        return without(rows, rejected, name)
    once = by_ids(rows, again, "left_semi", name).dropDuplicates([name]).drop(name)
    return without(rows, rejected.select("doc_id").union(again), name).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, name = keyed(docs)
    found = decontaminate.contamination(rows.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, found.where("contaminated"), name)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows."""
    out = secret_scan.scan(docs, secret_scan.BASE + secret_scan.EXTRA, out="_spans", redacted="text").drop("_spans")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", best_fit_packing),
]

#: The stages hold a language model and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
