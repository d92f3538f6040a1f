"""From raw documents to packed sequences: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import language_id, minhash, packing, quality, secrets
from rowloom.llm.common import shared_dir
from rowloom.llm.queries import CAPACITY, END_ID, table, tokenizer_json


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that no operator gives a column of its own, and those names; what else a table holds can't clash then."""
    names = {c: f"c_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the log-likelihood ratio keep. A null text goes."""
    rows, names = apart(docs)
    judged = quality.judge(rows, quality.fit(docs, table(spark, sf_dir, "labels")), text=names["text"])
    return back(judged.filter("kept"), names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that isn't rejected; `lang` stays what the source says."""
    rows, names = apart(docs)
    found = language_id.identify(rows, language_id.fit(docs), keep=tuple(rows.columns), text=names["text"])
    return back(found.filter(~F.col("rejected")), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links and of five-word similarity 0.8: that of the smallest doc_id. Rows without a doc_id stay; rows that repeat a doc_id stay together."""
    found = minhash.near_copies(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the spans of its secrets replaced, and n_chars to match."""
    rows, names = apart(docs)
    redacted = secrets.redact(secrets.scan(rows, keep=tuple(rows.columns), text=names["text"]), text=names["text"])
    size = F.char_length(names["text"]).cast(docs.schema["n_chars"].dataType)
    return back(redacted.withColumn(names["n_chars"], F.when(F.size("spans") > 0, size).otherwise(F.col(names["n_chars"]))), names)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences."""
    return packing.pack(docs, tokenizer_json(), capacity=CAPACITY, end_id=END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The language models and the packing program have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
