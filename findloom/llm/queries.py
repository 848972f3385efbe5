"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.llm import exact_dedup, html_template, line_dedup, mixing, nn_descent, packing, pii, pseudo_likelihood, setsketch, source_audit, sql, toxicity, url_filter, vector_codes
from findloom.llm.tokenizer_files import TOKENIZER


ROOT = str(Path(__file__).resolve().parents[2])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; Python workers are told where this package is, wherever the driver was started."""
    had = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in had.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{had}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, toxicity.grades_of(_table(spark, sf_dir, "labels"))))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.delete_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(_table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "documents")
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_line_dedup, op3_nn_descent, op4_html_text, op5_setsketch_dedup, op6_pii, op7_exact_dedup, op8_mixing, op9_packing, op10_pseudo_likelihood, op11_url_filter, op12_source_audit, op13_vector_codes]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": sql.OP7_SQL, "op11_url_filter": sql.url_filter_sql(url_filter.ALPHABET), "op12_source_audit": sql.OP12_SQL, "op13_vector_codes": sql.vector_codes_sql()}
