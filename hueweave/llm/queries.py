"""The queries of this subpackage: each applies its operator to its whole table; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hueweave.llm import mixing, pieces, quality, secret_scan, sharding, simhash, spotsigs, token_files, topk, url_filter
from hueweave.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def _on(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": _on("documents", pieces.op2),
    "op3_sharding": _on("documents", sharding.op3),
    "op4_topk": _on("embeddings", topk.op4),
    "op5_secrets": _on("documents", secret_scan.op5),
    "op6_spotsigs": _on("documents", spotsigs.op6),
    "op7_mixing": _on("documents", mixing.op7),
    "op8_url_filter": _on("pages", url_filter.op8),
    "op9_token_files": _on("documents", token_files.op9),
    "op10_simhash": _on("documents", simhash.near_duplicates),
}

SQL: dict[str, str] = {"op3_sharding": sharding.SQL, "op4_topk": topk.SQL, "op8_url_filter": url_filter.SQL}
