"""Queries of this package and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickvault.llm import imatch, jaccard_join, licenses, negatives, packing, piece_fst, quality, quotes, runs, secrets, simhash, token_files, toxicity
from tickvault.llm.common import importable


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    return run


_QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_imatch": imatch.query,
    "op3_toxicity": toxicity.query,
    "op4_packing": packing.query,
    "op5_quote_links": quotes.query,
    "op6_secret_scan": secrets.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_license_scan": licenses.query,
    "op9_token_files": token_files.query,
    "op10_piece_fst": piece_fst.query,
    "op11_simhash": simhash.query,
    "op12_periodic_runs": runs.query,
    "op13_hard_negatives": negatives.query,
}

QUERIES = {name: _ready(query) for name, query in _QUERIES.items()}

SQL = {
    "op1_quality_rules": quality.oracle(),
    "op5_quote_links": quotes.SQL,
    "op13_hard_negatives": negatives.SQL,
}
