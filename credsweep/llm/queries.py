"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from credsweep.llm import bpe, collocations, fingerprints, html_extract, licenses, linking, mixing, neighbours, ngram_join, runs, sharding, tensored, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1,
        "op2_html_extraction": html_extract.op2,
        "op3_ngram_join": ngram_join.op3,
        "op4_fingerprints": fingerprints.op4,
        "op5_license_scan": licenses.op5,
        "op6_sharding": sharding.op6,
        "op7_token_counts": token_counts.op7,
        "op8_bpe": bpe.op8,
        "op9_toxicity": toxicity.op9,
        "op10_neighbours": neighbours.op10,
        "op11_minhash": tensored.op11,
        "op12_collocations": collocations.op12,
        "op13_run_detection": runs.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_join": linking.components_sql(80),
        "op11_minhash": f"SELECT *, doc_id = component_id AS kept FROM ({linking.components_sql(85)})",
        "op12_collocations": collocations.OP12_SQL,
    }
