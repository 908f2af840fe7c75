"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_model, licenses, mixing, multiset_hash, packing, quality_classifier, quality_rules, secrets, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_packing": packing.op4_packing,
        "op5_language_model": language_model.op5_language_model,
        "op6_simhash": simhash.op6_simhash,
        "op7_mixing": mixing.op7_mixing,
        "op8_multiset_hash": multiset_hash.op8_multiset_hash,
        "op9_secrets": secrets.op9_secrets,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.OP7_SQL, "op9_secrets": secrets.op9_sql(), "op10_licenses": licenses.op10_sql()}
