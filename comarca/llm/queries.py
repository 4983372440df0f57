"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from comarca.llm import (
    decontaminate,
    filter_audit,
    html_text,
    jaccard_join,
    language,
    line_dedup,
    packing,
    preference,
    sharding,
    simhash,
    topk,
    toxicity,
    whitening,
)
from comarca.session import configure


def _configured(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(configure(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _configured(run)
    for name, run in {
        "op1_packing": packing.op1_packing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_html_text": html_text.op3_html_text,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_topk": topk.op6_topk,
        "op7_sharding": sharding.op7_sharding,
        "op8_language": language.op8_language,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_preference": preference.op10_preference,
        "op11_simhash": simhash.op11_simhash,
        "op12_whitening": whitening.op12_whitening,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }.items()
}

ORACLES: dict[str, str] = {
    "op4_decontamination": decontaminate.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op6_topk": topk.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_preference": preference.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
