"""The operators as queries on the given tables, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberwatch.llm.bpe import op10_bpe
from emberwatch.llm.contamination import OP5_SQL, op5_decontamination
from emberwatch.llm.html import op4_html_extraction
from emberwatch.llm.kdtree import op9_kd_sharding
from emberwatch.llm.lines import OP8_SQL, op8_line_dedup
from emberwatch.llm.merkle import OP11_SQL, op11_merkle_manifest
from emberwatch.llm.minhash import OP12_SQL, op12_minhash
from emberwatch.llm.ngram import op2_quality_classifier
from emberwatch.llm.pii import op7_pii
from emberwatch.llm.rules import OP1_SQL, op1_quality_rules
from emberwatch.llm.search import OP13_SQL, op13_ranked_search
from emberwatch.llm.simhash import op3_simhash
from emberwatch.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quality_rules,
        op2_quality_classifier,
        op3_simhash,
        op4_html_extraction,
        op5_decontamination,
        op6_toxicity,
        op7_pii,
        op8_line_dedup,
        op9_kd_sharding,
        op10_bpe,
        op11_merkle_manifest,
        op12_minhash,
        op13_ranked_search,
    )
}

SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op5_decontamination": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_minhash": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
