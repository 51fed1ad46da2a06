"""Queries of this subpackage by name, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import importance, repair, topk
from granary.llm.ann import op7_ann
from granary.llm.bestfit import op13_best_fit
from granary.llm.langid import op2_language
from granary.llm.lines import op10_line_dedup
from granary.llm.minhash import op4_minhash
from granary.llm.packing import op1_packing
from granary.llm.pieces import op5_pieces
from granary.llm.secrets import op9_secret_scan
from granary.llm.sharding import op3_sharding
from granary.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op3_sharding": op3_sharding,
    "op4_minhash": op4_minhash,
    "op5_pieces": op5_pieces,
    "op6_top_k": topk.op6_top_k,
    "op7_ann": op7_ann,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_importance": importance.op11_importance,
    "op12_repair": repair.op12_repair,
    "op13_best_fit": op13_best_fit,
}

SQL: dict[str, str] = {"op6_top_k": topk.SQL, "op11_importance": importance.SQL, "op12_repair": repair.SQL}
