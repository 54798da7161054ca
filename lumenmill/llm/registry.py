"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracles
from .bm25_search import op2_bm25_search
from .byte_bpe import op10_byte_bpe
from .html_text import op3_html_text
from .license_scan import op9_license_scan
from .line_dedup import op7_line_dedup
from .near_dedup import op5_near_dedup
from .quality_net import op1_quality_net
from .quality_rules import op4_quality_rules
from .secret_scan import op8_secret_scan
from .source_mix import op6_source_mix



def _rule_counts(spark, sf_dir: str):
    """The part of op4 that SQL can say."""
    return op4_quality_rules(spark, sf_dir).drop("kept", "score")


def _mix_targets(spark, sf_dir: str):
    """The part of op6 that SQL can say."""
    return op6_source_mix(spark, sf_dir).select("doc_id", "size", F.col("source_size"), F.round("target", 4).alias("target"))


QUERIES = {
    "op1_quality_net": op1_quality_net,
    "op2_bm25_search": op2_bm25_search,
    "op3_html_text": op3_html_text,
    "op4_quality_rules": op4_quality_rules,
    "op5_near_dedup": op5_near_dedup,
    "op6_source_mix": op6_source_mix,
    "op7_line_dedup": op7_line_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_license_scan": op9_license_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "rule_counts": _rule_counts,
    "mix_targets": _mix_targets,
}

SQL: dict[str, str] = dict(oracles.SQL)
