"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from spanrank.llm import bpe, compaction, decontaminate, fmindex, lines, neardup, pii, quality, suffixes, urls
from spanrank.llm.common import table


def op1_line_dedup(spark, sf_dir):
    return lines.op1(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark, sf_dir):
    return quality.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filters(spark, sf_dir):
    return urls.op8(table(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark, sf_dir):
    return suffixes.op4(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark, sf_dir):
    return neardup.op5(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark, sf_dir):
    return bpe.encoded(table(spark, sf_dir, "documents"))


def op7_compaction(spark, sf_dir):
    return compaction.op7(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return fmindex.op9(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.op10(table(spark, sf_dir, "documents"))


def quality_base_counts(spark, sf_dir):
    """What of operator 3 SQL can say: the counts and the base rules."""
    return quality.base(table(spark, sf_dir, "documents"))


def url_rules(spark, sf_dir):
    """What of operator 8 SQL can say: hosts, paths and rules."""
    return urls.ruled(table(spark, sf_dir, "pages"))


def pii_base_spans(spark, sf_dir):
    """What of operator 10 SQL can say: the base spans."""
    return pii.based(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_decontamination,
        op3_quality_rules,
        op4_suffix_array_dedup,
        op5_minhash_near_dedup,
        op6_bpe_codec,
        op7_compaction,
        op8_url_filters,
        op9_substring_dedup,
        op10_pii,
        quality_base_counts,
        url_rules,
        pii_base_spans,
    )
}
