"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from fixloom.llm import canonical, components, consensus, leakage, overlap, packing, representative, spam, splits
from fixloom.llm.sql import SQL
from fixloom.plans.tables import table

__all__ = ["QUERIES", "SQL"]

QUERIES = {
    "p1_found": lambda spark, d: overlap.found(table(spark, d, "entries")),
    "p1_report": lambda spark, d: overlap.overlap_report(table(spark, d, "entries")),
    "p1_commits": lambda spark, d: overlap.commit_overlaps(table(spark, d, "entries")),
    "p3_found": lambda spark, d: components.group_members(table(spark, d, "relationship_edges"), "url1", "url2").toDF("group_url", "url"),
    "p3_sizes": lambda spark, d: components.group_report(table(spark, d, "relationship_edges"), "url1", "url2").toDF("group_url", "n_members"),
    "p5_found": lambda spark, d: representative.found(table(spark, d, "entries"), table(spark, d, "src_catalog")),
    "p5_consensus": lambda spark, d: consensus.consensus_records(table(spark, d, "entries"), table(spark, d, "src_catalog")),
    "p5_majority": lambda spark, d: consensus.majorities(table(spark, d, "entries"), table(spark, d, "src_catalog")),
    "p6_found": lambda spark, d: canonical.copies(table(spark, d, "raw_records")),
    "p6_collapsed": lambda spark, d: canonical.collapsed(table(spark, d, "raw_records")),
    "p7_found": lambda spark, d: splits.found(table(spark, d, "entries")),
    "p7_split": lambda spark, d: splits.grouped_split(table(spark, d, "entries")),
    "p7_labels": lambda spark, d: splits.split_labels(table(spark, d, "entries")),
    "p7_check": lambda spark, d: splits.split_check(table(spark, d, "entries")),
    "p8_pack": lambda spark, d: packing.packed(table(spark, d, "documents"), table(spark, d, "pack_targets")),
    "p8_fill": lambda spark, d: packing.fill_report(table(spark, d, "documents"), table(spark, d, "pack_targets")),
    "p8_check": lambda spark, d: packing.packing_check(table(spark, d, "documents"), table(spark, d, "pack_targets")),
    "p9_found": lambda spark, d: leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p9_report": lambda spark, d: leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p10_found": lambda spark, d: spam.found(table(spark, d, "documents")),
    "p10_reasons": lambda spark, d: spam.spam_pages(table(spark, d, "documents")),
}
