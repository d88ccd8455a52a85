"""The contract's plan: tables by company are never sent whole to the driver."""

import re

from ledgerlens.bindings import texts

SF = "/root/testdata/sf0.001"


def test_only_short_lists_are_broadcast(spark):
    """Pages and the checklist's roles go to all tasks; cards, facts, quotes and sample sizes of all runs do not."""
    plan = texts.contract_audit(spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"BroadcastHashJoin \[(\w+)#", plan)
    assert sorted(joins) == ["expert_id", "page"], joins


def test_lines_without_numbers_end_behind_their_context(spark):
    """Only the first line of a document and lines with numbers reach the scan and the label patterns."""
    plan = texts.contract_audit(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Filter \(\(line#\d+ = 1\) OR", plan)


def test_results_are_dealt_by_rows(spark, monkeypatch):
    """A small file of scores makes long texts: tasks hold a bounded number of them, and documents are counted where they are."""
    monkeypatch.setattr(texts, "RESULTS_A_TASK", 20)
    found = texts.results(spark, SF)
    sizes = [n for n in found.select("ts_code").rdd.glom().map(len).collect()]
    assert len(sizes) == -(-sum(sizes) // 20) > 2 and max(sizes) < sum(sizes) / 2
    plan = texts.knowledge_pages(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ts_code" not in plan
