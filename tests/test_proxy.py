"""The derived tables: what is exchanged and what is stored."""

import os

import pytest

from ledgerlens.bindings import proxy
from ledgerlens.operators import peers
from ledgerlens.plans import company as C

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("base", [proxy.quarter_base, proxy.year_base, proxy.daily])
def test_lines_are_exchanged_before_they_are_summed(spark, base):
    """Sums of one task are as many as its lines where companies are spread over all files, and wider."""
    above, *below = plan(base(spark, SF)).split("Exchange ")
    assert len(below) == 1 and "HashAggregate" in above and "Aggregate" not in below[0]


def test_quotes_are_read_off_the_stored_days(spark):
    t = proxy.tables(spark, SF)
    days = t["day_sums"]
    for name in ("daily_basic", "daily_quotes"):
        assert t[name].count() == days.count() and not os.path.exists(f"{t.folder}/{name}")


def test_quotes_of_other_days_are_not_exchanged(spark, monkeypatch):
    """The newest dates cut the quotes where they are scanned."""
    seen = []
    monkeypatch.setattr(peers, "materialize", lambda df, purpose: seen.append(df) or df)
    peers.measures(C.peer_inputs(proxy.tables(spark, SF)), C.day(proxy.AS_OF))
    quotes = [part for part in plan(seen[0]).split("Exchange ") if "pe_ttm" in part or "earn" in part]
    assert any("BroadcastHashJoin" in part and "LeftSemi" in part and "earn" in part for part in quotes)
