"""Plans: filters and columns reach the scan, and nothing becomes a cross join."""

import contextlib
import io

import pytest

from millrace import session
from millrace.plans import catalog, digests


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["signals_window", "due_deliveries", "digest_candidate_counts", "latest_delivery", "upsert_signals"])
def test_no_cross_join(name, spark, sf):
    assert "CartesianProduct" not in plan(catalog.queries()[name](spark, sf))


def test_signals_scan_is_pruned(spark, sf):
    shown = plan(catalog.queries()["signals_window"](spark, sf))
    assert "l_comment" not in shown and "o_totalprice" not in shown


@pytest.mark.parametrize("name", ["entity_groups", "merged_items", "digest_items", "select_source_aware"])
def test_signals_are_computed_once(name, spark, sf, monkeypatch):
    """The five-table join behind the signals is in one written stage; what reads it does not go back to lineitem."""
    scans = []
    monkeypatch.setattr(digests, "staged", lambda df: scans.append(plan(df).count("lineitem.parquet")) or session.staged(df))
    shown = plan(catalog.queries()[name](spark, sf))
    assert sum(n > 0 for n in scans) == 1 and "lineitem.parquet" not in shown
