"""Physical plans: what must be pushed down, and what must never appear."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewire.operators import articles as ar
from tidewire.operators import events as ev
from tidewire.operators import keys, terms
from tidewire.sources import articles as scans
from tidewire.sources import standins

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("R")))
def test_no_cross_joins_and_no_row_at_a_time_python(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_time_filters_reach_the_scan(spark, sf):
    events = standins.crawl_events(spark, sf)
    for df in (ev.in_window(events, standins.EVENTS_AS_OF, "1h"), ev.event_timeseries(events, standins.EVENTS_AS_OF, "1h")):
        text = plan(df)
        assert "GreaterThanOrEqual(ts," in text, text
    counts = plan(ev.class_counts(ev.in_window(events, standins.EVENTS_AS_OF, "1h"), "source_id"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in counts


def test_only_needed_columns_are_read(spark, sf):
    text = plan(terms.term_frequency(terms.tokenize_articles(standins.articles(spark, sf))))
    assert "ReadSchema: struct<text:string>" in text


def test_archive_reads_only_the_years_in_range(spark, sf, tmp_path):
    path = str(tmp_path / "archive")
    scans.write_articles(standins.articles(spark, sf), path)
    df = scans.read_articles(spark, path, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 12))
    text = plan(df)
    assert "PartitionFilters: [isnotnull(pub_year" in text and "GreaterThanOrEqual(published_at" in text
    years = sorted(p.name for p in (tmp_path / "archive").iterdir() if p.name.startswith("pub_year"))
    assert years == ["pub_year=2025", "pub_year=2026"]


def test_rank_filters_run_before_the_shuffle(spark, sf):
    events = standins.crawl_events(spark, sf)
    text = plan(keys.top_per(events, ["source_id"], [F.desc("created_at")], 5))
    assert text.count("WindowGroupLimit") == 2


def test_top_k_needs_no_full_sort(spark, sf):
    for df in (ar.paginate(standins.articles(spark, sf).select("id", "title"), 3, 20), ev.recent_signals(standins.crawl_events(spark, sf))):
        text = plan(df)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_tokens_are_computed_once(spark, sf):
    text = plan(terms.term_frequency(terms.tokenize_articles(standins.articles(spark, sf))))
    assert text.count("regexp_extract_all") <= 2  # once in the projection, once in its generator's input


@pytest.mark.parametrize("name", ["J4_next_session", "K7_save_targets", "K8_apply_backtest", "M7_backtest_returns", "M7b_backtest_from_open"])
def test_daily_bars_are_made_once(name, spark, sf, monkeypatch):
    made, real = [], standins.stock_daily
    monkeypatch.setattr(standins, "stock_daily", lambda *args: made.append(args) or real(*args))
    text = plan(QUERIES[name](spark, sf))
    assert len(made) == 1 and "l_shipdate" not in text, text
