"""Streams over several micro-batches against their batch forms, and replays."""

import datetime as dt
import os
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import events as ev
from tidewire.operators import keys, sinks, terms
from tidewire.sources import standins
from tidewire.streaming import operators as st
from tidewire.streaming import rate_audit, runs


def split(df, folder, order, n=3):
    """Write a table as n files in time order, so that a stream sees n micro-batches."""
    parts = df.withColumn("part", F.ntile(n).over(Window.orderBy(order)))
    for i in range(1, n + 1):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
        newest = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (time.time() - 100 + i, time.time() - 100 + i))
    return folder


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_event_counts_over_batches(spark, sf, tmp_path):
    events = standins.crawl_events(spark, sf)
    folder = split(events, str(tmp_path / "in"), "created_at")
    stream = runs.file_stream(spark, folder, events.schema, files_per_batch=1)
    runs.write_batches(st.event_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = runs.read_latest(spark, str(tmp_path / "out"), ["start", "source_id"])
    assert runs.read_batches(spark, str(tmp_path / "out")).select("batch").distinct().count() >= 3
    assert rows(got.select("start", "source_id", *ev.CLASSES)) == rows(st.event_counts(events))


def gaps_of(spark, out):
    return rows(runs.read_latest(spark, out, ["id"]).select("id", F.coalesce("gap_seconds", F.lit(-1.0))))


def test_gaps_over_batches_in_any_order_and_restart(spark, sf, tmp_path):
    events = standins.crawl_events(spark, sf)
    calls = events.where(ev.event_class().isin(list(ev.REQUEST_CLASSES))).select("id", "source_id", "created_at")
    want = rows(keys.gap_to_previous(calls, "source_id", "created_at", "id").select("id", F.coalesce("gap_seconds", F.lit(-1.0))))
    mixed = events.withColumn("mix", F.xxhash64("id"))
    own = rate_audit.state_session(spark)
    for name, data, by, lateness in (("time", events, "created_at", "10 minutes"), ("mixed", mixed, "mix", "60 days")):
        folder = split(data, str(tmp_path / name / "in"), by)
        stream = runs.file_stream(own, folder, data.schema, files_per_batch=1)
        out, cp = str(tmp_path / name / "out"), str(tmp_path / name / "cp")
        rate_audit.write_gaps(stream, out, cp, lateness, 60).awaitTermination()
        assert gaps_of(spark, out) == want
        # a batch that was written but not recorded as done runs again after a restart
        commits = sorted((tmp_path / name / "cp" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
        for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
            f.unlink(missing_ok=True)
        rate_audit.write_gaps(stream, out, cp, lateness, 60).awaitTermination()
        assert gaps_of(spark, out) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != own.conf.get("spark.sql.streaming.stateStore.providerClass")


def stream_of(own, spark, folder, batches, lateness="10 minutes"):
    """A stream of calls (id, seconds, source), a batch after another."""
    at = lambda s: dt.datetime(2026, 1, 1, 12) + dt.timedelta(seconds=s)
    shape = "id long, source_id int, event_type string, created_at timestamp_ntz"
    for i, b in enumerate(batches):
        spark.createDataFrame([(k, source, "article_ingest", None if s is None else at(s)) for k, s, source in b], shape).coalesce(1).write.parquet(str(folder / f"b{i}"))
        for f in (folder / f"b{i}").glob("*.parquet"):
            f.rename(folder / f"{i}.parquet")
            os.utime(folder / f"{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    return runs.file_stream(own, str(folder), spark.read.parquet(str(folder / "0.parquet")).schema, files_per_batch=1)


def test_late_calls_restate_their_successors(spark, tmp_path):
    batches = [[(1, 0, 1), (2, 60, 1)], [(3, 30, 1), (4, 90, 1), (2, 60, 1)], [(5, -10, 1)]]
    stream = stream_of(rate_audit.state_session(spark), spark, tmp_path / "in", batches)
    rate_audit.write_gaps(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert gaps_of(spark, str(tmp_path / "out")) == [(1, 10.0), (2, 30.0), (3, 30.0), (4, 30.0), (5, -1.0)]


def test_closed_calls_leave_their_last_and_quiet_sources_are_forgotten(spark, tmp_path):
    day = 86_400
    batches = [[(1, 0, 1), (2, 100, 1), (3, 50, None), (4, None, 1)], [(5, 5000, 1), (6, 5000, 1), (7, 90 * 60, 2)], [(8, 9000, None)], [(9, 20 * day, 2)], [(10, 20 * day + 9000, 1)], [(11, 20 * day + 9000, 1)]]
    stream = stream_of(rate_audit.state_session(spark), spark, tmp_path / "in", batches)
    rate_audit.write_gaps(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = gaps_of(spark, str(tmp_path / "out"))
    assert got == [(1, -1.0), (2, 100.0), (3, -1.0), (5, 4900.0), (6, 0.0), (7, -1.0), (8, 8950.0), (9, -1.0), (10, -1.0), (11, 0.0)]


def test_stream_queries_read_tables_of_several_files(spark, sf, tmp_path):
    import __spark_entry__ as entry

    for name in ("documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("R2_stream_new_links", "R3_stream_term_frequency", "R6_stream_signals"):
        query = entry.queries()[name]
        assert rows(query(spark, str(tmp_path))) == rows(query(spark, sf)) != []


def test_without_a_horizon_no_source_is_forgotten(spark, tmp_path):
    day = 86_400
    batches = [[(1, 0, 1), (2, 100, 1)], [(3, 5000, 2)], [(4, 20 * day, 2)], [(5, 20 * day + 9000, 1)], [(6, 40 * day, 1)]]
    stream = stream_of(rate_audit.state_session(spark), spark, tmp_path / "in", batches)
    rate_audit.write_gaps(stream, str(tmp_path / "out"), str(tmp_path / "cp"), horizon_days=None).awaitTermination()
    want = [(1, -1.0), (2, 100.0), (3, -1.0), (4, 20 * day - 5000.0), (5, 20 * day + 8900.0), (6, 20 * day - 9000.0)]
    assert gaps_of(spark, str(tmp_path / "out")) == want


def test_new_links_across_batches(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    # the second "a" comes a day later, behind the watermark of the de-duplication
    data = [("https://x/a?utm_q=1", base), ("https://x/b", base), ("https://x/b", base), ("https://x/a#f", base + dt.timedelta(days=1)), ("https://x/old/", base), ("https://x/c", base + dt.timedelta(days=2))]
    df = spark.createDataFrame(data, "url string, crawled_at timestamp_ntz")
    folder = split(df, str(tmp_path / "in"), "crawled_at")
    stored = spark.createDataFrame([("https://x/old",)], "url string")
    stream = runs.file_stream(spark, folder, df.schema, files_per_batch=1)
    table = st.link_table(str(tmp_path / "links"))
    st.write_new_links(st.new_links(stream, stored), table, str(tmp_path / "cp")).awaitTermination()
    assert rows(table.read(spark).select("canonical", "url")) == [("https://x/a", "https://x/a?utm_q=1"), ("https://x/b", "https://x/b"), ("https://x/c", "https://x/c")]
    # a second run from a new checkpoint brings the same batches again: they count already
    st.write_new_links(st.new_links(stream, stored), table, str(tmp_path / "cp2")).awaitTermination()
    assert table.read(spark).count() == 3


def test_a_batch_of_links_reads_the_buckets_of_its_own(spark, tmp_path):
    table = st.link_table(str(tmp_path / "links"), buckets=256)
    many = spark.range(20_000).select(F.concat(F.lit("https://x/"), "id").alias("canonical"), F.lit("u").alias("url"), F.current_timestamp().alias("crawled_at"))
    table.write(many, 0)
    few = many.limit(3)
    places = table.places_of(few)
    assert len(places) <= 3
    read = table.read(spark, places)
    assert {f.split("place=")[1].split("/")[0] for f in read.inputFiles()} == set(places)
    assert few.join(read, "canonical", "left_anti").count() == 0 and read.count() < 1000


def test_edges_fold_batch_by_batch(spark, sf, tmp_path):
    articles = standins.articles(spark, sf)
    folder = split(articles, str(tmp_path / "in"), "id")
    at = "2026-01-02 12:00:00"
    stream = runs.file_stream(spark, folder, articles.schema, files_per_batch=1)
    table = st.edge_table(str(tmp_path / "edges"), buckets=8)
    st.write_edges(stream, table, str(tmp_path / "cp"), at, 15).awaitTermination()
    want = spark.createDataFrame([], "src string, dst string, weight long, updated_at timestamp_ntz")
    bounds = [r[0] for r in articles.withColumn("part", F.ntile(3).over(Window.orderBy("id"))).groupBy("part").agg(F.max("id")).orderBy("part").select("max(id)").collect()]
    low = -1
    for high in bounds:
        part = articles.where((F.col("id") > low) & (F.col("id") <= high))
        want = sinks.merge_edges(want, terms.cooccurrence(terms.tokenize_articles(part), 15), at)
        low = high
    last = table.read(spark).select("src", "dst", "weight")
    assert last.count() and rows(last) == rows(want.select("src", "dst", "weight"))


def test_streams_leave_their_tables_as_the_batch_forms(spark, sf, tmp_path):
    articles, feedbacks = standins.articles(spark, sf), standins.feedbacks(spark, sf)
    folder = split(articles, str(tmp_path / "a"), "published_at", 4)
    stream = runs.file_stream(spark, folder, articles.schema, files_per_batch=1)
    table = st.term_table(str(tmp_path / "terms"))
    runs.write_table(st.term_counts(stream), table, str(tmp_path / "cp-a")).awaitTermination()
    assert rows(table.read(spark)) == rows(st.term_counts(articles).select("time", "source_id", "term", "frequency", "doc_count"))
    day = articles.agg(F.max("published_at")).first()[0]
    recent = st.recent_terms(spark, table, day.isoformat(sep=" "), 1)
    assert {f.split("place=")[1].split("/")[0] for f in recent.inputFiles()} == {day.date().isoformat()}
    folder = split(feedbacks, str(tmp_path / "f"), "created_at" if "created_at" in feedbacks.columns else feedbacks.columns[0], 4)
    stream = runs.file_stream(spark, folder, feedbacks.schema, files_per_batch=1)
    table = st.counter_table(str(tmp_path / "counters"))
    runs.write_table(st.feedback_counts(stream), table, str(tmp_path / "cp-f")).awaitTermination()
    assert rows(table.read(spark)) == rows(st.feedback_counts(feedbacks).select("article_id", "clicks", "impressions"))


def test_retention_drops_whole_days(spark, tmp_path):
    days = spark.createDataFrame([(i, dt.date(2024, 1, i)) for i in range(1, 21)], "id int, dt date")
    days.write.partitionBy("dt").parquet(str(tmp_path / "t"))
    assert len(st.drop_expired_days(spark, str(tmp_path / "t"), "2024-01-20 12:00:00")) == 12
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.min("id")).first()[0] == 13


def test_compaction(spark, tmp_path):
    for i, v in ((0, "old"), (1, "new")):
        spark.createDataFrame([("k", v)], "key string, value string").write.parquet(f"{tmp_path}/out/batch={i}")
    runs.compact(spark, f"{tmp_path}/out", ["key"], f"{tmp_path}/folded")
    assert rows(spark.read.parquet(f"{tmp_path}/folded")) == [("k", "new")]


def test_terms_are_added_without_state_in_any_order_and_once(spark, sf, tmp_path):
    articles = standins.articles(spark, sf)
    folder = split(articles.withColumn("mix", F.xxhash64("id")), str(tmp_path / "in"), "mix")  # most rows come behind a watermark, and windows come again
    stream = runs.file_stream(spark, folder, articles.schema, files_per_batch=1)
    table = st.added_terms(str(tmp_path / "terms"))
    st.write_terms(stream, table, str(tmp_path / "cp")).awaitTermination()
    want = rows(st.term_counts(articles).select("time", "source_id", "term", "frequency", "doc_count"))
    assert table.committed(spark) >= 2 and rows(table.read(spark)) == want
    assert not (tmp_path / "cp" / "state").exists()
    st.write_terms(stream, table, str(tmp_path / "cp2")).awaitTermination()  # the same batches again
    assert rows(table.read(spark)) == want
