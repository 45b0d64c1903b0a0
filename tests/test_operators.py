"""Operators on hand-made tables, with brute force where SQL is too slow on whole tables."""

import datetime as dt
import itertools
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewire.operators import articles as ar
from tidewire.operators import events as ev
from tidewire.operators import keys, quant, reco, sinks, terms


def ts(text):
    return dt.datetime.fromisoformat(text)


def tokens_table(spark, docs):
    return spark.createDataFrame([(i, 1, d) for i, d in enumerate(docs)], "doc_id long, source_id int, tokens array<string>")


def test_cooccurrence_matches_brute_force_with_copies(spark):
    rng = random.Random(3)
    docs = [[rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 8))] for _ in range(60)]
    docs += [["aa", "bb", "cc"]] * 40 + [["zz"], []]
    want = Counter()
    for d in docs:
        for pair in itertools.combinations(sorted(set(d)), 2):
            want[pair] += 1
    want = {p: n for p, n in want.items() if n >= 2}
    table = tokens_table(spark, docs)
    got = {(r["src"], r["dst"]): r["weight"] for r in terms.cooccurrence(table).collect()}
    assert got == want
    vocabulary = terms.term_frequency(table, 4)
    words = {r["term"] for r in vocabulary.collect()}
    inside = {(r["src"], r["dst"]): r["weight"] for r in terms.cooccurrence_within(table, vocabulary).collect()}
    assert inside == {p: n for p, n in want.items() if set(p) <= words}


def test_term_frequency_counts_repeats_once_per_document(spark):
    got = {r["term"]: (r["frequency"], r["doc_count"]) for r in terms.term_frequency(tokens_table(spark, [["x", "y", "x"], ["x"], []])).collect()}
    assert got == {"x": (3, 2), "y": (1, 1)}


def test_gap_to_previous_equals_plain_lag_for_a_hot_key(spark):
    rng = random.Random(5)
    base = ts("2024-01-01 00:00:00")
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b"]), base + dt.timedelta(seconds=rng.choice([0, 1, 59, 3600, 7200, 86400]) * rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, at timestamp_ntz")
    got = {r["id"]: r["gap_seconds"] for r in keys.gap_to_previous(df, "k", "at", "id", 600).collect()}
    want = {}
    for k in {"hot", "a", "b"}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == k)
        for (p, _), (c, i) in zip([(None, None)] + mine, mine):
            want[i] = None if p is None else (c - p).total_seconds()
    assert got == want


def test_next_session_edges(spark):
    bars = spark.createDataFrame(
        [(dt.date(2024, 1, d), "A", 10 * d, 10 * d + 1, 10 * d + 2) for d in (2, 3, 8)], "target_dt date, code string, open_price long, high_price long, close_price long"
    )
    targets = spark.createDataFrame(
        [(1, dt.date(2024, 1, 2), "A", 20), (2, dt.date(2024, 1, 5), "A", 20), (3, dt.date(2024, 1, 1), "A", 20), (4, dt.date(2024, 1, 3), "A", 20), (5, dt.date(2024, 1, 2), "B", 20)],
        "id long, target_dt date, code string, closing_price long",
    )
    got = {r["id"]: r["next_dt"].day for r in quant.next_session(targets, bars).collect()}
    # the day itself is a session for 1 and 4; 3 starts at the first bar; 2 has one bar left and 5 none
    assert got == {1: 3, 3: 3, 4: 8}


def test_backtest_success_uses_the_unrounded_return(spark):
    row = spark.createDataFrame([(1, 100000, 100000, 101496, 100000)], "id long, closing_price long, next_day_open long, next_day_10m_high long, next_day_close long")
    got = quant.backtest_returns(row).first()
    assert (got["return_rate_high"], got["is_success"]) == (1.5, False)
    assert quant.quant_stats(row.where("false").withColumns({"is_success": F.lit(True), "return_rate_open": F.lit(1.0), "return_rate_high": F.lit(1.0)})).first().asDict() == {
        "total_trades": 0, "success_trades": 0, "win_rate": 0.0, "avg_return_rate_open": 0.0, "avg_return_rate_high": 0.0,
    }


def test_volume_surge_needs_all_sessions(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(days=i), "A", 100) for i in range(20)] + [(day + dt.timedelta(days=20), "A", 200), (day + dt.timedelta(days=21), "A", 200)]
    rows += [(day + dt.timedelta(days=i), "B", 100 if i < 19 else 900) for i in range(20)]
    got = quant.volume_surge(spark.createDataFrame(rows, "target_dt date, code string, volume long")).collect()
    assert [(r["code"], r["target_dt"].day, r["surge"]) for r in got] == [("A", 21, 2.0)]


def articles_table(spark, rows):
    shape = "id long, source_id int, url string, title string, summary string, published_at timestamp_ntz, metadata string, sentiment_score double"
    return spark.createDataFrame(rows, shape)


def test_pending_text_is_greedy_in_order(spark):
    rows = [
        (1, 1, "u1", "t1", None, ts("2024-01-05"), None, None),
        (2, 1, "u2", "t1", None, ts("2024-01-04"), None, None),  # title taken
        (3, 1, "u2", "t2", "", ts("2024-01-03"), "{}", None),  # its url was never taken: 2 was skipped
        (4, 1, "u4", "t4", "done", ts("2024-01-02"), '{"nlp_processed":true}', None),
        (5, 1, "u5", "t5", None, ts("2024-01-01"), '{"nlp_processed":true,"nlp_error":"x"}', None),
        (6, 1, "u6", "t6", "s", ts("2023-01-01"), '{"nlp_processed":false}', None),
    ]
    got = [r["id"] for r in ar.pending_text(articles_table(spark, rows)).collect()]
    assert got == [1, 3, 5, 6]
    assert [r["id"] for r in ar.pending_text(articles_table(spark, rows), skip_failed=True).collect()] == [1, 3, 6]
    assert [r["id"] for r in ar.pending_text(articles_table(spark, rows), 2).collect()] == [1, 3]
    copies = [(100 + i, 1, "same", f"x{i}", None, ts("2025-01-01"), None, None) for i in range(40)]
    assert [r["id"] for r in ar.pending_text(articles_table(spark, rows + copies), 3).collect()] == [139, 1, 3]


def test_new_urls_drops_raw_and_canonical_matches(spark):
    stored = spark.createDataFrame([("https://a.com/1?utm_x=1",), ("https://a.com/2/",)], "url string")
    cand = spark.createDataFrame(
        [(0, "https://a.com/1"), (1, "https://a.com/2#x"), (2, "https://a.com/3?ref=1"), (3, "https://a.com/3/"), (4, ""), (5, None), (6, "https://a.com/1?utm_x=1")], "pos long, url string"
    )
    assert [r["pos"] for r in ar.new_urls(cand, stored).collect()] == [2]


def test_append_new_is_idempotent(spark):
    at = ts("2024-01-01")
    target = spark.createDataFrame([("a", at, "old")], "url string, published_at timestamp_ntz, tag string")
    batch = spark.createDataFrame([("a", at, "n", 0), ("b", at, "first", 1), ("b", at, "second", 2), ("a", ts("2024-01-02"), "later", 3)], "url string, published_at timestamp_ntz, tag string, pos long")
    once = sinks.append_new(target, batch)
    rows = sorted(tuple(r) for r in once.collect())
    assert [(r[0], r[2]) for r in rows] == [("a", "old"), ("a", "later"), ("b", "first")]
    assert sorted(tuple(r) for r in sinks.append_new(once, batch).collect()) == rows


def test_upsert_inserts_first_and_sets_last(spark):
    target = spark.createDataFrame([(1, "x", "me", "old", 1)], "article_id long, comment_ext_id string, author string, content string, score int")
    batch = spark.createDataFrame(
        [(1, "x", "you", "new", None, 0), (2, "y", "first", "c1", 1, 0), (2, "y", "last", "c2", 2, 1)], "article_id long, comment_ext_id string, author string, content string, score int, pos int"
    )
    got = sorted((tuple(r) for r in sinks.upsert(target, batch, sinks.COMMENT_KEYS, ["content", "score"]).collect()), key=str)
    assert got == [(1, "x", "me", "new", None), (2, "y", "first", "c2", 2)]


def test_merge_json_keeps_types_and_right_wins(spark):
    row = spark.createDataFrame([('{"a":1,"b":{"c":[1,"x"]},"d":"s"}', '{"a":null,"e":true}'), (None, '{"e":1.5}'), ("{}", None)], "t string, p string")
    got = [r[0] for r in row.select(sinks.merge_json(F.col("t"), F.col("p"))).collect()]
    assert got == ['{"b":{"c":[1,"x"]},"d":"s","a":null,"e":true}', '{"e":1.5}', "{}"]


def events_table(spark, rows):
    shaped = [(i, s, k, f"t{i}", f"https://s{s}/{i}", ts(t)) for i, (s, k, t) in enumerate(rows)]
    return spark.createDataFrame(shaped, "id long, source_id int, event_type string, title string, url string, created_at timestamp_ntz")


def test_lanes_edges(spark):
    sources = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    start, buckets, step, _ = ev.lane_window("2024-01-01 01:00:05", "10m")
    begin = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=start)
    end = begin + dt.timedelta(seconds=buckets * step)
    fmt = lambda t: t.isoformat(sep=" ")
    events = events_table(
        spark,
        [
            (1, "seed_scan", fmt(begin)), (1, "article_ingest", fmt(begin + dt.timedelta(seconds=9.9))), (1, "llm_enrich", fmt(begin)), (9, "big_image", fmt(begin)),
            (None, "error", fmt(begin)), (2, "trend_spike_detected", fmt(begin)), (2, "seed_scan", fmt(end - dt.timedelta(microseconds=1))), (2, "seed_scan", fmt(end)),
            (2, "seed_scan", fmt(begin - dt.timedelta(microseconds=1))),
        ],
    )
    lanes = ev.lane_stream(events, sources, "2024-01-01 01:00:05", "10m")
    assert lanes.count() == 4 * buckets
    by = {(r["lane"], r["bucket"]): r for r in lanes.where("total > 0").collect()}
    assert {k: (r["requests"], r["total"]) for k, r in by.items()} == {
        ("total", 0): (3, 5), ("1", 0): (2, 2), ("llm", 0): (1, 1), ("total", buckets - 1): (1, 1), ("2", buckets - 1): (1, 1),
    }
    summary = {r["lane"]: r for r in ev.lane_summary(lanes, buckets).collect()}
    assert (summary["2"]["current_count"], summary["2"]["peak_rate"], summary["total"]["total_count"]) == (1, 0.1, 4)


def test_recent_calls_gap_reaches_behind_the_kept_rows(spark):
    base = ts("2024-01-01 00:00:00")
    rows = [(1, "seed_scan", (base + dt.timedelta(seconds=2 * i)).isoformat(sep=" ")) for i in range(20)] + [(1, "seed_scan", (base + dt.timedelta(seconds=38)).isoformat(sep=" "))]
    got = ev.recent_calls(events_table(spark, rows), spark.createDataFrame([(1,)], "id int"), "2024-01-01 00:00:40", "1m", 3).orderBy("id").collect()
    assert [(r["id"], r["interval_seconds"], r["instant_rate"]) for r in got] == [(18, 2.0, 0.5), (19, 2.0, 0.5), (20, 0.0, 0.0)]


def test_empty_dashboard_has_no_rate(spark):
    empty = events_table(spark, [(1, "x", "2020-01-01 00:00:00")])
    articles = spark.createDataFrame([], "crawled_at timestamp_ntz")
    got = ev.dashboard_counts(articles, spark.createDataFrame([(1, True), (2, False)], "id int, is_active boolean"), empty, "2024-01-01 00:00:00").first()
    assert (got["total_articles"], got["active_sources"], got["success_rate_24h"]) == (0, 1, None)


def test_backfill_stops_at_the_daily_cap(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day, i, o) for i, o in enumerate(["skipped", "saved", "error", "saved", "skipped", "saved"])]
    got = ev.backfill_progress(spark.createDataFrame(rows, "day date, pos long, outcome string"), 2).first()
    assert (got["saved"], got["skipped"], got["error"]) == (2, 1, 1)


def test_bandits(spark):
    stats = spark.createDataFrame([(1, 3, 10), (2, 0, 0), (3, 9, 2)], "id long, clicks long, impressions long")
    scores = {r["id"]: r["score"] for r in reco.ucb1_scores(stats).collect()}
    assert scores[2] == float("inf") and scores[3] > scores[1]
    first = [tuple(r) for r in reco.thompson_scores(stats, 7, 3).collect()]
    assert first == [tuple(r) for r in reco.thompson_scores(stats, 7, 3).collect()]
    many = spark.range(4000).select("id", F.lit(30).cast("long").alias("clicks"), F.lit(100).cast("long").alias("impressions"))
    mean = reco.thompson_scores(many, 1, 4000).agg(F.avg("score")).first()[0]
    assert abs(mean - 31 / 102) < 0.003


def test_captions(spark):
    articles = spark.createDataFrame([(1, "a {{IMG:1:u}} b"), (2, "plain"), (3, "none")], "id long, content string")
    images = spark.createDataFrame(
        [(1, 1, 1, "{{IMG:1:u}}", "COMPLETED", "cat"), (2, 1, 2, "{{IMG:2:v}}", "COMPLETED", "dog"), (3, 2, 1, "t", "PENDING", "x"), (4, 2, 2, "t", "COMPLETED", "")]
        + [(10 + i, 3, i, f"z{i}", "COMPLETED", f"d{i}") for i in range(4, 0, -1)],
        "id long, article_id long, order_index int, placeholder_token string, status string, description string",
    )
    got = {r["id"]: r["content"] for r in ar.inject_captions(articles, images).collect()}
    head, mid, tail = ar.CAPTION
    assert got[1] == f"a {head}1{mid}cat{tail} b{head}2{mid}dog{tail}" and got[2] == "plain"
    assert got[3].index("d1") < got[3].index("d2") < got[3].index("d4")
    few = {r["id"]: r["content"] for r in ar.inject_captions(articles, images, 3).collect()}
    assert "d3" in few[3] and "d4" not in few[3]


def test_worker_caption_block(spark):
    articles = spark.createDataFrame([(1, "text", '{"k":1}'), (2, "text\n\n[이미지 1 설명: cat]", None), (3, "none", None)], "id long, content string, metadata string")
    described = spark.createDataFrame(
        [(1, 0, "u0", "success", "cat", None), (1, 1, "u1", "error", None, "e"), (1, 2, "u2", "success", "dog", None), (1, 3, "u3", "success", "late", None), (2, 0, "u0", "success", "cat", None)],
        "id long, order_index int, image_url string, status string, description string, error string",
    )
    got = {r["id"]: r for r in ar.append_caption_block(articles, described, "m", F.lit("2026-01-01 00:00:00").cast("timestamp")).collect()}
    assert got[1]["content"] == "text\n\n[이미지 1 설명: cat]\n[이미지 3 설명: dog]"
    assert got[2]["content"] == "text\n\n[이미지 1 설명: cat]" and got[3]["content"] == "none"
    images = json.loads(got[1]["metadata"])["images"]
    assert [i.get("caption") for i in images] == ["cat", None, "dog"] and images[1]["error"] == "e" and json.loads(got[1]["metadata"])["k"] == 1


def test_repeated_results_change_one_row(spark):
    target = spark.createDataFrame([(1, None)], "id long, x int").select("id", *[F.lit(None).cast("int").alias(c) for c in ("next_day_open", "next_day_10m_high", "next_day_close", "return_rate_open", "return_rate_high", "is_success")])
    results = target.withColumns({"next_day_open": F.lit(1), "seen": F.lit(1)}).unionByName(target.withColumns({"next_day_open": F.lit(0), "seen": F.lit(2)}))
    assert [r["next_day_open"] for r in sinks.apply_backtest(target, results, "seen").collect()] == [0]
    picks = spark.createDataFrame([("2026-01-01", "a", "s", 1.0), ("2026-01-01", "a", "s", 9.0)], "target_dt string, code string, strategy_name string, target_score double")
    assert [r["target_score"] for r in sinks.save_targets(picks.limit(0), picks).collect()] == [9.0]


def test_topic_expand_levels_and_query(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("a", "c", 4), ("b", "d", 3), ("c", "d", 9), ("d", "e", 7)], "src string, dst string, weight long")
    got = {r["term"]: (r["level"], r["weight"]) for r in terms.topic_expand(edges, "a", 8, 2).collect()}
    assert got == {"b": (1, 5), "c": (1, 4), "d": (2, 9)}
    assert terms.topic_query(terms.topic_expand(edges, "a"), "a").first()[0] == "a b OR c"
    assert terms.topic_query(terms.topic_expand(edges, "zz"), "zz").first()[0] == "zz"


def test_versioned_tables(spark, tmp_path):
    name = "versioned_t"
    sinks.replace_table(spark.range(3), name, str(tmp_path))
    assert spark.table(name).count() == 3
    grown = spark.table(name).unionByName(spark.range(3, 5))
    sinks.replace_table(grown, name, str(tmp_path))
    assert spark.table(name).count() == 5
    spark.sql(f"DROP TABLE {name}")
