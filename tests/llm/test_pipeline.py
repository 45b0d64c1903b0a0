"""The pipeline's stages on a small table where what must go is known."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    text = lambda n=80: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(), "en", f"s{i % 3}", 1) for i in range(900)]
    bench = [(k, text(20) + ". " + text(5) + ".") for k in range(6)]
    toxic, short, repeated, copies, near, leaks = [], [], [], [], [], []
    for i in range(900):
        if i % 5 == 4:
            rows[i] = (i, rows[i][1] + " nastyword vilething", "en", "s", 1)
            toxic.append(i)
    short.append((2000, "too few words", "en", "s", 1))
    short += [(2001, None, None, None, None), (2002, "", "en", "s", 1)]
    repeated.append((2003, "again and again we say these eight words " * 20, "en", "s", 1))
    for k in range(5):
        copies.append((3000 + k, rows[k][1], "en", "s", 1))
        w = rows[10 + k][1].split()
        w[7] = "changed"
        near.append((3100 + k, " ".join(w), "en", "s", 1))
    leaks = [(4000 + k, text(60) + " " + bench[k][1] + " " + text(60), "en", "s", 1) for k in range(6)]
    extra = [(None, text(), "en", "s", 1)]
    docs = spark.createDataFrame(rows + short + repeated + copies + near + leaks + extra, "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in set(toxic))) for i in range(900)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    # row 4 is toxic and so is its copy; rows 10 to 14 have near copies, of which 14 is toxic
    gone = [set(range(2000, 2004)), {*toxic, 3004, 3104}, {r[0] for r in copies + near}, {r[0] for r in leaks}]
    return d, docs.columns, gone


def test_each_stage_drops_what_it_must_and_nothing_else(spark, made):
    d, columns, gone = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before = ids(docs)
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:4], gone, strict=True):
        docs = stage(spark, docs, d).cache()
        after = ids(docs)
        assert docs.columns == columns, name
        assert before - after == lost & before, (name, sorted(before - after)[:20], sorted(lost & before)[:20])
        before = after
    packed = corpus_pipeline.STAGES[4][1](spark, docs, d)
    assert ids(packed) == before and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert ids(corpus_pipeline.run(spark, d)) == before


def test_stages_of_an_empty_table(spark, made):
    d, columns, _ = made
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (5, c, "en", "s", 1), (5, c, "en", "s", 1), (None, a, "en", "s", 1), (7, None, None, None, None), (8, "", None, None, None), (9, "x " * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_row": F.lit("clash"), "tie": F.lit("clash"), "is_first": F.lit("clash")})
    left = corpus_pipeline.keep_one_copy(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(1, a), (2, b), (5, c), (None, a), (7, None), (9, "x " * 200_000)], key=repr)
