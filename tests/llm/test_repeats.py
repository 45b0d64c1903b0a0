"""Suffix arrays, permuted common prefixes and the removal of repeated strings, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import repeats
from tidewire.llm.suffix_arrays import common_prefixes, suffix_array

CLASH = ("tie", "row", "anchor", "print", "start", "starts", "n", "body", "spans", "kept", "first", "equal", "shard", "hot", "known", "copies", "bytes")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


def result(docs, **more):
    rows = repeats.remove_repeats(docs, **more).collect()
    return sorted(
        ((r["doc_id"], r["n_bytes"], [(s["begin"], s["end"]) for s in r["spans"]], r["text_sha256"] if r["kept"] is None else hashlib.sha256(r["kept"]).hexdigest()) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])
    )


@pytest.mark.parametrize("symbols", [1, 2, 3, 26, 250])
def test_suffix_arrays_and_prefixes(symbols):
    rng = random.Random(symbols)
    for size in [1, 2, 3, *(rng.randint(4, 90) for _ in range(60))]:
        text = bytes(rng.randrange(symbols) for _ in range(size))
        data = np.frombuffer(text, np.uint8)
        order = suffix_array(np.r_[data.astype(np.int16) + 1, 0].astype(np.int16))
        assert order[0] == size and order[1:].tolist() == sorted(range(size), key=lambda k: text[k:])
        common, before = common_prefixes(data, order[1:])
        for k, (n, other) in enumerate(zip(common.tolist(), before.tolist(), strict=True)):
            assert n == (0 if other < 0 else next((m for m in range(size) if text[k + m : k + m + 1] != text[other + m : other + m + 1] or k + m == size), size))


def texts(rng):
    words = [f"{a}{b}" for a in "bdfgklmé" for b in ("ai", "on", "ur", "ét")]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = some(60), some(80)
    made = [some(rng.randint(1, 200)) for _ in range(30)]
    made += [f"{some(9)} {passage} {some(5)}" for _ in range(12)] + [f"{passage[:150]}{some(4)}{passage[150:]}{other}" for _ in range(6)]
    made += [made[3], made[3], made[4] + " tail", "", None, "x" * 99, "x" * 100, "x" * 5000, "ab" * 300, "abc def " * 700, some(6000), "é" * 99]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("segments", [1, 2000])
def test_every_string_that_begins_earlier_goes(spark, monkeypatch, segments):
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", segments)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 20_000)
    rows = list(enumerate(texts(random.Random(segments)))) + [(None, "p" * 300 + " alone")]
    assert result(frame(spark, rows)) == repeats.by_brute_force(rows)


def test_other_lengths(spark):
    rows = list(enumerate(texts(random.Random(5))))
    assert result(frame(spark, rows), length=50) == repeats.by_brute_force(rows, 50)


def test_repeated_rows_and_ids(spark):
    a, b = "one text that is long enough " * 4 + "end", "quite another text, but long as well, for the same id, and so on until there are enough bytes of it all"
    whole = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = result(frame(spark, [(1, a), (1, a), (1, b), (2, b), (None, a), (3, None), (3, None), (4, "short"), (4, "short")]))
    gone = whole("")
    assert [r[0] for r in got].count(1) == 3 and len(got) == 9
    assert got[0] == (None, len(a), [], whole(a))  # the row without an id is the first of its text
    assert got.count((1, len(a), [(0, len(a))], gone)) == 2 and (1, len(b), [], whole(b)) in got and (2, len(b), [(0, len(b))], gone) in got
    assert got.count((3, 0, [], gone)) == 2 and got.count((4, 5, [], whole("short"))) == 2


def test_nothing(spark):
    assert result(frame(spark, [(1, None)]).limit(0)) == []


def test_kept_bytes_are_the_text_without_its_spans(spark):
    rows = list(enumerate(texts(random.Random(9))))
    by_id = {i: (t or "").encode() for i, t in rows}
    for r in repeats.remove_repeats(frame(spark, rows)).where("kept IS NOT NULL").collect():
        left = bytearray(by_id[r["doc_id"]])
        for s in reversed(r["spans"]):
            del left[s["begin"] : s["end"]]
        assert bytes(left) == r["kept"]
