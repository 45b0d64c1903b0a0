"""Alignment of two tokenizers against whole texts encoded at once, byte ranges compared pair by pair."""

import random
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tidewire.llm import alignment

CLASH = ("row", "pairs", "times", "groups", "n", "best", "pair", "n_a", "p")


@pytest.fixture(scope="module")
def aligner():
    return alignment.aligner_of(None)


def encoded(aligner, text):
    """(ids, byte ranges) by each tokenizer of a space and the text, encoded whole; None if there are no tokens."""
    if not text:
        return None
    out = []
    for ids, spell in ((aligner.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, aligner.a.bytes_of), (aligner.b.model.encode(text), aligner.b.bytes_of)):
        if b"".join(spell[i] for i in ids) != (" " + text).encode():
            return None
        at, ranges = 0, []
        for i in ids:
            ranges.append((at, at + len(spell[i])))
            at += len(spell[i])
        out.append((ids, ranges))
    return out


def brute_force(aligner, texts):
    made = []
    for text in texts:
        both = encoded(aligner, text)
        if both is None:
            made.append(None)
            continue
        (a, ra), (b, rb) = both
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, begin = [], 0
        for end in cuts:
            inside = lambda ids, ranges: ",".join(str(i) for i, (x, y) in zip(ids, ranges, strict=True) if begin <= x and y <= end)  # noqa: B023, E731
            groups.append(f"{inside(a, ra)}|{inside(b, rb)}")
            begin = end
        links = [(i, j) for i, (x, y) in zip(a, ra, strict=True) for j, (u, v) in zip(b, rb, strict=True) if x < v and u < y]
        made.append((len(a), len(b), ";".join(groups), len(groups), links))
    counts = Counter(p for m in made if m for p in m[4])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if m is None else (m[0], m[1], m[3], len(m[4]), sum(counts[p] == most[p[1]] for p in m[4]), sum(counts[p] for p in m[4]), m[2]) for m in made]


def texts():
    rng = random.Random(2)
    marks = ["word", "Émile", "don't", "naïve", "x" * 30, "12345", "a\tb", "line\nbreak", "  ", " ", "\n\n", "…", "日本語", "слово", "😀", "<|endoftext|>", "<s>", "é", "\x00", "\xa0", "　", "½ﬁ", "\x1c", "'s", "!!!", "ab" * 50, "tail "]
    made = [" ".join(rng.choice(marks) for _ in range(rng.randint(1, 25))) for _ in range(60)] + ["".join(rng.choice(marks) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    return [*made, *marks, made[0], "", None, "a ▁b", "▁", " ", "   ", " leading", "trailing  ", "ends with a break\n"]


def result(docs, **more):
    return sorted(((r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"))) for r in alignment.align(docs, **more).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.mark.parametrize("few", [True, False])
def test_rows_are_those_of_brute_force(spark, aligner, monkeypatch, few):
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 1_000_000 if few else 1)
    monkeypatch.setattr(alignment, "PAIRS", 50)
    rows = [*enumerate(texts()), (None, "no id"), (7, "the same id"), (7, "the same id")]
    expected = brute_force(aligner, [t for _, t in rows])
    assert result(frame(spark, rows)) == sorted(((i, *e) for (i, _), e in zip(rows, expected, strict=True)), key=repr)


def test_long_texts_and_forgetting(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "PARTS", 40)
    rng = random.Random(3)
    long = [" ".join(str(rng.randrange(10**6)) for _ in range(3000)), "y" * 20_000]
    for text in [*long, *texts()]:
        got = aligner.align([text or ""])[0]
        both = encoded(aligner, text)
        assert (got[0], got[1]) == ((0, 0) if both is None else (len(both[0][0]), len(both[1][0])))


def test_both_encoders_of_latin_texts_agree(aligner):
    assert aligner.a.fast and aligner.b.cuts
    for c in map(chr, range(0x250)):
        for text in (f" a{c}b", f" {c}{c}1", f" x {c} y", f"{c}", f" 1{c} "):
            assert aligner.a.fast.encode_ordinary(text) == aligner.a.tokenizer.encode(text, add_special_tokens=False).ids


def test_outcome_and_nothing(spark):
    rows = [(1, "some text"), (2, None)]
    by_id = {r[0]: r[-1] for r in result(frame(spark, rows), outcome=alignment.sha256_of)}
    groups = {r[0]: r[-1] for r in result(frame(spark, rows))}
    assert by_id == {1: alignment.sha256_of(groups[1]), 2: ""}
    assert result(frame(spark, rows).limit(0)) == []


def test_slices_and_links():
    assert alignment.group_slices([2, 5, 9], [5, 7, 9]) == [(0, 2, 0, 1), (2, 3, 1, 3)]
    assert alignment.links_of(0, 2, 0, 2, [3, 9], [5, 9]) == [(0, 0), (1, 0), (1, 1)]
