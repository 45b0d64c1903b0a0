"""The methods themselves, without Spark, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import decontaminate, language, language_model, packing, simhash, toxicity, urls


@pytest.mark.parametrize(("distance", "segments"), [(4, 2), (4, 1), (10, 4)])
def test_trie_links_join_what_brute_force_joins(distance, segments):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = base[rng.integers(0, 40, 300)].copy()
    for i in range(len(near)):
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            near[i] ^= np.uint64(1) << np.uint64(b)
    bits = np.sort(np.concatenate([base, near, near[:5]]))  # equal numbers, too
    n, width = len(bits), 64 // segments
    got, want = simhash._Classes(n), simhash._Classes(n)
    budgets = [distance // segments if d < width else distance for d in range(64)] + [distance]
    for s in range(segments):
        turned = (bits << np.uint64(s * width)) | (bits >> np.uint64(64 - s * width)) if s else bits
        order = np.argsort(turned, kind="stable")
        for a, b in simhash.trie_links(turned[order], np.ones(n, bool), budgets):
            got.join(order[[a]], order[[b]])
    for i in range(n):
        j = np.nonzero(np.bitwise_count(bits[i] ^ bits[i + 1 :]) <= distance)[0] + i + 1
        want.join(np.full(len(j), i), j)
    assert np.array_equal(got.roots(), want.roots())


def test_dense_groups_are_no_square():
    rng = np.random.default_rng(2)
    flips = [np.uint64(1) << b for b in np.arange(64, dtype=np.uint64)]
    bits = np.unique(np.array([flips[a] ^ flips[b] ^ flips[c] for a, b, c in rng.integers(0, 64, (4000, 3))], np.uint64))
    forest = simhash.trie_links(bits, np.ones(len(bits), bool), [2] * 32 + [4] * 33)
    assert len(forest) == len(bits) - 1


def test_trie_links_of_nothing_and_of_one():
    for n in (0, 1):
        assert simhash.trie_links(np.zeros(n, np.uint64), np.ones(n, bool), [2] * 32 + [4] * 33) == []


def test_sketches_estimate_similarity():
    rng = random.Random(3)
    words = [f"w{i}".encode() for i in range(3000)]
    a = [rng.choice(words) for _ in range(600)]
    for edits, similar in ((0, True), (4, True), (60, False)):
        b = list(a)
        for i in rng.sample(range(600), edits):
            b[i] = b"x%d" % i
        x, y = (np.frombuffer(simhash.sketch(simhash.shingle_hashes(w, 5)), np.uint8)[None] for w in (a, b))
        assert bool(simhash.similar(x, y, 0.8)[0]) == similar
    empty = np.frombuffer(simhash.sketch(simhash.shingle_hashes([], 5)), np.uint8)[None]
    assert not simhash.similar(empty, empty, 0.8)[0]


def items(n=60, seed=4):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(400)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 40))) + ". " + " ".join(rng.choice(words) for _ in range(4)) + ".") for i in range(n)]


def test_wand_retrieves_what_full_sums_retrieve():
    held = items()
    lengths = [decontaminate.words_of(t) for _, t in held]
    df = Counter(t for w in lengths for t in set(w))
    index = decontaminate.build_index(held, (len(held), sum(map(len, lengths)) / len(held), df))
    rng = random.Random(5)
    for threshold in (0.05, 0.2, 0.5):
        queries = [sorted({index.term[w] for w in rng.choice(lengths)[:20] + rng.choice(lengths)[:20]}) for _ in range(30)]
        q = np.repeat(np.arange(30), [len(x) for x in queries])
        got = {(int(a), int(b)): float(s) for a, b, s in zip(*decontaminate.wand(index, q, np.concatenate(queries), threshold), strict=True)}
        want = {}
        for i, terms in enumerate(queries):
            total = np.zeros(len(index.ids))
            for t in terms:
                r = slice(index.first[index.entries[t]], index.first[index.entries[t + 1]])
                total[index.item[r]] += index.impact[r]
            want |= {(i, int(k)): float(total[k]) for k in np.nonzero(total >= threshold - 1e-9)[0]}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_question_and_answer():
    assert decontaminate.parts_of("What is it? Forty two men.") == ([b"what", b"is", b"it"], [b"forty", b"two", b"men"])
    assert decontaminate.parts_of("What is it now? Two.")[1] == [b"it", b"now", b"two"]  # a short answer takes the words before it along
    assert decontaminate.parts_of(None) == ([], []) and decontaminate.parts_of("one")[0] == [b"one"]


def check_plan(counts, capacity):
    steps, total = packing.plan(counts, capacity)
    fill, seen = {}, {}
    for length, rank, n, first, beside, offset in steps:
        for j in range(n):
            fill.setdefault(first + j // beside, []).append((offset + j % beside * length, length))
        seen.setdefault(length, []).append((rank, n))
    assert sorted(fill) == list(range(total))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * x > capacity for _, x in pieces) <= 2
    for length, n in counts.items():
        at = 0
        for rank, k in sorted(seen.get(length, [])):
            assert rank == at
            at += k
        assert at == n
    return total


def test_plans_hold_every_piece_once():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([10, 17, 64])
        check_plan({x: rng.randint(1, 5) for x in rng.sample(range(1, capacity + 1), rng.randint(1, 10))}, capacity)
    assert check_plan({}, 64) == 0
    draws = np.minimum(np.random.default_rng(1).lognormal(6.3, 0.9, 20_000).astype(int) + 1, 2048)
    counts = dict(Counter(draws.tolist()))
    assert check_plan(counts, 2048) <= 1.01 * math.ceil(sum(k * n for k, n in counts.items()) / 2048)


def test_merges_of_many_parts_are_the_tokenizers():
    import public_tokenizers

    encoder = packing.encoder_of(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzéèüñßœøđ'"
    parts = ["".join(rng.choice(letters[:-1]) for _ in range(rng.randint(1, 12))) for _ in range(20_000)] + ["aaaaaaaaaaaa", "ababababab", "a", "the", "'s", "ﬁ"] + [chr(c) for c in range(0xE0, 0x250) if chr(c).islower()]
    parts = [p for p in parts if len(p.encode()) <= packing.Merges.LONGEST]
    assert encoder.merges.usable and encoder.merges.ids([p.encode() for p in parts]) == encoder._ids(parts)
    assert encoder.merges.ids([]) == []


def test_word_by_word_ids_are_the_tokenizers(monkeypatch):
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    texts = ["it's a TEST\x1d b", "<|endoftext|> x", " Á ́b l'été 12ab!?", "", " x\u0085y\u3000z", "a" * 5000, "…—“q” \n\n\t end", "I'LL we'Re ''s ~ a~b ~~ 'sx", "İ Σς ΑΣ Ǆ ŉ ß", "1234 ½ ²³ ª º"]
    assert e.encode(texts) == e._ids(texts)
    rng = random.Random(3)
    some = [chr(c) for c in range(0x20, 0x100)] + ["\n", "\t", " ", "'s", "'ll", " don't ", "__", " İ", "œ", "Ω", "日", "<|", "\x1c", "\x85"]
    made = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert e.encode(made) == e._ids(made)
    monkeypatch.setattr(packing, "PARTS_KNOWN", 5)  # forgets all the time
    small = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    assert [x for t in texts * 2 for x in small.encode([t])] == e._ids(texts) * 2


def test_neural_log_probabilities_are_normalised_and_beat_frequencies():
    rng = np.random.default_rng(7)
    shape = ((language_model.NEAR_WORDS + language_model.NEAR_SPELLINGS) * language_model.FAR, language_model.OWN + language_model.SPELLINGS)
    counts = np.zeros(shape)
    for c in range(0, shape[0], 16):
        counts[c, (c // 16 * 7) % 64 : (c // 16 * 7) % 64 + 8] = rng.integers(50, 100, 8)
    log_p = language_model.train(counts)
    assert np.allclose(np.exp(log_p.astype(float)).sum(1), 1, atol=1e-3)
    p = counts.sum(0) / counts.sum()
    base = (counts * np.log(np.maximum(p, 1e-12))).sum() / counts.sum()
    assert (counts * log_p).sum() / counts.sum() > base + 0.3
    assert np.isfinite(language_model.train(np.zeros(shape))).all()


def test_contexts_do_not_cross_texts():
    lexicon = language_model.Lexicon({b"": 0, b"a": 1, b"b": 2}, np.array([2, 3, 1]), np.array([0, 1, 2]), np.arange(4096) % 256, np.zeros(4096, int), 6, 3)
    number, out, context, tail = lexicon.classes([[b"a", b"b"], [], [b"zz"]])
    assert number.tolist() == [1, 2, 0, 0, -1, 0] and tail == [b"zz"] and out[4] == language_model.OWN + language_model.spelling(b"zz")
    assert (context // language_model.FAR).tolist()[:5] == [0, 1, 2, 0, 0]


def test_bundles_are_sums_of_bound_vectors():
    coder = language.Coder("abc")
    texts = ["abca", None, "12 !", "ab 7 c", "a" * 3000]
    got = coder.bundle(texts)
    for row, text in zip(got, texts, strict=True):
        want = np.zeros(language.DIMENSIONS)
        x = [0]
        for c in text or "":
            k = coder.own.get(c, 0)
            if k or x[-1]:
                x.append(k)
        x += [0] if x[-1] else []
        for a, b, c in zip(x, x[1:], x[2:]):
            want += np.roll(coder.at[2][a], 2).astype(int) * np.roll(coder.at[2][b], 1) * coder.at[2][c]
        assert np.array_equal(row, want)


def test_longest_match_against_all_rules():
    rng = random.Random(8)
    hosts, paths = ["org", "b.org", "a.b.org", "com", "xb.org"], ["/", "/e", "/en/", "/en/1", "/en/1/", ""]
    for _ in range(40):
        rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(5)]
        trie = urls.build_trie(rules)
        for host in [*hosts, "", "z.a.b.org", "org."]:
            for path in ["", "/", "/en", "/en/", "/en/12", "/en/1/x", "/x", "//"]:
                fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
                got = urls.longest_match(trie, host, path)
                want = max(fits, default=None)
                assert (got and (got[0], got[1], got[3])) == (want and (want[0], want[1], want[4]))


def test_nearest_examples_are_exact():
    rng = random.Random(9)
    terms = [f"t{i}" for i in range(40)]
    examples = [(i, Counter(rng.choices(terms, k=rng.randint(1, 6))), rng.randint(0, 1)) for i in range(700)] + [(900, Counter(), 0)]
    index = toxicity.build_index(examples, {t: 1 + i / 10 for i, t in enumerate(terms)})
    for _ in range(50):
        t, w = index.vector(Counter(rng.choices(terms, k=4)))
        rows, cosines = index.nearest(t, w)
        full = w @ index.weights[t]
        order = np.lexsort((np.arange(len(full)), -np.round(full, 12)))
        order = order[full[order] > 0]
        end = int(np.argmax(np.cumsum(index.total[order]) >= toxicity.NEAREST)) + 1 if index.total[order].sum() >= toxicity.NEAREST else len(order)
        assert rows.tolist() == order[:end].tolist() and np.allclose(cosines, full[order[:end]])
    assert 0 <= index.score({})[0] <= 1 and index.score({"unknown": 3})[0] == index.bare


def test_index_of_no_examples():
    index = toxicity.build_index([], {})
    assert 0 <= index.score({"a": 1})[0] <= 1
