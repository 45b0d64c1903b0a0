"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import random
import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, language, language_model, licenses, packing, quality, sharding, simhash, toxicity, urls
from tidewire.llm.components import components

#: Columns whose names the operators use inside; none may disturb or survive where it isn't asked for.
CLASH = ("fp", "score", "length", "host", "quality", "words", "_text", "_row", "row", "bits", "key", "part", "node", "sketch", "hashes", "class", "_id", "stratum")


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bdfgklm" for b in ("ai", "on", "ur", "et", "ie")] + ["Zu", "x|", "y##", "la."]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    made += [made[3], made[3], made[4] + " tail", "one two three", "ONE two\nthree", "a b c d e f g h a b c d e f g h", "same\nsame\n \nsame\nother"]
    made += ["", " \n\t", None, None, "w " * 30_000, "é" * 20 + " ü\x0bß"]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(made)]
    return [*rows, rows[5], (None, "one two three", None), (None, None, None)]


def test_fingerprints_and_classes(spark, texts):
    got = simhash.near_duplicates(table(spark, texts)).collect()
    assert len(got) == len(texts) and got[0].__fields__ == ["doc_id", "fingerprint", "component_id", "n_copies"]

    def print_of(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, print_of(t)) for i, t, _ in texts]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, format(p, "016x")) for i, p in prints)
    up = {p: p for _, p in prints}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for p in list(up):
        for q in list(up):
            if (p ^ q).bit_count() <= 4:
                up[root(p)] = root(q)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    want = Counter((i, least.get(root(p))) for i, p in prints)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want


def test_groups_of_near_copies(spark):
    rng = random.Random(2)
    base = [[f"q{rng.randint(0, 900)}" for _ in range(rng.randint(60, 200))] for _ in range(25)]
    rows, want = [], []
    for k, w in enumerate(base):
        for c in range(4):
            copy = list(w)
            if c:
                copy[rng.randrange(len(copy))] = f"n{c}"  # five shingles of 56 or more
            rows.append((100 * k + c, " ".join(copy), "en"))
            want.append((100 * k + c, 100 * k))
    got = simhash.near_duplicate_groups(table(spark, [*rows, rows[0], (None, rows[0][1], None)])).distinct().collect()
    assert sorted(map(tuple, got)) == want
    assert simhash.near_duplicate_groups(table(spark, rows[:0])).count() == 0


def shingle_jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_groups_of_copies_that_differ_in_a_block(spark):
    rng = random.Random(12)
    rows = []
    for k in range(300):
        w = [f"q{rng.randint(0, 5000)}" for _ in range(rng.randint(100, 400))]
        cut = int(len(w) * rng.uniform(0.82, 0.86))
        other = w[:cut] if k % 2 else w + [f"q{rng.randint(0, 5000)}" for _ in range(len(w) - cut)]
        assert shingle_jaccard(w, other) >= 0.8
        rows += [(2 * k, " ".join(w), "en"), (2 * k + 1, " ".join(other), "en")]
    got = dict(map(tuple, simhash.near_duplicate_groups(table(spark, rows)).collect()))
    assert len(got) == 600 and all(c in (i, i - i % 2) for i, c in got.items())
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 299  # one pair in 5,000 is expected to be missed


def test_groups_come_through_the_fingerprints_first(spark, monkeypatch):
    rng = random.Random(13)
    rows = []
    for k in range(12):
        w = [f"q{rng.randint(0, 5000)}" for _ in range(3000)]
        rows += [(2 * k, " ".join(w), "en"), (2 * k + 1, " ".join([*w[:-1], "end"]), "en")]
    rows += [(100, " ".join(["same"] * 40), "en"), (101, " ".join(["same"] * 40 + ["but", "not", "so", "here"] * 9), "en")]
    monkeypatch.setattr(simhash, "band_keys", lambda shingles, multipliers: shingles[:0])  # no node shares a band
    got = dict(map(tuple, simhash.near_duplicate_groups(table(spark, rows)).collect()))
    assert got == {**{k: k - k % 2 for k in range(24)}, 100: 100, 101: 101}


def test_groups_are_decided_by_exact_similarity(spark):
    rows, want = [], []
    for k in range(40):  # 800 shingles and 199 or 201 more: a similarity of 0.8008 or 0.7992
        w = [f"t{k}x{i}" for i in range(804)]
        more = [f"m{k}x{i}" for i in range(199 if k % 2 else 201)]
        rows += [(10 * k, " ".join(w), "en"), (10 * k + 1, " ".join(w + more), "en")]
        want += [(10 * k, 10 * k), (10 * k + 1, 10 * k + 1 - k % 2)]
        if k % 4 == 0:  # a text between the two that are too far apart joins them
            rows.append((10 * k + 2, " ".join(w + more[:100]), "en"))
            want[-1:] = [(10 * k + 1, 10 * k), (10 * k + 2, 10 * k)]
    assert sorted(map(tuple, simhash.near_duplicate_groups(table(spark, rows)).collect())) == want


def classes_by_brute_force(sets, similarity=0.8):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    for i, j in links:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))], links


def test_a_dense_group_of_copies_costs_no_square(spark, monkeypatch):
    rng = random.Random(14)
    words, tested = [], []
    for base, n in (([f"a{i}" for i in range(200)], 350), ([f"a{i}" if i < 155 else f"b{i}" for i in range(200)], 150)):  # two groups that share bands
        for k in range(n):
            w = list(base)
            for _ in range(rng.randint(1, 10)):
                i, how = rng.randrange(len(w)), rng.randrange(3)
                w[i : i + (how != 1)] = [f"n{rng.randrange(10**9)}"] if how else []
            words.append(w)
    want, links = classes_by_brute_force([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words])
    assert len(links) > 5000 and 50 < len(set(want)) < 400
    alike = simhash._alike

    def counted(pairs, *more):
        tested.append(pairs.count())
        return alike(pairs, *more)

    monkeypatch.setattr(simhash, "_alike", counted)
    got = dict(map(tuple, simhash.near_duplicate_groups(table(spark, [(i, " ".join(w), "en") for i, w in enumerate(words)])).collect()))
    assert [got[i] for i in range(len(words))] == want
    assert sum(tested) < 10 * len(words), tested


def test_pairs_around_a_centre_leave_out_no_link(spark):
    rng = random.Random(15)
    for similarity, family in ((0.8, 2), (0.6, 1), (0.9, 3)):
        centre = set(range(60))
        bases = [(centre - set(rng.sample(range(60), 8))) | {1000 * (f + 1) + i for i in range(8)} for f in range(family)]
        sets = [frozenset(centre)]
        for k in range(160):
            s = set(rng.choice([centre, *bases]))
            s -= set(rng.sample(sorted(s), rng.randint(0, 14)))
            sets.append(frozenset(s | {rng.randint(5000, 5100) for _ in range(rng.randint(0, 10))}))
        sets = [frozenset(centre), *sorted(set(sets) - {frozenset(centre)}, key=sorted)]
        sets.append(frozenset(range(40)))
        sets = list(dict.fromkeys(sets))
        _, links = classes_by_brute_force(sets, similarity)
        up = {i: 0 if (i, 0) in set(links) else i for i in range(len(sets))}  # only the links to the centre are known
        arms = spark.createDataFrame([(0, i, up[i]) for i in range(1, len(sets))], "src long, dst long, class long")
        held = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, shingles array<long>")
        got = set(map(tuple, simhash._pairs_around_centres(arms, held, similarity, "t").collect()))
        assert all(up[a] != up[b] and a < b for a, b in got)
        assert {(j, i) for i, j in links if up[i] != up[j]} <= got


def test_components_are_those_of_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 80), 100 + rng.randint(0, 80)) for _ in range(60)] + [(500, x) for x in range(501, 560)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in up)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_quality_counts(spark, texts):
    rows = quality.text_features(table(spark, texts), keep=["doc_id", "text"]).select("doc_id", "text", "quality.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = r["text"] or ""
        w = [x for x in regex.split(r"[\x20\x09-\x0d]+", t) if x]
        lines = [x for x in t.split("\n") if regex.search(r"[^\x20\x09-\x0d]", x)]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_binomial_tail_is_exact(spark):
    cases = [(100, 0), (100, 1), (500, 3), (5000, 20), (7, 7)]
    n, k = F.col("n"), F.col("k")
    for r in spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(n, k, 0.0125).alias("p")).collect():
        p = Fraction(1, 80)
        want = float(sum(comb(r["n"], j) * p**j * (1 - p) ** (r["n"] - j) for j in range(r["k"] + 1))) if r["k"] <= r["n"] / 80 else 1.0
        assert abs(r["p"] - want) < 1e-9


def test_cutoffs_are_certified_and_keep_the_good(spark, texts):
    word = " ".join(f"w{i}" for i in range(30))
    rows = [(i, word + f" v{i} u{i}" + (" ### $$$ %%% |||" * 3 if i % 5 == 0 else ""), "en" if i < 1500 else None) for i in range(1700)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(1700)] + [(9999, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    cuts = quality.choose_cutoffs(docs, labels)
    found = {(r["stratum"], r["rule"]): r for r in cuts.collect()}
    assert ("en", "symbol_share") in found and all(k[0] == "en" for k in found)  # 160 good ones certify nothing in the stratum without a language
    assert found["en", "symbol_share"]["rejected_good"] == 0 and found["en", "symbol_share"]["p_value"] < 0.05
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, cuts, keep=["doc_id"]).collect()}
    assert all(kept[i] == (i % 5 != 0) for i in range(1500)) and all(kept[i] for i in range(1500, 1700))
    odd = table(spark, texts)
    judged = quality.judge(odd, quality.choose_cutoffs(odd, labels.limit(0)), keep=odd.columns)
    assert judged.count() == len(texts) and judged.where("kept = base_failed").count() == 0
    assert quality.judge(odd.limit(0), cuts, keep=["doc_id"]).count() == 0


def test_cutoffs_count_every_label(spark):
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("doc_id")) for i in range(24)])
    bad = F.col("doc_id") % 6 == 0
    rows = spark.range(100_600).withColumnRenamed("id", "doc_id").withColumn("lang", F.when(F.col("doc_id") < 600, "small").otherwise("large"))
    docs = rows.withColumn("text", F.concat(words, F.when(bad, " ### $$$ %%% ||| ### $$$").otherwise("")))
    cuts = quality.choose_cutoffs(docs, rows.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality"))).collect()
    found = {(r["stratum"], r["rule"]): r["n_good"] for r in cuts}
    assert found == {("small", "symbol_share"): 500, ("large", "symbol_share"): 83_333}


def test_contamination(spark, texts):
    rng = random.Random(5)
    vocabulary = [f"item{i}" for i in range(300)]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(20)) + ". " + " ".join(rng.choice(vocabulary) for _ in range(6)) + ".") for i in range(30)]
    clean = [(i, t, lang) for i, t, lang in texts]
    dirty = [(1000 + k, ("lead in words " * (40 * k)) + bench[k][1].upper() + " and on" * 50, "en") for k in range(10)]
    items = spark.createDataFrame([*bench, bench[0], (None, "x"), (77, None), (78, " ")], "item_id long, text string")
    docs = table(spark, clean + dirty)
    got = decontaminate.contamination(docs, items).where("contaminated").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1000 + k, k) for k in range(10)]
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and left.count() == len(clean)
    assert decontaminate.clean(docs, items.limit(0)).count() == len(clean) + 10
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), items).count() == 0
    assert sum(1 for _ in decontaminate.build_indexes(items, 7)) == 5  # several indexes


def test_long_items_are_found(spark):
    rng = random.Random(13)
    vocabulary = [f"item{i}" for i in range(900)]
    made = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(k, made(n - 10) + ". " + made(10) + ".") for k, n in enumerate((20, 63, 130, 400, 1500))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    docs = table(spark, [(100 + k, "lead in words " * 70 + t + " and on" * 300, "en") for k, t in bench] + [(7, made(3000), "en")])
    got = decontaminate.contamination(docs, items).where("contaminated").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(100 + k, k) for k, _ in bench]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [7]


def test_copies_with_an_edited_end_and_hidden_copies_are_found(spark):
    rng = random.Random(14)
    vocabulary = [f"item{i}" for i in range(900)]
    bench = [(k, " ".join(rng.choice(vocabulary) for _ in range(24)) + ". " + " ".join(rng.choice(vocabulary) for _ in range(3)) + ".") for k in range(3)]
    words = [t.split() for _, t in bench]
    between = " and on" * 300
    rows = [
        (100, " ".join([*words[0][:-1], "misspelt"]) + between),
        (101, " ".join(words[1][:24]) + between),  # the last sentence is cut off
        (102, " ".join(rng.sample(words[2], 27)) + between + " ".join(words[2][:26]) + between),  # all words in another order score higher than the copy
        (103, " ".join(rng.sample(words[2], 27)) + between),
    ]
    items = spark.createDataFrame(bench, "item_id long, text string")
    docs = table(spark, [(*r, "en") for r in rows])
    got = decontaminate.contamination(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["contaminated"]) for r in got) == [(100, 0, True), (101, 1, True), (102, 2, True), (103, 2, False)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [103]


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    docs = table(spark, texts)
    rows = packing.pack(packing.token_pieces(docs, with_ids=True), parts=3).collect()
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]] and len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"]))
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048 and len(at) <= -(-sum(at.values()) // 2048) + 1
    whole = Counter()
    for i, t, _ in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            whole[i, k // 2048, k, tuple(ids[k : k + 2048])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in rows) == whole
    assert packing.pack(packing.token_pieces(docs.limit(0))).count() == 0


def test_language_model(spark, texts, monkeypatch):
    docs, training = table(spark, texts), table(spark, texts[:50])
    monkeypatch.setattr(language_model, "HEAD", 25)  # words outside the head are joined
    counts = Counter(w for _, t, _ in texts[:50] for w in [*language_model.tokens(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    from math import log10

    for i, t, _ in texts:
        w = [*language_model.tokens(t), b""]
        want[i, len(w), sum(counts[x] > 0 for x in w), round(sum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    got = language_model.score(docs, training).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert language_model.score(docs.limit(0), training).count() == 0
    assert all(r["n_known"] == 0 for r in language_model.score(docs.limit(5), training.limit(0)).collect())


def test_language(spark):
    rng = random.Random(6)
    letters = {"xx": "aeioubcd", "yy": "mnopqrst", "zz": "éüöwxyzk"}
    made = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 8))) for _ in range(40)), k) for i, k in enumerate(list(letters) * 30)]
    odd = [(500, None, "xx"), (501, "", "xx"), (502, "123 !?", "yy"), (503, "moprst " * 40_000, None), made[0]]
    profiles = language.learn(table(spark, made[:60] + odd[:3]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(table(spark, made + odd), profiles, ["doc_id"]).collect()}
    assert all(got[i][0] == k for i, _, k in made) and all(got[i] == ("und", 0.0) for i in (500, 501, 502)) and got[503][0] == "yy"
    assert all(0 <= s <= 1 for _, s in got.values())
    none = language.learn(table(spark, made[:0]))
    assert {tuple(r) for r in language.predict(table(spark, made[:2]), none, ["doc_id"]).collect()} == {(0, "und", 0.0), (1, "und", 0.0)}


def test_languages_of_small_scripts(spark):
    rng = random.Random(15)
    starts = {"big": 0x4E00, "yi": 0xA002, "vai": 0xA500, "ge": 0x10D1, "am": 0x1200}  # the small ones have the same words, each in its own letters
    words = {n: [[rng.randrange(n) for _ in range(rng.randint(2, 8))] for _ in range(200)] for n in (9, 300)}
    made = [(i, " ".join("".join(chr(starts[k] + x) for x in rng.choice(words[300 if k == "big" else 9])) for _ in range(3000 if k == "big" else 30)), k) for i, k in enumerate(list(starts) * 40)]
    profiles = language.learn(table(spark, made[:100]))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(table(spark, made[100:]), profiles, ["doc_id"]).collect()}
    assert [got[i] for i, _, _ in made[100:]] == [k for _, _, k in made[100:]]


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("org", "/", "block")]
    rows = [(1, "http://A.Example.ORG/es/1?x"), (2, "https://x.org/"), (3, None), (4, "no scheme"), (5, ""), (6, "a://org?q=/"), (7, "http://forg/"), (8, "http://x.org/a#/b"), (8, "http://x.org/a#/b"), (None, "http://x.org/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "_url")})
    got = sorted(map(tuple, urls.judge(pages, rules).collect()), key=str)
    assert got == sorted(
        [(1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "x.org", "/", "org/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "org", "", None, "allow"),
         (7, "forg", "/", None, "allow"), (8, "x.org", "/a", "org/", "block"), (8, "x.org", "/a", "org/", "block"), (None, "x.org", "/es/", "org/", "block")], key=str)
    assert urls.judge(pages.limit(0), rules).count() == 0 and urls.judge(pages, []).where("rule IS NOT NULL").count() == 0
    parts = sorted(map(tuple, urls.judge(pages, rules).collect()), key=str)
    assert parts == got


def test_shards(spark, texts):
    rng = random.Random(7)
    rows = [(i, "z" * rng.randint(0, 400), "en") for i in range(3000)] + [(5000 + i, "hot text " * 20, "en") for i in range(1500)] + texts[:70]
    got = sharding.assign(table(spark, rows), 6).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    load, slots = Counter(), {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(load.values()) < 1.03 * min(load.values()) and len(load) == 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(table(spark, texts), 6).count() == len(texts) and sharding.assign(table(spark, texts[:0]), 6).count() == 0


def test_toxicity(spark, texts):
    rng = random.Random(8)
    plain = [f"p{c}{d}o" for c in "abcdefgh" for d in "aeiou"]
    made = [(i, " ".join(rng.choice(plain) for _ in range(40)) + (" foulword vileness" if i % 4 == 0 else ""), "en") for i in range(800)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 600)] + [(None, 1, 1), (7777, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, made + texts[-12:])
    index = toxicity.learn(docs, labels)
    got = toxicity.score(docs, index, ["doc_id"]).collect()
    assert len(got) == len(made) + 12 and all(0 <= r["score"] <= 1 for r in got)
    late = {r["doc_id"]: r["score"] for r in got if r["doc_id"] is not None and 600 <= r["doc_id"] < 800}
    assert all((s >= 0.5) == (i % 4 == 0) for i, s in late.items())
    kept = toxicity.score(docs, index, below=0.5)
    assert kept.columns == docs.columns and kept.count() == len(made) - 200 + 12
    blank = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(docs, blank, below=0.6).count() == len(made) + 12 and toxicity.score(docs.limit(0), index, ["doc_id"]).count() == 0


def windows_that_hold(notices, rows):
    """(doc_id, template) to (share, first word, windows), every window of every text against every notice."""
    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    want = {}
    for name, notice in notices:
        w = split(notice)
        pairs, width = set(zip(w, w[1:])), 4
        while width < len(w):
            width *= 2
        for i, t, _ in rows:
            v = split(t)
            p = list(zip(v, v[1:]))
            best = [(len(pairs & set(p[s : s + 2 * width - 1])) / len(pairs), s) for s in range(0, max(0, len(v) - 1), width)]
            hits = [(c, s) for c, s in best if c >= licenses.CONTAINED - 1e-9]
            if hits:
                want[i, name] = (round(max(hits)[0], 6), min(s for _, s in hits), len(hits))
    return want


def scanned(docs, *more):
    return {(r["doc_id"], r["template"]): (round(r["containment"], 6), r["first_word"], r["n_windows"]) for r in licenses.scan(docs, *more).collect()}


def test_licenses(spark, texts):
    rng = random.Random(9)
    notices = list(licenses.TEMPLATES.items())
    made = []
    for i in range(40):
        words = [f"p{rng.randint(0, 500)}" for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(words))
        made.append((i, " ".join([*words[:at], notices[i % len(notices)][1] if i % 3 else "", *words[at:]]), "en"))
    rows = made + [(90 + k, t, "en") for k, (_, t, _) in enumerate(texts[-14:])] + [(None, "ALL rights, reserved", None)]
    want = windows_that_hold(notices, rows)
    assert scanned(table(spark, rows)) == want and len(want) >= 25
    assert licenses.scan(table(spark, rows[:0])).count() == 0 and licenses.scan(table(spark, rows), {}).count() == 0


@pytest.mark.parametrize("searched", [0, 10_000])
def test_whole_licenses_and_edited_notices(spark, monkeypatch, searched):
    """A text of 1,600 words, and copies of it and of short notices with words changed, near both sides of the limit."""
    monkeypatch.setattr(licenses, "SEARCHED", searched)
    rng = random.Random(10)
    some = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("ai", "on", "ur") for c in ("ret", "sion", "", "ment")]
    notices = {"whole": " ".join(rng.choice(some) for _ in range(1600)), "short": "Under the terms of Some License v 2", "two": "Copyright Holders"} | {f"n{k}": " ".join(rng.choice(some) for _ in range(rng.randint(2, 60))) for k in range(30)}
    rows = []
    for i in range(60):
        words = rng.choice(list(notices.values())).split() if i % 4 else notices["whole"].split()
        for k in rng.sample(range(len(words)), int(len(words) * rng.choice((0, 0, 0.05, 0.1, 0.12)))):
            words[k] = f"changed{k}"
        rows.append((i, " ".join([*(rng.choice(some) for _ in range(rng.randint(0, 300))), *words, "end"]), "en"))
    want = windows_that_hold(list(notices.items()), rows)
    assert scanned(table(spark, rows), notices) == want and len({i for i, n in want if n == "whole"}) >= 8


def test_needed_pairs():
    pairs = [("all", "rights"), ("rights", "reserved")]
    assert licenses.needed(pairs, 0.8) == ({1}, {"reserved"})
    many = [(f"w{k}", f"w{k + 1}") for k in range(20)]
    held, words = licenses.needed(many, 0.8)
    assert len(held) >= 5 and all(set(many[k]) & words for k in held)
