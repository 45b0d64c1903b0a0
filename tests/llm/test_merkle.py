"""The Merkle manifest against a plain recursive version, and its proofs against a verifier that holds nothing else."""

import hashlib

from pyspark.sql import functions as F

from tidewire.llm import merkle

CLASH = ("grp", "rank", "total", "digest", "changed", "slots", "siblings", "root", "subroot", "name", "key", "of", "block", "_tie", "_at")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root, and siblings level by level for each node."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(place):
            run = nodes[at - at % 16 : at - at % 16 + 16]
            paths[k].append((run[: at % 16], run[at % 16 + 1 :]))
        nodes = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        place = [at // 16 for at in place]
    return nodes[0], paths


def folded(node, path):
    for left, right in path:
        node = digest(*left, node, *right)
    return node


def expected(rows, change):
    """(doc_id, leaf, subroot, root, siblings, folded_root) of each (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in by[s]])
    root, tops = tree([trees[s][0] for s in sources]) if sources else ("", [])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip(by[s], trees[s][1], strict=True):
            new = leaf_of(change(r))
            out.append((r[0], leaf_of(r), trees[s][0], root, "".join("".join([*a, *b]) for a, b in path + top), folded(new, path + top)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(5)


def result(docs):
    where = F.col("doc_id") % 5 == 0
    found = merkle.manifest(docs, replaced={"text": F.translate("text", "ABC", "abc")}, where=where)
    checked = found.withColumn("again", merkle.fold(F.col("leaf"), F.col("slots"), F.col("siblings")))
    rows = checked.collect()
    assert all(r["again"] == r["root"] for r in rows)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], "".join(r["siblings"]), r["folded_root"]) for r in rows), key=repr)


def change(r):
    return (*r[:4], None if r[4] is None else r[4].translate(str.maketrans("ABC", "abc"))) if r[0] is not None and r[0] % 5 == 0 else r


def test_sources_of_every_size(spark):
    rows = [(k, "hot", ("en", None)[k % 2], k, f"A text {k} B") for k in range(4500)]  # four levels
    rows += [(k, f"s{k % 40}", "de", None, "é" * (k % 7)) for k in range(10_000, 10_300)]
    rows += [(20_001, "one", None, 1, "ABC"), (20_005, "ONE", None, 1, "ABC"), (20_010, None, "en", 3, None), (20_011, "", "en", 3, ""), (20_015, "ü", "en", 1, "lower"), (20_016, "𝒳", "-", 0, "-")]
    assert result(frame(spark, rows)) == expected(rows, change)


def test_nulls_repeated_rows_long_and_empty_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, None, "en", 1, "A" * 300_000)] * 20 + [(5, None, "en", 1, "B"), (7, "x", "en", 1, ""), (7, "x", "en", 1, None)]
    assert result(frame(spark, rows)) == expected(rows, change)


def test_one_row_is_its_own_root(spark):
    rows = [(1, "a", "en", 1, "A")]
    assert result(frame(spark, rows)) == expected(rows, change) == [(1, leaf_of(rows[0]), leaf_of(rows[0]), leaf_of(rows[0]), "", leaf_of(rows[0]))]


def test_nothing(spark):
    assert result(frame(spark, [(1, "a", "en", 1, "A")]).limit(0)) == []
