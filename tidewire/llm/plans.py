"""The registered queries of this package, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import alignment, decontaminate, language, language_model, licenses, merkle, packing, quality, repeats, sharding, simhash, toxicity, urls
from tidewire.llm.common import rest_of_crc, table


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of the other four fifths, beside that of counts alone."""
    docs = table(spark, sf_dir, "documents")
    scored = language_model.score(docs, docs.where(rest_of_crc("doc_id", 5) != 1))
    return scored.select("doc_id", (rest_of_crc("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; profiles are learned from the other two thirds."""
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn(docs.where(rest_of_crc("doc_id", 3) != 1))
    found = language.predict(docs, profiles, ["doc_id"])
    return found.select("doc_id", (rest_of_crc("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


#: Fixed rules of the query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest matching rule and verdict for every page."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of near equal bytes."""
    return sharding.assign(table(spark, sf_dir, "documents"), 24)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict for every document, with cutoffs certified on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    cutoffs = quality.choose_cutoffs(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs, cutoffs, keep=["doc_id"])
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "broken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by fingerprints of four-word shingles at four or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a passage of a document retrieves, with the overlaps that decide."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and evidence for every document; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    index = toxicity.learn(docs, table(spark, sf_dir, "labels").where(rest_of_crc("doc_id", 5) != 0))
    scored = toxicity.score(docs, index, ["doc_id"])
    return scored.select("doc_id", (rest_of_crc("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "matched")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when strings of 100 bytes that begin earlier are removed."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.sha2("kept", 256), "text_sha256").alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; every fifth one by crc32 is checked with its text in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = merkle.manifest(table(spark, sf_dir, "documents"), replaced={"text": F.translate("text", upper, lower)}, where=rest_of_crc("doc_id", 5) == 0)
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the ids of two tokenizers for every document, weighed by the counts of the whole corpus."""
    found = alignment.align(table(spark, sf_dir, "documents"), outcome=alignment.sha256_of)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_simhash, op2_decontaminate, op3_best_fit_packing, op4_language_model, op5_language, op6_url_rules, op7_sharding, op8_quality_rules, op9_toxicity, op10_licenses),
        *(op11_suffix_array_dedup, op12_merkle_manifest, op13_token_alignment),
    )
}


def _merkle_sql(levels: int = 4, group_levels: int = 3) -> str:
    """SQL for op12: so many levels of sixteen for a source's leaves and for the sources, enough for 65,536 documents a source and 4,096 sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce(list_prepend(xor(c, b), [CAST(x AS BIGINT) FOR x IN range(8)]), lambda d, _: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {byte}), 4294967295)"
    parts = [f"l0 AS (SELECT doc_id, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, {leaf('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS f FROM documents)"]
    parts.append("n0 AS (SELECT g, i, h FROM l0)")

    def up(name: str, k: int) -> str:  # a group's only node stays as it is
        one = "count(*) = 1 AND any_value(t) = 1"
        return f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN {one} THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS t FROM {name}{k}) GROUP BY g, i // 16)"

    parts += [up("n", k) for k in range(levels)]
    parts.append(f"s0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS name FROM n{levels})")
    parts += [up("s", k) for k in range(group_levels)]

    def step(before: str, after: str, tree: str, i: str, g: str) -> str:  # what a run's others are, and the folded node with them
        run = f"(SELECT g, i // 16 AS run, list(h ORDER BY i) AS hs, any_value(t) AS t FROM (SELECT *, count(*) OVER (PARTITION BY g) AS t FROM {tree}) GROUP BY g, i // 16)"
        left, right = f"array_to_string(hs[1:CAST({i} % 16 AS BIGINT)], '')", f"array_to_string(hs[CAST({i} % 16 + 2 AS BIGINT):], '')"
        return f"{after} AS (SELECT x.* REPLACE ({i} // 16 AS {i}, CASE WHEN t = 1 THEN p ELSE p || {left} || {right} END AS p, CASE WHEN t = 1 THEN f ELSE sha256({left} || f || {right}) END AS f) FROM {before} x JOIN {run} r ON x.{g} IS NOT DISTINCT FROM r.g AND x.{i} // 16 = r.run)"

    parts.append("w0 AS (SELECT l0.*, '' AS p, l0.i AS k, 0 AS zero FROM l0)")
    parts += [step(f"w{k}", f"w{k + 1}", f"n{k}", "k", "g") for k in range(levels)]
    parts.append(f"v0 AS (SELECT w.* REPLACE (s0.i AS k), s0.h AS subroot FROM w{levels} w JOIN s0 ON w.g IS NOT DISTINCT FROM s0.name)")
    parts += [step(f"v{k}", f"v{k + 1}", f"s{k}", "k", "zero") for k in range(group_levels)]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, v.h AS leaf, subroot, s.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = s.h AS verified FROM v{group_levels} v, s{group_levels} s"


SQL: dict[str, str] = {
    "op6_url_rules": """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, f, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(h || f, length(h) * 1000 + length(f)) AS rule, arg_max(v, length(h) * 1000 + length(f)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op12_merkle_manifest": _merkle_sql(),
    "op11_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(n - 99, 0))) AS p FROM d)),
later AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r
  FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM later)),
spans AS (SELECT doc_id, min(p) AS b, max(p) + 100 AS e FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM spans),
cut AS (SELECT g.doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) || substr(any_value(x), 2 * max(e) + 1) AS kept
  FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id""",
}
