"""Operator 8: quality rules whose cutoffs are chosen under a proven limit on false rejections. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewire.llm.common import BLANKS, BROADCAST_ROWS

#: Cutoffs of each rule, fixed before any label is seen (a condition of the tests below), loosest last.
GRID = {
    "symbol_share": [0.005 * i for i in range(1, 41)],
    "shout_share": [0.01 * i for i in range(1, 51)],
    "dup_line_share": [0.02 * i for i in range(1, 46)],
    "repeat_share": [0.01 * i for i in range(1, 46)],
}
#: Limit on the share of good documents that all rules together may reject in a stratum, and the chance that any limit is broken.
RISK, DELTA = 0.05, 0.05


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))


def _window_hashes(words: str) -> Column:
    """A hash for each window of eight words: words are hashed once, then pairs of words, pairs of pairs and pairs of fours."""
    h, n = F.transform(words, lambda w: F.xxhash64(w)), F.size(words)

    def doubled(width: int):
        m = n - 2 * width + 1  # windows of twice the width
        return lambda x: F.zip_with(F.slice(x, 1, m), F.slice(x, width + 1, m), lambda a, b: F.xxhash64(a, b))

    # each step names its input as a lambda variable, so that nothing is computed twice
    for width in (1, 2, 4):
        h = F.transform(F.array(h), doubled(width))[0]
    return h


def _repeat_words() -> Column:
    """Words inside windows that occur twice or more: equal window hashes side by side after a sort, then the union of their spans."""
    pairs = F.col("_pairs")
    at = lambda k: F.get(pairs, k)["h"]
    starts = F.array_sort(F.transform(F.filter(pairs, lambda x, k: (at(k - 1) == x["h"]) | (at(k + 1) == x["h"])), lambda x: x["i"]))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(8), i + 8 - a["end"])).alias("n"), (i + 8).alias("end"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-8).alias("end")), step, lambda a: a["n"])


def text_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and one struct ``quality`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts.

    A null or blank text has no words, lines or symbols: every count is 0. Counts are over the whole text.
    """
    keep = docs.columns if keep is None else keep
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumn("_words", _words(F.col("_text")))
    windows = F.when(F.size("_words") >= 8, _window_hashes("_words")).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    df = df.withColumns({"_windows": windows, "_lines": lines})
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    pairs = F.when(repeated, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_pairs", pairs)
    counts = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeat_words(), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        ((F.length("_text") - F.length(F.replace("_text", F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_shouts"),
    )
    # explode of a one-element array: later filters on the counts stay above it, so that no count is computed twice
    return df.select("_row", F.explode(F.array(counts)).alias("quality")).select("_row.*", "quality")


def rule_values(q: str = "quality") -> dict[str, Column]:
    """Value of each rule, from 0 up; a text without words has 0 in all."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(f"{q}.{a}"), F.col(f"{q}.{b}")), F.lit(0.0))
    return {"symbol_share": share("n_symbols", "word_chars"), "shout_share": share("n_shouts", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")}


def base_failed(q: str = "quality") -> Column:
    return (F.col(f"{q}.n_words") < 20) | (100 * F.col(f"{q}.n_repeat_words") > 30 * F.col(f"{q}.n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exactly, as the sum of its terms; 1 where k is above the mean, where no test passes anyway."""
    odds = F.log(F.lit(p / (1 - p)))
    first = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(terms, first, step, lambda a: a["s"]))


def choose_cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang", grid: dict[str, list[float]] | None = None, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, rejected_good, p_value): the certified cutoff of each rule; a rule without one is missing.

    Of the good documents of a stratum, a cutoff would reject a share that must not exceed ``risk`` / rules. That it does is the hypothesis
    tested, with the exact binomial tail, from the loosest cutoff on until the first that isn't refuted (fixed-sequence testing needs no correction within
    a rule); ``delta`` is divided by rules x strata (Bonferroni). With probability 1 - delta every certified cutoff keeps its limit.
    Among the certified ones the cutoff is taken that gains most (share of bad documents less five times the share of good ones),
    ties going to the loosest; without gain the rule is off. Strata of few labels certify nothing. Every labelled row is counted.

    A null stratum counts as the stratum "". Labels without a document, null labels and repeated labels of an id (the smallest counts) are left out.
    """
    grid = GRID if grid is None else grid
    held = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
    few = held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    base = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").alias("text"))
    rows = text_features(base.join(F.broadcast(held) if few else held, "_id"), keep=["stratum", "_good"])
    values = rule_values()
    level = lambda r: F.size(F.filter(F.array(*map(F.lit, grid[r])), lambda c: c < values[r]))  # noqa: E731  cutoffs that reject the document
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in grid])
    levels = rows.select("stratum", "_good", F.inline(entries))
    counted = levels.groupBy("stratum", "rule", "level").agg(F.count_if(F.col("_good") == 1).alias("g"), F.count_if(F.col("_good") != 1).alias("b"))
    spine = counted.select("stratum").distinct().select("stratum", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i + 1).alias("level"), F.lit(c).alias("cutoff")) for r, cuts in grid.items() for i, c in enumerate(cuts)])))
    totals = counted.groupBy("stratum", "rule").agg(F.sum("g").alias("n_good"), F.sum("b").alias("n_bad"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    tried = spine.join(counted, ["stratum", "rule", "level"], "left").join(totals, ["stratum", "rule"])
    tried = tried.withColumns({"rejected_good": F.sum(F.coalesce("g", F.lit(0))).over(above), "rejected_bad": F.sum(F.coalesce("b", F.lit(0))).over(above)})
    tried = tried.withColumn("_strata", F.size(F.collect_set("stratum").over(Window.partitionBy("rule"))))
    tried = tried.withColumn("p_value", binomial_tail(F.col("n_good"), F.col("rejected_good"), risk / len(grid)))
    ok = F.col("p_value") <= delta / len(grid) / F.col("_strata")
    tried = tried.withColumn("_certified", F.min(ok.cast("int")).over(above) == 1)
    gain = F.coalesce(F.try_divide("rejected_bad", "n_bad"), F.lit(0.0)) - 5 * F.col("rejected_good") / F.greatest("n_good", F.lit(1))
    best = F.max_by(F.struct("cutoff", "n_good", "rejected_good", "p_value"), F.struct(gain, "level"))
    chosen = tried.where("_certified").where(gain > 0).groupBy("stratum", "rule").agg(best.alias("best"))
    return chosen.select("stratum", "rule", "best.*")


def judge(docs: DataFrame, cutoffs: DataFrame, stratum: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all), ``quality``, ``base_failed``, ``broken`` (names of the rules that are broken) and ``kept``.

    ``cutoffs`` has a row for each stratum and rule, few by construction (a stratum needs hundreds of labels for one), and is broadcast.
    """
    keep = docs.columns if keep is None else keep
    by = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.collect_list(F.struct("rule", "cutoff")).alias("_cutoffs"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row_"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), F.col("text").alias("_text_"))
    df = text_features(base, "_text_", keep=["_row_", "_stratum"]).join(F.broadcast(by), "_stratum", "left")
    value = F.create_map(*[x for r, v in rule_values().items() for x in (F.lit(r), v)])
    broken = F.transform(F.filter(F.coalesce("_cutoffs", F.array().cast("array<struct<rule:string,cutoff:double>>")), lambda c: F.col("_value")[c["rule"]] > c["cutoff"]), lambda c: c["rule"])
    df = df.withColumn("_value", value).withColumn("_broken", broken)
    return df.select("_row_", "quality", base_failed().alias("_failed"), "_broken").select(
        "_row_.*", "quality", F.col("_failed").alias("base_failed"), F.col("_broken").alias("broken"), (~F.col("_failed") & (F.size("_broken") == 0)).alias("kept")
    )
