"""Click feedback and bandit scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.core import round_half_up

# Exploration weight, candidate count.
UCB_C = 1.414
CANDIDATES = 50


def feedback_counts(feedbacks: DataFrame) -> DataFrame:
    """Clicks and impressions per article (A5)."""
    kind = F.col("event_type")
    return feedbacks.groupBy("article_id").agg(F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "impression").alias("impressions"))


def feedback_to_score(feedbacks: DataFrame) -> DataFrame:
    """A click scores 1, anything else 0."""
    return feedbacks.withColumn("score", F.when(F.col("event_type") == "click", 1.0).otherwise(0.0))


def latest(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The newest ``n`` rows (T2); ties by id."""
    return rows.orderBy(F.desc(by), F.desc("id")).limit(n)


def feedback_stats_for(candidates: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """Candidates with their counts (J2). Feedback is cut down to the candidates before it is counted."""
    ids = candidates.select(F.col("id").alias("article_id"))
    counts = feedback_counts(feedbacks.join(ids, "article_id", "left_semi"))
    joined = candidates.join(counts, candidates["id"] == counts["article_id"], "left").drop("article_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("clicks", "impressions")})


def _uniforms(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each 64-bit key, by the mixing steps of splitmix64."""
    x = keys + np.uint64(draw) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54


def _gammas(keys: np.ndarray, shape: np.ndarray, first: int) -> np.ndarray:
    """Gamma samples for shapes of at least 1, all rows at once: rejection from a cubed normal, repeated for the rows not accepted yet."""
    d = shape - 1 / 3
    out, open_rows, draw = d.copy(), np.arange(len(shape)), first
    while len(open_rows):
        k, e = keys[open_rows], d[open_rows]
        n = np.sqrt(-2 * np.log(_uniforms(k, draw))) * np.cos(2 * np.pi * _uniforms(k, draw + 1))
        v = (1 + n / np.sqrt(9 * e)) ** 3
        ok = (v > 0) & (np.log(_uniforms(k, draw + 2)) < 0.5 * n * n + e - e * v + e * np.log(np.maximum(v, 1e-300)))
        out[open_rows[ok]] = (e * v)[ok]
        open_rows, draw = open_rows[~ok], draw + 6
    return out


def beta_sampler(seed: int):
    """A vectorised column function (key, alpha, beta) -> Beta sample for alpha, beta >= 1; the same for the same seed and key."""

    @F.pandas_udf("double")
    def sample(keys: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
        bits = keys.to_numpy().astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            a = _gammas(bits, alpha.to_numpy().astype(float), 1)
            b = _gammas(bits, beta.to_numpy().astype(float), 4)
        return pd.Series(a / (a + b))

    return lambda ids, alpha, beta: sample(F.xxhash64(ids, F.lit(seed)), alpha, beta)


def thompson_inputs(stats: DataFrame) -> DataFrame:
    """id, alpha and beta of every candidate: clicks + 1 and misses + 1."""
    misses = F.greatest(F.col("impressions") - F.col("clicks"), F.lit(0))
    return stats.select("id", (F.col("clicks") + 1).alias("alpha"), (misses + 1).alias("beta"))


def thompson_scores(stats: DataFrame, seed: int, n: int = 5) -> DataFrame:
    """The best ``n`` candidates by a Beta(clicks + 1, misses + 1) sample (M8)."""
    misses = F.greatest(F.col("impressions") - F.col("clicks"), F.lit(0))
    score = beta_sampler(seed)(F.col("id"), F.col("clicks") + 1, misses + 1)
    return stats.withColumn("score", score).orderBy(F.desc("score"), "id").limit(n).withColumn("score", round_half_up("score", 4))


def recommend(articles: DataFrame, feedbacks: DataFrame, seed: int, n: int = 5, candidates: int = CANDIDATES) -> DataFrame:
    """Thompson sampling over the newest articles."""
    newest = latest(articles.select("id", "title", "published_at"), "published_at", candidates)
    return thompson_scores(feedback_stats_for(newest, feedbacks), seed, n)


def ucb1_scores(stats: DataFrame, c: float = UCB_C) -> DataFrame:
    """Upper confidence bounds (M9); an article without trials comes first."""
    trials = F.col("impressions").cast("double")
    everyone = stats.agg(F.greatest(F.coalesce(F.sum("impressions"), F.lit(0)), F.lit(1)).cast("double")).scalar()
    bound = F.col("clicks") / trials + F.lit(c) * F.sqrt(F.ln("all_trials") / trials)
    scored = stats.withColumn("all_trials", everyone)
    return scored.withColumn("score", F.when(F.col("impressions") == 0, F.lit(float("inf"))).otherwise(round_half_up(bound, 6))).drop("all_trials")
