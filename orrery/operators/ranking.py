"""Ranks, cuts, and the merge of candidate sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What stands for a source that didn't give a candidate.
NO_RANK, NO_PCT, NO_SCORE = 1000, 2.0, -1.0


def ranked(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """df with position (score, then repo id, falling) and min_rank / max_rank, the range of its ties, within by."""
    order = Window.partitionBy(*by).orderBy(F.desc(score))
    ties = Window.partitionBy(*by, score)
    out = df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.desc("repo_id"))) - 1)
    out = out.withColumn("min_rank", F.rank().over(order) - 1)
    return out.withColumn("max_rank", F.col("min_rank") + F.count("*").over(ties))


def kept(df: DataFrame, most: int, least_score: float = 0.0, score: str = "score") -> DataFrame:
    """df of ranked() with keep: among the first most, and scored least_score at least."""
    return df.withColumn("keep", (F.col("position") < most) & (F.col(score) >= least_score))


def top(df: DataFrame, by: list[str], n: int, score: str = "score") -> DataFrame:
    """The first n of each group; Spark cuts groups before the shuffle."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.desc("repo_id")))
    return df.withColumn("k", k).where(F.col("k") <= n).drop("k")


def rank_by_popularity(ids: DataFrame, popularity: DataFrame) -> DataFrame:
    """group_id, repo_id and position of given ids, the most watched first."""
    n = popularity.select("repo_id", "n_watchers")
    rows = ids.join(n, "repo_id", "left").withColumn("n_watchers", F.coalesce("n_watchers", F.lit(0)))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n_watchers"), "repo_id")) - 1)


def unwatched(df: DataFrame, watched: DataFrame) -> DataFrame:
    """df without what its users watch. Rows go to their user, and what follows by user and repo needs no other exchange."""
    seen = watched.groupBy("user_id").agg(F.collect_list("repo_id").alias("seen"))
    return df.join(seen.hint("merge"), "user_id", "left").where(~F.coalesce(F.array_contains("seen", F.col("repo_id")), F.lit(False))).drop("seen")


def merge(candidates: DataFrame, watched: DataFrame, sources: list[str]) -> DataFrame:
    """One row for each (user, repo) that a source kept and the user doesn't watch.

    candidates: user_id, repo_id, source, score, min_rank, size (of the source's list), keep. The result has each source's rank,
    percentile and score (or what stands for its absence), summaries over sources, and the summed score.
    """
    rows = unwatched(candidates.where("keep"), watched)
    at = lambda s, x: F.max(F.when(F.col("source") == s, x))
    columns = []
    for s in sources:
        columns += [at(s, F.col("min_rank")).alias(f"{s}_rank"), at(s, F.col("min_rank") / F.col("size")).alias(f"{s}_pct"), at(s, F.col("score")).alias(f"{s}_score")]
    each = rows.groupBy("user_id", "repo_id").agg(*columns, F.count("*").alias("num_in"), F.sum("min_rank").alias("in_rank"), F.min("min_rank").alias("min_in_rank"), F.max("min_rank").alias("max_in_rank"), F.sum("score").alias("score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    # A source that lacks the candidate counts as ranked after all that were made for the user.
    each = each.withColumn("num_generated", F.count("*").over(Window.partitionBy("user_id")))
    missing = F.lit(len(sources)) - F.col("num_in")
    total = F.col("in_rank") + missing * (F.col("num_generated") + 1)
    fill = {f"{s}_rank": NO_RANK for s in sources} | {f"{s}_pct": NO_PCT for s in sources} | {f"{s}_score": NO_SCORE for s in sources}
    return each.fillna(fill).select(
        "user_id", "repo_id", *fill, "num_in", total.alias("total_rank"), F.least(F.lit(10000), F.col("min_in_rank")).alias("min_rank_in"), F.col("max_in_rank").alias("max_rank_in"),
        (total / len(sources)).alias("avg_rank"), "score", F.col("min_score"), F.col("max_score"), (F.col("score") / len(sources)).alias("avg_score"),
    )


def heuristic(df: DataFrame, by: list[str]) -> DataFrame:
    """df of merged candidates with the mean of its tie range as rank, and that over the group's size."""
    out = ranked(df, by).withColumn("heuristic_rank", (F.col("min_rank") + F.col("max_rank")) / 2)
    return out.withColumn("heuristic_pct", F.col("heuristic_rank") / F.count("*").over(Window.partitionBy(*by)))


def recommendations(df: DataFrame, watched: DataFrame, n: int) -> DataFrame:
    """user_id and its first n unwatched repos in order, as structs of repo_id and score."""
    rows = top(df.join(watched, ["user_id", "repo_id"], "left_anti"), ["user_id"], n)
    found = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("repo_id")).alias("r"))))  # n at most
    return rows.groupBy("user_id").agg(F.transform(found, lambda x: F.struct((-x["r"]).alias("repo_id"), (-x["s"]).alias("score"))).alias("repos"))


def set_score(df: DataFrame, parents: DataFrame, authored: DataFrame, names: DataFrame, popular: DataFrame) -> DataFrame:
    """The rule-based score without a model: 200 for parents, 100 for own authors, 20 for names, 20 for popular repos."""
    on = ["user_id", "repo_id"]
    flag = lambda x, name: x.select(*on).distinct().withColumn(name, F.lit(1))
    out = df.join(flag(parents, "p"), on, "left").join(flag(authored, "a"), on, "left").join(flag(names, "m"), on, "left").join(flag(popular, "w"), on, "left")
    n = lambda k: F.coalesce(F.col(k), F.lit(0))
    return out.withColumn("score", (200 * n("p") + 100 * n("a") + 20 * n("m") + 20 * n("w")).cast("double")).drop("p", "a", "m", "w")
