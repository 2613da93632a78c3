"""Leave-one-out evaluation, sampling of training rows, and statistics of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.numbers import xdiv


def hashed(a: Column, b: Column, seed: int = 0) -> Column:
    """A reproducible order of pairs that other engines can follow: plain arithmetic."""
    return (b * 7919 + a * 104729 + seed * 1299709) % 10007


def leave_one_out(watches: DataFrame, users: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(watches that stay, (user_id, answer)): of each eligible user the first watch in hashed order whose repo has two watchers or more.

    Everything derived is to be worked out anew from the watches that stay.
    """
    busy = watches.groupBy("repo_id").agg(F.count("*").alias("n")).where("n >= 2").select("repo_id")
    able = watches.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 2").select("user_id")
    rows = watches.join(busy, "repo_id", "left_semi").join(able, "user_id", "left_semi")
    if users is not None:
        rows = rows.join(users.select("user_id"), "user_id", "left_semi")
    order = Window.partitionBy("user_id").orderBy(hashed(F.col("user_id"), F.col("repo_id"), seed), "repo_id")
    held = rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("user_id", F.col("repo_id").alias("answer"))
    stay = watches.join(held.withColumnRenamed("answer", "repo_id"), ["user_id", "repo_id"], "left_anti")
    return stay, held


def training_rows(candidates: DataFrame, watched: DataFrame, answers: DataFrame, most: int = 20, include_all_correct: bool = False, seed: int = 0, hard: bool = False, hardest: int = 10) -> DataFrame:
    """user_id, repo_id, label, weight, real_test: up to most wrong candidates, the answer, and up to most watched ones.

    hard: instead of a sample, the hardest highest-scored wrong candidates. A class's rows weigh 1 together; the answer
    counts for its class also where it isn't among the candidates.
    """
    on = ["user_id", "repo_id"]
    answer = answers.select("user_id", F.col("answer").alias("repo_id"))
    order = [F.desc("score"), F.desc("repo_id")] if hard else [hashed(F.col("user_id"), F.col("repo_id"), seed), F.col("repo_id")]
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    wrong = candidates.join(watched.select(*on), on, "left_anti").join(answer, on, "left_anti").withColumn("k", k).where(F.col("k") <= (hardest if hard else most))
    rows = wrong.select(*on, F.lit(0).alias("label"), F.lit(False).alias("real_test"))
    rows = rows.unionByName(answer.select(*on, F.lit(1).alias("label"), F.lit(True).alias("real_test")))
    if include_all_correct:
        right = candidates.join(watched.select(*on), on, "left_semi").withColumn("k", k).where(F.col("k") <= most)
        rows = rows.unionByName(right.select(*on, F.lit(1).alias("label"), F.lit(False).alias("real_test")))
    return rows.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("user_id", "label")))


def marked(candidates: DataFrame, watched: DataFrame, answers: DataFrame, most: int = 20, seed: int = 0) -> DataFrame:
    """candidates with marks, the (label, weight) of each row of training_rows(include_all_correct=True) that is theirs.

    Training rows are found where the user's candidates are, so these don't go to another exchange with all their columns.
    """
    seen = watched.groupBy("user_id").agg(F.collect_list("repo_id").alias("seen"))
    own = answers.groupBy("user_id").agg(F.collect_list("answer").alias("answers"))
    among = lambda x: F.coalesce(F.array_contains(x, F.col("repo_id")), F.lit(False))
    rows = candidates.join(seen, "user_id", "left").join(own, "user_id", "left")
    rows = rows.withColumn("kind", F.when(among("seen"), 1).when(~among("answers"), 0))
    k = F.row_number().over(Window.partitionBy("user_id", "kind").orderBy(hashed(F.col("user_id"), F.col("repo_id"), seed), "repo_id"))
    taken = lambda kind: F.least(F.count(F.when(F.col("kind") == kind, 1)).over(Window.partitionBy("user_id")), F.lit(most))
    rows = rows.withColumn("chosen", F.col("kind").isNotNull() & (k <= most)).withColumn("wrong", taken(0)).withColumn("right", taken(1) + F.greatest(F.size("answers"), F.lit(0)))
    mark = lambda label, n: F.struct(F.lit(label).alias("label"), (1.0 / F.col(n)).alias("weight"))
    sampled = F.when(F.col("chosen"), F.when(F.col("kind") == 1, mark(1, "right")).otherwise(mark(0, "wrong")))
    answer = F.when(among("answers"), mark(1, "right"))
    return rows.select(*candidates.columns, F.array_compact(F.array(sampled, answer)).alias("marks"))


def source_stats(candidates: DataFrame, watched: DataFrame, answers: DataFrame) -> DataFrame:
    """source, fired, correct, watched, total, per_user, recall (over users for whom it fired), precision."""
    on = ["user_id", "repo_id"]
    rows = candidates.join(answers.select("user_id", F.col("answer").alias("repo_id"), F.lit(1).alias("is_answer")).hint("merge"), on, "left").join(watched.select(*on, F.lit(1).alias("is_watched")).hint("merge"), on, "left")
    out = rows.groupBy("source").agg(F.count_distinct("user_id").alias("fired"), F.count("is_answer").alias("correct"), F.count("is_watched").alias("watched"), F.count("*").alias("total"))
    return out.select("*", xdiv(F.col("total"), F.col("fired")).alias("per_user"), xdiv(F.col("correct"), F.col("fired")).alias("recall"), xdiv(F.col("correct") + F.col("watched"), F.col("total")).alias("precision"))


def incremental_stats(candidates: DataFrame, answers: DataFrame, sources: list[str]) -> DataFrame:
    """source, size, correct, and new_size, new_correct: what no earlier source of the list gave."""
    ordinal = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(sources))):
        ordinal = F.when(F.col("source") == s, i).otherwise(ordinal)
    rows = candidates.withColumn("o", ordinal).where("o is not null")
    rows = rows.withColumn("first", F.min("o").over(Window.partitionBy("user_id", "repo_id")))
    rows = rows.join(answers.select("user_id", F.col("answer").alias("repo_id"), F.lit(1).alias("hit")), ["user_id", "repo_id"], "left")
    new = F.col("o") == F.col("first")
    return rows.groupBy("source").agg(F.count("*").alias("size"), F.count("hit").alias("correct"), F.sum(F.when(new, 1).otherwise(0)).alias("new_size"), F.sum(F.when(new & F.col("hit").isNotNull(), 1).otherwise(0)).alias("new_correct"))


def recall(ranked: DataFrame, answers: DataFrame, n: int = 10) -> DataFrame:
    """One row: users, correct (answer among the first n), possible (among all), choices a user, recall, coverage; ranked has position from 0."""
    hit = answers.join(ranked, (answers.user_id == ranked.user_id) & (answers.answer == ranked.repo_id), "left").select(answers.user_id, "position")
    sizes = ranked.join(answers.select("user_id"), "user_id", "left_semi").agg(F.count("*").alias("choices"))
    out = hit.agg(F.count("*").alias("users"), F.sum(F.when(F.col("position") < n, 1).otherwise(0)).alias("correct"), F.count("position").alias("possible"))
    return out.join(F.broadcast(sizes)).select("users", "correct", "possible", xdiv(F.col("choices"), F.col("users")).alias("choices_per_user"), xdiv(F.col("correct"), F.col("users")).alias("recall"), xdiv(F.col("possible"), F.col("users")).alias("coverage"))


def tranche(users: DataFrame, pattern: str) -> DataFrame:
    """Users whose position in id order has a sign other than 0 in the repeated pattern."""
    from orrery.operators.property_graph import dense_ids

    at = dense_ids(users.select("user_id").distinct(), ["user_id"])
    return at.where(F.substring(F.lit(pattern), (F.col("id") % len(pattern) + 1).cast("int"), F.lit(1)) != "0").select("user_id")


def grouped_split(rows: DataFrame, group: str = "user_id", validation: int = 20, test: int = 10) -> DataFrame:
    """rows with split: train, validation or test by the group, so that a group stays together."""
    h = (F.col(group) * 7919 + 17) % 100
    return rows.withColumn("split", F.when(h < test, "test").when(h < test + validation, "validation").otherwise("train"))


def range_matches(users: DataFrame, user_ranges: DataFrame, repo_ranges: DataFrame, repos: DataFrame, watches: DataFrame, most: int = 10) -> DataFrame:
    """user_id and the first most repos of its id range, odd ones (watched first beyond the range of their
    own) before others, by id; for users whose range has an odd repo and who watch nothing up to its end."""
    first = watches.groupBy("user_id").agg(F.min("repo_id").alias("first"))
    u = users.select("user_id").distinct().join(user_ranges, "user_id").join(first, "user_id", "left").where("first is null or first > max_repo")
    bucket = lambda k: F.floor(F.col(k) / 1024)
    u = u.select("user_id", "min_repo", "max_repo", F.explode(F.sequence(bucket("min_repo"), bucket("max_repo"))).alias("bucket"))
    seen = watches.groupBy("repo_id").agg(F.min("user_id").alias("first_user"))
    r = repos.select("repo_id").join(repo_ranges.select("repo_id", "max_user"), "repo_id", "left").join(seen, "repo_id", "left")
    r = r.select("repo_id", bucket("repo_id").alias("bucket"), F.coalesce(F.col("first_user") > F.coalesce("max_user", F.lit(-1)), F.lit(False)).alias("odd"))
    rows = u.join(r, "bucket").where("repo_id between min_repo and max_repo")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("odd"), "repo_id"))
    rows = rows.withColumn("k", k).where(F.col("k") <= most)
    found = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", "repo_id"))).alias("x"), F.bool_or("odd").alias("odd"))  # most at most
    return found.where("odd").select("user_id", F.col("x.repo_id").alias("repos"))
