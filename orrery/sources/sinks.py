"""What a run writes: ranked lists, submissions, training rows, cluster maps, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked_lines(recommended: DataFrame) -> DataFrame:
    """user:{repo,score},... of user_id and repos (structs of repo_id and score), scores with four digits."""
    item = F.transform("repos", lambda r: F.format_string("{%d,%.4f}", r["repo_id"], r["score"].cast("double")))
    return recommended.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.concat_ws(",", item)).alias("value"))


def submission_lines(recommended: DataFrame, n: int = 10) -> DataFrame:
    """user:repo,repo,... with the first n."""
    ids = F.transform(F.slice("repos", 1, n), lambda r: r["repo_id"].cast("string"))
    return recommended.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.concat_ws(",", ids)).alias("value"))


def training_header(names: list[str], booleans: set[str] = frozenset()) -> str:
    kinds = [f"{n}:k={'BOOLEAN' if n in booleans else 'REAL'}" for n in names]
    return " ".join(["LABEL:k=BOOLEAN", "WT:k=REAL", "GROUP:k=REAL", "REAL_TEST:k=BOOLEAN", *kinds])


def training_lines(rows: DataFrame, names: list[str]) -> DataFrame:
    """label weight group real_test features # comment, a line for each row; missing features are NaN."""
    number = lambda c: F.coalesce(F.col(c).cast("double").cast("string"), F.lit("NaN"))
    head = [F.col("label").cast("string"), number("weight"), F.col("user_id").cast("string"), F.col("real_test").cast("int").cast("string")]
    return rows.select(F.concat_ws(" ", *head, *map(number, names), F.lit("#"), F.col("repo_id").cast("string")).alias("value"))


def training_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def cluster_lines(clusters: DataFrame, key: str) -> DataFrame:
    return clusters.select(F.concat_ws(":", F.col(key).cast("string"), F.coalesce("cluster_id", F.lit(-1)).cast("string")).alias("value"))


def predictions(ranked: DataFrame, answers: DataFrame, counted: DataFrame) -> DataFrame:
    """user_id, position, repo_id, score, correct, n_watchers, name: to look at what was ranked where."""
    hit = answers.select("user_id", F.col("answer").alias("repo_id"), F.lit(True).alias("correct"))
    rows = ranked.join(hit, ["user_id", "repo_id"], "left").join(counted.select("repo_id", "n_watchers", "name"), "repo_id", "left")
    return rows.select("user_id", "position", "repo_id", "score", F.coalesce("correct", F.lit(False)).alias("correct"), "n_watchers", "name")


def report_lines(metrics: DataFrame) -> DataFrame:
    """The metrics of a run, a line for each."""
    return metrics.select(F.explode(F.array(*(F.concat_ws(" ", F.lit(c), F.col(c).cast("string")) for c in metrics.columns))).alias("value"))


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> None:
    lines.write.mode("overwrite").option("compression", compression or "none").text(path)
