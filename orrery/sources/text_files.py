"""Readers of the graph's text formats. Each parser takes lines (value) and returns typed columns;
read() takes a path, compressed by suffix or not. Malformed lines raise where the format demands it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.text import unescape_json_string

MOST_USERS, MOST_REPOS = 60_000, 125_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files; gzip, bzip2 and the like by suffix. Pipes and commands aren't read, by design."""
    return spark.read.text(path)


def _part(pattern: str, n: int):
    return F.regexp_extract("value", pattern, n)


def repos(lines: DataFrame, most: int = MOST_REPOS) -> DataFrame:
    """id:author/name,date[,parent]; an empty author is null. Ids outside [1, most) raise."""
    p = r"^(\d+):([^/]*)/([^,]*),(\d{4}-\d{2}-\d{2})(?:,(\d+))?$"
    out = lines.select(_part(p, 1).cast("long").alias("repo_id"), F.nullif(_part(p, 2), F.lit("")).alias("author_name"), _part(p, 3).alias("name"), _part(p, 4).alias("day"), F.nullif(_part(p, 5), F.lit("")).cast("long").alias("parent_id"))
    bad = F.raise_error(F.concat(F.lit("repo id out of range: "), F.col("repo_id").cast("string")))
    out = out.withColumn("repo_id", F.when((F.col("repo_id") >= 1) & (F.col("repo_id") < most), F.col("repo_id")).otherwise(bad.cast("long")))
    return out.select("repo_id", "author_name", "name", F.to_date("day").alias("created"), "parent_id")


def descriptions(lines: DataFrame, repos: DataFrame) -> DataFrame:
    """owner/name:string; unknown repos are skipped, the last of a repo wins, but "---" never over another. lines: value, line_no."""
    p = r"^([^/]*)/([^:]*):(.*)$"
    rows = lines.select("line_no", F.nullif(_part(p, 1), F.lit("")).alias("author_name"), _part(p, 2).alias("name"), unescape_json_string(_part(p, 3)).alias("description"))
    rows = rows.join(repos.select("repo_id", F.col("author_name").alias("a"), F.col("name").alias("n")), F.col("author_name").eqNullSafe(F.col("a")) & (F.col("name") == F.col("n")))
    return rows.groupBy("repo_id").agg(F.max_by("description", F.struct(F.col("description") != "---", "line_no")).alias("description"))


def authors(lines: DataFrame) -> DataFrame:
    """name:following,id,followers,date; blank names are skipped, the id isn't kept."""
    p = r"^([^:]*):(\d+),(\d+),(\d+),(.*)$"
    return lines.select(_part(p, 1).alias("author_name"), _part(p, 2).cast("int").alias("num_following"), _part(p, 4).cast("int").alias("num_followers"), F.to_date(F.nullif(_part(p, 5), F.lit(""))).alias("joined")).where("trim(author_name) <> ''")


def all_authors(read: DataFrame, repos: DataFrame) -> DataFrame:
    """Authors that were read and those that only repos name."""
    return read.join(repos.select("author_name").where("author_name is not null").distinct(), "author_name", "full_outer")


def languages(lines: DataFrame) -> DataFrame:
    """repo:Lang;lines,Lang;lines..."""
    items = F.explode(F.split(_part(r"^\d+:(.*)$", 1), ","))
    rows = lines.select(_part(r"^(\d+):", 1).cast("long").alias("repo_id"), items.alias("x")).where("x <> ''")
    return rows.select("repo_id", F.split("x", ";")[0].alias("lang"), F.split("x", ";")[1].cast("long").alias("lines"))


def watches(lines: DataFrame, most_users: int = MOST_USERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """user:repo, distinct; ids out of range raise."""
    out = lines.select(F.split("value", ":")[0].cast("long").alias("user_id"), F.split("value", ":")[1].cast("long").alias("repo_id"))
    good = (F.col("user_id") >= 0) & (F.col("user_id") < most_users) & (F.col("repo_id") > 0) & (F.col("repo_id") < most_repos)
    bad = F.raise_error(F.concat_ws(":", F.lit("watch out of range"), F.col("user_id").cast("string"), F.col("repo_id").cast("string")))
    return out.select(F.when(good, F.col("user_id")).otherwise(bad.cast("long")).alias("user_id"), "repo_id").distinct()


def test_users(lines: DataFrame) -> DataFrame:
    """user[:answer]; the answer is null where there is none."""
    parts = F.split("value", ":")
    return lines.select(parts[0].cast("long").alias("user_id"), F.try_element_at(parts, F.lit(2)).cast("long").alias("answer"))


def counts(lines: DataFrame, repos: DataFrame, name: str) -> DataFrame:
    """repo n, split by white space; a repo that isn't known raises."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts[0].cast("long").alias("repo_id"), parts[1].cast("long").alias(name)).join(repos.select("repo_id", F.lit(1).alias("ok")), "repo_id", "left")
    return rows.select(F.when(F.col("ok") == 1, F.col("repo_id")).otherwise(F.raise_error(F.concat(F.lit("unknown repo "), F.col("repo_id").cast("string"))).cast("long")).alias("repo_id"), name)


def repo_collaborators(lines: DataFrame, authors: DataFrame) -> DataFrame:
    """repo name author author...; unknown authors are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts[0].cast("long").alias("repo_id"), F.explode(F.slice(parts, 3, 1_000_000)).alias("author_name"))
    return rows.join(authors.select("author_name").distinct(), "author_name", "left_semi").select("repo_id", "author_name")


def follows(lines: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between known users, the edges dropped) of lines: follower followed."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts[0].cast("long").alias("follower_id"), parts[1].cast("long").alias("followed_id"))
    u = users.select("user_id").distinct()
    good = rows.join(u.withColumnRenamed("user_id", "follower_id"), "follower_id", "left_semi").join(u.withColumnRenamed("user_id", "followed_id"), "followed_id", "left_semi")
    return good, rows.join(good, ["follower_id", "followed_id"], "left_anti")


def stop_words(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("word")).where("word <> ''").distinct()


def clusters(lines: DataFrame, key: str) -> DataFrame:
    """id:cluster; -1 stands for none."""
    rows = lines.select(F.split("value", ":")[0].cast("long").alias(key), F.split("value", ":")[1].cast("int").alias("cluster_id"))
    return rows.where("cluster_id <> -1")


def described(records: DataFrame) -> DataFrame:
    """owner/name:description lines of records of an interface's answers (value with owner:, name:, description: lines)."""
    field = lambda k: F.trim(F.regexp_extract("value", rf"(?m)^\s*:?{k}:\s*(.*)$", 1))
    rows = records.select(field("owner").alias("owner"), field("name").alias("name"), field("description").alias("d")).where("owner <> '' and name <> ''")
    return rows.select(F.concat(F.col("owner"), F.lit("/"), F.col("name"), F.lit(":"), F.col("d")).alias("value"))


def numbered(lines: DataFrame) -> DataFrame:
    """lines with line_no, growing in the order of the file."""
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
