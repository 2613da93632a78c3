"""The watch graph as named tables, and the statements that derive it from the driver's tables.

The statements read alike in Spark SQL and in DuckDB, so the same graph is the input of a query and of its SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from orrery.plans.materialize import written
from orrery.plans.ship import ship

VIEWS = {
    "watches_dense": """
        SELECT DISTINCT o_custkey AS user_id, l_partkey + 1 AS repo_id
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "watches": """
        SELECT DISTINCT o_custkey AS user_id, l_partkey + 1 AS repo_id
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R' AND l_discount >= 0.05""",
    "repos": """
        SELECT p_partkey + 1 AS repo_id, concat(p_brand, '-', CAST(p_size AS STRING)) AS author_name,
               p_name AS name, p_size AS created_day,
               CASE WHEN (p_partkey + 1) % 3 = 0 THEN CAST(floor((p_partkey + 1) / 3) AS BIGINT) END AS parent_id
        FROM part""",
    "repo_languages": """
        SELECT l_partkey + 1 AS repo_id, concat(l_returnflag, l_linestatus) AS lang,
               SUM(CAST(l_quantity AS BIGINT)) AS lines
        FROM lineitem GROUP BY l_partkey + 1, concat(l_returnflag, l_linestatus)""",
    "descriptions": """
        SELECT doc_id + 1 AS repo_id, text AS description FROM documents""",
    "follows": """
        SELECT DISTINCT o_custkey AS follower_id, (o_orderkey * 31) % 1500 AS followed_id
        FROM orders WHERE o_custkey <> (o_orderkey * 31) % 1500""",
    "authors": """
        SELECT author_name, max(p_size) AS num_followers, min(p_size) AS num_following
        FROM (SELECT concat(p_brand, '-', CAST(p_size AS STRING)) AS author_name, p_size FROM part) p
        GROUP BY author_name""",
    "test_users": """
        SELECT user_id, repo_id AS answer FROM (
          SELECT w.user_id, w.repo_id, row_number() OVER (PARTITION BY w.user_id
                   ORDER BY (w.repo_id * 7919 + w.user_id * 104729) % 10007, w.repo_id) AS rn
          FROM watches w
          JOIN (SELECT repo_id FROM watches GROUP BY repo_id HAVING count(*) >= 2) r ON r.repo_id = w.repo_id
          JOIN (SELECT user_id FROM watches GROUP BY user_id HAVING count(*) >= 2) u ON u.user_id = w.user_id
          WHERE w.user_id % 7 = 3) x
        WHERE rn = 1""",
    "vectors": """
        SELECT vec_id + 1 AS repo_id, label AS cluster_id, embedding FROM embeddings""",
}
_NEEDS = {
    "watches_dense": ("orders", "lineitem"), "watches": ("orders", "lineitem"), "repos": ("part",), "repo_languages": ("lineitem",),
    "descriptions": ("documents",), "follows": ("orders",), "authors": ("part",), "test_users": (), "vectors": ("embeddings",),
}


@dataclass
class WatchDataset:
    """Tables of the graph. Columns: see VIEWS."""

    watches: DataFrame
    repos: DataFrame
    repo_languages: DataFrame
    descriptions: DataFrame
    follows: DataFrame
    authors: DataFrame
    test_users: DataFrame
    watches_dense: DataFrame
    vectors: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> WatchDataset:
        return _OfTables(spark, sf_dir)

    def replaced(self, **tables: DataFrame) -> WatchDataset:
        """This graph with some tables in place of its own."""
        return WatchDataset(**{f.name: tables[f.name] if f.name in tables else getattr(self, f.name) for f in fields(WatchDataset)})


class _OfTables(WatchDataset):
    """The graph of the driver's tables, each of its tables derived when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self._spark, self._sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        # Views are resolved as the statement is read, so another dataset's views of these names don't change this one.
        for t in _NEEDS[name]:
            self._spark.read.parquet(f"{self._sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        if name == "test_users":
            self.watches.createOrReplaceTempView("watches")
        table = self._spark.sql(VIEWS[name])
        # Watches are a join and a distinct that most queries use several times, and test users come from them.
        table = written(table, name) if name in ("watches", "test_users") else table
        setattr(self, name, table)
        return table


def with_views(sql: str) -> str:
    """sql for DuckDB with the graph's tables in front, as far as it names them; WITH [RECURSIVE] of sql is joined to them."""
    body = sql.strip()
    needed = [v for v in VIEWS if f" {v}" in body or f"\n{v}" in body or f"({v}" in body]
    if "test_users" in needed and "watches" not in needed:
        needed.insert(0, "watches")
    needed.sort(key=list(VIEWS).index)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            return f"WITH RECURSIVE {head}, {rest[9:]}" if head else body
        return f"WITH {head}, {rest}" if head else body
    return f"WITH {head} {body}" if head else body
