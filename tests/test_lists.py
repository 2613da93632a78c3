"""Lists of sources that are never made whole, pairs that go through no shuffle, and sums at a half of the last digit."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import candidates, evaluation, graph, keywords, ml
from orrery.plans.dataset import WatchDataset
from orrery.plans.queries import ORACLES, QUERIES


def test_sums_at_a_half_of_the_last_digit(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    there = c.execute(ORACLES["rk03_cooccurrence"])
    names = [x[0] for x in there.description]
    assert sorted(map(tuple, QUERIES["rk03_cooccurrence"](spark, sf).select(*names).collect())) == sorted(there.fetchall())


@pytest.fixture
def never_whole(monkeypatch):
    def whole(c):
        raise AssertionError("the whole list was asked for")

    monkeypatch.setitem(candidates.SOURCES, "same_name", whole)


def test_first_of_alike_repos(spark):
    """As the whole list, ranked and cut, with groups that are larger than the cut and users who watch many of a group."""
    repos = spark.range(1, 61).select(F.col("id").alias("repo_id"), F.concat(F.lit("n"), (F.col("id") % 3).cast("string")).alias("name"), F.lit("a").alias("author_name"), F.lit(1).alias("created_day"), F.lit(None).cast("long").alias("parent_id"))
    watches = spark.createDataFrame([(u, r) for u in range(1, 8) for r in range(1, 61) if (r * r + u * r) % 11 < u % 4], "user_id long, repo_id long")
    empty = spark.range(0)
    c = candidates.Context(WatchDataset(watches, repos, *[empty] * 7), watches.select("user_id").distinct())
    counts = {r.repo_id: r["count"] for r in watches.groupBy("repo_id").count().collect()}
    want = {}
    for r in candidates.same_name(c).collect():
        want.setdefault(r.user_id, []).append((counts.get(r.repo_id, 0), r.repo_id))
    got = {}
    for r in candidates.first_alike(c, "name", F.col("n_watchers"), most=5).collect():
        got.setdefault(r.user_id, []).append((r.score, r.repo_id))
        assert r.size == len(want[r.user_id])
    assert got and {u: sorted(x, reverse=True) for u, x in got.items()} == {u: sorted(x, reverse=True)[:5] for u, x in want.items()}


def test_incremental_stats_without_whole_lists(spark, sf, never_whole):
    assert QUERIES["eval04_incremental_stats"](spark, sf).count() == 5


def test_exclusion_without_a_shuffle_of_pairs(spark, sf):
    """No exchange stands above the join that makes the pairs."""
    plan = QUERIES["jn07_not_alike"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[: min(plan.index(x) for x in ("BroadcastNestedLoopJoin", "CartesianProduct", "BroadcastHashJoin") if x in plan)]
    assert "Exchange" not in above and "Join" not in above


def test_pairs_of_a_large_group_go_through_no_shuffle(spark, sf):
    """All pairs of a name come from several tasks, after whose join there is no exchange."""
    df = QUERIES["srce_same_name"](spark, sf)
    assert "Exchange" not in (plan := df._jdf.queryExecution().executedPlan().toString())[: plan.index("Generate")] and "Generate" in plan


def test_parents_and_same_names_are_made_once(spark, sf, monkeypatch):
    monkeypatch.setattr(candidates, "same_name", None)
    df = QUERIES["rk08_heuristic_score"](spark, sf)
    assert {220.0, 200.0, 20.0} >= {r.score for r in df.select("score").distinct().collect()} and df.count() == df.select("user_id", "repo_id").distinct().count()


def test_rk04_default_ranker_without_whole_lists(spark, sf, never_whole):
    assert QUERIES["rk04_default_ranker"](spark, sf).count()


def test_eval03_source_stats_without_whole_lists(spark, sf, never_whole):
    assert QUERIES["eval03_source_stats"](spark, sf).count()


def test_eval07_possible_only_without_whole_lists(spark, sf, never_whole):
    assert QUERIES["eval07_possible_only"](spark, sf).count()


def test_rk01_merge_without_whole_lists(spark, sf, never_whole):
    assert QUERIES["rk01_merge"](spark, sf).count()


def test_rk05_classifier_ranker_without_whole_lists(spark, sf, never_whole):
    assert QUERIES["rk05_classifier_ranker"](spark, sf).count()


@pytest.fixture
def no_pairs(monkeypatch):
    def pairs(*_):
        raise AssertionError("the table of pairs of repos was asked for")

    monkeypatch.setattr(graph, "cooccurrence", pairs)


def test_met_coocs(spark):
    """As coocs and coocs2, with users on both sides of both bounds, repos of one watcher, and repos without name or author."""
    texts = lambda k, n: F.when(F.col("id") % 50 != 0, F.concat(F.lit(k), (F.col("id") % n).cast("string")))
    repos = spark.range(1, 121).select(F.col("id").alias("repo_id"), texts("n", 40).alias("name"), texts("a", 90).alias("author_name"), F.lit(1).alias("created_day"), F.lit(None).cast("long").alias("parent_id"))
    sizes = [1, 2, 3, 5, 19, 20, 21, 22, 49, 50, 51, 60]
    watches = spark.createDataFrame([(u, 1 + (u * 13 + k * 7) % 125) for u, n in enumerate(sizes) for k in range(n)], "user_id long, repo_id long")
    empty = spark.range(0)
    for users in (watches, watches.where("user_id in (1, 3, 7, 11)")):
        c = candidates.Context(WatchDataset(watches, repos, *[empty] * 7), users.select("user_id").distinct())
        for name in ("coocs", "coocs2"):
            counts = {r.repo_id: r["count"] for r in watches.groupBy("repo_id").count().collect()}
            want = sorted((r.user_id, r.repo_id, counts[r.repo_id]) for r in candidates.source(name)(c).collect())
            assert want and sorted(map(tuple, candidates.with_watchers(name, c).select("user_id", "repo_id", "n_watchers").collect())) == want


def test_rk04_default_ranker_without_a_table_of_pairs(spark, sf, no_pairs):
    assert QUERIES["rk04_default_ranker"](spark, sf).count()


def test_eval03_source_stats_without_a_table_of_pairs(spark, sf, no_pairs):
    assert QUERIES["eval03_source_stats"](spark, sf).count()


def test_eval07_possible_only_without_a_table_of_pairs(spark, sf, no_pairs):
    assert QUERIES["eval07_possible_only"](spark, sf).count()


def test_rk01_merge_without_a_table_of_pairs(spark, sf, no_pairs):
    assert QUERIES["rk01_merge"](spark, sf).count()


def test_rk05_classifier_ranker_without_a_table_of_pairs(spark, sf, no_pairs):
    assert QUERIES["rk05_classifier_ranker"](spark, sf).count()


@pytest.mark.parametrize("name", ["eval03_source_stats", "rk01_merge"])
def test_lists_send_no_growing_table(spark, sf, name):
    """Only the most watched repos, a list of a fixed length, are broadcast, however small Spark takes the tables for."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan


def test_marked_as_training_rows(spark):
    """The same rows, labels and weights, with answers that are watched, aren't candidates, or are missing."""
    pairs = spark.createDataFrame([(u, r, float(r)) for u in range(1, 9) for r in range(1, 80) if (r * u) % 3 or u == 8], "user_id long, repo_id long, score double")
    watched = spark.createDataFrame([(u, r) for u in range(1, 8) for r in range(1, 80, 8 - u)], "user_id long, repo_id long")
    answers = spark.createDataFrame([(1, 1), (2, 9), (3, 2), (4, 1000), (5, 3), (8, 5)], "user_id long, answer long")
    want = evaluation.training_rows(pairs, watched, answers, include_all_correct=True).join(pairs, ["user_id", "repo_id"]).select("user_id", "repo_id", "label", "weight", "score")
    got = evaluation.marked(pairs, watched, answers).select("user_id", "repo_id", F.inline("marks"), "score")
    assert want.count() and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_factors_go_in_slices(spark, monkeypatch):
    """The same factors when no more than one column or row of them goes to the tasks or comes back at once."""
    rows = spark.createDataFrame([(r, c, float((r * c + r) % 7)) for r in range(30) for c in range(20) if (r + c) % 3], "row long, col long, value double")
    _, want, _ = ml.svd(rows, k=4)
    monkeypatch.setattr(ml, "SLICE_BYTES", 8)
    left, s, right = ml.svd(rows, k=4)
    assert np.allclose(s, want, rtol=1e-9) and left.count() == 30 and right.count() == 20
    u, v = (np.array([x.v for x in f.orderBy(f.columns[0]).collect()]) for f in (left, right))
    m = np.zeros((30, 20))
    for r in rows.collect():
        m[r.row, r.col] = r.value
    assert np.allclose(m @ v, u * s, atol=1e-6)


def test_clusters_are_cut_before_vectors_are_compared(spark, sf, monkeypatch):
    """The first of each user by watchers, then id, with the same features as in its whole list; no vectors of others are compared."""
    c = candidates.Context(d := WatchDataset.from_tables(spark, "/root/testdata/sf0.01"), d.test_users)
    whole = {}
    for r in candidates.in_cluster_repo(c).collect():
        whole.setdefault(r.user_id, []).append(tuple(r))
    monkeypatch.setattr(candidates, "MOST_CLUSTERED", 7)
    df = candidates.in_cluster_repo(c)
    at = {x: i for i, x in enumerate(df.columns)}
    got = {}
    for r in df.collect():
        got.setdefault(r.user_id, []).append(tuple(r))
    order = lambda x: (-x[at["n_cluster_watchers"]], x[at["repo_id"]])
    assert any(len(x) > 7 for x in whole.values()) and {u: sorted(x, key=order) for u, x in got.items()} == {u: sorted(x, key=order)[:7] for u, x in whole.items()}
    assert "last_watchers" in df._jdf.queryExecution().optimizedPlan().toString()


def test_users_of_a_cluster_are_cut_before_vectors_are_compared(spark, monkeypatch):
    """The first of each user by members that watch, then id, with the same features as in its whole list, over several chunks of the list."""
    v = spark.range(1, 41).select(F.col("id").alias("user_id"), (F.col("id") % 3).alias("cluster_id"), F.array(F.sin("id"), F.cos(F.col("id") * 2), F.lit(0.5)).alias("embedding"))
    repos = spark.range(1, 91).select(F.col("id").alias("repo_id"), F.concat(F.lit("n"), (F.col("id") % 30).cast("string")).alias("name"), F.concat(F.lit("a"), (F.col("id") % 45).cast("string")).alias("author_name"), F.lit(1).alias("created_day"), F.lit(None).cast("long").alias("parent_id"))
    watches = spark.createDataFrame([(u, r) for u in range(1, 41) for r in range(1, 91) if (r * r + u * r + u) % 13 == 0], "user_id long, repo_id long")
    c = candidates.Context(WatchDataset(watches, repos, *[spark.range(0)] * 7), watches.select("user_id").where("user_id % 2 = 0").distinct(), v)
    monkeypatch.setattr(candidates, "ID_BUCKET", 4)
    whole, vectors, seen = {}, {r.user_id: np.array(r.embedding) for r in v.collect()}, {}
    for r in watches.collect():
        seen.setdefault(r.user_id, set()).add(r.repo_id)
    for u in [u for u in seen if u % 2 == 0]:
        for r in range(1, 91):
            mates = [m for m in seen if m != u and m % 3 == u % 3 and r in seen[m]]
            if mates and not any(r % 30 == x % 30 or r % 45 == x % 45 for x in seen[u]):
                dots = [vectors[u] @ vectors[m] for m in mates]
                cosines = [d / np.linalg.norm(vectors[u]) / np.linalg.norm(vectors[m]) for d, m in zip(dots, mates)]
                whole.setdefault(u, []).append((-len(mates), r, sum(1 / len(seen[m]) for m in mates), max(dots), max(cosines)))
    for most in (6, 2000):
        monkeypatch.setattr(candidates, "MOST_CLUSTERED", most)
        got = {}
        df = candidates.in_cluster_user(c)
        for r in df.collect():
            got.setdefault(r.user_id, []).append((-r.num_watched, r.repo_id, r.weighted, r.max_dot, r.max_cosine))
        assert got.keys() == whole.keys() and all(np.allclose(sorted(got[u]), sorted(whole[u])[:most]) for u in whole)
    assert any(len(x) > 6 for x in whole.values()) and "last_k" in df._jdf.queryExecution().optimizedPlan().toString()


def test_keywords_stay_with_their_repo(spark, monkeypatch):
    """Rare camel case split, frequent kept, equal texts counted once; the same whether the vocabulary is sent or joined; only texts and rare words are dealt, by repo."""
    texts = [(r, "GitHub myTool%d _x_ Plain" % r) for r in range(60)] + [(1, "Été AaBb aabb, (AaBb)"), (2, "rareWords RareWords"), (2, "rareWords RareWords"), (3, None), (4, ".. --"), (5, "RareWords a")]
    df = spark.createDataFrame(texts, "repo_id long, text string")
    tf = keywords.tokens(df)
    got = {(r.repo_id, r.token): r.tf for r in tf.collect()}
    assert got[7, "github"] == 0.25 and (7, "mytool7") in got and got[1, "bb"] == 1 / 3 and (1, "aabb") in got and got[2, "rare"] == got[2, "rarewords"] == got[5, "a"] == 1 / 3 and (5, "rarewords") not in got
    sent = keywords.tf_idf(tf, 60)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(repo_id") == 2 and "hashpartitioning(token" not in plan
    monkeypatch.setattr(keywords, "SENT_TOKENS", 0)
    joined = keywords.tf_idf(tf, 60)
    assert sorted(map(tuple, sent.collect())) and np.allclose([x[2:] for x in sorted(map(tuple, sent.collect()))], [x[2:] for x in sorted(map(tuple, joined.collect()))])


def test_a_column_at_once_is_no_join(spark, monkeypatch):
    """Factors beyond the bound of which a column fits are multiplied in the parts of the matrix, with values as with ones."""
    monkeypatch.setattr(ml, "_svd_joined", None)
    monkeypatch.setattr(ml, "SUM_ENTRIES", 4)
    for of in (lambda r, c: 1.0, lambda r, c: float((r * c + r) % 7 - 2)):
        m = np.array([[of(r, c) * ((r * 3 + c * c) % 5 > 1) for c in range(18)] for r in range(25)])
        rows = spark.createDataFrame([(int(r) * 5 - 9, int(c) + 2**40, float(m[r, c])) for r, c in zip(*np.nonzero(m))], "row long, col long, value double")
        left, s, right = ml.svd(rows, k=3, settled=1e-12, broadcast_bytes=8 * 25)
        u, v = (np.array([x.v for x in f.orderBy(f.columns[0]).collect()]) for f in (left, right))
        best = np.linalg.svd(m)
        assert np.allclose(s, best[1][:3], rtol=1e-6) and np.allclose(m @ v, u * s, atol=1e-6) and np.allclose(v.T @ v, np.eye(3), atol=1e-9)
    assert ml.svd(rows, k=3, broadcast_bytes=8 * 18, left=False)[0] is None


def _small(spark, n_users=240, n_repos=96):
    """A graph with repos without name or author, parents, and users who watch many of a group."""
    texts = lambda k, n: F.when(F.col("id") % 31 != 0, F.concat(F.lit(k), (F.col("id") % n).cast("string")))
    parent = F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 3) + F.col("id") % 2)
    repos = spark.range(1, n_repos + 1).select(F.col("id").alias("repo_id"), texts("n", 4).alias("name"), texts("a", 24).alias("author_name"), F.lit(1).alias("created_day"), parent.cast("long").alias("parent_id"))
    watches = spark.createDataFrame([(u, r) for u in range(1, n_users + 1) for r in range(1, n_repos + 1) if (r * r + u * r + u) % 53 < (12 if u % 40 == 0 else 2)], "user_id long, repo_id long")
    return candidates.Context(WatchDataset(watches, repos, *[spark.range(0)] * 7), watches.select("user_id").where("user_id % 8 < 7").distinct())


def _graph(c):
    repos, seen = {r.repo_id: r for r in c.data.repos.collect()}, {}
    for r in c.data.watches.collect():
        seen.setdefault(r.user_id, set()).add(r.repo_id)
    return repos, {r.user_id: seen[r.user_id] for r in c.users.collect()}


def _beside(rows):
    """The share of rows whose repo is that of the row before."""
    return sum(a.repo_id == b.repo_id for a, b in zip(rows, rows[1:])) / len(rows)


def test_users_meet_repos_one_after_the_other(spark):
    """As by brute force, with repos without name or author; users follow each other for a repo, so files are small; no generated code holds all pairs of a list."""
    c = _small(spark)
    repos, seen = _graph(c)
    names, authors = ({u: {repos[r][k] for r in x} for u, x in seen.items()} for k in ("name", "author_name"))
    want = {(u, r) for u in seen for r in repos if (repos[r].name is None or repos[r].name not in names[u]) and repos[r].author_name not in authors[u]}
    df = candidates.unlike_repos(c, c.codes)
    got = df.collect()
    assert {(r.user_id, r.repo_id) for r in got} == want and len(got) == len(want) and _beside(got) > 0.5
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and ") BroadcastNestedLoopJoin" not in plan


def test_same_names_and_parents_beside_each_other(spark, monkeypatch):
    """As by brute force, with lists of users and chunks of repos cut; users follow each other for a repo; no generated code holds all pairs of a chunk."""
    monkeypatch.setattr(candidates, "ALIKE_SHARES", 2)
    c = _small(spark)
    repos, seen = _graph(c)
    named = {(u, r): 20 for u, x in seen.items() for r in repos if repos[r].name is not None and r not in x and any(repos[r].name == repos[w].name for w in x)}
    parent = {(u, repos[w].parent_id): 200 for u, x in seen.items() for w in x if repos[w].parent_id is not None}
    want = {k: named.get(k, 0) + parent.get(k, 0) for k in {*named, *parent}}
    for ids in (1024, 8):
        monkeypatch.setattr(candidates, "ID_BUCKET", ids)
        df = candidates.parents_or_same_name(c)
        got = df.collect()
        assert {(r.user_id, r.repo_id): 200 * r.is_parent + 20 * r.is_named for r in got} == want and len(got) == len(want) and _beside(got) > 0.5
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate inline(filter(" in plan and ") Generate inline(filter(" not in plan


def test_shares_of_alike_repos_are_rounded_once(spark):
    """Shares rounded where they are made are those of the whole rows, for users who watch few and many of a group; users follow each other for a repo."""
    c = _small(spark)
    shares = ["watched_share", "watcher_share", "abs_pct", "unwatched_pct"]
    for key in ("name", "author_name"):
        got = candidates._alike(c, key, 3).collect()
        assert _beside(got) > (0.5 if key == "name" else 0.1)
        whole = candidates._alike(c, key).withColumns({k: F.round(k, 3) for k in shares}).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, whole))
        repos, seen = _graph(c)
        counts = {r.repo_id: r["count"] for r in c.data.watches.groupBy("repo_id").count().collect()}
        assert {(r.user_id, r.repo_id) for r in got} == {(u, r) for u, x in seen.items() for r in repos if repos[r][key] is not None and r not in x and any(repos[w][key] == repos[r][key] for w in x)}
        for r in got[::97]:
            group = [k for k in repos if repos[k][key] == repos[r.repo_id][key]]
            left = [k for k in group if k not in seen[r.user_id]]
            above = sum(counts.get(k, 0) > counts.get(r.repo_id, 0) for k in left)
            assert (r.n_repos, r.n_watched, r.unwatched_rank) == (len(group), len(group) - len(left), above) and abs(r.unwatched_pct - above / len(left)) <= 0.0005001
    assert {r.n_watched > candidates.FEW_WATCHED for r in candidates.same_name(c).collect()} == {True, False}


def test_cluster_mates_are_compared_in_blocks(spark, monkeypatch):
    """Products of vectors are made for lists of users and chunks of whole repos at once: no function of higher order goes through them, and no exchange stands above."""
    v = spark.createDataFrame([(u, u % 2, [float(u % 5), 1.0, float(u % 3) - 1]) for u in range(1, 31)], "user_id long, cluster_id int, embedding array<double>")
    repos = spark.range(1, 61).select(F.col("id").alias("repo_id"), F.col("id").cast("string").alias("name"), F.col("id").cast("string").alias("author_name"), F.lit(1).alias("created_day"), F.lit(None).cast("long").alias("parent_id"))
    watches = spark.createDataFrame([(u, r) for u in range(1, 31) for r in range(1, 61) if (u * r + r) % 7 == 0], "user_id long, repo_id long")
    c = candidates.Context(WatchDataset(watches, repos, *[spark.range(0)] * 7), watches.select("user_id").distinct(), v)
    plan = candidates.in_cluster_user(c)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "MapInArrow" in above and "Exchange" not in above and "zip_with" not in above and "aggregate(" not in above
