"""Statistics of the watch graph: popularity, closures, co-occurrence, random walk, inferred identities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.numbers import xdiv
from orrery.plans.materialize import written

#: Groups above these sizes don't count for cooc and cooc2.
COOC_MOST, COOC2_MOST = 20, 50
USER_STEP, REPO_STEP = 100, 200


def popularity(watches: DataFrame) -> DataFrame:
    """repo_id, n_watchers and its unique 0-based rank, the most watched first.

    The rank is global. It is found by the counts: repos of equal counts are numbered among
    themselves, then moved by the repos of larger counts, so no task sorts all repos.
    """
    counts = watches.groupBy("repo_id").agg(F.count("*").alias("n_watchers"))
    sizes = counts.groupBy("n_watchers").agg(F.count("*").alias("c"))
    above = Window.orderBy(F.desc("n_watchers")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct count
    offsets = sizes.select("n_watchers", F.coalesce(F.sum("c").over(above), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("n_watchers").orderBy("repo_id")
    ranked = counts.withColumn("k", F.row_number().over(within) - 1).join(offsets, "n_watchers")
    return ranked.select("repo_id", "n_watchers", (F.col("k") + F.col("ahead")).alias("popularity_rank"))


def children(repos: DataFrame) -> DataFrame:
    return repos.where("parent_id is not null").groupBy(F.col("parent_id").alias("repo_id")).agg(F.count("*").alias("n_children"))


def closure(repos: DataFrame) -> DataFrame:
    """repo_id, ancestor_id and distance, by doubling: paths of length up to 2k from those of length up to k.

    Parents that aren't repos end a path. Distances are the least ones, so on a cycle none is longer than
    it, and rounds end when no pair is as far apart as the last one reached.
    """
    edges = repos.where("parent_id is not null").select("repo_id", F.col("parent_id").alias("ancestor_id"))
    edges = edges.join(repos.select(F.col("repo_id").alias("ancestor_id")), "ancestor_id", "left_semi").where("repo_id <> ancestor_id")
    paths, reach = written(edges.select("repo_id", "ancestor_id", F.lit(1).alias("distance")), "paths"), 1
    while True:
        far = paths.where(F.col("distance") == reach)
        if far.isEmpty():
            break
        more = far.alias("a").join(paths.alias("b"), F.col("a.ancestor_id") == F.col("b.repo_id")).select("a.repo_id", "b.ancestor_id", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        paths = written(paths.unionByName(more.where("repo_id <> ancestor_id")).groupBy("repo_id", "ancestor_id").agg(F.min("distance").alias("distance")), "paths")
        reach *= 2
    return paths


def depths(repos: DataFrame) -> DataFrame:
    """repo_id, depth (0 for roots) and ancestors from the root to the parent."""
    up = closure(repos).groupBy("repo_id").agg(F.max("distance").alias("depth"), F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_id"))).alias("x"))
    return repos.select("repo_id").join(up, "repo_id", "left").select("repo_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce(F.col("x.ancestor_id"), F.array().cast("array<bigint>")).alias("ancestors"))


def cooccurrence(edges: DataFrame, group: str, member: str) -> DataFrame:
    """Ordered pairs of members that share groups: cooc sums 1 / n^2 over groups of n <= 20, cooc2 1 / n over n <= 50.

    Larger groups don't count by definition, so a group emits at most 50 * 49 pairs.
    """
    sized = edges.join(edges.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n").between(2, COOC2_MOST)), group)
    a, b = sized.select(group, F.col(member).alias("a"), "n"), sized.select(group, F.col(member).alias("b"))
    pairs = a.join(b, group).where("a <> b")
    return pairs.groupBy("a", "b").agg(
        F.sum(F.when(F.col("n") <= COOC_MOST, 1.0 / (F.col("n") * F.col("n"))).otherwise(0.0)).alias("cooc"),
        F.sum(1.0 / F.col("n")).alias("cooc2"),
        F.max(F.col("n") <= COOC_MOST).alias("in_cooc"),
    )


def overlap(left: DataFrame, right: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Dot product and number of common keys of sparse vectors (id, key, value), for each pair of ids that share a key."""
    joined = left.select(F.col("id").alias("a"), key, F.col(value).alias("x")).join(right.select(F.col("id").alias("b"), key, F.col(value).alias("y")), key)
    return joined.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.count("*").alias("common"))


def density_grid(watches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two histograms of (user, repo) ids, the second moved by half a step."""
    out = []
    for shift in (0, 0.5):
        bu = F.floor((F.col("user_id") + shift * USER_STEP) / USER_STEP).alias("bu")
        br = F.floor((F.col("repo_id") + shift * REPO_STEP) / REPO_STEP).alias("br")
        out.append(watches.groupBy(bu, br).agg(F.count("*").alias("n")))
    return out[0], out[1]


def density(pairs: DataFrame, watches: DataFrame) -> DataFrame:
    """pairs (user_id, repo_id) with the larger count of its two cells."""
    one, two = density_grid(watches)
    x = pairs
    for name, grid, shift in (("d1", one, 0), ("d2", two, 0.5)):
        bu = F.floor((F.col("user_id") + shift * USER_STEP) / USER_STEP)
        br = F.floor((F.col("repo_id") + shift * REPO_STEP) / REPO_STEP)
        x = x.withColumn("bu", bu).withColumn("br", br).join(grid.withColumnRenamed("n", name), ["bu", "br"], "left").drop("bu", "br")
    return x.withColumn("density", F.greatest(F.coalesce("d1", F.lit(0)), F.coalesce("d2", F.lit(0)))).drop("d1", "d2")


def random_walk(watches: DataFrame, rounds: int = 20, restart: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(repo_id, prob, rank, pct) and (user_id, prob, rank, pct) after rounds of user to repo to user steps.

    Users start uniform. Each user's mass goes to its repos alike, is normalised, goes back to the
    repos' watchers alike, and is mixed with restart of the uniform distribution over the users.
    """
    # Degrees are counted before the shuffle and written, so that the watches of a popular repo can be dealt to several tasks.
    degree = lambda key, name: written(watches.groupBy(key).agg(F.count("*").alias(name)), "degree")
    edges = written(watches.join(degree("user_id", "du"), "user_id").join(degree("repo_id", "dr"), "repo_id").select("user_id", "repo_id", "du", "dr"), "edges")
    users = edges.select("user_id").distinct()
    n = max(users.count(), 1)
    user = users.withColumn("p", F.lit(1.0 / n))
    repo = None
    for k in range(rounds):
        repo = edges.join(user, "user_id").groupBy("repo_id").agg(F.sum(F.col("p") / F.col("du")).alias("p"))
        back = edges.join(repo, "repo_id").groupBy("user_id").agg((F.sum(F.col("p") / F.col("dr")) * (1 - restart) + restart / n).alias("p"))
        user = written(back, "walk") if k % 5 == 4 or k == rounds - 1 else back
    repo = edges.join(user, "user_id").groupBy("repo_id").agg(F.sum(F.col("p") / F.col("du")).alias("p")) if repo is None else repo
    return _ranked(repo, "repo_id"), _ranked(user, "user_id")


def _ranked(p: DataFrame, key: str) -> DataFrame:
    """Global ranks of probabilities by way of ranges: rows are sorted within ranges and moved by the ranges before."""
    spark = p.sparkSession
    cut = written(p, "probabilities")
    total = cut.count()
    bounds = cut.approxQuantile("p", [i / 16 for i in range(1, 16)], 0.01) if total > 200_000 else []
    part = F.lit(0)
    for b in sorted(set(bounds)):
        part = part + F.when(F.col("p") < b, 1).otherwise(0)
    cut = cut.withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy(F.desc("p"), key)
    ranked = cut.withColumn("k", F.row_number().over(within) - 1).join(F.broadcast(ahead), "part")  # 16 rows at most
    rank = F.col("k") + F.col("ahead")
    return ranked.select(key, F.col("p").alias("prob"), rank.alias("rank"), (rank / F.lit(max(total, 1))).alias("pct"))


def author_stats(watches: DataFrame, repos: DataFrame) -> DataFrame:
    n = watches.groupBy("repo_id").agg(F.count("*").alias("n"))
    return repos.join(n, "repo_id", "left").groupBy("author_name").agg(F.count("*").alias("n_repos"), F.sum(F.coalesce("n", F.lit(0))).alias("num_watchers"))


def name_stats(watches: DataFrame, repos: DataFrame) -> DataFrame:
    n = watches.groupBy("repo_id").agg(F.count("*").alias("n"))
    return repos.join(n, "repo_id", "left").groupBy("name").agg(F.count("*").alias("n_repos"), F.sum(F.coalesce("n", F.lit(0))).alias("num_watchers"))


def infer_authors(watches: DataFrame, repos: DataFrame) -> DataFrame:
    """user_id and author_name: whoever alone watches a repo is taken for its author."""
    alone = watches.groupBy("repo_id").agg(F.count("*").alias("n"), F.min("user_id").alias("user_id")).where("n = 1")
    return alone.join(repos, "repo_id").where("author_name is not null").select("user_id", "author_name").distinct()


def collaborators(watches: DataFrame, repos: DataFrame, inferred: DataFrame) -> DataFrame:
    """(u, v): v watches a repo of one of u's authors, and u one of v's."""
    w = watches.join(repos.select("repo_id", "author_name"), "repo_id").where("author_name is not null").select("user_id", "author_name").distinct()
    seen = w.join(inferred.withColumnRenamed("user_id", "of"), "author_name").where("user_id <> of").select(F.col("user_id").alias("v"), F.col("of").alias("u")).distinct()
    back = seen.select(F.col("u").alias("v"), F.col("v").alias("u"))
    return seen.join(back, ["u", "v"]).select(F.col("u").alias("user_id"), F.col("v").alias("other_id"))


def id_line(watches: DataFrame) -> DataFrame:
    """The single-watcher repos that follow the line of growing ids, in order: repo_id, user_id, last_repo, last_user.

    A repo is accepted if its watcher's id lies above the last accepted one's, by at most half the
    repos since and 50. Acceptance depends on the acceptance before, so the fold is over one sorted
    partition of (repo_id, user_id): two numbers for each repo with a single watcher.
    """
    alone = watches.groupBy("repo_id").agg(F.count("*").alias("n"), F.min("user_id").alias("user_id")).where("n = 1").select("repo_id", "user_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_repo = last_user = 0
        for b in batches:
            out = []
            for r, u in zip(b.repo_id.tolist(), b.user_id.tolist()):
                if last_user < u <= last_user + (r - last_repo) // 2 + 50:
                    out.append((r, u, last_repo, last_user))
                    last_repo, last_user = r, u
            yield pd.DataFrame(out, columns=["repo_id", "user_id", "last_repo", "last_user"])

    return alone.repartition(1).sortWithinPartitions("repo_id").mapInPandas(fold, "repo_id long, user_id long, last_repo long, last_user long")


def id_ranges(watches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, min_repo, max_repo) and (repo_id, min_user, max_user), of the segments between accepted points."""
    line = written(id_line(watches), "id-line")
    # A point ends one segment and starts the next; it belongs to the one it starts, the last point to itself alone.
    last = line.agg(F.max(F.struct("repo_id", "user_id")).alias("x")).where("x is not null")
    last = last.select(F.col("x.repo_id").alias("r0"), F.col("x.repo_id").alias("r1"), F.col("x.user_id").alias("u0"), F.col("x.user_id").alias("u1"))
    segments = line.select(F.col("last_repo").alias("r0"), F.col("repo_id").alias("r1"), F.col("last_user").alias("u0"), F.col("user_id").alias("u1"))
    points = lambda lo, hi: F.explode(F.sequence(F.greatest(F.col(lo), F.lit(1)), F.greatest(F.col(hi) - 1, F.col(lo), F.lit(1))))
    users = segments.where("u1 > 1").select(points("u0", "u1").alias("user_id"), "r0", "r1").unionByName(last.select(F.col("u0").alias("user_id"), "r0", "r1"))
    repos = segments.where("r1 > 1").select(points("r0", "r1").alias("repo_id"), "u0", "u1").unionByName(last.select(F.col("r0").alias("repo_id"), "u0", "u1"))
    return users.select("user_id", F.col("r0").alias("min_repo"), F.col("r1").alias("max_repo")), repos.select("repo_id", F.col("u0").alias("min_user"), F.col("u1").alias("max_user"))


def language_shares(repo_languages: DataFrame) -> DataFrame:
    """repo_id, lang and its share of the repo's lines (0 for a repo without lines)."""
    totals = repo_languages.groupBy("repo_id").agg(F.sum("lines").alias("total"))
    return repo_languages.join(totals, "repo_id").select("repo_id", "lang", xdiv(F.col("lines"), F.col("total")).alias("share"))


def user_languages(watches: DataFrame, repo_languages: DataFrame) -> DataFrame:
    """user_id, lang and the mean share over all watched repos, and the profile's norm."""
    n = watches.groupBy("user_id").agg(F.count("*").alias("n"))
    mean = watches.join(language_shares(repo_languages), "repo_id").groupBy("user_id", "lang").agg(F.sum("share").alias("s")).join(n, "user_id")
    mean = mean.select("user_id", "lang", (F.col("s") / F.col("n")).alias("share"))
    norms = mean.groupBy("user_id").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("norm"))
    return mean.join(norms, "user_id")


def propagate(watches: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """user_id, repo_id, total, n, mean of two-step propagation: to the other watchers of watched repos, then to their repos.

    users (user_id): whose propagation is wanted, all by default; what they don't start isn't worked out.
    """
    n = watches.groupBy("repo_id").agg(F.count("*").alias("n")).where("n >= 2")
    started = watches if users is None else watches.join(users.select("user_id").distinct(), "user_id", "left_semi")
    seeds = started.join(n, "repo_id").select(F.col("user_id").alias("u"), "repo_id", (1.0 / (F.col("n") - 1)).alias("w"))
    steps = seeds.join(watches, "repo_id").where("u <> user_id").groupBy("u", "user_id").agg(F.sum("w").alias("w"), F.count("*").alias("k"))
    steps = steps.withColumn("w", F.col("w") / F.sum("k").over(Window.partitionBy("u")))
    degree = watches.groupBy("user_id").agg(F.count("*").alias("d"))
    out = steps.join(degree, "user_id").join(watches, "user_id").groupBy("u", "repo_id").agg(F.sum(F.col("w") / F.col("d")).alias("total"), F.count("*").alias("n"))
    out = out.select(F.col("u").alias("user_id"), "repo_id", "total", "n", (F.col("total") / F.col("n")).alias("mean"))
    return out.join(started, ["user_id", "repo_id"], "left_anti")
