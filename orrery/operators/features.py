"""Features of users and of (user, repo) pairs, in groups; each group is a table to join on its ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.numbers import dot, norm, xdiv
from orrery.operators import graph


def user_profile(watched: DataFrame, counted: DataFrame, popularity: DataFrame, inferred: DataFrame, authors: DataFrame) -> DataFrame:
    """A row for each user: popularity and watchers of its repos, spread over authors and names, its own repos."""
    rows = watched.join(counted, "repo_id").join(popularity.select("repo_id", "popularity_rank"), "repo_id", "left")
    three = lambda k, name: [F.min(k).alias(f"min_{name}"), F.max(k).alias(f"max_{name}"), F.avg(k).alias(f"avg_{name}")]
    base = rows.groupBy("user_id").agg(F.count("*").alias("n_watched"), *three("popularity_rank", "popularity"), *three("n_watchers", "watchers"), F.count_distinct("author_name").alias("n_authors"), F.count_distinct("name").alias("n_names"))
    for key in ("author_name", "name"):
        label = key.split("_")[0]
        each = rows.where(F.col(key).isNotNull()).groupBy("user_id", key).agg(F.count("*").alias("n")).join(counted.groupBy(key).agg(F.count("*").alias("of")), key)
        each = each.withColumn("share", xdiv(F.col("n"), F.col("of")))
        base = base.join(each.groupBy("user_id").agg(*three("n", f"per_{label}"), *three("share", f"share_{label}")), "user_id", "left")
    own = inferred.join(counted, "author_name").groupBy("user_id").agg(F.count_distinct("repo_id").alias("n_own_repos"))
    follow = inferred.join(authors, "author_name").groupBy("user_id").agg(F.max("num_followers").alias("followers"), F.max("num_following").alias("following"))
    return base.join(own, "user_id", "left").join(follow, "user_id", "left").fillna(0, subset=["n_own_repos", "followers", "following"])


def language_match(pairs: DataFrame, watches: DataFrame, repo_languages: DataFrame) -> DataFrame:
    """Dot product and cosine of the user's and the repo's languages."""
    u = graph.user_languages(watches, repo_languages).withColumnRenamed("share", "us").withColumnRenamed("norm", "un")
    r = graph.language_shares(repo_languages)
    r = r.join(r.groupBy("repo_id").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("rn")), "repo_id")
    rows = pairs.join(u, "user_id").join(r, ["repo_id", "lang"]).groupBy("user_id", "repo_id").agg(F.sum(F.col("us") * F.col("share")).alias("language_dot"), F.first("un").alias("un"), F.first("rn").alias("rn"))
    rows = rows.select("user_id", "repo_id", "language_dot", xdiv(F.col("language_dot"), F.col("un") * F.col("rn")).alias("language_cosine"))
    return pairs.join(rows, ["user_id", "repo_id"], "left").fillna(0.0, subset=["language_dot", "language_cosine"])


def name_author(pairs: DataFrame, repos: DataFrame, watches: DataFrame) -> DataFrame:
    """Whether the author's name and the repo's contain one another, and the size and watchers of both groups."""
    a = graph.author_stats(watches, repos).select("author_name", F.col("n_repos").alias("author_repos"), F.col("num_watchers").alias("author_watchers"))
    n = graph.name_stats(watches, repos).select("name", F.col("n_repos").alias("name_repos"), F.col("num_watchers").alias("name_watchers"))
    x = pairs.join(repos.select("repo_id", "author_name", "name"), "repo_id").join(a, "author_name", "left").join(n, "name", "left")
    named = F.coalesce(F.length("author_name"), F.lit(0)) > 0
    return x.select("user_id", "repo_id", (named & F.coalesce(F.expr("contains(author_name, name)"), F.lit(False))).alias("author_name_contains_repo"), (named & F.coalesce(F.expr("contains(name, author_name)"), F.lit(False))).alias("repo_name_contains_author"), "author_repos", "author_watchers", "name_repos", "name_watchers")


def inference(pairs: DataFrame, repos: DataFrame, inferred: DataFrame) -> DataFrame:
    x = pairs.join(repos.select("repo_id", "author_name"), "repo_id", "left").join(inferred.withColumn("by_inferred_author", F.lit(True)), ["user_id", "author_name"], "left")
    n = inferred.groupBy("user_id").agg(F.count("*").alias("n_inferred"))
    return x.join(n, "user_id", "left").select("user_id", "repo_id", F.coalesce("by_inferred_author", F.lit(False)).alias("by_inferred_author"), F.coalesce("n_inferred", F.lit(0)).alias("n_inferred"))


def cooccurrence(pairs: DataFrame, watches: DataFrame, cooc: DataFrame, prefix: str, user_side: bool = False) -> DataFrame:
    """Sum, mean and maximum of the co-occurrence of the repo with W (or of the user with the repo's watchers), for both weights."""
    on, other = ("repo_id", "user_id") if not user_side else ("user_id", "repo_id")
    held = watches.select(F.col(other).alias("_o"), F.col(on).alias("b"))
    rows = pairs.join(held, pairs[other] == F.col("_o")).join(cooc, (F.col("a") == pairs[on]) & (cooc.b == held.b)).groupBy(pairs.user_id, pairs.repo_id)
    rows = rows.agg(*(f for k in ("cooc", "cooc2") for f in (F.sum(k).alias(f"{prefix}_{k}_total"), F.avg(k).alias(f"{prefix}_{k}_mean"), F.max(k).alias(f"{prefix}_{k}_max"))))
    out = pairs.join(rows, ["user_id", "repo_id"], "left")
    return out.fillna(0.0, subset=[c for c in out.columns if c.startswith(prefix)])


def dates(pairs: DataFrame, repos: DataFrame, authors: DataFrame, inferred: DataFrame) -> DataFrame:
    """Day numbers of the repo and of the user's first own author, their difference, and followers of both sides."""
    a = authors.select("author_name", F.col("num_followers").alias("author_followers"), F.col("num_following").alias("author_following"))
    x = pairs.join(repos.select("repo_id", "author_name", "created_day"), "repo_id", "left").join(a, "author_name", "left")
    first = repos.groupBy("author_name").agg(F.min("created_day").alias("day"))
    u = inferred.join(first, "author_name").join(a, "author_name", "left").groupBy("user_id").agg(F.min("day").alias("user_day"), F.max("author_followers").alias("user_followers"), F.max("author_following").alias("user_following"))
    x = x.join(u, "user_id", "left").fillna({"user_day": 10000, "user_followers": 0, "user_following": 0, "author_followers": 0, "author_following": 0})
    return x.select("user_id", "repo_id", "created_day", "user_day", (F.col("created_day") - F.col("user_day")).alias("day_difference"), "author_followers", "author_following", "user_followers", "user_following")


def author_dates(pairs: DataFrame, repos: DataFrame, authors: DataFrame, inferred: DataFrame) -> DataFrame:
    """Days on which the repo was made, its author joined, and the user's first own author joined, their
    differences, and the largest counts of the user's own authors; -1 where an author's counts aren't known.

    authors: author_name, num_followers, num_following and joined, a day. Where there is no joined, the
    day of the author's first repo stands in for it.
    """
    on = ["user_id", "repo_id"]
    known = authors.where("num_followers is not null")
    if "joined" not in known.columns:
        known = known.join(repos.groupBy("author_name").agg(F.min("created_day").alias("joined")), "author_name", "left")
    own = inferred.join(known, "author_name").groupBy("user_id").agg(F.min("joined").alias("own_joined"), F.max("num_followers").alias("own_followers"), F.max("num_following").alias("own_following"))
    x = pairs.select(*on).join(repos.select("repo_id", "author_name", "created_day"), "repo_id", "left")
    x = x.join(known.select("author_name", F.col("joined").alias("author_joined")), "author_name", "left").join(own, "user_id", "left")
    x = x.fillna({"author_joined": 0, "own_joined": 10000, "own_followers": -1, "own_following": -1})
    return x.select(
        *on, "author_joined", (F.col("created_day") - F.col("author_joined")).alias("repo_after_author"), "own_joined", (F.col("created_day") - F.col("own_joined")).alias("repo_after_own"),
        (F.col("author_joined") - F.col("own_joined")).alias("author_after_own"), "own_followers", "own_following",
    )


def follow_counts(pairs: DataFrame, follows: DataFrame) -> DataFrame:
    """How many follow the user, and how many the user follows."""
    count = lambda key, other, name: follows.groupBy(F.col(key).alias("user_id")).agg(F.count_distinct(other).alias(name))
    x = pairs.select("user_id", "repo_id").join(count("followed_id", "follower_id", "n_followers"), "user_id", "left")
    return x.join(count("follower_id", "followed_id", "n_following"), "user_id", "left").fillna(0)


def cooccurrence_sizes(pairs: DataFrame, watches: DataFrame, cooc: DataFrame, prefix: str, user_side: bool = False) -> DataFrame:
    """For both weights of cooccurrence(): its total over all of W (or all of the repo's watchers), and how
    many the user (or the repo) co-occurs with, by cooc among the same kind."""
    on, other = ("repo_id", "user_id") if not user_side else ("user_id", "repo_id")
    total = cooccurrence(pairs.select("user_id", "repo_id"), watches, cooc, prefix, user_side)
    held = watches.groupBy(other).agg(F.count("*").alias("_held"))
    met = cooc.groupBy(F.col("a").alias(on)).agg(F.count_if("in_cooc").alias(f"{prefix}_cooc_met"), F.count("*").alias(f"{prefix}_cooc2_met"))
    x = total.join(held, other, "left").join(met, on, "left").fillna(0)
    share = lambda k: xdiv(F.col(f"{prefix}_{k}_total"), F.col("_held")).alias(f"{prefix}_{k}_share")
    return x.select(*total.columns, share("cooc"), share("cooc2"), f"{prefix}_cooc_met", f"{prefix}_cooc2_met")


def author_similarity(pairs: DataFrame, repos: DataFrame, inferred: DataFrame, user_vectors: DataFrame) -> DataFrame:
    """The largest dot product and cosine of the user's vector with that of a user who may be the repo's
    author; -2 if there is none, null for a repo without author."""
    on = ["user_id", "repo_id"]
    x = pairs.select(*on).join(repos.select("repo_id", "author_name"), "repo_id", "left")
    theirs = inferred.join(user_vectors, "user_id").select("author_name", F.col("v").alias("_v"))
    each = x.join(theirs, "author_name").join(user_vectors, "user_id").groupBy(*on)
    best = each.agg(F.max(dot(F.col("v"), F.col("_v"))).alias("author_best_dot"), F.max(xdiv(dot(F.col("v"), F.col("_v")), norm(F.col("v")) * norm(F.col("_v")))).alias("author_best_cosine"))
    x = x.join(best, on, "left")
    return x.select(*on, *(F.when(F.col("author_name").isNotNull(), F.coalesce(k, F.lit(-2.0))).alias(k) for k in ("author_best_dot", "author_best_cosine")))


def keyword_vectors(pairs: DataFrame, watched: DataFrame, repo_vectors: DataFrame) -> DataFrame:
    """Keyword vectors (repo_id, v) of the repo and of W, whose mean is of vectors of length 1: largest
    terms, and the terms of their product, as they are and for a repo's vector of length 1."""
    on = ["user_id", "repo_id"]
    unit = repo_vectors.select("repo_id", "v", norm(F.col("v")).alias("n")).where("n > 0")
    held = watched.groupBy("user_id").agg(F.count("*").alias("_held"))
    terms = watched.join(unit, "repo_id").select("user_id", F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("_i", "_x"))
    mean = terms.groupBy("user_id", "_i").agg(F.sum("_x").alias("_x")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("u"))  # one place for each dimension
    mean = mean.join(held, "user_id").select("user_id", F.transform("u", lambda t: t["_x"] / F.col("_held")).alias("u"))
    x = pairs.select(*on).join(mean, "user_id", "left").join(unit, "repo_id", "left").withColumn("_t", F.zip_with("u", "v", lambda a, b: a * b))
    total, most = F.aggregate("_t", F.lit(0.0), lambda a, b: a + b), F.array_max("_t")
    return x.select(
        *on, F.array_max("u").alias("kw_user_max"), F.array_max("v").alias("kw_repo_max"), xdiv(F.array_max("v"), F.col("n")).alias("kw_repo_max_share"), total.alias("kw_total"), most.alias("kw_max"),
        xdiv(most, total).alias("kw_max_share"), xdiv(total, F.col("n")).alias("kw_total_norm"), xdiv(most, F.col("n")).alias("kw_max_norm"),
    )


def api_counts(pairs: DataFrame, counted: DataFrame, kids: DataFrame, api: DataFrame) -> DataFrame:
    """Watches and forks that an interface reports (repo_id, num_watches, num_forks), and how many more they are than the graph has."""
    x = pairs.select("user_id", "repo_id").join(api, "repo_id", "left").join(counted.select("repo_id", "n_watchers"), "repo_id", "left").join(kids, "repo_id", "left")
    x = x.fillna({"num_watches": -1, "num_forks": -1, "n_watchers": 0, "n_children": 0})
    return x.select("user_id", "repo_id", "num_watches", (F.col("num_watches") - F.col("n_watchers")).alias("more_watches"), "num_forks", (F.col("num_forks") - F.col("n_children")).alias("more_forks"))


def id_range(pairs: DataFrame, users: DataFrame, repos: DataFrame, watches: DataFrame) -> DataFrame:
    """Whether the ids lie in each other's ranges, how far the ranges reach, whether what the user (the repo)
    is linked with starts beyond its range or nothing is, and a score of all. An unknown range reaches from -1 to -1."""
    first = lambda key, other: watches.groupBy(key).agg(F.min(other).alias(f"_first_{other}"))
    x = pairs.join(users, "user_id", "left").join(repos, "repo_id", "left").fillna(-1, subset=["min_repo", "max_repo", "min_user", "max_user"])
    x = x.join(first("user_id", "repo_id"), "user_id", "left").join(first("repo_id", "user_id"), "repo_id", "left")
    in_u, in_r = F.expr("int(repo_id between min_repo and max_repo)"), F.expr("int(user_id between min_user and max_user)")
    odd_u, odd_r = F.expr("int(coalesce(_first_repo_id > max_repo, true))"), F.expr("int(coalesce(_first_user_id > max_user, true))")
    return x.select("user_id", "repo_id", in_u.alias("in_user_range"), in_r.alias("in_repo_range"), F.expr("max_repo - min_repo").alias("user_range_size"), F.expr("max_user - min_user").alias("repo_range_size"),
        odd_u.alias("suspicious_user"), odd_r.alias("suspicious_repo"), F.when(in_u + in_r > 0, in_r + in_u + 2 * odd_u + 2 * odd_r + 2 * odd_u * odd_r).otherwise(0).alias("range_score"))


def vectors(pairs: DataFrame, user_vectors: DataFrame, repo_vectors: DataFrame, centroids: DataFrame, singular: list[float]) -> DataFrame:
    """Products of the user's and the repo's vectors: weighted sum, sum, largest term and its share, and the repo against the centroid."""
    x = pairs.join(user_vectors.withColumnRenamed("v", "u"), "user_id", "left").join(repo_vectors.withColumnRenamed("v", "r"), "repo_id", "left").join(centroids.withColumnRenamed("v", "c"), "user_id", "left")
    weights = F.array(*map(F.lit, singular))
    terms = F.zip_with("u", "r", lambda a, b: a * b)
    total = dot(F.col("u"), F.col("r"))
    return x.select("user_id", "repo_id", dot(terms, weights).alias("svd_weighted"), total.alias("svd_total"), F.array_max(terms).alias("svd_max"), xdiv(F.array_max(terms), total).alias("svd_max_share"), F.coalesce(xdiv(dot(F.col("r"), F.col("c")), norm(F.col("r"))), F.lit(-1.0)).alias("svd_centroid"))


def best_against_watched(pairs: DataFrame, watched: DataFrame, repo_vectors: DataFrame, prefix: str) -> DataFrame:
    """The largest dot product and cosine of the repo with a repo of W; -2 where there is none."""
    w = watched.select(F.col("user_id").alias("_u"), F.col("repo_id").alias("_w")).join(repo_vectors.select(F.col("repo_id").alias("_w"), F.col("v").alias("wv")), "_w")
    rows = pairs.join(repo_vectors, "repo_id").join(w, F.col("user_id") == F.col("_u")).where("_w <> repo_id").groupBy("user_id", "repo_id")
    rows = rows.agg(F.max(dot(F.col("v"), F.col("wv"))).alias(f"{prefix}_best_dot"), F.max(xdiv(dot(F.col("v"), F.col("wv")), norm(F.col("v")) * norm(F.col("wv")))).alias(f"{prefix}_best_cosine"))
    return pairs.join(rows, ["user_id", "repo_id"], "left").fillna(-2.0, subset=[f"{prefix}_best_dot", f"{prefix}_best_cosine"])


def keyword_overlap(pairs: DataFrame, watched: DataFrame, keywords: DataFrame) -> DataFrame:
    """Overlap of the repo's keywords with those of W by tf and tf-idf, plain and normalised (-2 for a zero norm), and the number of common words."""
    u = watched.join(keywords, "repo_id").groupBy("user_id", "token").agg(F.sum("tf").alias("utf"), F.sum("tfidf").alias("uti"))
    un = u.groupBy("user_id").agg(F.count("*").alias("user_words"), F.sqrt(F.sum(F.col("utf") ** 2)).alias("utn"), F.sqrt(F.sum(F.col("uti") ** 2)).alias("uin"))
    rn = keywords.groupBy("repo_id").agg(F.count("*").alias("repo_words"), F.first("tf_norm").alias("rtn"), F.first("norm").alias("rin"))
    both = pairs.join(keywords, "repo_id").join(u, ["user_id", "token"]).groupBy("user_id", "repo_id").agg(F.sum(F.col("tf") * F.col("utf")).alias("tf_overlap"), F.sum(F.col("tfidf") * F.col("uti")).alias("tfidf_overlap"), F.count("*").alias("common_words"))
    x = pairs.join(both, ["user_id", "repo_id"], "left").join(un, "user_id", "left").join(rn, "repo_id", "left").fillna(0)
    over = lambda a, b: F.when(b == 0, F.lit(-2.0)).otherwise(xdiv(a, b))
    return x.select("user_id", "repo_id", "tf_overlap", over(F.col("tf_overlap"), F.col("utn") * F.col("rtn")).alias("tf_overlap_norm"), "tfidf_overlap", over(F.col("tfidf_overlap"), F.col("uin") * F.col("rin")).alias("tfidf_overlap_norm"), "common_words", "user_words", "repo_words",
        F.col("utn").alias("user_tf_norm"), F.col("uin").alias("user_tfidf_norm"), F.col("rtn").alias("repo_tf_norm"), F.col("rin").alias("repo_tfidf_norm"))


def relations(pairs: DataFrame, repos: DataFrame, inferred: DataFrame, follows: DataFrame, watches: DataFrame) -> DataFrame:
    """Whether the user is the repo's author, follows or is followed by a possible author, and how many those are."""
    x = pairs.join(repos.select("repo_id", "author_name"), "repo_id", "left")
    possible = inferred.withColumnRenamed("user_id", "p")
    n = possible.groupBy("author_name").agg(F.count("*").alias("n_possible"))
    links = x.join(possible, "author_name").select("user_id", "repo_id", "p")
    me = links.where("p = user_id").select("user_id", "repo_id").distinct().withColumn("authored", F.lit(True))
    f = links.join(follows, (links.user_id == follows.follower_id) & (links.p == follows.followed_id)).select("user_id", "repo_id").distinct().withColumn("follows_author", F.lit(True))
    b = links.join(follows, (links.user_id == follows.followed_id) & (links.p == follows.follower_id)).select("user_id", "repo_id").distinct().withColumn("author_follows", F.lit(True))
    on = ["user_id", "repo_id"]
    x = x.join(me, on, "left").join(f, on, "left").join(b, on, "left").join(n, "author_name", "left")
    return x.select(*on, *(F.coalesce(k, F.lit(False)).alias(k) for k in ("authored", "follows_author", "author_follows")), F.coalesce("n_possible", F.lit(0)).alias("n_possible"))
