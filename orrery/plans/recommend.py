"""The three runs: cluster, train, recommend. Each works on all target users at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import candidates as cand
from orrery.operators import evaluation as ev
from orrery.operators import features as feat
from orrery.operators import graph, keywords, ml, property_graph, ranking
from orrery.plans.config import Config
from orrery.plans.dataset import WatchDataset
from orrery.plans.materialize import written
from orrery.sources import sinks


@dataclass
class Settings:
    sources: list[str] = field(default_factory=lambda: list(cand.DEFAULT_SOURCES))
    most_entries: dict[str, int] = field(default_factory=lambda: {"by_watched_authors": 200})
    least_score: float = 0.0
    ranker: str = "classifier"  # default, classifier or reranker
    bags: int = 5
    walk_rounds: int = 20
    svd_rank: int = 50
    keyword_rank: int = 100
    clusters: int = 200
    tranche_sources: str = "10"
    tranche_ranker: str = "01"


    @classmethod
    def of(cls, config: Config, block: str = "") -> Settings:
        """Settings of a configuration's block; what isn't named there stays as it is."""
        out, at = cls(), f"{block}." if block else ""
        for name, now in list(vars(out).items()):
            if (found := config.find(at + name)) is None:
                continue
            if isinstance(now, list):
                value = config.names(at + name)
            elif isinstance(now, dict):
                value = {k.strip(): int(n) for k, _, n in (x.partition(":") for x in found.split(",") if x.strip())}
            else:
                value = type(now)(found)
            setattr(out, name, value)
        return out


@dataclass
class Models:
    """The models of the sources, the ranker's bags, and a second ranker; with the names of their features."""

    sources: dict[str, tuple[PipelineModel, list[str]]] = field(default_factory=dict)
    ranker: list[PipelineModel] = field(default_factory=list)
    second: list[PipelineModel] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


class Run:
    """A dataset with what its runs share: vectors, clusters, walk, and the lists of the sources."""

    def __init__(self, data: WatchDataset, users: DataFrame, settings: Settings | None = None, api: DataFrame | None = None):
        """api: repo_id, num_watches, num_forks as an interface reports them, where they are known."""
        self.api = api
        self.data, self.users, self.settings = data, users.select("user_id").distinct(), settings or Settings()
        self.walk = tuple(written(x, "walk") for x in graph.random_walk(data.watches, rounds=self.settings.walk_rounds))
        self.context = cand.Context(data, self.users, most=self.settings.most_entries)
        self.own: dict[str, list[str]] = {}  # the sources' own features

    def factorise(self) -> None:
        """Vectors of repos and users from the watch matrix, centroids of users, clusters of both."""
        w = self.data.watches
        left, s, right = ml.svd(w.select(F.col("repo_id").alias("row"), F.col("user_id").alias("col"), F.lit(1.0).alias("value")), k=self.settings.svd_rank)
        self.repo_vectors = written(left.select(F.col("row").alias("repo_id"), "v"), "repo-vectors")
        self.user_vectors = written(right.select(F.col("col").alias("user_id"), "v"), "user-vectors")
        self.singular, self.centroids = [float(x) for x in s], written(ml.user_centroids(w, self.repo_vectors), "centroids")
        self.keywords = written(keywords.tf_idf(keywords.tokens(self.data.descriptions.select("repo_id", F.col("description").alias("text"))), max(self.data.repos.count(), 1)), "keywords")
        ids = property_graph.dense_ids(self.keywords.select("token").distinct(), ["token"]).withColumnRenamed("id", "row")
        _, _, words = ml.svd(self.keywords.join(ids, "token").select("row", F.col("repo_id").alias("col"), F.col("tf").alias("value")), k=self.settings.keyword_rank, left=False)
        self.keyword_vectors = written(words.select(F.col("col").alias("repo_id"), "v"), "keyword-vectors")
        # Repos are clustered by both vectors; those without keywords belong to no cluster. Without any keywords, by watches alone.
        both = self.repo_vectors.join(self.keyword_vectors.withColumnRenamed("v", "kv"), "repo_id").select("repo_id", F.concat("v", "kv").alias("v"))
        grouped = self.repo_vectors if self.keyword_vectors.isEmpty() else both
        self.repo_clusters = written(ml.kmeans(grouped, "repo_id", self.settings.clusters), "repo-clusters")
        self.user_clusters = written(ml.kmeans(self.user_vectors, "user_id", self.settings.clusters), "user-clusters")
        self.data.vectors = self.repo_clusters.join(self.repo_vectors, "repo_id").select("repo_id", "cluster_id", F.col("v").alias("embedding"))
        self.context.user_clusters = self.user_clusters.join(self.user_vectors, "user_id").select("user_id", "cluster_id", F.col("v").alias("embedding"))

    def source_rows(self, name: str) -> tuple[DataFrame, list[str]]:
        """Candidates of a source with the common features and its own, and their names."""
        rows = written(cand.source(name)(self.context), name)
        self.own[name] = [c for c in rows.columns if c not in ("user_id", "repo_id")]
        common = cand.common_features(self.context, rows.select("user_id", "repo_id"), self.walk)
        out = written(rows.join(common, ["user_id", "repo_id"]), f"{name}-features")
        names = [c for c in out.columns if c not in ("user_id", "repo_id")]
        return out.select("user_id", "repo_id", *(F.col(c).cast("double").alias(c) for c in names)), names

    def lists(self, models: Models) -> DataFrame:
        """The sources' lists, scored by their models (by watchers where there is none), ranked and cut."""
        out = None
        for name in self.settings.sources:
            rows, names = self.source_rows(name)
            if name in models.sources:
                rows = ml.score(models.sources[name][0], rows, names)
            else:
                rows = rows.withColumn("score", F.col("n_watchers") / (1 + F.col("n_watchers")))
            own = F.create_map(*(x for c in self.own[name] for x in (F.lit(f"{name}_{c}"), F.col(c)))) if self.own[name] else F.create_map().cast("map<string,double>")
            rows = rows.select("user_id", "repo_id", F.lit(name).alias("source"), "score", own.alias("own"))
            out = rows if out is None else out.unionByName(rows)
        by = ["user_id", "source"]
        sized = ranking.ranked(out, by).withColumn("size", F.count("*").over(ranking.Window.partitionBy(*by)))
        most = F.lit(cand.MOST_ENTRIES)
        for name, n in self.settings.most_entries.items():
            most = F.when(F.col("source") == name, n).otherwise(most)
        return written(sized.withColumn("keep", (F.col("position") < most) & (F.col("score") >= self.settings.least_score)), "lists")

    def candidates(self, models: Models, with_watched: bool = False) -> DataFrame:
        """Merged candidates with the generator's features. with_watched keeps W, for training."""
        seen = self.context.watched.limit(0) if with_watched else self.context.watched
        lists = self.lists(models)
        merged = ranking.merge(lists, seen, self.settings.sources)
        names = [f"{s}_{c}" for s in self.settings.sources for c in self.own[s]]
        if names:  # a map for each source that kept the candidate, so a group has as many as there are sources
            every = F.map_from_entries(F.flatten(F.collect_list(F.map_entries("own"))))
            own = lists.where("keep").groupBy("user_id", "repo_id").agg(every.alias("own"))
            own = own.select("user_id", "repo_id", *(F.col("own")[n].alias(n) for n in names))
            merged = merged.join(own, ["user_id", "repo_id"], "left")
        return written(merged, "merged")

    def featured(self, merged: DataFrame) -> tuple[DataFrame, list[str]]:
        """Candidates with the features of users and of (user, repo) pairs besides the generator's, and their names."""
        d, c, on = self.data, self.context, ["user_id", "repo_id"]
        pairs = merged.select(*on)
        groups = [
            cand.common_features(c, pairs, self.walk),
            feat.language_match(pairs, d.watches, d.repo_languages),
            feat.name_author(pairs, d.repos, d.watches),
            feat.inference(pairs, d.repos, c.inferred),
            feat.cooccurrence_sizes(pairs, c.watched, c.cooc, "repo"),
            feat.cooccurrence_sizes(pairs, d.watches, c.user_cooc, "user", user_side=True),
            feat.dates(pairs, d.repos, d.authors, c.inferred).select(*on, "created_day", "author_followers", "author_following"),
            feat.author_dates(pairs, d.repos, d.authors, c.inferred),
            feat.follow_counts(pairs, d.follows),
            feat.id_range(pairs, *graph.id_ranges(d.watches), d.watches),
            feat.relations(pairs, d.repos, c.inferred, d.follows, d.watches),
        ]
        if hasattr(self, "repo_vectors"):
            groups.append(feat.vectors(pairs, self.user_vectors, self.repo_vectors, self.centroids, self.singular))
            groups.append(feat.best_against_watched(pairs, c.watched, self.repo_vectors, "svd"))
            groups.append(feat.best_against_watched(pairs, c.watched, self.keyword_vectors, "kw"))
            groups.append(feat.author_similarity(pairs, d.repos, c.inferred, self.user_vectors))
            groups.append(feat.keyword_vectors(pairs, c.watched, self.keyword_vectors))
            groups.append(feat.keyword_overlap(pairs, c.watched, self.keywords))
        if self.api is not None:
            groups.append(feat.api_counts(pairs, c.counted, graph.children(d.repos), self.api))
        out = ranking.heuristic(merged, ["user_id"]).withColumnRenamed("score", "score_sum").drop("position", "min_rank", "max_rank")
        for g in groups:
            out = out.join(g.drop(*(x for x in g.columns if x in out.columns and x not in on)), on, "left")
        out = out.join(feat.user_profile(c.watched, c.counted, c.popular, c.inferred, d.authors).withColumnsRenamed({"followers": "user_max_followers", "following": "user_max_following"}), "user_id", "left")
        names = [x for x in out.columns if x not in on]
        return written(out.select(*on, *(F.col(x).cast("double").alias(x) for x in names)), "features"), names

    def train(self, answers: DataFrame) -> Models:
        """Models of the sources over one tranche of users, then the ranker over the other, so that neither sees the other's answers."""
        models, s = Models(), self.settings
        mine = answers.join(ev.tranche(answers, s.tranche_sources), "user_id", "left_semi")
        for name in s.sources:
            rows, names = self.source_rows(name)
            labelled = ev.training_rows(rows.withColumn("score", F.lit(0.0)), self.context.watched, mine, include_all_correct=True)
            train = written(labelled.join(rows, ["user_id", "repo_id"]), "training")
            if train.select("label").distinct().count() == 2:
                models.sources[name] = (ml.fit(train, names, "glm"), names)
        theirs = answers.join(ev.tranche(answers, s.tranche_ranker), "user_id", "left_semi")
        merged = self.candidates(models, with_watched=True)
        rows, models.names = self.featured(merged)
        labelled = ev.training_rows(merged, self.context.watched, theirs, include_all_correct=True)
        train = written(labelled.join(rows, ["user_id", "repo_id"]), "training")
        if train.select("label").distinct().count() == 2:
            models.ranker = ml.fit_bagged(train, models.names, bags=s.bags)
            if s.ranker == "reranker":
                one = ml.score(models.ranker, train, models.names)
                order = ranking.Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("repo_id"))
                one = one.withColumn("first_rank", (F.row_number().over(order) - 1).cast("double")).withColumn("first_pct", F.col("first_rank") / F.count("*").over(ranking.Window.partitionBy("user_id"))).withColumnRenamed("score", "first_score")
                models.second = ml.fit_bagged(one, [*models.names, "first_score", "first_rank", "first_pct"], bags=1)
        return models

    def rank(self, models: Models) -> DataFrame:
        """user_id, repo_id, score, position of all candidates, by the chosen ranker."""
        merged = self.candidates(models)
        if self.settings.ranker == "default" or not models.ranker:
            scored = merged
        else:
            rows, _ = self.featured(merged)
            scored = ml.rerank(models.ranker, rows, models.names, models.second) if models.second else ml.score(models.ranker, rows, models.names)
        return ranking.ranked(scored.select("user_id", "repo_id", "score"), ["user_id"])

    def recommend(self, models: Models, n: int = 100) -> DataFrame:
        return ranking.recommendations(self.rank(models), self.context.watched, n)

    def write(self, models: Models, path: str, n: int = 10) -> None:
        """The submission file of a run."""
        sinks.write_lines(sinks.submission_lines(self.recommend(models), n), path)


def leave_one_out(data: WatchDataset, users: DataFrame, settings: Settings | None = None, factorise: bool = False) -> tuple[Run, DataFrame]:
    """A run over the watches without one held-out watch for each user, everything derived worked out anew, and the answers."""
    stay, held = ev.leave_one_out(data.watches, users)
    fresh = data.replaced(watches=written(stay, "stay"), test_users=held)
    run = Run(fresh, held, settings)
    if factorise:
        run.factorise()
    return run, written(held, "held")
