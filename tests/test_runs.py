import pytest
from pyspark.sql import functions as F

from orrery.operators import candidates, evaluation
from orrery.plans import recommend
from orrery.plans.config import Config
from orrery.plans.dataset import WatchDataset


def test_leave_one_out_run(spark, sf, tmp_path):
    data = WatchDataset.from_tables(spark, sf)
    settings = recommend.Settings(sources=["parents_of_watched", "same_name", "coocs2", "in_cluster_repo", "most_watched"], bags=1, walk_rounds=3, svd_rank=5, clusters=5)
    run, held = recommend.leave_one_out(data, data.watches.select("user_id").distinct().where("user_id % 3 = 0"), settings, factorise=True)
    assert run.context.watched.join(held, (F.col("repo_id") == F.col("answer")) & (run.context.watched.user_id == held.user_id)).count() == 0
    models = run.train(held)
    assert models.ranker and set(models.sources) <= set(settings.sources)
    ranked = run.rank(models)
    metrics = evaluation.recall(ranked, held).first()
    assert metrics.users == held.count() and metrics.correct <= metrics.possible <= metrics.users and metrics.possible > 0
    top = run.recommend(models, 10).collect()
    assert all(len(r.repos) <= 10 and len({x.repo_id for x in r.repos}) == len(r.repos) for r in top)
    run.write(models, str(tmp_path / "out"))
    assert all(":" in r.value for r in spark.read.text(str(tmp_path / "out")).collect())


def test_default_ranker_needs_no_model(spark, sf):
    data = WatchDataset.from_tables(spark, sf)
    run = recommend.Run(data, data.test_users, recommend.Settings(sources=["parents_of_watched", "most_watched"], ranker="default", walk_rounds=1))
    assert run.rank(recommend.Models()).where("position = 0").count() == data.test_users.count()


def test_config():
    c = Config.parse("# note\nx=1;\ngenerator { sources=a,b; a { type=t; } }\n", ["generator.a.n=5", "x=2"])
    assert c.find("generator.a.type") == "t" and c.find("generator.a.sources") == "a,b" and c.find("generator.b.x") == "2" and c.find("generator.a.n") == "5"
    assert c.names("generator.sources") == ["a", "b"] and c.find("none", "d") == "d"
    for bad in ("a {", "}"):
        with pytest.raises(ValueError):
            Config.parse(bad)


def test_unknown_source():
    with pytest.raises(KeyError):
        candidates.source("nothing")


def test_settings_of_a_configuration():
    config = Config.parse("generator { sources = coocs, same_name; bags = 2; most_entries = coocs:7, same_name:9; least_score = 0.25; } ranker = default;")
    s = recommend.Settings.of(config, "generator")
    assert s.sources == ["coocs", "same_name"] and s.bags == 2 and s.most_entries == {"coocs": 7, "same_name": 9} and s.least_score == 0.25 and s.ranker == "default" and s.svd_rank == 50


def test_own_features_reach_the_ranker_and_a_second_model_ranks_again(spark, sf):
    data = WatchDataset.from_tables(spark, sf)
    api = data.repos.select("repo_id", F.lit(3).alias("num_watches"), F.lit(1).alias("num_forks"))
    settings = recommend.Settings(sources=["parents_of_watched", "same_name", "coocs2"], bags=1, walk_rounds=2, svd_rank=4, keyword_rank=3, clusters=4, ranker="reranker")
    stay, held = evaluation.leave_one_out(data.watches, data.watches.select("user_id").distinct().where("user_id % 3 = 1"))
    run = recommend.Run(data.replaced(watches=stay, test_users=held), held, settings, api)
    run.factorise()
    models = run.train(held)
    wanted = {"same_name_n_watched", "same_name_unwatched_rank", "coocs2_total", "coocs2_n", "kw_total", "kw_best_cosine", "tf_overlap", "author_best_dot", "user_cooc_total", "repo_cooc_met", "n_followers", "author_joined", "more_forks", "suspicious_user"}
    assert wanted <= set(models.names) and len(models.names) == len(set(models.names))
    assert models.second
    first, second = run.rank(recommend.Models(models.sources, models.ranker, [], models.names)), run.rank(models)
    assert first.count() == second.count() > 0
    assert second.where("score < 0 or score > 1 or score is null").isEmpty()
    assert {(r.user_id, r.repo_id) for r in first.collect()} == {(r.user_id, r.repo_id) for r in second.collect()}
