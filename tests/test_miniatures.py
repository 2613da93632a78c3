"""Small graphs with results worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from orrery.functions import numbers, text
from orrery.operators import evaluation, graph, keywords, ml, property_graph, ranking
from orrery.sources import matrices, sinks, text_files


def watches(spark, pairs):
    return spark.createDataFrame(pairs, "user_id long, repo_id long")


def test_cooccurrence(spark):
    got = {(r.a, r.b): (r.cooc, r.cooc2) for r in graph.cooccurrence(watches(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]), "user_id", "repo_id").collect()}
    assert got[1, 2] == pytest.approx((1 / 4 + 1 / 9, 1 / 2 + 1 / 3)) and got[3, 1] == pytest.approx((1 / 9, 1 / 3)) and len(got) == 6


def test_cooccurrence_of_large_groups(spark):
    big = [(1, r) for r in range(30)] + [(2, r) for r in range(60)] + [(3, 0)]
    got = graph.cooccurrence(watches(spark, big), "user_id", "repo_id")
    assert got.count() == 30 * 29 and got.agg(F.max("cooc")).first()[0] == 0 and not got.agg(F.max("in_cooc")).first()[0]


def test_closure(spark):
    repos = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6)], "repo_id long, parent_id long")
    d = {r.repo_id: (r.depth, r.ancestors) for r in graph.depths(repos.where("repo_id < 6")).collect()}
    assert d[4] == (3, [1, 2, 3]) and d[1] == (0, []) and d[5] == (0, [])
    assert graph.closure(repos).where("repo_id = 6").count() == 1  # a cycle ends


def test_walk(spark):
    repo, user = graph.random_walk(watches(spark, [(1, 1), (2, 1), (2, 2)]), rounds=1)
    assert [round(r.prob, 6) for r in repo.orderBy("repo_id").collect()] == [0.75, 0.25]
    assert {r.user_id: (round(r.prob, 6), r["rank"]) for r in user.collect()} == {1: (0.40625, 1), 2: (0.59375, 0)}


def test_ranks_of_ties(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 3.0)], "user_id long, repo_id long, score double")
    got = {r.repo_id: (r.position, r.min_rank, r.max_rank) for r in ranking.ranked(rows, ["user_id"]).collect()}
    assert got == {2: (0, 0, 2), 1: (1, 0, 2), 3: (2, 2, 3)}


def test_words(spark):
    f = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert f(text.tokenize(F.lit("RailsAuthPlugin"))) == ["railsauthplugin"]
    assert f(text.uncamelcase(F.lit("RailsAuthPlugin"))) == ["rails", "auth", "plugin"] and f(text.uncamelcase(F.lit("JSON"))) == ["json"] and f(text.uncamelcase(F.lit("abc"))) == ["abc"]
    assert f(text.tokenize(F.lit("my-cool.repo"))) == ["my", "cool", "repo"] and f(text.tokenize(F.lit('"hello!"'))) == ["hello"]
    assert f(text.unescape_json_string(F.lit('"a\\"b"'))) == 'a"b' and f(text.unescape_json_string(F.lit("plain"))) == "plain" and f(text.unescape_json_string(F.lit('""'))) == ""
    assert f(text.unescape_json_string(F.lit('"a\\nb"'))) == "anb"
    with pytest.raises(Exception, match="unterminated"):
        f(text.unescape_json_string(F.lit('"open')))


def test_inferred_authors_and_collaborators(spark):
    repos = spark.createDataFrame([(9, "A"), (8, "B"), (7, "A"), (6, "B")], "repo_id long, author_name string")
    w = watches(spark, [(7, 9), (5, 8), (7, 6), (1, 6), (5, 7), (2, 7)])
    inferred = graph.infer_authors(w, repos)
    assert {tuple(r) for r in inferred.collect()} == {(7, "A"), (5, "B")}
    assert {tuple(r) for r in graph.collaborators(w, repos, inferred).collect()} == {(7, 5), (5, 7)}


def test_id_line(spark):
    w = watches(spark, [(1, 1), (2, 3), (60, 5), (3, 6), (50, 4), (51, 4)])
    assert [(r.repo_id, r.user_id) for r in graph.id_line(w).collect()] == [(1, 1), (3, 2), (6, 3)]
    users, repos = graph.id_ranges(w)
    assert {r.user_id: (r.min_repo, r.max_repo) for r in users.collect()} == {1: (1, 3), 2: (3, 6), 3: (6, 6)}
    assert {r.repo_id: (r.min_user, r.max_user) for r in repos.collect()}[6] == (3, 3)


def test_kept_together(spark):
    texts = [(i, "JavaScript") for i in range(60)] + [(100 + i, "GreenFrog") for i in range(10)]
    got = {r.token for r in keywords.tokens(spark.createDataFrame(texts, "repo_id long, text string")).collect()}
    assert got == {"javascript", "green", "frog"}


def test_empty_tables(spark):
    none = watches(spark, [])
    repos = spark.createDataFrame([], "repo_id long, author_name string, name string, parent_id long")
    for df in (graph.popularity(none), graph.closure(repos), graph.cooccurrence(none, "user_id", "repo_id"), *graph.random_walk(none, 2), graph.infer_authors(none, repos), graph.id_line(none), *graph.id_ranges(none), graph.propagate(none)):
        assert df.count() == 0


@pytest.mark.parametrize("kind", matrices.FORMATS)
def test_matrix_files(spark, tmp_path, kind):
    import numpy as np

    row, col, value = np.array([0, 2, 1]), np.array([0, 0, 3]), np.array([1.5, -2.0, 4.0])
    (tmp_path / "m").write_bytes(matrices.encode(3, 4, row, col, value, kind))
    got = matrices.read(spark, str(tmp_path / "m"), kind).collect()
    assert sorted((r["row"], r["col"], r["value"]) for r in got) == [(0, 0, 1.5), (1, 3, 4.0), (2, 0, -2.0)] and {(r.n_rows, r.n_cols) for r in got} == {(3, 4)}
    assert len(matrices.decode(matrices.encode(2, 2, np.array([], int), np.array([], int), np.array([]), kind), kind)[4]) == 0


def test_svd_is_that_of_numpy(spark):
    import numpy as np

    m = np.random.default_rng(0).integers(0, 2, (30, 20)).astype(float)
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    left, s, right = ml.svd(spark.createDataFrame(rows, "row long, col long, value double"), k=5, rounds=40)
    u, exact, v = np.linalg.svd(m)
    assert np.allclose(s[:3], exact[:3], rtol=1e-3)
    got = {r["row"]: r.v for r in left.collect()}
    first = np.array([got.get(i, [0] * 5)[0] for i in range(30)])
    assert abs(abs(first @ u[:, 0]) - 1) < 1e-3


def test_kmeans_and_assignment(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(10)] + [(20 + i, [0.01 * i, 1.0]) for i in range(10)] + [(99, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "repo_id long, v array<double>")
    c = ml.kmeans(v, "repo_id", k=2)
    by = {r.repo_id: r.cluster_id for r in c.collect()}
    assert 99 not in by and len({by[i] for i in range(10)}) == 1 and by[0] != by[20]
    again = {r.repo_id: r.cluster_id for r in ml.assign(v.where("repo_id <> 99"), ml.centroids(v, c, "repo_id"), "repo_id").collect()}
    assert again == by


def test_learners_rank_the_answer(spark):
    rows = [(u, r, int(r == u % 5), float(r == u % 5) + 0.01 * r, float(u)) for u in range(40) for r in range(5)]
    df = spark.createDataFrame(rows, "user_id long, repo_id long, label int, a double, b double").withColumn("weight", F.lit(1.0))
    for kind in [*ml.LEARNERS, "perceptron"]:
        model = ml.fit(df, ["a", "b"], kind)
        got = ml.score(model, df, ["a", "b"])
        low, high = (got.where(f"label = {k}").agg(F.avg("score")).first()[0] for k in (0, 1))
        assert high > low + 0.2, kind
    bags = ml.fit_bagged(df, ["a", "b"], bags=2, learner="glm")
    scored = ml.score(bags, df, ["a", "b"])
    calibrated = ml.calibrate(scored)(scored)
    assert calibrated.where("label = 1").agg(F.min("probability")).first()[0] > calibrated.where("label = 0").agg(F.max("probability")).first()[0]
    assert "probability" in ml.calibrate(scored, platt=False)(scored).columns


def test_models_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 1.0)] * 10, "label int, a double, weight double")
    model = ml.fit(df, ["a"])
    ml.save(model, str(tmp_path / "m"))
    assert [r.score for r in ml.score(ml.load(str(tmp_path / "m")), df, ["a"]).collect()] == [r.score for r in ml.score(model, df, ["a"]).collect()]


def test_property_graph(spark):
    g = property_graph.PropertyGraph.empty(spark).add_edge_type("knows", property_graph.EdgeBehavior.SYMMETRIC)
    g = g.get_or_create_nodes("user", spark.createDataFrame([("b",), ("a",), ("a",)], "k string"))
    g = g.get_or_create_nodes("user", spark.createDataFrame([("c",), ("a",)], "k string"))
    ids = {r.key: r.id for r in g.nodes.collect()}
    assert ids == {"a": 0, "b": 1, "c": 2}
    g = g.get_or_create_edges("knows", spark.createDataFrame([(0, 1), (0, 1)], "src long, dst long")).get_or_create_edges("knows", spark.createDataFrame([(1, 0)], "src long, dst long"))
    assert {tuple(r) for r in g.neighbours("knows").collect()} == {(0, 1), (1, 0)}
    g = g.set_attributes("user", "age", spark.createDataFrame([(0, 3), (1, 3)], "id long, value int"), "int").set_attributes("user", "age", spark.createDataFrame([(1, 4)], "id long, value int"), "int", version=1)
    assert g.unique("user", "age", 3) == 0 and g.unique("user", "age", 4) == 1
    with pytest.raises(property_graph.NotUnique):
        g.unique("user", "age", 9)
    with pytest.raises(TypeError):
        g.add_attribute_type("age", "date")
    assert property_graph.compare("bonus", "hello") < 0 and property_graph.compare(2, 1) > 0


def test_sources_refuse_what_is_wrong(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    r = text_files.repos(lines("5:me/x,2009-01-02,3", "6:/y,2009-01-02")).collect()
    assert [tuple(x) for x in r] == [(5, "me", "x", datetime.date(2009, 1, 2), 3), (6, None, "y", datetime.date(2009, 1, 2), None)]
    for bad in (text_files.repos(lines("125000:me/x,2009-01-02")), text_files.watches(lines("60000:1")), text_files.counts(lines("9 1"), spark.createDataFrame([(1,)], "repo_id long"), "n")):
        with pytest.raises(Exception, match="range|unknown"):
            bad.collect()
    records = lines("owner: me\nname: x\ndescription: nice thing\n", "name: only")
    assert [r.value for r in text_files.described(records).collect()] == ["me/x:nice thing"]


def test_compressed_files(spark, tmp_path):
    out = str(tmp_path / "lines")
    sinks.write_lines(spark.createDataFrame([("1:2",), ("1:3",)], "value string"), out, "gzip")
    assert text_files.watches(text_files.read(spark, out)).count() == 2


def test_training_lines(spark):
    rows = spark.createDataFrame([(1, 7, 1, 0.5, True, 2.0, None)], "user_id long, repo_id long, label int, weight double, real_test boolean, a double, b double")
    assert sinks.training_lines(rows, ["a", "b"]).first().value == "1 0.5 1 1 2.0 NaN # 7"
    assert sinks.training_header(["a"], set()) == "LABEL:k=BOOLEAN WT:k=REAL GROUP:k=REAL REAL_TEST:k=BOOLEAN a:k=REAL"


def test_split_keeps_groups(spark):
    got = evaluation.grouped_split(spark.range(1000).selectExpr("id % 100 as user_id")).groupBy("user_id").agg(F.count_distinct("split").alias("n"))
    assert got.where("n > 1").count() == 0


def test_buckets_and_division(spark):
    got = spark.createDataFrame([(0,), (11,), (1000,), (1001,)], "v int").select(numbers.bucket(F.col("v")).alias("b"), numbers.xdiv(F.lit(1.0), F.col("v")).alias("x")).collect()
    assert [r.b for r in got] == [0, 12, 1000, None] and got[0].x == 0.0


def test_long_chains_and_cycles_have_all_their_ancestors(spark):
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 1001)] + [(2000 + i, 2000 + (i + 1) % 90) for i in range(90)]
    repos = spark.createDataFrame(chain, "repo_id long, parent_id long")
    got = {r.repo_id: (r.depth, len(r.ancestors), r.ancestors[:1]) for r in graph.depths(repos).where("repo_id in (1, 2, 200, 1000, 2005)").collect()}
    assert got[1] == (0, 0, []) and got[2] == (1, 1, [1]) and got[200] == (199, 199, [1]) and got[1000] == (999, 999, [1])
    assert got[2005] == (89, 89, [2004])


def test_walk_and_cooccurrence_hold_their_laws(spark):
    w = spark.createDataFrame([(u, r) for u in range(12) for r in range(9) if (u * 7 + r * 5 + u * r) % 5 == 0], "user_id long, repo_id long")
    repo, user = graph.random_walk(w, rounds=5)
    assert abs(repo.agg(F.sum("prob")).first()[0] - 1) < 1e-9 and abs(user.agg(F.sum("prob")).first()[0] - 1) < 1e-9
    pairs = {(r.a, r.b): (r.cooc, r.cooc2) for r in graph.cooccurrence(w, "user_id", "repo_id").collect()}
    assert pairs and all(pairs[b, a] == x for (a, b), x in pairs.items())
    every = {tuple(r) for r in graph.propagate(w).where("user_id in (1, 4)").collect()}
    assert {tuple(r) for r in graph.propagate(w, w.where("user_id in (1, 4)")).collect()} == every != set()


def test_both_ways_of_factorising_agree(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    m = rnd.random((25, 3)) * [9, 5, 3] @ rnd.standard_normal((3, 18)) + 0.01 * rnd.random((25, 18))
    rows = spark.createDataFrame([(100 + int(i), 7 * int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row long, col long, value double")
    for size in (0, 64 << 20):
        left, s, right = ml.svd(rows, k=3, rounds=12, settled=1e-10, broadcast_bytes=size)
        u, v = ({r[0]: np.array(r.v) for r in x.collect()} for x in (left, right))
        assert np.allclose(s, np.linalg.svd(m)[1][:3], rtol=1e-4)
        best = np.linalg.svd(m)
        close = best[0][:, :3] * best[1][:3] @ best[2][:3]
        assert np.abs(np.array([[u[100 + i] @ (s * v[7 * j]) for j in range(18)] for i in range(25)]) - close).max() < 1e-2
    empty = ml.svd(rows.limit(0), k=3)
    assert empty[0].count() == empty[2].count() == 0


def test_id_ranges_as_features_and_matches(spark):
    from orrery.operators import features

    users = spark.createDataFrame([(1, 10, 14), (2, 20, 21)], "user_id long, min_repo long, max_repo long")
    repos = spark.createDataFrame([(11, 1, 1), (12, 1, 3), (20, 2, 2)], "repo_id long, min_user long, max_user long")
    watches = spark.createDataFrame([(1, 30), (2, 20), (9, 11), (2, 12)], "user_id long, repo_id long")
    pairs = spark.createDataFrame([(1, 11), (2, 20), (3, 40)], "user_id long, repo_id long")
    got = {(r.user_id, r.repo_id): tuple(r)[2:] for r in features.id_range(pairs, users, repos, watches).collect()}
    # in user range, in repo range, sizes of both, suspicious user and repo, score
    assert got == {(1, 11): (1, 1, 4, 0, 1, 1, 8), (2, 20): (1, 1, 1, 0, 0, 0, 2), (3, 40): (0, 0, 0, 0, 1, 1, 0)}
    every = spark.createDataFrame([(k,) for k in range(10, 22)], "repo_id long")
    found = {r.user_id: r.repos for r in evaluation.range_matches(users, users, repos, every, watches).collect()}
    assert found == {1: [11, 10, 12, 13, 14]}  # 11 is first watched by 9, beyond its range; 2 watches inside its own


def test_contrastive_pairs(spark):
    w = spark.createDataFrame([(u, r) for u in range(20) for r in range(u % 5)], "user_id long, repo_id long")
    repos = spark.createDataFrame([(r,) for r in range(50)], "repo_id long")
    rows = ml.contrastive_pairs(w, repos, 3).collect()
    seen = {tuple(r) for r in w.collect()}
    good, bad = ({(r.user_id, r.repo_id) for r in rows if r.positive == p} for p in (True, False))
    assert good == seen and bad and not bad & seen and len(rows) == len(good) + len(bad) <= 4 * len(seen)
    assert {tuple(r) for r in ml.contrastive_pairs(w, repos, 3).collect()} == {tuple(r) for r in rows}


def test_api_counts(spark):
    from orrery.operators import features

    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = features.api_counts(one([(1, 5), (1, 6)], "user_id long, repo_id long"), one([(5, 2)], "repo_id long, n_watchers long"), one([(5, 1)], "repo_id long, n_children long"), one([(5, 9, 4)], "repo_id long, num_watches long, num_forks long"))
    assert {tuple(r) for r in rows.collect()} == {(1, 5, 9, 7, 4, 3), (1, 6, -1, -1, -1, -1)}
