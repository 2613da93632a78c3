import random

import numpy as np

from orrery.llm import neardup


def found(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(df, **more).collect()}


def test_is_all_pairs(documents, texts):
    assert found(documents, width=2) == neardup.brute(list(texts.items()), 2)
    assert found(documents, width=5) == neardup.brute(list(texts.items()), 5)


def test_large_groups_of_near_copies(spark):
    """Copies of a base that are similar to it and mostly not to each other, among groups that share half of their words."""
    rnd = random.Random(5)
    word = lambda: "w%d" % rnd.randrange(10**6)
    docs, base = [], [word() for _ in range(120)]
    for k in range(150):
        x = list(base)
        for i in rnd.sample(range(120), rnd.randint(2, 9)):
            x[i] = word()
        docs.append((1000 + k, " ".join(x)))
    docs.append((1500, " ".join(base)))
    half = [word() for _ in range(60)]
    docs += [(2000 + k, " ".join(half + [word() for _ in range(60)])) for k in range(80)]
    docs += [(3000 + k, "the very same text again and again here") for k in range(200)]
    rnd.shuffle(docs)
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), width=2)
    assert got == neardup.brute(docs, 2)


def test_min_max_values_estimate_similarity():
    a, b = np.arange(0, 1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    a, b = (np.unique(neardup._mixed(x * neardup._MIX)) for x in (a, b))
    same = np.mean(neardup.bands(a) == neardup.bands(b))
    assert abs(same - (800 / 1200) ** neardup.ROWS) < 0.25


def test_edge_cases(odd, empty):
    rows = neardup.classes(odd, width=2).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and all(by[k].kept for k in (2, 3, 4))
    assert by[7].n_shingles == 1 and by[8].component_id == 1 and not by[8].kept
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert neardup.classes(empty, width=2).count() == 0
    kept = neardup.dedup(odd, width=2)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 8").count() == 0
    assert kept.where("doc_id is null").count() == 2 and neardup.dedup(empty).count() == 0


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_many_cells_and_joined_ids_give_the_same(spark, documents, texts):
    expected = neardup.brute(list(texts.items()), 2)
    assert found(documents, width=2, cell=300, broadcast_ids=0) == expected
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for k in range(90):
        x = list(base)
        for i in rnd.sample(range(100), rnd.randint(3, 8)):
            x[i] = f"v{rnd.randrange(10**6)}"
        docs.append((k, " ".join(x)))
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), width=2, cell=500) == neardup.brute(docs, 2)


def test_a_cell_gives_no_more_links_than_it_joins():
    rnd = np.random.default_rng(1)
    base = np.unique(rnd.integers(0, 1 << 62, 200, dtype=np.uint64))
    sets = [np.sort(np.concatenate([base[:190], np.unique(rnd.integers(0, 1 << 62, 4, dtype=np.uint64))])) for _ in range(40)]
    sets += [np.unique(rnd.integers(0, 1 << 62, 100, dtype=np.uint64)) for _ in range(5)]
    members = [(k, k, False, x.tobytes()) for k, x in enumerate(sets)]
    outliers = [(k, k, True, x.tobytes()) for k, x in enumerate(sets)]
    links = neardup._joining(members, outliers, 80)
    assert len(links) == 39 and {x for link in links for x in link} == set(range(40))


def test_finds_the_near_copies_of_five_words(spark):
    """Recall at the pipeline's width, against all pairs."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), width=5)
    assert got == neardup.brute(docs, 5)
