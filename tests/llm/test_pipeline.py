import re
from collections import Counter

import corpus_pipeline
from orrery.llm import decontam, neardup, packing, pii, quality


def test_each_stage_against_brute_force(spark, documents, sf, tmp_path):
    docs, columns, out = documents, documents.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = (before, docs)
        assert name == "best_fit_packing" or docs.columns == columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = map(text, out["quality_rules"])
    assert set(after) == {r.doc_id for r in quality.quality_scores(documents).where("kept").collect()} and all(before[d] == t for d, t in after.items())

    before, after = map(text, out["near_dedup"])
    assert set(after) == {d for d, (_, c) in neardup.brute(list(before.items()), 5).items() if c == d}

    before, after = map(text, out["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(r[5] for r in decontam.brute(list(after.items()), items))
    hit = {r[0] for r in decontam.brute(list(before.items()), items) if r[5]}
    assert hit and all(before[d] == after[d] for d in set(before) - hit)

    before, after = map(text, out["personal_data"])
    assert set(before) == set(after) and all(r.spans == "" for r in pii.personal_data(out["personal_data"][1]).collect())
    assert all(before[d] == after[d] for d in before if not re.search(r"[0-9@]", before[d])) and any("[EMAIL]" in t for t in after.values())
    assert all(r.n_chars == len(r.text) for r in out["personal_data"][1].collect())

    rows = out["best_fit_packing"][1].collect()
    assert {r.doc_id for r in rows} == set(after)
    assert len({r.sequence_id for r in rows}) == packing.lower_bound(Counter(r.length for r in rows), packing.CAPACITY)
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_stages_stand_odd_rows(spark, odd, sf):
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, odd, sf)
        assert done.count() > 0 and (name == "best_fit_packing" or done.columns == odd.columns)
        assert stage(spark, odd.limit(0), sf).count() == 0
