import collections
import math
import random
import re

from orrery.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for found in at.values() if len(found) > 1 for i in found for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts_are_those_of_the_definition(documents, texts):
    rows = quality.quality_scores(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_windows_at_any_vocabulary():
    words = [b"%d" % (i * i % 4999) for i in range(12_000)]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for f in at.values() if len(f) > 1 for i in f for j in range(i, i + 5)}
    assert quality.repeat_words(words) == len(hit) > 0


def test_agrees_with_labels(spark, documents, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.quality_scores(documents).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id]]
    bad = [r.kept for r in rows if not labels[r.doc_id]]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_em_finds_the_rules_that_are_right():
    import random

    rnd = random.Random(1)
    counts = {}
    for _ in range(20_000):
        good = rnd.random() < 0.8
        votes = tuple(-1 if rnd.random() < 0.3 else int(rnd.random() > (0.01 if good else p)) for p in (0.9, 0.8, 0.4))
        counts[votes] = counts.get(votes, 0) + 1
    share, rejects = quality.fit(sorted(counts.items()), 3)
    assert abs(share - 0.8) < 0.05
    assert abs(rejects[0, 0] - 0.9) < 0.08 and abs(rejects[0, 2] - 0.4) < 0.1 and (rejects[1] <= 0.03).all()


def posterior(votes, shares, rejects):
    like = [s * math.prod(r if x == 0 else 1 - r if x == 1 else 1 for x, r in zip(votes, kind)) for s, kind in zip(shares, rejects)]
    return like[-1] / sum(like)


def test_posterior_differs_from_any_reject_both_ways():
    """Most documents are bad, of two kinds; the third rule rejects good ones by mistake, and some bad ones get no reject vote."""
    rnd, rows = random.Random(2), []
    rates = ([0.95, 0.9, 0.3, 0.02, 0.02], [0.02, 0.02, 0.3, 0.9, 0.95], [0.01, 0.01, 0.2, 0.01, 0.01])
    for _ in range(30_000):
        kind = rnd.choices((0, 1, 2), (0.35, 0.35, 0.3))[0]
        votes = tuple(-1 if rnd.random() < 0.5 else int(rnd.random() > p) for p in rates[kind])
        rows.append((votes, kind == 2))
    counts = collections.Counter(v for v, _ in rows)
    model = quality.fit_kinds(sorted(counts.items()), 5)
    kept = {v: posterior(v, *model) >= 0.5 for v in counts}
    assert any(kept[v] and 0 in v for v in counts) and any(not kept[v] and 0 not in v for v in counts)
    right = sum(kept[v] == good for v, good in rows)
    by_any = sum((0 not in v) == good for v, good in rows)
    assert right > by_any + 0.02 * len(rows)


def test_posterior_column_is_bayes_rule_on_the_fitted_rates(documents):
    voted = quality._voted(documents)
    model = quality.learn(voted)
    for r in quality.quality_scores(documents).collect():
        votes = [r[f"vote_{k}"] for k in quality.rules()]
        assert abs(r.posterior - posterior(votes, *model)) < 1e-9
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_one_mistaken_rule_is_outvoted(spark):
    """Good documents that a lenient rule alone rejects stay; judged by any reject vote they would go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.quality_scores(docs).collect() if r.doc_id in labels and not r.base_failed]
    any_reject = {r.doc_id: any(r[f"vote_{k}"] == 0 for k in quality.rules()) for r in rows}
    assert any(r.kept and any_reject[r.doc_id] for r in rows)
    right = sum(r.kept == bool(labels[r.doc_id]) for r in rows)
    assert right > sum(any_reject[r.doc_id] != bool(labels[r.doc_id]) for r in rows)


def test_edge_cases(odd, empty):
    rows = quality.quality_scores(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert (r.n_words, r.base_failed, r.kept) == (0, True, False)
    assert len({r.posterior for r in rows if r.doc_id == 1}) == 1
    assert quality.quality_scores(empty).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in rows if r.kept)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ids
    assert quality.keep_good(empty).count() == 0
