import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.llm import packing
from orrery.llm.tokens import encoder


def check(rows, texts):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    ids_of = dict(zip(texts, encoder("byte_bpe_50k.json").ids([t or "" for t in texts.values()])))
    for d in texts:
        ids, at = np.append(np.frombuffer(ids_of[d], "<u2"), 0).astype("<u4"), 0
        for k, r in enumerate(sorted(pieces[d], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == packing.CAPACITY or k == 0
            at += r.length
        assert at == len(ids) and (len(ids) > packing.CAPACITY or len(pieces[d]) == 1)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(places)


def test_packs_all_in_few(documents, texts):
    rows = packing.pack(documents).collect()
    counts = Counter(r.length for r in rows)
    assert check(rows, texts) == packing.lower_bound(counts, packing.CAPACITY)


def test_sequences_hold_the_ids(documents):
    packed = packing.pack(documents, keep_ids=True)
    rows = {(r.sequence_id, r.offset): r for r in packed.collect()}
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for (s, at), r in rows.items():
        assert zlib.crc32(whole[s][4 * at : 4 * (at + r.length)]) == r.ids_crc32


def best(sizes, capacity):
    """Fewest bins by trying everything."""
    found = [len(sizes)]

    def place(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= sizes[i]:
                place(i + 1, [*bins[:k], bins[k] - sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return found[0]


@pytest.mark.parametrize("seed", range(25))
def test_small_plans_are_the_best(seed):
    rnd = random.Random(seed)
    sizes = sorted((rnd.randint(15, 60) for _ in range(11)), reverse=True)
    plan = packing.plan(dict(Counter(sizes)), 100)
    placed = Counter()
    for filling, m in plan:
        assert sum(filling) <= 100
        placed.update({k: n * m for k, n in Counter(filling).items()})
    assert placed == Counter(sizes) and sum(m for _, m in plan) <= best(sizes, 100)


def test_plans_are_no_worse_than_best_fit():
    rnd = random.Random(9)
    for n in (50, 3000):
        counts = dict(Counter(rnd.randint(500, 1100) for _ in range(n)))
        one, two = (sum(m for _, m in p) for p in (packing.plan(counts), packing.best_fit(counts, packing.CAPACITY)))
        assert packing.lower_bound(counts, packing.CAPACITY) <= one <= two
    assert packing.plan({}) == [] and sum(m for _, m in packing.plan({2048: 10**9, 1: 5})) == 10**9 + 1


@pytest.mark.parametrize("seed", range(40))
def test_the_whole_search_finds_the_best(seed):
    rnd = random.Random(100 + seed)
    capacity = rnd.choice((20, 50, 100))
    sizes = [rnd.randint(1, capacity * 3 // 5) for _ in range(rnd.randint(1, 11))]
    plan = packing.plan(dict(Counter(sizes)), capacity, packing.EXACT)
    placed = Counter()
    for filling, m in plan:
        assert sum(filling) <= capacity
        placed.update({k: n * m for k, n in Counter(filling).items()})
    assert placed == Counter(sizes) and sum(m for _, m in plan) == best(sorted(sizes, reverse=True), capacity)


def test_fillings_are_those_that_nothing_dominates():
    """By brute force: no piece that is left fits into the room or for one or two shorter ones."""
    from itertools import combinations

    rnd = random.Random(7)
    for _ in range(60):
        sizes = sorted((rnd.randint(1, 30) for _ in range(9)), reverse=True)
        left, room = packing._Left(Counter(sizes)), 40 - sizes[0]
        expected = set()
        for n in range(9):
            for c in combinations(range(1, 9), n):
                taken, free = [sizes[i] for i in c], room - sum(sizes[i] for i in c)
                rest = [sizes[i] for i in range(1, 9) if i not in c]
                if free >= 0 and not any(z <= free for z in rest) and not any(x < z <= x + free for x in taken for z in rest) and not any(sum(p) <= z <= sum(p) + free for p in combinations(taken, 2) for z in rest):
                    expected.add((sizes[0], *taken))
        assert set(packing.fillings(left, sizes[0], 40, packing.EXACT)) == expected
        assert left.n == Counter(sizes)


def test_groups_of_equal_lengths(spark):
    """More than one group of a length: the places are the same."""
    docs = spark.createDataFrame([(k, "a " * (1 + k % 3) * 400) for k in range(60)], "doc_id long, text string")
    rows = packing.pack(docs, group=7).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(rows, texts) == check(packing.pack(docs).collect(), texts)


def test_edge_cases(odd, empty):
    rows = packing.pack(odd).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert all(r.length == 1 for r in rows if r.doc_id in (2, 3))
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 and len({o for o, _ in x}) == len(x) for x in seqs.values())
    assert packing.pack(empty).count() == 0
