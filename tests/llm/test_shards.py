import random
import zlib
from collections import defaultdict

from orrery.llm import shards


def check(rows, texts=None):
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [size[k] for k in range(shards.SHARDS)]


def test_balanced_whole_groups(documents, texts):
    rows = shards.shard(documents).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    size = check(rows)
    assert max(size) - min(size) <= max(len(t.encode()) for t in texts.values()) and sum(size) == sum(len(t.encode()) + 1 for t in texts.values())
    of = defaultdict(set)
    for r in rows:
        of[texts[r.doc_id]].add(r.shard)
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in of.values())


def test_hot_group(spark):
    rnd = random.Random(1)
    rows = [(i, "hot text that is everywhere") for i in range(2000)] + [(9000 + i, "x" * rnd.randint(1, 300)) for i in range(2000)]
    rows = shards.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = sorted(check(rows))
    assert max(size[:-1]) - min(size[:-1]) <= 1500  # all but that of the hot group are even


def test_differencing_beats_longest_first():
    rnd = random.Random(2)
    sizes = {i: rnd.randint(1, 10**6) for i in range(300)}
    at = shards.differencing(sizes, 8)
    sums = [sum(s for i, s in sizes.items() if at[i] == k) for k in range(8)]
    longest = [0] * 8
    for s in sorted(sizes.values(), reverse=True):
        longest[longest.index(min(longest))] += s
    assert set(at) == set(sizes) and max(sums) - min(sums) <= max(longest) - min(longest)
    assert shards.differencing({}, 8) == {} and shards.differencing({"a": 3}, 8).keys() == {"a"}
    four = shards.differencing({"a": 8, "b": 7, "c": 6, "d": 5, "e": 4}, 2)  # the textbook case ends with a difference of 2
    assert abs(sum((8, 7, 6, 5, 4)["abcde".index(k)] * (1 if v else -1) for k, v in four.items())) == 2


def test_edge_cases(odd, empty):
    rows = shards.shard(odd).collect()
    assert len(rows) == odd.count()
    check(rows)
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {1} and {r.text_crc32 for r in rows if r.doc_id in (2, 3)} == {0}
    assert shards.shard(empty).count() == 0
