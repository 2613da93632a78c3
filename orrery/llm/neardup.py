"""Near duplicates by min-max hashing.

Each permutation of a document's shingles gives two values, its minimum and its maximum, so half as
many hash evaluations fill a signature. Bands of ROWS values make buckets. No bucket emits its pairs.
Its members are first compared with one hub, the member that meets the most others over all its
buckets, and pairs are confirmed on the full shingle sets; confirmed links make components. Where members of a bucket
still lie in several components, those outside its largest one are compared with all members of the
buckets alike, in cells of a bounded number of shingles, which emit confirmed links alone. So every
pair that shares a bucket and could join two components is compared, and nothing is capped. Sets equal
to another's are one class from the start, so copies cost nothing further.

With 24 bands of 4 values a pair at similarity 0.8 shares no bucket with probability 3e-6, and less
above it.

Edge cases: null and empty texts and texts without words have an empty set, are linked with nothing
and stay (component_id is their own id); repeated rows are copies; a null id gets component_id null and
stays; shared smallest ids among copies resolve to that id; an empty table gives an empty result; other
columns are ignored, or kept by dedup().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import arrow_map, claim, cut, ship

BANDS, ROWS = 24, 4
#: Shingles of the members, and of the outliers, that are compared in one place.
CELL = 100_000
#: Ids of 8 bytes that are sent to all tasks at most.
BROADCAST_IDS = 1_000_000
#: Words that a worker remembers the hash of.
CACHE = 200_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_ODD = _rng.integers(1, 1 << 63, BANDS * ROWS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS // 2, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of width words; of all words as one where there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(claim("shingle words", _words)) > CACHE:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    at = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(at) - width + 1)
    out = np.full(n, np.uint64(min(width, len(at))), np.uint64)
    for k in range(min(width, len(at))):
        out = _mixed(out * _MIX + at[k : k + n])
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of the bands of a non-empty set."""
    low, high = np.empty(len(_ODD), np.uint64), np.empty(len(_ODD), np.uint64)
    for i in range(0, len(_ODD), 8):
        x = found[None, :] * _ODD[i : i + 8, None] + _ADD[i : i + 8, None]
        x ^= x >> np.uint64(32)
        x *= _MIX
        low[i : i + 8], high[i : i + 8] = x.min(1), x.max(1)
    values = np.stack([low, high], 1).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _MIX + values[:, k])
    return key.view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_key binary, keys array<long>"


def _signer(width: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, sets, keys = [], [], []
        for t in b.column("text").to_pylist():
            s = shingles(t, width)
            n.append(len(s))
            sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(bands(s) if len(s) else None)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "keys"])

    return run


def _sets(docs: DataFrame, needed: DataFrame, width: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """rep and shingles of the documents in needed (rep); docs has rep and text. The ids are sent to the
    texts while they are few enough, so that texts aren't shuffled."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("rep"), pa.array([shingles(t, width).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["rep", "shingles"])

    needed = cut(needed.select("rep").distinct(), "needed")
    near = F.broadcast(needed) if needed.count() <= broadcast_ids else needed
    return cut(arrow_map(docs.join(near, "rep", "left_semi"), run, "rep long, shingles binary").dropDuplicates(["rep", "shingles"]), "sets")


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, set_a, set_b) that reach the similarity."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * same >= percent * (len(x) + len(y) - same))
        return pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(pairs, run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component (its smallest node reachable) of the nodes of edges (a, b).

    Alternates large-star and small-star: every node hangs its larger neighbours, then its smaller
    ones and itself, to the smallest node it knows; a few rounds turn any component into a star.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    before = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that a hub's edges can be dealt to several tasks: a join over an aggregate isn't split.
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), name)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("x"), "m").where("x <> m").distinct()
        smallest = large.groupBy("x").agg(F.min("m").alias("s"))
        small = large.join(smallest, "x")
        small = small.where("m <> s").select(F.col("m").alias("x"), "s").unionByName(smallest).distinct()
        edges = cut(small.select(F.col("s").alias("a"), F.col("x").alias("b")), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots).distinct()


def _joining(members: list[tuple], outliers: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links of outliers with members of other components, as many as join those that there are: of
    (rep, root, outlier, shingles). Links within what the links before have joined are left out."""
    sets = [np.frombuffer(x[3], np.uint64) for x in members]
    sizes, every = np.array([len(x) for x in sets]), np.concatenate(sets)
    names, at = np.unique(every, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    _, part = np.unique([x[1] for x in (*members, *outliers)], return_inverse=True)
    out = []
    for k, (rep, _, _, raw) in enumerate(outliers):
        own, mine = np.frombuffer(raw, np.uint64), part[len(members) + k]
        flag = np.zeros(len(names), np.int64)
        where = np.searchsorted(names, own)
        where[where == len(names)] = 0
        flag[where[names[where] == own]] = 1
        same = np.add.reduceat(flag[at], starts)
        hit = np.flatnonzero((100 * same >= percent * (sizes + len(own) - same)) & (part[: len(members)] != mine))
        others, first = np.unique(part[hit], return_index=True)
        if len(others):
            out.extend((rep, members[hit[i]][0]) for i in first.tolist())
            part[np.isin(part, others)] = mine
    return out


def _across(cells: DataFrame, percent: int) -> DataFrame:
    """Links between the outliers and the members of each cell, of different roots; cells stand together and sorted."""

    def run(batches):
        cell, members, outliers, found = None, [], [], []
        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in ("group", "b", "c", "rep", "root", "outlier", "shingles"))):
                if r[:3] != cell:
                    if members and outliers:
                        found += _joining(members, outliers, percent)
                    cell, members, outliers = r[:3], [], []
                (outliers if r[5] else members).append(r[3:])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
            found = []
        if members and outliers:
            found = _joining(members, outliers, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    ship(cells.sparkSession)
    return cells.mapInArrow(run, "a long, b long")


def links(signed: DataFrame, docs: DataFrame, percent: int, width: int, cell: int = CELL, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """node and component of the classes of equal sets that are linked with others.

    signed has rep, n_shingles and keys of each class, docs its rep and text. What is aggregated by bucket
    is written before it is joined with the bucket's members, so that a hot bucket can be dealt to several tasks.
    """
    signed = cut(signed, "signatures")
    rows = signed.select("rep", "n_shingles", F.explode("keys").alias("key"))
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    rows = cut(rows.join(sizes, "key"), "buckets")
    meets = cut(rows.groupBy("rep").agg(F.sum("size").alias("meets")), "meets")
    hubs = rows.join(meets, "rep").groupBy("key").agg(F.max(F.struct("meets", (-F.col("rep")).alias("r"), "n_shingles")).alias("x"))
    hubs = cut(hubs.select("key", (-F.col("x.r")).alias("hub"), F.col("x.n_shingles").alias("hub_n")), "hubs")
    rows = cut(rows.join(hubs, "key").where("rep <> hub").select("key", "rep", "n_shingles", "hub", "hub_n"), "members")

    pairs = rows.where(100 * F.least("n_shingles", "hub_n") >= percent * F.greatest("n_shingles", "hub_n"))
    pairs = cut(pairs.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("rep")), width, broadcast_ids)
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = both.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
    edges = cut(_confirm(both.select("a", "b", "set_a", "set_b"), percent), "links")
    roots = components(edges)

    # Buckets in which members other than the hub still lie in several components. A pair of two components has
    # a member outside the bucket's largest, so comparing those outliers with all is enough.
    rows = rows.select("key", "rep", "n_shingles").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    rows = rows.select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("root"))
    inside = rows.groupBy("key", "root").agg(F.count("*").alias("inside"))
    open_ = inside.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("inside", "root"))["root"].alias("group")).where("roots > 1")
    open_ = cut(open_, "open-buckets")
    members = rows.join(open_, "key").select("group", "rep", "root", "n_shingles", (F.col("root") != F.col("group")).alias("outlier")).distinct()
    members = cut(members, "open")
    if members.isEmpty():
        return roots
    cells = members.groupBy("group").agg(F.sum("n_shingles").alias("all"), F.sum(F.when(F.col("outlier"), F.col("n_shingles"))).alias("out"))
    cells = cut(cells.select("group", F.ceil(F.col("all") / cell).cast("int").alias("bs"), F.ceil(F.col("out") / cell).cast("int").alias("cs")), "cells")
    placed = members.join(cells, "group").join(_sets(docs, members, width, broadcast_ids), "rep")
    of = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.select("group", of("bs").alias("b"), every("cs").alias("c"), "rep", "root", F.lit(False).alias("outlier"), "shingles")
    right = placed.where("outlier").select("group", every("bs").alias("b"), of("cs").alias("c"), "rep", "root", "outlier", "shingles")
    together = left.unionByName(right).repartition("group", "b", "c").sortWithinPartitions("group", "b", "c")
    more = cut(_across(together, percent), "more")
    return roots if more.isEmpty() else components(edges.unionByName(more))


def classes(docs: DataFrame, width: int = 5, percent: int = 80, cell: int = CELL, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    cell: shingles of the members, and of the outliers, that are compared in one place; broadcast_ids: how
    many ids are sent to the texts, beyond which they are joined. Neither changes the result.
    """
    docs = docs.select("doc_id", "text")
    signed = cut(arrow_map(docs, _signer(width), SIGNED), "signed")
    # One class for each set; its smallest id stands for it.
    reps = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = cut(reps, "classes")
    same = (signed.doc_id == reps.rep) & (signed.set_key == reps.set_key)
    chosen = signed.join(reps, same).select("rep", reps.set_key, "n_shingles", "keys").dropDuplicates(["rep", "set_key"])
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    roots = links(chosen, texts, percent, width, cell, broadcast_ids)
    found = signed.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left")
    found = found.join(roots, found.rep == roots.node, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class: that of the smallest id, and of rows with that same id and text, one."""
    ids = classes(docs, width, percent).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.sum(F.col("kept").cast("int")).alias("n"))
    ids = cut(ids.where("doc_id is not null"), "kept")
    gone = ids.where("not kept").select("doc_id")
    # Few ids are sent to the texts; many are joined.
    some = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    return some if ids.where("n > 1").isEmpty() else some.dropDuplicates(["doc_id", "text"])


def brute(docs: list[tuple[int, str | None]], width: int = 2, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id to n_shingles and component_id by comparing all pairs, for tests."""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                same = len(x & y)
                if 100 * same >= percent * (len(x) + len(y) - same):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}
