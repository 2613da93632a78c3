"""Factorisation, clustering and learned scores."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.numbers import dot, norm, xdiv
from orrery.plans.materialize import removed, written


def _sum(df: DataFrame, key: str) -> DataFrame:
    """Sums of the arrays v by key, on the JVM side."""
    return df.groupBy(key).agg(Summarizer.sum(array_to_vector("v")).alias("v")).select(key, vector_to_array("v").alias("v"))


def _gram(df: DataFrame, k: int) -> np.ndarray:
    """The k x k matrix of sums of v_i v_j: all that the driver sees."""
    outer = F.flatten(F.transform("v", lambda a: F.transform("v", lambda b: a * b)))
    found = df.select(Summarizer.sum(array_to_vector(outer)).alias("g")).first()["g"]
    return np.zeros((k, k)) if found is None else found.toArray().reshape(k, k)


def _times(df: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """Each v times m, in Arrow batches."""

    def run(batches):
        for b in batches:
            v = np.stack(b.v.to_numpy()) @ m if len(b) else []
            yield pd.DataFrame({key: b[key], "v": list(v)})

    return df.select(key, "v").mapInPandas(run, f"{key} long, v array<double>")


#: Bytes of a column of a factor that is sent to all tasks at most; beyond it, products are joins.
BROADCAST_BYTES = 64 << 20
#: Bytes of the columns of a factor that go to the tasks and come back at once.
SLICE_BYTES = 16 << 20
#: The change of the singular values in a round, as a share of the largest, at which they count as settled.
SETTLED = 1e-4
#: Entries of a part of the matrix, of a batch dealt out to the parts, and of a sum that is made at once; tasks that make sums of all columns.
PART_ENTRIES, DEALT_ENTRIES, SUM_ENTRIES, MOST_TASKS = 2_000_000, 1_000_000, 2048, 32


def svd(entries: DataFrame, k: int = 50, rounds: int = 8, seed: int = 0, settled: float = SETTLED, broadcast_bytes: int = BROADCAST_BYTES, left: bool = True, taken: bool = False) -> tuple[DataFrame | None, np.ndarray, DataFrame]:
    """(row, v), singular values, (col, v) of the sparse matrix entries (row, col, value), in rounds that end when the values have settled.

    While a column of the factors that are made fits broadcast_bytes, the matrix is dealt by rows into parts, each of which
    multiplies slices of the factor by itself and its transpose at once (the driver keeps a factor for each round in
    files, which make a space by block Lanczos); larger ones are joined with the entries, by subspace iteration.
    The order of the vectors is that of the values. A matrix without entries has no vectors. Without left, those of
    the rows aren't made, and None stands for them. taken: entries are a written table that may go on the way.
    """
    entries = entries.select("row", "col", F.col("value").cast("double").alias("value"))
    entries = entries if taken else written(entries, "entries")
    n = entries.count()
    if not n:
        none = F.array().cast("array<double>").alias("v")
        return entries.select("row", none) if left else None, np.zeros(0), entries.select("col", none)
    cols = written(entries.select("col").distinct(), "cols")
    n_cols, n_rows = cols.count(), entries.select("row").distinct().count() if left else 0
    if 8 * max(n_cols, n_rows) <= broadcast_bytes:
        return _svd_sent(entries, n, np.sort(cols.toArrow().column(0).to_numpy()), k, rounds, seed, settled, left)
    found = _svd_joined(entries, max(1, min(k, n_cols, n_rows or entries.select("row").distinct().count())), rounds, seed, settled)
    return found if left else (None, *found[1:])


def _runs(to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How entries lie for sums by to, numbers below n that all occur: (count, size) of runs of sums with equally many
    entries, the places of to in that order, and the entries' order."""
    sizes = np.bincount(to, minlength=n)
    by = np.argsort(sizes, kind="stable")
    place = np.empty(n, np.int32)
    place[by] = np.arange(n, dtype=np.int32)
    size, count = np.unique(sizes, return_counts=True)
    return np.stack([count, size], 1).astype("<i8"), place, np.argsort(place[to], kind="stable")


def _sums(runs: np.ndarray, at: np.ndarray, values: np.ndarray | None, f: np.ndarray) -> np.ndarray:
    """The sums of the rows of f at the places at, times values (None: all 1), in the order of runs."""
    out, o, a = np.zeros((int(runs[:, 0].sum()), f.shape[1])), 0, 0
    ones = np.ones((1, SUM_ENTRIES))
    for count, size in runs.tolist():
        end = o + count
        while o < end:
            many = min(end - o, max(1, SUM_ENTRIES // size))
            for first in range(0, size, SUM_ENTRIES):  # more than one only where a single sum has more entries
                length = min(size - first, SUM_ENTRIES)
                rows = np.take(f, at[a : a + many * length], axis=0, mode="clip").reshape(many, length, -1)
                by = ones[:, :length] if values is None else values[a : a + many * length].reshape(many, 1, length)
                out[o : o + many] += np.matmul(by, rows)[:, 0]
                a += many * length
            o += many
    return out


#: Spark's setting by which the shuffle files of a statement go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_DEALT = "part int, row binary, col binary, value binary"
_PACKED = "row binary, col binary, row_runs binary, row_at binary, row_values binary, col_runs binary, col_at binary, col_values binary"


def _packed(entries: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The matrix of n entries in parts, a row for each, written: a row of the matrix lies in one part whole. And the tasks for it."""
    spark = entries.sparkSession
    tasks = max(1, min(MOST_TASKS, spark.sparkContext.defaultParallelism))
    each = 2 * -(-n // (2 * tasks * PART_ENTRIES))
    # Names of parts that go to as many parts in each partition.
    names: dict[int, list[int]] = {}
    for r in spark.range(100 * tasks * each, numPartitions=1).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("p")).collect():
        names.setdefault(r.p, []).append(r.id)
    labels = np.array([x for p in sorted(names) for x in names[p][:each]], np.int32)

    def deal(batches):
        def out(held):
            t = pa.Table.from_batches(held)
            row, col, value = (t.column(x).to_numpy() for x in ("row", "col", "value"))
            mixed = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part = ((mixed >> np.uint64(40)) % np.uint64(len(labels))).astype(np.uint16 if len(labels) <= 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(len(labels) + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                x = order[cuts[i] : cuts[i + 1]]
                plain = (value[x] == 1).all()
                yield pa.RecordBatch.from_pydict({"part": pa.array(labels[i : i + 1]), "row": [row[x].tobytes()], "col": [col[x].tobytes()], "value": pa.array([None if plain else value[x].tobytes()], pa.binary())})

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= DEALT_ENTRIES:
                yield from out(held)
                held, size = [], 0
        if size:
            yield from out(held)

    def pack(t: pa.Table) -> pa.Table:
        (rows, row), (cols, col) = (np.unique(np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in t.column(c)]), return_inverse=True) for c in ("row", "col"))
        value = None
        if t.column("value").null_count < len(t):
            value = np.concatenate([np.ones(len(r.as_py()) // 8) if v.as_py() is None else np.frombuffer(v.as_py()) for r, v in zip(t.column("row"), t.column("value"))])
        (row_runs, row_place, by_row), (col_runs, col_place, by_col) = _runs(row, len(rows)), _runs(col, len(cols))
        short = lambda x, m: x.astype("<u2" if m <= 1 << 16 else "<i4")
        out = {
            "row": rows[np.argsort(row_place)], "col": cols[np.argsort(col_place)],
            "row_runs": row_runs, "row_at": short(col_place[col[by_row]], len(cols)), "row_values": None if value is None else value[by_row],
            "col_runs": col_runs, "col_at": short(row_place[row[by_col]], len(rows)), "col_values": None if value is None else value[by_col],
        }
        return pa.table({c: pa.array([None if x is None else x.tobytes()], pa.binary()) for c, x in out.items()})

    dealt = entries.mapInArrow(deal, _DEALT).repartition(tasks, "part")
    return written(dealt.groupBy("part").applyInArrow(pack, _PACKED), "packed"), tasks


def _svd_sent(entries: DataFrame, n: int, cols: np.ndarray, k: int, rounds: int, seed: int, settled: float, left: bool) -> tuple[DataFrame | None, np.ndarray, DataFrame]:
    spark = entries.sparkSession
    packed, tasks = _packed(entries, n)
    removed(entries)
    every, n_cols, n_rows = spark.sparkContext.broadcast(cols), len(cols), packed.agg(F.sum(F.length("row"))).first()[0] // 8
    k = max(1, min(k, n_rows, n_cols))
    wide = min(k + 10, n_rows, n_cols)
    step = max(wide, SLICE_BYTES // (32 * wide))
    pieces = [slice(a, min(a + step, n_cols)) for a in range(0, n_cols, step)]  # of the rows of a factor

    def through(factor: np.ndarray, back: bool):
        """For slices of columns: where the first is, and the tables that tasks make of them, by the matrix and if back by its transpose."""
        most = max(1, SLICE_BYTES // (8 * (n_cols if back else max(n_cols, n_rows))))
        slices = -(-factor.shape[1] // most)
        for columns in np.array_split(np.arange(factor.shape[1]), slices):
            sent = spark.sparkContext.broadcast(np.ascontiguousarray(factor[:, columns[0] : columns[-1] + 1]))

            def part(batches):
                total = np.zeros(sent.value.shape) if back else None
                for b in batches:
                    for r in (dict(zip(b.schema.names, x)) for x in zip(*b.columns)):
                        numbers = lambda c, kind: None if not r[c].is_valid else np.frombuffer(r[c].as_buffer(), kind)  # noqa: B023, E731
                        at = np.searchsorted(every.value, numbers("col", "<i8"))
                        place = lambda c, m: numbers(c, "<u2" if m <= 1 << 16 else "<i4")  # noqa: B023, E731
                        sums = _sums(numbers("row_runs", "<i8").reshape(-1, 2), place("row_at", len(at)), numbers("row_values", "<f8"), sent.value[at])
                        if back:
                            total[at] += _sums(numbers("col_runs", "<i8").reshape(-1, 2), place("col_at", len(sums)), numbers("col_values", "<f8"), sums)
                        else:
                            yield pa.RecordBatch.from_pydict({"row": [r["row"].as_py()], "sums": [sums.tobytes()]})
                if back:
                    yield pa.table({"piece": pa.array(range(len(pieces)), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * len(pieces), pa.int32()), "sums": [total[p].tobytes() for p in pieces]}).to_batches()[0]

            def add(t: pa.Table) -> pa.Table:
                t = t.sort_by("task")
                return pa.table({"piece": t.column("piece")[:1], "sums": [sum(np.frombuffer(x.as_buffer()) for x in t.column("sums").combine_chunks()).tobytes()]})

            if back:  # the tasks' sums meet by pieces, so that the driver gets each piece once
                made = packed.coalesce(tasks).mapInArrow(part, "piece int, task int, sums binary").repartition(tasks, "piece").groupBy("piece").applyInArrow(add, "piece int, sums binary")
            else:
                made = packed.coalesce(tasks).mapInArrow(part, "row binary, sums binary")
            yield columns, made.toLocalIterator() if not back else made.toArrow()
            sent.destroy()

    # Block Lanczos on the transpose times the matrix with full orthogonalisation: each round widens the space by one
    # block, and the values are those of the matrix on the whole space so far. The blocks lie in files without a
    # name, which go with their arrays; pieces are in memory.
    def stored(shape: tuple[int, int]) -> np.ndarray:
        with tempfile.TemporaryFile(prefix="orrery-") as file:
            return np.memmap(file, np.float64, "w+", shape=shape)

    def image(block: np.ndarray) -> np.ndarray:
        out, before = stored(block.shape), spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        for columns, sums in through(block, True):
            for i, x in zip(sums.column("piece").to_pylist(), sums.column("sums")):
                out[pieces[i], columns[0] : columns[-1] + 1] = np.frombuffer(x.as_buffer()).reshape(-1, len(columns))
        spark.conf.set(_CLEANUP, before)
        return out

    def products(block: np.ndarray) -> np.ndarray:
        """The space's transpose times block."""
        return np.vstack([sum(x[p].T @ block[p] for p in pieces) for x in space])

    def spread(p: slice, m: np.ndarray) -> np.ndarray:
        """A piece of the space times m."""
        out, at = np.zeros((p.stop - p.start, m.shape[1])), 0
        for x in space:
            out += x[p] @ m[at : at + x.shape[1]]
            at += x.shape[1]
        return out

    def orthogonal(block: np.ndarray) -> None:
        m = products(block)
        for p in pieces:
            block[p] -= spread(p, m)

    def qr(block: np.ndarray) -> np.ndarray:
        """R; block becomes Q."""
        parts = []
        for p in pieces:
            q, r = np.linalg.qr(block[p])
            block[p, : q.shape[1]] = q
            parts.append(r)
        q, r = np.linalg.qr(np.vstack(parts))
        at = 0
        for p, x in zip(pieces, parts):
            block[p] = block[p, : len(x)] @ q[at : at + len(x)]
            at += len(x)
        return r

    block, random = stored((n_cols, wide)), np.random.default_rng(seed)
    for p in pieces:
        block[p] = random.standard_normal((p.stop - p.start, wide))
    qr(block)
    space, gram, before = [], np.zeros((0, 0)), None
    for done in range(1, max(1, rounds) + 1):
        space.append(block)
        del block
        after = image(space[-1])
        beside = products(after)
        gram = np.block([[gram, beside[: len(gram)]], [beside[: len(gram)].T, beside[len(gram) :]]])
        values, vectors = np.linalg.eigh(gram)
        s, turn = np.sqrt(np.maximum(values[::-1][:k], 0)), vectors[:, ::-1][:, :k]
        if done >= rounds or before is not None and np.abs(s - before).max() <= settled * max(s[0], 1e-300):
            break
        before, room = s, min(wide, n_cols - len(gram))
        for _ in range(2):
            orthogonal(after)
        kept = (np.abs(np.diag(qr(after))) > 1e-9 * max(s[0] ** 2, 1e-300)).nonzero()[0][:room]
        if not len(kept):
            break
        block = after
        if len(kept) < after.shape[1]:
            block = stored((n_cols, len(kept)))
            for p in pieces:
                block[p] = after[p][:, kept]
        orthogonal(block)
        qr(block)

    del after

    def frame(name: str, ids: np.ndarray, rows) -> DataFrame:
        out, most = None, max(1, SLICE_BYTES // (8 * len(s)))
        for first in range(0, len(ids), most):
            x = rows(slice(first, min(first + most, len(ids))))
            v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), np.ascontiguousarray(x).ravel())
            made = written(spark.createDataFrame(pa.table({name: pa.array(ids[first : first + most], pa.int64()), "v": v})), name)
            out = made if out is None else out.unionByName(made)
        return out

    if not left:
        removed(packed)
    right, of_rows = frame("col", cols, lambda p: spread(p, turn)), None
    if left:
        factor, sums = stored((n_cols, len(s))), stored((n_rows, len(s)))
        ids = np.sort(np.concatenate([np.frombuffer(r.row, "<i8") for r in packed.select("row").toLocalIterator()]))
        for a in range(0, n_cols, step):
            p = slice(a, min(a + step, n_cols))
            factor[p] = spread(p, turn * np.where(s > 1e-9, 1 / np.maximum(s, 1e-9), 0))
        for columns, parts in through(factor, False):
            for r in parts:
                sums[np.searchsorted(ids, np.frombuffer(r.row, "<i8")), columns[0] : columns[-1] + 1] = np.frombuffer(r.sums).reshape(-1, len(columns))
        of_rows = frame("row", ids, lambda p: sums[p])
        removed(packed)
    return of_rows, s, right


def _svd_joined(entries: DataFrame, k: int, rounds: int, seed: int, settled: float) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Products with the matrix are joins on the entries, and each round writes one table of k numbers for
    each column; the driver holds k x k matrices only."""
    start = [((F.xxhash64("col", F.lit(seed * 1000 + i)) % 2000003) / 2000003.0) for i in range(k)]
    right, s = entries.select("col").distinct().select("col", F.array(*start).alias("v")), np.zeros(k)

    def through(x: DataFrame, a: str, b: str) -> DataFrame:
        return _sum(entries.join(x, a).select(b, F.transform("v", lambda y: y * F.col("value")).alias("v")), b)

    for _ in range(rounds):
        product = written(through(through(right, "col", "row"), "row", "col"), "product")
        values, vectors = np.linalg.eigh(_gram(product, k))
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        scale = np.where(values > 1e-14 * max(values[0], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
        before, s = s, values**0.25  # the product is with the matrix and its transpose
        right = _times(product, "col", vectors * scale)
        if np.abs(s - before).max() <= settled * max(s.max(), 1e-300):
            break
    right = written(right, "right")
    left = _times(through(right, "col", "row"), "row", np.diag(np.where(s > 1e-9, 1 / np.maximum(s, 1e-9), 0)))
    return left, s, right


def user_centroids(watches: DataFrame, repo_vectors: DataFrame) -> DataFrame:
    """user_id and the normalised sum of the vectors (repo_id, v) of its repos."""
    total = _sum(watches.join(repo_vectors, "repo_id").select("user_id", "v"), "user_id")
    return total.select("user_id", F.transform("v", lambda x: xdiv(x, norm(F.col("v")))).alias("v"))


def kmeans(vectors: DataFrame, key: str, k: int = 200, rounds: int = 100, seed: int = 0) -> DataFrame:
    """key and cluster_id, by spherical k-means; vectors of norm 0 belong to no cluster."""
    rows = vectors.where(norm(F.col("v")) > 0).select(key, array_to_vector("v").alias("features"))
    model = KMeans(k=k, maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster_id"))


def assign(vectors: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """key and the cluster of largest dot product; centroids (cluster_id, c) are a list of a fixed length."""
    every = vectors.crossJoin(F.broadcast(centroids))
    return every.groupBy(key).agg(F.max(F.struct(dot(F.col("v"), F.col("c")).alias("d"), (-F.col("cluster_id")).alias("n"))).alias("x")).select(key, (-F.col("x.n")).alias("cluster_id"))


def centroids(vectors: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    total = _sum(vectors.join(clusters, key).select("cluster_id", "v"), "cluster_id")
    return total.select("cluster_id", F.transform("v", lambda x: xdiv(x, norm(F.col("v")))).alias("c"))


def cluster_members(clusters: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """cluster_id, key and its rank in the cluster by weight (key, weight)."""
    rows = clusters.join(weights, key, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("weight"), key)) - 1)


def nearest(vectors: DataFrame, probes: list[int], n: int = 20) -> DataFrame:
    """The n nearest repos (repo_id, v) by cosine of each of a few given ones."""
    p = F.broadcast(vectors.where(F.col("repo_id").isin(probes)).select(F.col("repo_id").alias("probe_id"), F.col("v").alias("p")))
    rows = vectors.crossJoin(p).where("repo_id <> probe_id")
    rows = rows.select("probe_id", "repo_id", xdiv(dot(F.col("v"), F.col("p")), norm(F.col("v")) * norm(F.col("p"))).alias("cosine"))
    k = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("cosine"), "repo_id"))
    return rows.withColumn("rank", k).where(F.col("rank") <= n)


def contrastive_pairs(watches: DataFrame, repos: DataFrame, negatives: int = 1, seed: int = 0) -> DataFrame:
    """user_id, repo_id, positive: every watch, and for each up to negatives repos that the user doesn't
    watch, drawn by a hash among all repos, so that a run gives the same ones again; a draw that is watched goes."""
    good = watches.select("user_id", "repo_id", F.lit(True).alias("positive"))
    if not negatives:
        return good
    ids = repos.select("repo_id").distinct()
    n = max(ids.count(), 1)
    # Dense numbers by buckets of a hash, so that no task orders all repos.
    parts = 1 + n // 100_000
    ids = ids.withColumn("part", F.pmod(F.xxhash64("repo_id"), F.lit(parts)))
    ahead = ids.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ids = ids.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("repo_id")) - 1).join(ahead, "part").select("repo_id", (F.col("k") + F.col("ahead")).alias("draw"))
    drawn = watches.select("user_id", "repo_id", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("i"))
    drawn = drawn.select("user_id", F.pmod(F.xxhash64("user_id", "repo_id", "i", F.lit(seed)), F.lit(n)).alias("draw")).join(ids, "draw").select("user_id", "repo_id").distinct()
    bad = drawn.join(watches, ["user_id", "repo_id"], "left_anti").withColumn("positive", F.lit(False))
    return good.unionByName(bad)


# Matrices as (row, col, value).
def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def times_vector(m: DataFrame, x: DataFrame) -> DataFrame:
    """row and value of m x, for x (col, x)."""
    return m.join(x, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def gram_times_vector(m: DataFrame, x: DataFrame) -> DataFrame:
    """col and value of mT m x."""
    y = times_vector(m, x).select("row", F.col("value").alias("y"))
    return m.join(y, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("y")).alias("value"))


def to_dense(m: DataFrame, n_cols: int) -> DataFrame:
    """row and its array of n_cols values."""
    at = F.map_from_entries(F.collect_list(F.struct("col", "value")))
    return m.groupBy("row").agg(at.alias("m")).select("row", F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("values"))


def to_sparse(m: DataFrame) -> DataFrame:
    return m.select("row", F.posexplode("values").alias("col", "value")).where("value <> 0").select("row", F.col("col").cast("long").alias("col"), "value")


# Learned scores. rows: label, weight and feature columns.
LEARNERS = {
    "glm": lambda: LogisticRegression(maxIter=50, regParam=1e-4),
    "boosted_trees": lambda: GBTClassifier(maxDepth=3, maxIter=50, featureSubsetStrategy="0.5", seed=1),
    "boosted_stumps": lambda: GBTClassifier(maxDepth=1, maxIter=50, seed=1),
    "bagged_trees": lambda: RandomForestClassifier(numTrees=20, maxDepth=6, seed=1),
    "tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=1),
}


def _features(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")


def fit(rows: DataFrame, names: list[str], learner: str = "glm") -> PipelineModel:
    rows = rows.fillna(-1.0, subset=names)
    if learner == "perceptron":
        return Pipeline(stages=[_features(names), MultilayerPerceptronClassifier(layers=[len(names), 50, 2], maxIter=50, seed=1)]).fit(rows)
    return Pipeline(stages=[_features(names), LEARNERS[learner]().setWeightCol("weight")]).fit(rows)


def fit_bagged(rows: DataFrame, names: list[str], bags: int = 5, learner: str = "boosted_trees") -> list[PipelineModel]:
    """Models of bootstrap samples, whose probabilities are averaged."""
    return [fit(rows.sample(withReplacement=True, fraction=1.0, seed=k), names, learner) for k in range(bags)]


def score(models: list[PipelineModel] | PipelineModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with score: the mean probability of class 1."""
    models = models if isinstance(models, list) else [models]
    out = rows.fillna(-1.0, subset=names)
    drop = ["features", "rawPrediction", "probability", "prediction"]
    for k, m in enumerate(models):
        out = m.transform(out).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop(*drop)
    mean = sum((F.col(f"_p{k}") for k in range(len(models))), F.lit(0.0)) / len(models)
    return out.withColumn("score", mean).drop(*(f"_p{k}" for k in range(len(models))))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def calibrate(rows: DataFrame, platt: bool = True):
    """A function from rows with score to rows with probability, fitted on score, label and weight."""
    if platt:
        model = Pipeline(stages=[VectorAssembler(inputCols=["score"], outputCol="_s"), LogisticRegression(featuresCol="_s", weightCol="weight", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_q")]).fit(rows)
        return lambda x: model.transform(x).withColumn("probability", vector_to_array("_p")[1]).drop("_s", "_p", "_r", "_q")
    iso = IsotonicRegression(featuresCol="score", weightCol="weight", predictionCol="probability").fit(rows.withColumn("label", F.col("label").cast("double")))
    return lambda x: iso.transform(x)


def rerank(models: list[PipelineModel] | PipelineModel, rows: DataFrame, names: list[str], second: list[PipelineModel] | PipelineModel, most: int = 200) -> DataFrame:
    """A second model over the first one's score, rank and percentile as three more features; 0 beyond rank most."""
    one = score(models, rows, names)
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("repo_id"))
    one = one.withColumn("first_rank", (F.row_number().over(order) - 1).cast("double")).withColumn("first_pct", F.col("first_rank") / F.count("*").over(Window.partitionBy("user_id"))).withColumnRenamed("score", "first_score")
    two = score(second, one, [*names, "first_score", "first_rank", "first_pct"])
    return two.withColumn("score", F.when(F.col("first_rank") < most, F.col("score")).otherwise(0.0))
