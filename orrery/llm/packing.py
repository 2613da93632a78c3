"""Packing documents into as few fixed-size sequences as can be: bin completion on counts of lengths.

Only the number of pieces of each length matters to a packing, so a plan is made on the driver from at
most CAPACITY counts, whatever the corpus: a list of fillings, each with how many sequences have it.
Branch and bound takes the longest piece left, enumerates fillings of the rest of its sequence that no
other dominates (no piece left fits into what they leave, nor in place of one or two shorter ones), tries
those of least waste first and gives up a branch once its waste rules out a plan better than the best so
far. Best-fit decreasing gives the first incumbent; a plan that meets the lower bound ends the search.
Search bounds how much is tried; EXACT lifts all bounds. Pieces then find their place by
their rank among those of equal length, which needs no task to hold more than a bounded group.

A document is its ids and an end id. One of up to CAPACITY ids is one piece; a longer one is cut into
pieces of CAPACITY, of which the first may be shorter.

Edge cases: null or empty text is a piece of the end id alone; repeated rows and equal ids are pieces
of their own; null ids stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import arrow_map, cut
from orrery.llm.tokens import REMEMBERED, encoder

CAPACITY, END_ID = 2048, 0

class Search(NamedTuple):
    """How much of the search is made; None is no bound. Each bound only ends the search early, with the best plan so far."""

    nodes: int | None = 20_000  # branches
    most: int | None = 6  # fillings kept at a level, those of least waste
    tries: int | None = 48  # lengths tried for a further piece
    deep: int | None = 2  # further pieces for which more than the largest that fits is tried
    at_once: bool = True  # a filling is used as often as its pieces last, not one sequence at a time


#: The whole search, which finds the fewest sequences: for small tables of lengths.
EXACT = Search(None, None, None, None, False)

#: Pieces of one length that are ranked together, about.
GROUP = 1_000

Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by volume, and by pieces of which no two fit together (Martello and Toth)."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for t in sorted({min(k, capacity - k) for k in counts} | {0}):
        if t > capacity // 2:
            break
        alone = sum(n for k, n in counts.items() if k > capacity - t)
        large = sum(n for k, n in counts.items() if capacity / 2 < k <= capacity - t)
        room = sum((capacity - k) * n for k, n in counts.items() if capacity / 2 < k <= capacity - t)
        small = sum(k * n for k, n in counts.items() if t <= k <= capacity / 2)
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, on whole groups of equal bins at a time."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    mask = 0
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            above = mask >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                at = open_[room]
                content, m = at.popitem()
                if m > n:
                    at[content] = m - n
                if not at:
                    mask &= ~(1 << room)
                content, m, left = (*content, size), min(m, n), room - size
            else:
                each = min(n, capacity // size)
                content, m, left = (size,) * each, n // each, capacity - size * each
            open_.setdefault(left, {})[content] = open_.get(left, {}).get(content, 0) + m
            mask |= 1 << left
            n -= m * (content.count(size) if not above else 1)
    return [(c, m) for at in open_.values() for c, m in at.items()]


class _Left:
    """Counts of lengths left, with the largest of at most a size found in a bit mask."""

    def __init__(self, counts: dict[int, int]):
        self.n = dict(counts)
        self.mask = sum(1 << k for k, v in counts.items() if v)

    def below(self, size: int) -> int:
        return (self.mask & ((1 << (size + 1)) - 1)).bit_length() - 1 if size > 0 else -1

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for k in filling:
            self.n[k] = self.n.get(k, 0) - times
            self.mask = self.mask | 1 << k if self.n[k] > 0 else self.mask & ~(1 << k)


def _dominated(taken: tuple[int, ...], room: int, left: _Left) -> bool:
    """Whether a piece that is left fits into room, or in place of one or two shorter ones but the first:
    any plan with this filling is then no worse with that one, and one with less waste or fewer pieces."""
    if 0 < left.below(room):
        return True
    rest = sorted(set(taken[1:]))
    for i, x in enumerate(rest):
        if left.below(x + room) > x:
            return True
        for y in rest[i:]:
            if (x != y or taken[1:].count(x) > 1) and left.below(x + y + room) >= x + y:
                return True
    return False


def fillings(left: _Left, first: int, capacity: int, search: Search = Search()) -> list[tuple[int, ...]]:
    """Fillings around a piece of length first, of least waste first, that no other dominates."""
    found: dict[tuple[int, ...], int] = {}
    exact = search.tries is None and search.deep is None

    def grow(taken: tuple[int, ...], room: int, deep: int) -> bool:
        k = taken[-1]
        left.n[k] -= 1
        if left.n[k] <= 0:
            left.mask &= ~(1 << k)
        try:
            size, n, more = left.below(min(room, k)), 0, search.deep is None or deep < search.deep
            if size <= 0:
                if not _dominated(taken, room, left):
                    found[taken] = room
                    return room == 0 and not exact
                return False
            while size > 0 and (search.tries is None or n < (search.tries if more else 1)):
                if grow((*taken, size), room - size, deep + 1):
                    return True
                if not exact and more and found and size * (room // size + 1) < room - min(found.values()):
                    break
                size, n = left.below(size - 1), n + 1
            return False
        finally:
            left.n[k] += 1
            left.mask |= 1 << k

    grow((first,), capacity - first, 0)
    if not found:  # of the bounded tries all were dominated: the largest that fits, always
        taken, room = (first,), capacity - first
        left.take((first,), 1)
        while (size := left.below(room)) > 0:
            left.take((size,), 1)
            taken, room = (*taken, size), room - size
        left.take(taken, -1)
        found[taken] = room
    return sorted(found, key=lambda f: (found[f], [-k for k in f]))[: search.most]


def plan(counts: dict[int, int], capacity: int = CAPACITY, search: Search = Search()) -> Plan:
    """Fillings and how many sequences have each; all pieces are placed once. With EXACT, as few as there can be."""
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    total, least = sum(k * n for k, n in counts.items()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bins = sum(m for _, m in best)
    left, done, waste, used, nodes = _Left(counts), [], 0, 0, 0
    stack: list[list] = []  # alternatives of each level, the next last
    while bins > least and (search.nodes is None or nodes < search.nodes):
        if left.mask == 0 and used < bins:
            bins, best = used, list(done)
        if left.mask and waste <= (bins - 1) * capacity - total:
            stack.append(fillings(left, left.mask.bit_length() - 1, capacity, search)[::-1])
        else:
            stack.append([])
        while stack and not stack[-1]:  # back to the last level with another way
            stack.pop()
            if stack:
                filling, m = done.pop()
                left.take(filling, -m)
                waste, used = waste - m * (capacity - sum(filling)), used - m
        if not stack:
            break
        filling = stack[-1].pop()
        m = min(left.n[k] // filling.count(k) for k in set(filling)) if search.at_once else 1
        left.take(filling, m)
        done.append((filling, m))
        waste, used, nodes = waste + m * (capacity - sum(filling)), used + m, nodes + 1
    return best


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _cutter(tokenizer: str, capacity: int, keep_ids: bool, remembered: int):
    end = struct.pack("<H", END_ID)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        texts = [t or "" for t in b.column("text").to_pylist()]
        for doc_id, raw in zip(b.column("doc_id").to_pylist(), encoder(tokenizer, remembered).ids(texts)):
            ids = np.frombuffer(raw + end, "<u2").astype("<u4")
            at, k = 0, 0
            while at < len(ids):
                size = (len(ids) - at) % capacity or capacity if at == 0 else capacity
                part = ids[at : at + size].tobytes()
                rows.append((doc_id, k, at, size, zlib.crc32(part), part if keep_ids else None))
                at, k = at + size, k + 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, keep_ids: bool = False, remembered: int = REMEMBERED, search: Search = Search(), group: int = GROUP) -> DataFrame:
    """Every piece of docs (doc_id, text) with its sequence_id and offset, and its ids (uint32) if keep_ids.

    remembered: how many stretches of text a worker keeps the ids of; fewer take less memory and more time.
    group: pieces of one length that are ranked together, about; the sequences don't depend on it.
    """
    spark = docs.sparkSession
    made = arrow_map(docs.select("doc_id", "text"), _cutter(tokenizer, capacity, keep_ids, remembered), PIECES)
    pieces = cut(made if keep_ids else made.drop("ids"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    intervals, sequence = [], 0
    used: dict[int, int] = {}
    for filling, times in plan(counts, capacity, search):
        offset = 0
        for size in filling:
            at = used.get(size, 0)
            intervals.append((size, at, at + times, sequence - at, offset))
            used[size], offset = at + times, offset + size
        sequence += times
    places = spark.createDataFrame(intervals, "length long, low long, high long, shift long, offset long")
    # Rank among equal lengths: within groups of about GROUP pieces, then moved by the groups before. A length
    # that many pieces share has many groups. The number of groups by length is a table of at most capacity rows.
    groups = spark.createDataFrame([(k, 1 + n // group) for k, n in counts.items()], "length long, groups long")
    pieces = pieces.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups"))).drop("groups")
    sizes = pieces.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead", "part")
    # The places are a few for each filling, so their number is bounded by the plan, not by the rows.
    near = F.broadcast(places) if len(intervals) <= 200_000 else places
    on = (ranked["length"] == near["length"]) & (ranked["rank"] >= near["low"]) & (ranked["rank"] < near["high"])
    joined = ranked.join(near, on).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset", *(["ids"] if keep_ids else [])
    )
    return joined


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (uint32, little-endian), from pack(..., keep_ids=True); a sequence has at most capacity pieces."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(inside, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
