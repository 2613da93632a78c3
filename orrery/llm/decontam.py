"""Benchmark decontamination: hashed test n-grams, scanned over whole training texts, verified word by word.

The benchmark's windows are hashed and broadcast, in blocks of a bounded size: a benchmark
of more windows than one block holds is scanned block by block, and what the blocks found is put
together by document. A window is 10 consecutive words (ASCII letters lower-cased, words are runs of
digits, letters and anything beyond ASCII); an item of 1 to 9 words is one window.

Edge cases: null or empty text has no words and no hits; an item without words or without id has no
windows; equal items each count by their own id, repeated (id, text) rows once; a text that is one
huge word is one word; an empty benchmark contaminates nothing; an empty table gives an empty
result; other columns of either input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import arrow_map, cut

WIDTH = 10
#: UTF-8 bytes of benchmark text in one block; what is broadcast at once is at most nine times that, and 8 MB.
BLOCK_BYTES = 16 << 20

_SEPARATORS = bytes(i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122))
_TABLE = bytes(32 if i in _SEPARATORS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15) * (2 * np.arange(1, WIDTH + 1, dtype=np.uint64) + np.uint64(1))).astype(np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, as UTF-8. Bytes beyond ASCII belong to words, so bytes can be split as they are."""
    return (text or "").encode().translate(_TABLE).split()


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width values."""
    n = len(values) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += values[k : k + n] * _MULTIPLIERS[k]
        out ^= out >> np.uint64(29)
    return out


#: Bytes of text that are hashed at a time, at least.
CHUNK = 1 << 20
_LETTERS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[32] = 0
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _of_places(n: int) -> list[np.ndarray]:
    """What the letters of n places weigh, and how to take the weight of a word's first place from the word."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.full(n + 4096, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _hashed(flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of flat (letters and spaces) starts and ends, and a 64-bit hash of it."""
    parts, at = [], 0
    while at < len(flat):
        stop = flat.find(b" ", at + CHUNK)
        stop = len(flat) if stop < 0 else stop
        letters = np.frombuffer(flat, np.uint8, stop - at, at)
        edges = np.flatnonzero(np.diff(letters != 32, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            weight, back = _of_places(len(letters))
            total = np.cumsum(_LETTERS[letters] * weight[: len(letters)])[ends - 1]
            value = (total - np.concatenate((total[:1] * 0, total[:-1]))) * back[starts]
            value ^= value >> np.uint64(32)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            parts.append((starts + at, ends + at, value ^ (value >> np.uint64(29))))
        at = stop
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts)))


_FILTER = 22


def _bits(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER, bool)
    out[values >> np.uint64(64 - _FILTER)] = True
    return out


class Windows:
    """The windows of benchmark items as sorted 64-bit hashes, with the items' words as one run of bytes to verify hits.

    A word of the items takes 16 bytes beside its letters and one byte between (its window's hash, where
    that starts, and its offset), so a block of b bytes of text takes 9 b at most, and two filters of 4 MB.
    """

    def __init__(self, items: Iterable[tuple[object, str | None]]):
        self.ids: list[str] = []
        text, values, lengths, firsts = bytearray(), [], [], [0]
        starts: dict[int, list[np.ndarray]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item, raw in items:
            words = words_of(raw)
            if item is None or not words:
                continue
            self.ids.append(str(item))
            joined, width = b" ".join(words) + b" ", min(WIDTH, len(words))
            starts_, ends, own = _hashed(joined)
            hashes.setdefault(width, []).append(_rolled(own, width))
            starts.setdefault(width, []).append(np.arange(firsts[-1], firsts[-1] + len(words) - width + 1, dtype=np.uint32))
            text += joined
            lengths.append((ends - starts_).astype(np.uint32) + np.uint32(1))
            values.append(np.unique(own))
            firsts.append(firsts[-1] + len(words))
        self.text, self.firsts = bytes(text), np.array(firsts)
        self.at = np.cumsum(np.concatenate([np.zeros(1, np.uint32), *lengths]), dtype=np.uint32)
        self.known = _bits(np.concatenate(values)) if values else None
        self.by_width = {}
        for width in sorted(hashes):
            found, first = np.concatenate(hashes.pop(width)), np.concatenate(starts.pop(width))
            order = np.argsort(found, kind="stable")
            found = found[order]
            self.by_width[width] = (_bits(found), found, first[order])

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """The number of words, their spans [start, end) that lie in windows, merged, and the items with a window here."""
        flat = (text or "").encode().translate(_TABLE)
        starts, ends, values = _hashed(flat)
        if self.known is None or not len(values):
            return len(values), [], set()
        shift = np.uint64(64 - _FILTER)
        run = np.concatenate(([0], np.cumsum(self.known[values >> shift])))
        hits, items = [], set()
        for width, (bits, hashes, firsts) in self.by_width.items():
            if len(values) < width:
                continue
            full = np.flatnonzero(run[width:] - run[:-width] == width)  # windows of words that the items have
            if not len(full):
                continue
            at = _rolled(values, width)[full]
            passed = bits[at >> shift]
            full, at = full[passed], at[passed]
            low, high = np.searchsorted(hashes, at), np.searchsorted(hashes, at, "right")
            seen: dict[int, bytes] = {}  # of a window that comes again the items are known
            for i, h, a, b in zip(full.tolist(), at.tolist(), low.tolist(), high.tolist()):
                if a == b:
                    continue
                mine = b" ".join(flat[starts[i] : ends[i + width - 1]].split()) + b" "
                if seen.get(h) != mine:
                    first = firsts[a:b].astype(np.int64)
                    first = np.array([f for f in first.tolist() if self.text[self.at[f] : self.at[f + width]] == mine], np.int64)
                    if not len(first):
                        continue
                    seen[h] = mine
                    items.update(self.ids[k] for k in np.unique(np.searchsorted(self.firsts, first, "right") - 1).tolist())
                hits.append([i, i + width])
        return len(values), merged(hits), items


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping or touching spans become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


SCAN = "row_key string, doc_id long, n_words long, spans array<array<long>>, items array<string>"


def _sent(part: DataFrame) -> Broadcast:
    """The windows of a block, which every worker holds once."""
    windows = Windows((r[0], r[1]) for r in part.collect())  # at most block_bytes of text, or one item
    return part.sparkSession.sparkContext.broadcast(windows)


def _scanner(sent: Broadcast):
    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        windows = sent.value
        keys, ids, texts = b.column("row_key"), b.column("doc_id"), b.column("text").to_pylist()
        rows = [windows.scan(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [keys, ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))],
            ["row_key", "doc_id", "n_words", "spans", "items"],
        )

    return scan


def _together(b: pa.RecordBatch) -> pa.RecordBatch:
    """The spans and items of several blocks as one."""
    spans = [merged([x for one in found for x in one]) for found in b.column("spans").to_pylist()]
    items = [sorted({x for one in found for x in one}) for found in b.column("items").to_pylist()]
    cols = [b.column("row_key"), b.column("doc_id"), b.column("n_words"), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCAN.split(", ")])


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """Parts of items of about block_bytes of text each; one where all fit."""
    size = items.select(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n = int(size // block_bytes) + 1
    if n == 1:
        return [items]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == k) for k in range(n)]


def scan(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row_key, doc_id, n_words, spans (of words, merged), items of every row of docs (doc_id, text[, row_key])."""
    items = items.select("item_id", "text").distinct()
    key = F.col("row_key") if "row_key" in docs.columns else F.lit(None).cast("string").alias("row_key")
    parts = blocks(items, block_bytes)
    if len(parts) > 1:  # the rows of the blocks must meet again, also where ids repeat
        docs = cut(docs.select(F.uuid().alias("row_key"), "doc_id", "text"), "scan") if "row_key" not in docs.columns else docs
        key = F.col("row_key")
    docs = docs.select(key, "doc_id", "text")
    found = None
    for part in parts:
        one = arrow_map(docs, _scanner(_sent(part)), SCAN)
        found = one if found is None else found.unionByName(one)
    if len(parts) == 1:
        return found
    # A row for each block that found something, so a group has as many rows as there are blocks.
    grouped = found.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")
    )
    return arrow_map(grouped, _together, SCAN)


def contamination(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The digest of scan(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return scan(docs.select("doc_id", "text"), items, block_bytes).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _cutter(sent: Broadcast, drop_share: float):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        windows, out, keep = sent.value, [], []
        for t in b.column("text").to_pylist():
            n, spans, _ = windows.scan(t)
            keep.append(not spans or sum(e - s for s, e in spans) < drop_share * n)
            out.append(_without(t, spans) if spans and keep[-1] else t)
        cols = [pa.array(out, pa.string()) if n == "text" else b.column(n) for n in b.schema.names]
        return pa.RecordBatch.from_arrays(cols, b.schema.names).filter(pa.array(keep))

    return run


def _without(text: str, spans: list[list[int]]) -> str:
    """text without the words of spans and what stands between them."""
    raw = text.encode()
    flat = raw.translate(_TABLE)
    at, places = 0, []
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def _span_cutter(drop_share: float):
    """Cuts the spans that all blocks together found, which are the last column."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out, keep = [], []
        for t, spans in zip(b.column("text").to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            hit = sum(e - s for s, e in spans or ())
            keep.append(not spans or hit < drop_share * len(words_of(t)))
            out.append(_without(t, spans) if spans and keep[-1] else t)
        names = b.schema.names[:-1]
        cols = [pa.array(out, pa.string()) if n == "text" else b.column(n) for n in names]
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, drop_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with benchmark windows cut out of the text; a document of which drop_share of the words are
    hit goes altogether. Other columns stay as they are. Of a benchmark of several blocks, the spans of
    all are found on the whole text and put together by row before anything is cut. Null and empty texts, and
    those without a window, stay as they are; repeated rows are each cut; an empty benchmark changes nothing."""
    items = items.select("item_id", "text").distinct()
    if len(blocks(items, block_bytes)) == 1:
        return arrow_map(docs, _cutter(_sent(items), drop_share), docs.schema)
    key, spans = (f"_{x}_{uuid.uuid4().hex}" for x in ("row", "spans"))
    rows = cut(docs.withColumn(key, F.uuid()), "decontaminate")
    found = scan(rows.select(F.col(key).alias("row_key"), F.lit(None).cast("long").alias("doc_id"), "text"), items, block_bytes)
    found = found.where(F.size("spans") > 0).select(F.col("row_key").alias(key), F.col("spans").alias(spans))
    return arrow_map(rows.join(found, key, "left").select(*docs.columns, spans), _span_cutter(drop_share), docs.schema)


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> list[tuple]:
    """The plain definition, for tests."""
    wins = {}
    for i, t in items:
        w = words_of(t)
        if i is not None and w:
            k = min(WIDTH, len(w))
            for j in range(len(w) - k + 1):
                wins.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words_of(t), set(), set()
        for j in range(len(w)):
            for k in range(1, WIDTH + 1):
                if j + k <= len(w) and (found := wins.get(tuple(w[j : j + k]))):
                    hit.update(range(j, j + k))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
