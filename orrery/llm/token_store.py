"""Token ids in files of separately compressed documents under one shared zstandard dictionary.

A dictionary is trained on the serialised ids of a bounded sample of short documents (at most
DICTIONARY_DOCS rows and DICTIONARY_BYTES bytes of text; only the dictionary depends on the sample, every
document is written whole). Each document's ids, little-endian two-byte numbers, become one frame of
their own, so a single short document can be read by seeking to its frame.

A file: b"ZIDS1\\n", 8 bytes number of documents n, 8 bytes xxh64 of the dictionary, then n index
entries of 32 bytes (doc_id, offset of the frame in the frames' part, bytes of the frame, ids), then
the frames. Numbers are little-endian. The dictionary lies beside the files as "dictionary"; readers
refuse it if its hash differs. Files are written under a name of their attempt and then renamed, so a
repeated task leaves one whole file. Documents stand in ascending (doc_id, text) order over all files.

Edge cases: null or empty text is one document of the end id alone; rows without doc_id are refused by
no step, but carry the smallest number as id and are returned with null; repeated ids all stay, each
with its own frame; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import BATCH_ROWS, new_path, ship
from orrery.llm.tokens import encoder

MAGIC = b"ZIDS1\n"
ENTRY = struct.Struct("<qqqq")
END_ID = 1
NO_ID = -(1 << 63)
DICTIONARY_DOCS, DICTIONARY_BYTES, DICTIONARY_SIZE = 2_000, 8 << 20, 64 << 10
#: UTF-8 bytes of text that one file is meant to hold.
FILE_BYTES = 32 << 20


def train(samples: list[bytes]) -> bytes:
    """A dictionary from serialised ids; empty where there is too little to train on."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_SIZE, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Store:
    """Compresses and decompresses single documents under one dictionary."""

    def __init__(self, dictionary: bytes):
        self.hash = xxhash.xxh64_intdigest(dictionary)
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True, **shared).compress
        self.unpack = zstandard.ZstdDecompressor(**shared).decompress


def _fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, docs: list[tuple[int, int, bytes]], dictionary_hash: int) -> None:
    """docs: doc_id, number of ids, frame."""
    files, path = _fs(uri)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as out:
        out.write(MAGIC + struct.pack("<qQ", len(docs), dictionary_hash))
        at = 0
        for doc_id, n, frame in docs:
            out.write(ENTRY.pack(doc_id, at, len(frame), n))
            at += len(frame)
        for *_, frame in docs:
            out.write(frame)
    files.move(own, path)


class Reader:
    """One file, read by its index; ids(k) reads the k-th document's frame alone."""

    def __init__(self, uri: str, store: Store):
        files, path = _fs(uri)
        self.file = files.open_input_file(path)
        head = self.file.read(len(MAGIC) + 16)
        n, found = struct.unpack("<qQ", head[len(MAGIC) :])
        if head[: len(MAGIC)] != MAGIC or found != store.hash:
            raise ValueError(f"{uri} isn't a file under this dictionary")
        self.index = np.frombuffer(self.file.read(n * ENTRY.size), "<i8").reshape(n, 4)
        self.start, self.store = len(head) + n * ENTRY.size, store

    def ids(self, k: int) -> np.ndarray:
        _, at, size, _ = self.index[k]
        self.file.seek(self.start + int(at))
        return np.frombuffer(self.store.unpack(self.file.read(int(size))), "<u2")

    def close(self) -> None:
        self.file.close()


def _serialised(texts: list[str], tokenizer: str) -> list[bytes]:
    end = struct.pack("<H", END_ID)
    return [x + end for x in encoder(tokenizer).ids([t or "" for t in texts])]


def write(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", folder: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Writes docs (doc_id, text) as files of about file_bytes in folder (by default a new one in the shared folder) and returns it."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-store")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = docs.where(F.octet_length("text") <= DICTIONARY_BYTES // DICTIONARY_DOCS).select("text").limit(DICTIONARY_DOCS)
    sample = [r[0] for r in short.collect()]
    dictionary = train(_serialised(sample, tokenizer)) if sample else b""
    files, path = _fs(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/dictionary") as out:
        out.write(dictionary)
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0

    def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, part, n = Store(dictionary), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:08d}-{n:06d}.zids"
            write_file(f"{folder}/{name}", held, store.hash)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([n]), pa.array([name]), pa.array([len(held)]), pa.array([sum(x[1] for x in held)])], ["part", "piece", "name", "n_docs", "n_ids"]
            )

        for b in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            ids = [NO_ID if i is None else i for i in b.column("doc_id").to_pylist()]
            for doc_id, raw in zip(ids, _serialised(b.column("text").to_pylist(), tokenizer)):
                frame = store.pack(raw)
                held.append((doc_id, len(raw) // 2, frame))
                size += len(frame)
            if size >= file_bytes:
                yield flush()
                held, size, n = [], 0, n + 1
        if held:
            yield flush()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // file_bytes) + 1)
    placed = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ship(spark)
    placed.mapInArrow(to_files, "part long, piece long, name string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    files, path = _fs(folder)
    with files.open_input_file(f"{path}/dictionary") as f:
        dictionary = f.read()
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    width = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count()))

    def documents(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        store = Store(dictionary)
        for name, first in zip(b.column("name").to_pylist(), b.column("first").to_pylist()):
            file = Reader(f"{folder}/{name}", store)
            n = file.index[:, 3]
            start = first + np.cumsum(n) - n
            crc = [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(len(n))]
            file.close()
            ids = file.index[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from documents(b)

    return placed.repartition(width, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, name: str, doc_id: int) -> list[np.ndarray]:
    """The ids of a single document of a file, reading its frames alone."""
    files, path = _fs(folder)
    with files.open_input_file(f"{path}/dictionary") as f:
        store = Store(f.read())
    file = Reader(f"{folder}/{name}", store)
    out = [file.ids(k) for k in np.flatnonzero(file.index[:, 0] == doc_id).tolist()]
    file.close()
    return out
