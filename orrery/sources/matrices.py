"""Matrix files as (row, col, value): sparse text (st), sparse text Harwell-Boeing (sth), sparse binary
(sb), dense text (dt), dense binary (db). A matrix file has a header and counts that span the whole
file, so a file is read by one task; many files are read in parallel. Binary numbers are big-endian,
32-bit integers and floats.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, n_rows long, n_cols long, row long, col long, value double"
FORMATS = ("sth", "st", "sb", "dt", "db")


def decode(data: bytes, kind: str) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, cols, row, col, value) of a file's bytes."""
    if kind == "dt":
        words = data.split()
        r, c = int(words[0]), int(words[1])
        m = np.array(words[2 : 2 + r * c], float).reshape(r, c)
    elif kind == "db":
        r, c = struct.unpack(">ii", data[:8])
        m = np.frombuffer(data, ">f4", r * c, 8).reshape(r, c).astype(float)
    if kind in ("dt", "db"):
        row, col = np.nonzero(m)
        return r, c, row, col, m[row, col]
    if kind == "st":
        words = data.split()
        r, c, n = map(int, words[:3])
        at, rows, cols, values = 3, [], [], []
        for j in range(c):
            k = int(words[at])
            rows += map(int, words[at + 1 : at + 1 + 2 * k : 2])
            values += map(float, words[at + 2 : at + 2 + 2 * k : 2])
            cols += [j] * k
            at += 1 + 2 * k
        return r, c, np.array(rows, int), np.array(cols, int), np.array(values, float)
    if kind == "sb":
        r, c, n = struct.unpack(">iii", data[:12])
        at, rows, cols, values = 12, [], [], []
        for j in range(c):
            (k,) = struct.unpack_from(">i", data, at)
            pairs = np.frombuffer(data, np.dtype([("r", ">i4"), ("v", ">f4")]), k, at + 4)
            rows += pairs["r"].tolist()
            values += pairs["v"].astype(float).tolist()
            cols += [j] * k
            at += 4 + 8 * k
        return r, c, np.array(rows, int), np.array(cols, int), np.array(values, float)
    if kind == "sth":
        lines = data.decode().split("\n")
        r, c, n = map(int, lines[2].split()[1:4])
        words = " ".join(lines[4:]).split()
        starts = np.array(words[: c + 1], int) - 1
        row = np.array(words[c + 1 : c + 1 + n], int) - 1
        value = np.array(words[c + 1 + n : c + 1 + 2 * n], float)
        return r, c, row, np.repeat(np.arange(c), np.diff(starts)), value
    raise ValueError(f"no matrix format is named {kind!r}; there are {', '.join(FORMATS)}")


def encode(n_rows: int, n_cols: int, row: np.ndarray, col: np.ndarray, value: np.ndarray, kind: str) -> bytes:
    """The bytes of a file that decode() reads back."""
    order = np.lexsort((row, col))
    row, col, value = np.asarray(row)[order], np.asarray(col)[order], np.asarray(value, float)[order]
    if kind in ("dt", "db"):
        m = np.zeros((n_rows, n_cols))
        m[row, col] = value
        if kind == "dt":
            return (f"{n_rows} {n_cols}\n" + "".join(" ".join(f"{x:g}" for x in line) + "\n" for line in m)).encode()
        return struct.pack(">ii", n_rows, n_cols) + m.astype(">f4").tobytes()
    count = np.bincount(col, minlength=n_cols) if len(col) else np.zeros(n_cols, int)
    ends = np.cumsum(count)
    if kind == "st":
        out = [f"{n_rows} {n_cols} {len(value)}\n"]
        for j in range(n_cols):
            part = range(ends[j] - count[j], ends[j])
            out.append(f"{count[j]}\n" + "".join(f"{row[k]} {value[k]:g}\n" for k in part))
        return "".join(out).encode()
    if kind == "sb":
        out = [struct.pack(">iii", n_rows, n_cols, len(value))]
        for j in range(n_cols):
            part = slice(ends[j] - count[j], ends[j])
            pairs = np.zeros(count[j], np.dtype([("r", ">i4"), ("v", ">f4")]))
            pairs["r"], pairs["v"] = row[part], value[part]
            out.append(struct.pack(">i", count[j]) + pairs.tobytes())
        return b"".join(out)
    if kind == "sth":
        head = f"matrix\n#\nrra {n_rows} {n_cols} {len(value)} 0\n(10i8) (10i8) (8f10.3) (8f10.3)\n"
        numbers = [" ".join(map(str, np.concatenate(([1], ends + 1)))), " ".join(map(str, row + 1)), " ".join(f"{x:g}" for x in value)]
        return (head + "\n".join(numbers) + "\n").encode()
    raise ValueError(f"no matrix format is named {kind!r}; there are {', '.join(FORMATS)}")


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for p, content in zip(b.path, b.content):
                r, c, row, col, value = decode(bytes(content), kind)
                yield pd.DataFrame({"path": p, "n_rows": r, "n_cols": c, "row": row, "col": col, "value": value})

    return files.mapInPandas(run, SCHEMA)
