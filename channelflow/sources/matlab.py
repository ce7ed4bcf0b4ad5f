"""Matrices of level-5 MAT files: tagged elements, of which deflated ones are unpacked and numeric ones of two dimensions read. A file is one value of Spark's binary reader."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ROWS_A_BATCH = 1 << 13
# Number formats by data type, and the matrix classes that hold numbers.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
NUMERIC = range(6, 16)
MATRIX, DEFLATED = 14, 15
COMPLEX = 0x0800


def elements(raw: memoryview, order: str, padded: bool = True) -> Iterator[tuple[int, memoryview]]:
    """(type, content) of the elements that stand one after another; content of up to four bytes may stand within the tag."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        if at + 8 + size > len(raw):
            raise ValueError("an element is cut off")
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size
        if padded and kind != DEFLATED:
            at += -size % 8


def numbers(kind: int, content: memoryview, order: str) -> np.ndarray:
    return np.frombuffer(content, dtype=order + TYPES[kind])


def matrix(content: memoryview, order: str) -> tuple[str, np.ndarray] | None:
    """Name and values of a matrix element; None if it isn't numeric, real and of two dimensions."""
    parts = list(elements(content, order))
    if len(parts) < 4:
        return None
    flags = int(numbers(*parts[0], order)[0])
    shape = numbers(*parts[1], order)
    name = bytes(parts[2][1]).decode("ascii", "replace")
    if flags & 0xFF not in NUMERIC or flags & COMPLEX or len(shape) != 2 or parts[3][0] not in TYPES:
        return None
    return name, numbers(*parts[3], order).astype(np.float64).reshape(tuple(shape), order="F")


def matrices(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """The matrices of a whole file. A file of another version (such as the hierarchical one) is an error."""
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("no MAT file of level 5")
    order = "<" if raw[126:128] == b"IM" else ">"
    if struct.unpack(order + "H", raw[124:126])[0] >> 8 != 1:
        raise ValueError("a MAT file of another version than level 5")
    for kind, content in elements(memoryview(raw)[128:], order):
        inner = elements(memoryview(zlib.decompress(content)), order) if kind == DEFLATED else [(kind, content)]
        for own, part in inner:
            found = matrix(part, order) if own == MATRIX else None
            if found is not None:
                yield found


def read_mat(spark: SparkSession, path: str, tasks: list[str] | None = None, channels_first: bool | None = True) -> DataFrame:
    """{subject}.mat files as (subject, task, t, v): each numeric variable of two dimensions is a task; names that begin with two underscores aren't.

    Matrices are channels x times (or, by choice, times x channels; None: times are the longer side). Texts, cells, structures, complex and sparse matrices are left out. Variables given in tasks that a file lacks are an error. A file has 2 GB at most.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mat").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                subject, met = where.rsplit("/", 1)[-1].rsplit(".", 1)[0], set()
                for name, x in matrices(content):
                    if name.startswith("__") or tasks is not None and name not in tasks:
                        continue
                    met.add(name)
                    x = x.T if channels_first or channels_first is None and x.shape[0] <= x.shape[1] else x
                    for at in range(0, len(x), ROWS_A_BATCH):
                        part = x[at : at + ROWS_A_BATCH]
                        yield pd.DataFrame({"subject": subject, "task": name, "t": np.arange(at, at + len(part)), "v": list(part)})
                missing = sorted(set(tasks or ()) - met)
                if missing:
                    raise ValueError(f"no such task: {', '.join(missing)} of {subject}")

    return files.mapInPandas(run, "subject string, task string, t long, v array<double>")


def mat_bytes(variables: dict[str, np.ndarray], deflate: bool = True, order: str = "<") -> bytes:
    """A level-5 file of double matrices."""

    def element(kind: int, content: bytes) -> bytes:
        return struct.pack(order + "II", kind, len(content)) + content + b"\0" * (-len(content) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, x in variables.items():
        x = np.asarray(x, dtype=float)
        parts = element(6, struct.pack(order + "II", 6, 0)) + element(5, struct.pack(order + "ii", *x.shape)) + element(1, name.encode("ascii"))
        whole = element(MATRIX, parts + element(9, x.astype(order + "f8").tobytes(order="F")))
        packed = zlib.compress(whole) if deflate else b""
        out += struct.pack(order + "II", DEFLATED, len(packed)) + packed if deflate else whole
    return out
