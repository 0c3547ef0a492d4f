"""The binary fact file: columnar relations of 32-bit numbers and interned strings.

Layout, all little-endian: four bytes that mark the kind of file (any are read), version, number of relations and
number of strings; for each relation 32 bytes (name's string id, tuples, columns,
64-bit offset, the rest unused); the relations' columns of 32-bit numbers, one
after another; then the strings, each with its length before it. String 0 is "".
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrylog.library.relations import RELATIONS, schema

# Fixed values of the format.
VERSION, ENTRY = 2, 32
MOST_RELATIONS, MOST_STRINGS, LONGEST_STRING = 1024, 1 << 24, 1 << 20


class FactFileError(ValueError):
    pass


def parse(data: bytes) -> dict[str, list]:
    """Relations as columns: numpy arrays of numbers, or lists of strings."""
    if len(data) < 16:
        raise FactFileError("not a fact file")
    version, relations, strings = struct.unpack_from("<III", data, 4)
    if version > VERSION:
        raise FactFileError(f"version {version} is newer than {VERSION}")
    if relations > MOST_RELATIONS or strings > MOST_STRINGS:
        raise FactFileError("too many relations or strings")
    entries, end = [], 16 + relations * ENTRY
    for i in range(relations):
        name, tuples, columns, offset = struct.unpack_from("<IIIQ", data, 16 + i * ENTRY)
        entries.append((name, tuples, columns, offset))
        end = max(end, offset + 4 * tuples * columns)
    table, at = [], end
    for _ in range(strings):
        (size,) = struct.unpack_from("<I", data, at)
        if size > LONGEST_STRING or at + 4 + size > len(data):
            raise FactFileError("a string reaches beyond the file")
        table.append(data[at + 4 : at + 4 + size].decode("utf-8", "replace"))
        at += 4 + size
    out = {}
    for name, tuples, columns, offset in entries:
        name = table[name]
        kinds = [k for _, k in RELATIONS.get(name, [])]
        cols = []
        for c in range(columns):
            start = offset + 4 * tuples * c
            raw = np.frombuffer(data, "<u4", tuples, start)
            if c < len(kinds) and kinds[c] == "str":
                if len(raw) and raw.max() >= len(table):
                    raise FactFileError(f"{name} refers to a string that is not there")
                cols.append([table[i] for i in raw])
            else:
                cols.append(raw.view("<i4").astype(np.int64))
        out[name] = cols
    return out


def encode(relations: dict[str, list[tuple]], mark: bytes = b"FACT") -> bytes:
    """A fact file of relations given as lists of tuples, with the given mark."""
    ids: dict[str, int] = {"": 0}
    intern = lambda s: ids.setdefault(s, len(ids))
    entries, body, at = [], [], 16 + ENTRY * len(relations)
    for name, rows in relations.items():
        kinds = [k for _, k in RELATIONS[name]]
        for r in rows:
            if len(r) != len(kinds):
                raise FactFileError(f"{name} has {len(kinds)} columns, not {len(r)}")
        cols = [np.array([intern(r[c]) if k == "str" else r[c] for r in rows], np.int64).astype(np.uint32).astype("<u4").tobytes() for c, k in enumerate(kinds)]
        entries.append(struct.pack("<IIIQ", intern(name), len(rows), len(kinds), at).ljust(ENTRY, b"\0"))
        body += cols
        at += sum(map(len, cols))
    strings = b"".join(struct.pack("<I", len(s.encode())) + s.encode() for s in ids)
    return mark + struct.pack("<III", VERSION, len(relations), len(ids)) + b"".join(entries) + b"".join(body) + strings


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The known relations of a fact file, read through Spark so that any store will do."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    out = {}
    for name, cols in parse(data).items():
        if name not in RELATIONS:
            continue
        table = pa.table({c: pa.array(v) for (c, _), v in zip(RELATIONS[name], cols, strict=True)})
        out[name] = spark.createDataFrame(table.to_pandas(), schema(name)) if table.num_rows else spark.createDataFrame([], schema(name))
    return out
