"""Sorted hash arrays in the shared folder, memory-mapped by workers.

A table maps 64-bit keys to numbers. It is cut into shards by the top bits of
the key; Spark sorts each shard, and its task writes the sorted keys and the
value arrays as plain files, under a temporary name first, so that a task which
runs again only replaces a file by its equal. Workers map the files and search
them; nothing is broadcast, and pages are read as they are touched.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import U64, cached


OPEN_FILES = 768  # files that a worker keeps mapped of one table


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write one file below a shared folder (a path or any URI that Arrow opens)."""
    place = urlparse(folder)
    if place.scheme in ("", "file"):
        os.makedirs(place.path, exist_ok=True)
        part = f"{place.path}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{place.path}/{name}")
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as f:
        f.write(data)


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """One file of a shared folder, mapped. Every shard of a table has its files, so a missing one is a lost one: it raises.

    Where the folder is no file system path, the worker maps a copy of its own, whose
    space is given back with the array.
    """
    place = urlparse(folder)
    if place.scheme in ("", "file"):
        path = f"{place.path}/{name}"
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=dtype)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with tempfile.NamedTemporaryFile(prefix="mapped-") as own:
        fs.copy_files(f"{path}/{name}", own.name, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        return np.memmap(own.name, dtype=dtype, mode="r") if os.path.getsize(own.name) else np.zeros(0, dtype=dtype)


class MappedFiles:
    """The arrays of a folder's shards; at most ``OPEN_FILES`` are mapped at a time, as each holds a file descriptor."""

    def __init__(self, folder: str):
        self.folder = folder
        self.open: dict[tuple[int, str], np.ndarray] = {}

    def get(self, shard: int, kind: str, dtype) -> np.ndarray:
        array = self.open.pop((shard, kind), None)
        if array is None:
            while len(self.open) >= OPEN_FILES:
                self.open.pop(next(iter(self.open)))  # the one that was used the longest ago
            array = map_array(self.folder, f"{shard:06d}.{kind}", dtype)
        self.open[shard, kind] = array
        return array


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def shard_bits(n_shards: int) -> int:
    return max(0, (max(1, n_shards) - 1).bit_length())


def shard_column(key: Column, bits: int) -> Column:
    """The shard of a 64-bit key: its top bits."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def shards_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def sorted_shards(df: DataFrame, key: Column, bits: int, then: list[str], handle: Callable[[int, pa.Table], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """Run ``handle(shard, rows)`` on every shard of ``df``, its rows in order of (key, *then); they gain a column ``key``.

    Keys are compared as signed numbers within a shard. The rows of one shard are
    in memory at a time; the caller chooses ``bits`` by the size of the input. A shard
    without rows is handled as well, so that each writes its files; a row of nulls stands
    for it on the way. The last column of ``df`` is never null.
    """
    last = df.columns[-1]
    least = F.shiftleft("id", 64 - bits) if bits else F.lit(-(1 << 63))
    every = df.sparkSession.range(1 << bits).select(least.cast("long").alias("key"))
    rows = df.withColumn("key", key).unionByName(every, allowMissingColumns=True)
    rows = rows.repartition(shard_column(F.col("key"), bits)).withColumn("__shard", shard_column(F.col("key"), bits)).sortWithinPartitions("__shard", "key", *then)

    def real(held: list[pa.RecordBatch]) -> pa.Table:
        """The rows of a shard without its row of nulls."""
        table = pa.Table.from_batches(held)
        at = pc.index(pc.is_null(table.column(last)), True).as_py()
        return pa.concat_tables([table.slice(0, at), table.slice(at + 1)])

    def run(batches: Iterator[pa.RecordBatch]):
        held, now = [], None
        for batch in batches:
            shard = batch.column("__shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if now is not None and shard[a] != now:
                    yield from handle(int(now), real(held))
                    held = []
                now = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from handle(int(now), real(held))

    return rows.mapInArrow(run, schema)


def unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(U64)


def write_table(df: DataFrame, folder: str, n_shards: int, key: str = "key", value: str = "value") -> int:
    """Write (key long, value long) with distinct keys; returns the number of keys."""

    def put(shard: int, rows: pa.Table):
        keys, values = unsigned(rows.column("key")), rows.column("value").to_numpy()
        order = np.argsort(keys, kind="stable")
        put_file(folder, f"{shard:06d}.key", keys[order].astype("<u8").tobytes())
        put_file(folder, f"{shard:06d}.value", values[order].astype("<i8").tobytes())
        return [pa.RecordBatch.from_pydict({"n": pa.array([len(keys)], pa.int64())})]

    done = sorted_shards(df.select(F.col(key).alias("key"), F.col(value).alias("value")), F.col("key"), shard_bits(n_shards), [], put, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class MappedTable:
    """Look-ups in a table written by ``write_table``."""

    def __init__(self, folder: str, n_shards: int):
        self.files, self.bits = MappedFiles(folder), shard_bits(n_shards)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 for keys that the table lacks."""
        out = np.full(len(keys), -1, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        shard = shards_of(keys[order], self.bits)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            s = int(shard[a])
            known, values = self.files.get(s, "key", "<u8"), self.files.get(s, "value", "<i8")
            if len(known):
                some = keys[order[a:b]]
                at = np.minimum(np.searchsorted(known, some), len(known) - 1)
                out[order[a:b]] = np.where(known[at] == some, values[at], -1)
        return out


def mapped_table(folder: str, n_shards: int) -> MappedTable:
    return cached(("mapped", folder), lambda: MappedTable(folder, n_shards))
