"""Tables of immutable files under numbered versions.

A table is a folder with ``data`` (files that never change), ``index`` (one row per
file: its key range and a Bloom filter of its keys) and ``versions`` (one small JSON
manifest per version).  A commit writes files first and then creates the manifest of
the next number in one step that fails if the number is taken.  A reader takes the
highest manifest and its list of files, so it sees one version as a whole, and goes
on seeing it while others commit.  Of two writers that start from the same version
one gets ``Conflict`` and may try again on top of the other.

An upsert rewrites only files that may hold one of the keys; all others are named in
the new manifest as they are.
"""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.operators.audits import expectations, require
from stockloom.operators.validation import latest_per_key
from stockloom.session import materialize, ship_package

BITS_PER_KEY = 10
_HASHES = 6
# Filters of more bytes than this are not sent to the tasks; ranges alone decide then.
FILTER_BYTES = 64 << 20


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to write."""


@dataclass(frozen=True)
class Snapshot:
    """One version: its number, column types, files below the table's folder and their index parts."""

    version: int
    schema: dict
    keys: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)

    @property
    def columns(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)


class _Files:
    """The file system of a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        if not self.fs.exists(where):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Create a whole file in one step; ``Conflict`` if it is there already."""
        draft = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getScheme() == "file":
                # A link fails where a local rename would replace the other file.
                self._link(draft, name)
            else:
                self._rename(draft, name)
        finally:
            self.fs.delete(self._path(draft), False)

    def _link(self, draft: str, name: str) -> None:
        source, target = (self._path(n).toUri().getPath() for n in (draft, name))
        try:
            os.link(source, target)
        except FileExistsError:
            raise Conflict(name) from None

    def _rename(self, draft: str, name: str) -> None:
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        options[0] = kind.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        try:
            context.rename(self._path(draft), self._path(name), options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(name) from None
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all committed versions."""
    return [int(n.removesuffix(".json")) for n in _Files(spark, path).names("versions") if not n.startswith(".")]


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """A version of the table, the newest unless told otherwise; None before the first."""
    files = _Files(spark, path)
    known = versions(spark, path)
    if not known:
        return None
    return Snapshot(**json.loads(files.read(f"versions/{known[-1] if version is None else version:020d}.json")))


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of one version; later commits do not change what this reads."""
    found = snapshot(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no version in {path}")
    return _read(spark, path, found, found.files)


def _read(spark: SparkSession, path: str, found: Snapshot, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], found.columns)
    return spark.read.schema(found.columns).parquet(*[f"{path.rstrip('/')}/{f}" for f in files])


def commit(spark: SparkSession, path: str, parent: Snapshot | None, new: Snapshot) -> Snapshot:
    """Make ``new`` the version after ``parent``; ``Conflict`` if another writer was first."""
    number = 1 if parent is None else parent.version + 1
    done = Snapshot(number, new.schema, new.keys, new.files, new.indexes)
    _Files(spark, path).create(f"versions/{number:020d}.json", json.dumps(done.__dict__))
    return done


def _write(df: DataFrame, path: str, keys: list[str]) -> tuple[list[str], list[str]]:
    """New files of the table, and the index part that describes them if there are keys."""
    spark, part = df.sparkSession, uuid.uuid4().hex
    rows = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys) if keys else df
    rows.write.parquet(f"{path.rstrip('/')}/data/{part}")
    files = [f"data/{part}/{n}" for n in _Files(spark, path).names(f"data/{part}") if n.endswith(".parquet")]
    if not keys or not files:
        return files, []
    stored = spark.read.schema(df.schema).parquet(f"{path.rstrip('/')}/data/{part}")
    _file_index(stored, part, keys).write.parquet(f"{path.rstrip('/')}/index/{part}")
    return files, [f"index/{part}"]


def publish_snapshot(
    df: DataFrame, path: str, checks: dict[str, tuple[Column, float]] | None = None, keys: list[str] | None = None
) -> Snapshot:
    """Replace the table by ``df`` in one step, after its checks have passed on what was written.

    With ``keys`` the files are cut by key range and indexed, for ``upsert_snapshot``.
    """
    spark, keys = df.sparkSession, list(keys or [])
    before = snapshot(spark, path)
    files, indexes = _write(df, path, keys)
    new = Snapshot(0, json.loads(df.schema.json()), keys, files, indexes)
    if checks:
        require(expectations(_read(spark, path, new, files), checks))
    return commit(spark, path, before, new)


# ---- upsert of the files that may hold a key ------------------------------------


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for k in range(_HASHES):
        yield (_mix(hashes + np.uint64(k)) % np.uint64(size)).astype(np.int64)


def _file_index(stored: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """(file, rows, low, high, filter) of the files of one commit.

    Rows with a null in a key are in no range and no filter: they equal no key.
    """
    spark = stored.sparkSession
    ship_package(spark)
    file = F.concat(F.lit(f"data/{part}/"), F.element_at(F.split("_metadata.file_path", "/"), -1))
    known = stored.select(file.alias("file"), *keys).dropna(subset=keys)
    key = F.struct(*keys)
    ranges = known.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
    ranges = materialize(ranges)
    # One row per file of this commit.
    sizes = {r["file"]: max(64, r["rows"] * BITS_PER_KEY) for r in ranges.select("file", "rows").toLocalIterator()}
    shared = spark.sparkContext.broadcast(sizes)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            hashes = batch.column(1).to_numpy().view(np.uint64)
            for name in set(names.tolist()):
                size = shared.value[name]
                bits = filters.setdefault(name, np.zeros((size + 7) // 8, dtype=np.uint8))
                for at in _bits(hashes[names == name], size):
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if filters:
            yield pa.RecordBatch.from_pydict({"file": list(filters), "filter": [f.tobytes() for f in filters.values()]})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [
                np.bitwise_or.reduce([np.frombuffer(p, dtype=np.uint8) for p in parts]).tobytes() for parts in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"of": batch.column(0).to_pylist(), "filter": whole})

    parts = known.select("file", _key_hash(keys)).mapInArrow(fill, "file string, filter binary")
    # A file is read by a few tasks at most, so a few parts come together.
    filters = parts.groupBy("file").agg(F.collect_list("filter").alias("parts")).mapInArrow(join, "of string, filter binary")
    return ranges.join(filters, F.col("file") == F.col("of")).select("file", "rows", "low", "high", "filter")


class _Ranges:
    """Files by key range; ``holding(key)`` gives those whose range holds the key."""

    def __init__(self, rows: list[tuple[str, tuple, tuple]]):
        self.rows = sorted(rows, key=lambda r: r[1])
        self.lows = [r[1] for r in self.rows]
        self.tops = []
        for _, _, high in self.rows:
            self.tops.append(high if not self.tops or high > self.tops[-1] else self.tops[-1])

    def holding(self, key: tuple) -> Iterator[str]:
        for k in range(bisect_right(self.lows, key) - 1, -1, -1):
            if self.tops[k] < key:  # no file before this one reaches the key
                return
            if self.rows[k][2] >= key:
                yield self.rows[k][0]


def _files_with(spark: SparkSession, wanted: DataFrame, keys: list[str], ranges: _Ranges, filters: dict[str, tuple[bytes, int]]) -> set[str]:
    """The files that may hold one of the keys in ``wanted``."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast((ranges, filters))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, filters = shared.value
        found: set[str] = set()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            hashes = np.array(columns.pop(), dtype=np.int64).view(np.uint64)
            candidates: dict[str, list[int]] = {}
            for k, key in enumerate(zip(*columns)):
                for name in ranges.holding(key):
                    if name not in found:
                        candidates.setdefault(name, []).append(k)
            for name, rows in candidates.items():
                if name not in filters:
                    found.add(name)
                    continue
                data, size = filters[name]
                bits, there = np.frombuffer(data, dtype=np.uint8), np.ones(len(rows), dtype=bool)
                for at in _bits(hashes[rows], size):
                    there &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                if there.any():
                    found.add(name)
        if found:
            yield pa.RecordBatch.from_pydict({"file": sorted(found)})

    rows = wanted.select(*keys, _key_hash(keys)).dropna(subset=keys).mapInArrow(look, "file string")
    return {r["file"] for r in rows.distinct().collect()}  # names of files, as in the manifest


def touched_files(
    spark: SparkSession, path: str, found: Snapshot, wanted: DataFrame, filter_bytes: int = FILTER_BYTES
) -> set[str]:
    """The files of a version that may hold one of the keys in ``wanted``."""
    if not found.indexes:
        return set(found.files)
    keys, live = found.keys, F.broadcast(spark.createDataFrame([(f,) for f in found.files], "live string"))
    index = spark.read.parquet(*[f"{path.rstrip('/')}/{part}" for part in found.indexes])
    index = index.join(live, F.col("file") == F.col("live"), "left_semi")
    rows = [(r["file"], tuple(r["low"]), tuple(r["high"])) for r in index.select("file", "low", "high").toLocalIterator()]
    near = _files_with(spark, wanted, keys, _Ranges(rows), {})
    if not near:
        return near
    chosen = F.broadcast(spark.createDataFrame([(f,) for f in sorted(near)], "near string"))
    index = index.join(chosen, F.col("file") == F.col("near"), "left_semi")
    if (index.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) > filter_bytes:
        return near
    filters = {r["file"]: (bytes(r["filter"]), max(64, r["rows"] * BITS_PER_KEY)) for r in index.select("file", "rows", "filter").toLocalIterator()}
    return _files_with(spark, wanted, keys, _Ranges([r for r in rows if r[0] in near]), filters)


def upsert_snapshot(
    path: str, updates: DataFrame, order: str, attempts: int = 5, filter_bytes: int = FILTER_BYTES
) -> Snapshot:
    """Replace or add rows by the table's keys; of several updates of a key the latest wins.

    Files that cannot hold an updated key stay as they are.  Rows with a null in a key
    replace nothing and are added.  A conflict with another writer is tried again on
    top of what that one has written.
    """
    spark = updates.sparkSession
    latest = None
    for attempt in range(attempts):
        found = snapshot(spark, path)
        if found is None or not found.keys:
            raise ValueError(f"{path} is no table with keys")
        if latest is None:
            latest = materialize(latest_per_key(updates, found.keys, order).select(*found.columns.fieldNames()))
        touched = touched_files(spark, path, found, latest, filter_bytes)
        old = _read(spark, path, found, [f for f in found.files if f in touched])
        rows = old.join(latest.select(*found.keys), found.keys, "left_anti").unionByName(latest)
        files, indexes = _write(rows.select(*found.columns.fieldNames()), path, found.keys)
        kept = [f for f in found.files if f not in touched]
        try:
            return commit(spark, path, found, Snapshot(0, found.schema, found.keys, kept + files, found.indexes + indexes))
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise AssertionError("unreachable")


def update_snapshot(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> Snapshot:
    """Replace the table by ``change`` of its rows, on top of whatever others commit meanwhile."""
    for attempt in range(attempts):
        found = snapshot(spark, path)
        if found is None:
            raise FileNotFoundError(f"no version in {path}")
        files, indexes = _write(change(_read(spark, path, found, found.files)), path, found.keys)
        try:
            return commit(spark, path, found, Snapshot(0, found.schema, found.keys, files, indexes))
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise AssertionError("unreachable")


def remove_unused(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete versions before the newest ``keep`` and folders of files that no kept version names.

    Only for times without writers: files of a commit under way are in no version yet.
    """
    files, known = _Files(spark, path), versions(spark, path)
    for number in known[:-keep]:
        files.delete(f"versions/{number:020d}.json")
    used = {f.rpartition("/")[0] for n in known[-keep:] for f in snapshot(spark, path, n).files}
    parts = {i for n in known[-keep:] for i in snapshot(spark, path, n).indexes if f"data/{i.rpartition('/')[2]}" in used}
    gone = [f"data/{n}" for n in files.names("data") if f"data/{n}" not in used]
    gone += [f"index/{n}" for n in files.names("index") if f"index/{n}" not in parts and f"data/{n}" not in used]
    for name in gone:
        files.delete(name)
    return gone
