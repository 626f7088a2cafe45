"""Keyed tables under versioned snapshots: one base, and the changes since.

    path/base-<id>/...            one row per key
    path/changes-<name>/...       rows in any number of versions, one folder per write
    path/_snapshots/<version>     the folders that make up the table, and its schema

Readers resolve the newest snapshot and read the folders it names; nothing else below ``path`` exists for them. A writer
first writes a folder, then publishes a snapshot that names it: a crash between the two leaves a folder that no reader
sees. Publishing renames a finished file to the next version and fails if another writer was first, who then
tries again. ``compact`` writes a new base and publishes it with the changes that came in the meantime.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.sources import tables
from matchloom.sources.files import Files

_FOLDER = "_snapshots"


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema: str | None
    base: str | None
    changes: tuple[str, ...]

    @property
    def folders(self) -> list[str]:
        return [*([self.base] if self.base else []), *self.changes]


def current(spark: SparkSession, path: str) -> Snapshot:
    """The newest published snapshot; version 0 without any."""
    versions = [int(n) for n in Files(spark, path).names(_FOLDER) if n.isdigit()]
    if not versions:
        return Snapshot(0, None, None, ())
    text = spark.read.text(f"{path.rstrip('/')}/{_FOLDER}/{max(versions):012d}", wholetext=True).first()[0]
    found = json.loads(text)
    return Snapshot(max(versions), found["schema"], found["base"], tuple(found["changes"]))


def publish(spark: SparkSession, path: str, after: Snapshot, new: Snapshot) -> bool:
    """Make ``new`` the version that follows ``after``; False if another writer was first."""
    data = json.dumps({"schema": new.schema, "base": new.base, "changes": list(new.changes)})
    return Files(spark, path).write_new(_FOLDER, f"{after.version + 1:012d}", data.encode())


def _write(df: DataFrame, path: str, folder: str, partition: Sequence[str]) -> None:
    writer = df.write.mode("overwrite")  # a folder that is not published yet may be left over from a lost run
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{path.rstrip('/')}/{folder}")


def _schema(df: DataFrame) -> str:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).json()


def create(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Start a table with ``df``, which has one row per key, as its base."""
    folder = f"base-{uuid.uuid4().hex}"
    _write(df, path, folder, partition)
    if not publish(df.sparkSession, path, Snapshot(0, None, None, ()), Snapshot(1, _schema(df), folder, ())):
        raise FileExistsError(f"there is a table at {path}")


def append(df: DataFrame, path: str, name: str | None = None, partition: Sequence[str] = ()) -> None:
    """Add the rows of ``df`` as changes. A write repeated under one ``name`` adds them once."""
    spark, folder = df.sparkSession, f"changes-{name or uuid.uuid4().hex}"
    if folder in current(spark, path).changes:
        return
    _write(df, path, folder, partition)
    while True:
        now = current(spark, path)
        if folder in now.changes:
            return
        if publish(spark, path, now, replace(now, schema=now.schema or _schema(df), changes=(*now.changes, folder))):
            return


def _folders(spark: SparkSession, path: str, snapshot: Snapshot, folders: Sequence[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(snapshot.schema))
    frames = [spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{f}").select(*schema.names) for f in folders]
    return reduce(DataFrame.unionByName, frames)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def read(
    spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], where: Column | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The latest row per key. Base rows whose key did not change pass as they are; only the others are merged.

    ``where`` (on key columns) is applied to every folder first, so that it prunes partitions; ``columns`` are those to
    read beside the keys (all of them if not given). ``order`` must tell the versions of a key apart.
    """
    snapshot = current(spark, path)
    if not snapshot.version:
        raise FileNotFoundError(f"no table at {path}")
    found = _merged(spark, path, snapshot, keys, order, where, columns)
    return found if columns is None else found.select(*keys, *columns)


def _merged(spark, path, snapshot, keys, order, where=None, columns=None) -> DataFrame:
    def folders(names):
        df = _folders(spark, path, snapshot, names)
        df = df if columns is None else df.select(*dict.fromkeys([*keys, *order, *columns]))
        return df if where is None else df.where(where)

    if not snapshot.changes:
        return folders([snapshot.base])
    changes = folders(snapshot.changes)
    if snapshot.base is None:
        return tables.latest(changes, keys, order)
    base, touched = folders([snapshot.base]), changes.select(*keys).distinct()
    same = _same(base, touched, keys)
    return base.join(touched, same, "left_anti").unionByName(
        tables.latest(base.join(touched, same, "left_semi").unionByName(changes), keys, order)
    )


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], partition: Sequence[str] = ()) -> bool:
    """Write the merged rows as a new base and publish it. False if another compaction was first."""
    start = current(spark, path)
    if not start.changes:
        return False
    folder = f"base-{uuid.uuid4().hex}"
    merged = _merged(spark, path, start, keys, order)
    if partition:  # a few files per partition, whatever tasks its rows come from
        merged = merged.repartition(*partition, F.pmod(F.xxhash64(*keys), F.lit(8)))
    _write(merged, path, folder, partition)
    while True:
        now = current(spark, path)
        if now.base != start.base or now.changes[: len(start.changes)] != start.changes:
            Files(spark, path).delete(folder)
            return False
        if publish(spark, path, now, replace(now, base=folder, changes=now.changes[len(start.changes) :])):
            return True


def clean(spark: SparkSession, path: str) -> list[str]:
    """Delete what the newest snapshot does not name, when neither readers of older ones nor writers are at work."""
    files, kept = Files(spark, path), set(current(spark, path).folders)
    gone = [n for n in files.names("") if n != _FOLDER and n not in kept]
    for name in gone:
        files.delete(name)
    return gone
