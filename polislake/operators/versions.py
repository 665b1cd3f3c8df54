"""Tables in versions that share their files.

A version is a manifest: for each cell of the table (a hash of its predicate, a bucket of its rows) the folders that hold it. Adding rows reads the cells that they fall in, writes
those that are not there yet to a new folder and commits a manifest that names it beside the old ones; cells with many folders are merged. Readers see a version once its manifest is there. A
batch of a stream is named in the manifest that adds it, so a batch that is run again changes nothing.

root/data/u=<folder>/pk=<hash>/bucket=<n>/, root/versions/v<number>.json. The buckets are fixed when a table is made; rows are dealt to them by all that identifies them, so one subject
does not make one bucket hot."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import TRIPLE_COLUMNS, TRIPLE_SCHEMA
from ..sources.store import drop, written

#: Folders that a cell may be spread over before it is merged.
MOST_FOLDERS = 8
#: A cell is written by a task for each so many rows of a change, so that large cells do not make few tasks long.
FILE_ROWS = 4_000_000


@dataclass(frozen=True)
class Layout:
    schema: str
    identity: tuple[str, ...]  # columns that tell rows apart
    part: str | None = None  # the column that readers filter by


TRIPLES = Layout(TRIPLE_SCHEMA, TRIPLE_COLUMNS, "p")
IDS = Layout("id string", ("id",))


class Versions:
    def __init__(self, spark: SparkSession, root: str, layout: Layout = TRIPLES, buckets: int = 32) -> None:
        self.spark, self.root, self.layout, self.buckets = spark, root.rstrip("/"), layout, buckets
        self.columns = [c.split()[0] for c in layout.schema.split(", ")]

    # Manifests
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def numbers(self) -> list[int]:
        """Versions, oldest first."""
        return sorted(int(n[1:-5]) for n in self._names(f"{self.root}/versions") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest; the last one that is whole unless named. An empty one before the first."""
        for n in [version] if version is not None else reversed(self.numbers()):
            text = self.spark.read.text(f"{self.root}/versions/v{n:010d}.json", wholetext=True).first()
            try:
                return json.loads(text[0])
            except (TypeError, ValueError):  # a writer ended within it
                continue
        return {"version": 0, "rows": 0, "buckets": self.buckets, "cells": {}, "folders": {}, "applied": {}}

    def _commit(self, manifest: dict) -> dict:
        manifest["version"] = max([manifest["version"], *self.numbers()]) + 1
        p, fs = self._fs(f"{self.root}/versions/v{manifest['version']:010d}.json")
        out = fs.create(p, False)  # fails if another writer was first
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return manifest

    # Cells
    def _placed(self, df: DataFrame, buckets: int) -> DataFrame:
        key = F.substring(F.md5(F.coalesce(F.col(self.layout.part).cast("string"), F.lit(""))), 1, 16) if self.layout.part else F.lit("all")
        return df.select(*self.columns, key.alias("pk"), F.pmod(F.xxhash64(*self.layout.identity), F.lit(buckets)).cast("int").alias("bucket"))

    def _paths(self, manifest: dict, cells: set[str]) -> list[str]:
        """Folders where all they hold is wanted, cells of the others."""
        wanted: dict[str, list[str]] = {}
        for cell in cells & manifest["cells"].keys():
            for folder in manifest["cells"][cell]:
                wanted.setdefault(folder, []).append(cell)
        at = lambda f: f"{self.root}/data/u={f}"
        return sorted(x for f, own in wanted.items() for x in ([at(f)] if len(own) == manifest["folders"][f] else [f"{at(f)}/{c}" for c in own]))

    def _cells(self, manifest: dict, cells: set[str]) -> DataFrame:
        paths = self._paths(manifest, cells)
        schema = f"{self.layout.schema}, u string, pk string, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.root}/data").schema(schema).parquet(*paths)

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """The rows of a version; only the cells of `parts` (values of the layout's part) if given."""
        m = self.manifest(version)
        own = None if parts is None else {f"pk={hashlib.md5(x.encode()).hexdigest()[:16]}" for x in parts}
        out = self._cells(m, {c for c in m["cells"] if own is None or c.split("/")[0] in own}).select(*self.columns)
        return out if parts is None else out.where(F.col(self.layout.part).isin(parts))

    def missing(self, df: DataFrame, manifest: dict) -> DataFrame:
        """The rows of `df` (placed) that a version does not hold; only their cells are read."""
        cells = {f"pk={r['pk']}/bucket={r['bucket']}" for r in df.select("pk", "bucket").distinct().collect()}  # of a fixed number
        if not cells & manifest["cells"].keys():
            return df
        held = self._cells(manifest, cells).select("pk", "bucket", *[F.col(c).alias(f"held_{c}") for c in self.layout.identity])
        held = held.withColumnRenamed("pk", "held_pk").withColumnRenamed("bucket", "held_bucket")
        same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in ("pk", "bucket", *self.layout.identity)]
        # By a hash first: names that begin alike are long to compare, and sorted they would be compared with all their neighbours.
        df, held = df.withColumn("hash", F.xxhash64(*self.layout.identity)), held.withColumn("held_hash", F.xxhash64(*[f"held_{c}" for c in self.layout.identity]))
        return df.join(held, reduce(lambda a, b: a & b, same, F.col("hash") == F.col("held_hash")), "left_anti").drop("hash")

    def _write(self, df: DataFrame, files: int = 1) -> tuple[str, list[str]]:
        """A new folder with rows by cell, up to `files` files each, and its cells."""
        folder = uuid.uuid4().hex
        at = f"{self.root}/data/u={folder}"
        rows, part = df.select(*self.columns, "pk", "bucket"), F.pmod(F.xxhash64(*self.layout.identity, F.lit(1)), F.lit(files))
        rows.repartition("pk", "bucket", part).write.partitionBy("pk", "bucket").parquet(at)
        return folder, [f"{k}/{b}" for k in self._names(at) if k.startswith("pk=") for b in self._names(f"{at}/{k}")]

    # Changes
    def add(self, rows: DataFrame, applied: tuple[str, int] | None = None) -> dict:
        """Adds the rows that are not there. applied: a stream's name and batch; a batch that is already in changes nothing. Without new rows or a batch no version is made."""
        m = self.manifest()
        if applied and m["applied"].get(applied[0], [-1])[0] >= applied[1]:
            return m
        once = self._placed(rows, m["buckets"]).withColumn("hash", F.xxhash64(*self.layout.identity)).dropDuplicates(["hash", *self.layout.identity]).drop("hash")
        placed, at = written(once, "changes")
        folder, cells = self._write(self.missing(placed, m), placed.count() // FILE_ROWS + 1)
        drop(self.spark, at)
        m["added"] = self.spark.read.schema(self.layout.schema).parquet(f"{self.root}/data/u={folder}").count() if cells else 0
        if not cells:
            drop(self.spark, f"{self.root}/data/u={folder}")
            if not applied:
                return m
        else:
            m["folders"][folder] = len(cells)
            m["rows"] += m["added"]
            for c in cells:
                m["cells"].setdefault(c, []).append(folder)
        if applied:
            m["applied"][applied[0]] = [applied[1], m["added"]]
        self._merge(m)
        return self._commit(m)

    def _merge(self, m: dict) -> None:
        """Cells of too many folders get one."""
        full = {c for c, folders in m["cells"].items() if len(folders) > MOST_FOLDERS}
        if full:
            rows = self._cells(m, full)
            folder, cells = self._write(rows, rows.count() // FILE_ROWS + 1)
            m["folders"][folder] = len(cells)
            m["cells"].update({c: [folder] for c in cells})
            live = {f for folders in m["cells"].values() for f in folders}
            m["folders"] = {f: n for f, n in m["folders"].items() if f in live}

    def vacuum(self, keep: int = 2) -> None:
        """Forgets all versions but the last `keep`, and the folders that only they have. Not beside a writer."""
        numbers = self.numbers()
        live = {f for n in numbers[-keep:] for f in self.manifest(n)["folders"]}
        drop(self.spark, *[f"{self.root}/versions/v{n:010d}.json" for n in numbers[:-keep]])
        drop(self.spark, *[f"{self.root}/data/{n}" for n in self._names(f"{self.root}/data") if n.startswith("u=") and n[2:] not in live])
