"""Durable snapshots: sorted Parquet segments, a manifest, and a pointer to the latest run."""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gannet.operators.rollup import manifest_counts

SEGMENT_ROWS = 500_000  # fixed value: rows of a segment file


class StaleParent(RuntimeError):
    """Another run was published meanwhile."""


@dataclass(frozen=True)
class Store:
    """A folder of runs, in any file system that Spark reaches."""

    spark: SparkSession
    root: str

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        path = self._path()
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, *parts: str) -> str | None:
        fs, path = self._fs(), self._path(*parts)
        if not fs.exists(path):
            return None
        return self.spark.read.text(str(path), wholetext=True).first()[0]

    def _create(self, text: str, *parts: str) -> bool:
        """Writes a file that isn't there yet; false if it is. The file system decides between two writers."""
        try:
            out = self._fs().create(self._path(*parts), False)
        except Py4JJavaError as e:
            if self._fs().exists(self._path(*parts)):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _turns(self) -> list[int]:
        fs, folder = self._fs(), self._path("latest")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []

    def latest(self) -> str | None:
        """The run published last: that of the last turn. Turns are created, never replaced, so a writer that dies loses none."""
        turns = self._turns()
        found = self._read("latest", f"{turns[-1]:010d}") if turns else None
        return found.strip() if found else None

    def publish(self, rows: DataFrame, run_id: str, parent: str | None = None, key: str = "rel_key", segment_rows: int = SEGMENT_ROWS, facts: dict | None = None) -> dict:
        """Writes the rows in key order as a run, then makes it the latest.

        Raises for duplicate keys, an existing run, and a parent that isn't the latest any more:
        of two writers that start from one parent, one gets the next turn. facts (such as
        index_set_id and coverage) go into the manifest.
        """
        turns = self._turns()
        if self.latest() != parent:
            raise StaleParent(f"the latest run is {self.latest()}, not {parent}")
        if self._fs().exists(self._path(run_id, "COMPLETE")):
            raise ValueError(f"run {run_id} is there already")
        data = str(self._path(run_id, "segments"))
        rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("maxRecordsPerFile", segment_rows).option("compression", "snappy").parquet(data)
        written = self.spark.read.parquet(data)
        if twice := written.groupBy(key).count().where("count > 1").limit(1).collect():
            raise ValueError(f"key {twice[0][key]!r} is there twice")
        manifest = {**(facts or {}), "key": key, "run_id": run_id, "parent": parent, "parents": [parent] if parent else [], **manifest_counts(written).first().asDict(), "digest": self._digest(written), "segments": self._segments(written, data, key)}
        if not (self._create(json.dumps(manifest), run_id, "MANIFEST") and self._create(run_id, run_id, "COMPLETE")):
            raise ValueError(f"run {run_id} is there already")
        if not self._create(run_id, "latest", f"{(turns[-1] if turns else 0) + 1:010d}"):
            raise StaleParent(f"another run was published after {parent}")
        return manifest

    def _segments(self, rows: DataFrame, data: str, key: str) -> list[dict]:
        """Of each segment file in key order: name, rows, first and last key, tombstones, bytes and the SHA-256 of its bytes. One row for each file."""
        dead = F.count_if(F.col("deleted_at").isNotNull()) if "deleted_at" in rows.columns else F.lit(0)
        inside = rows.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key"), dead.alias("tombstones"))
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(data).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        return [r.asDict() for r in inside.join(files, "name").orderBy("min_key").collect()]

    @staticmethod
    def _digest(rows: DataFrame) -> str:
        """Of the rows in any order: their number, and the sum and xor of their hashes, so that equal rows don't cancel."""
        h = F.xxhash64(*rows.columns)
        r = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        return f"{r['n']}-{(r['x'] or 0) & (2**64 - 1):016x}-{int(r['s']) & (2**64 - 1):016x}"

    def runs(self) -> list[str]:
        """The published runs, the latest last."""
        return [self._read("latest", f"{t:010d}").strip() for t in self._turns()]

    def collect_garbage(self, keep_last: int) -> list[str]:
        """Deletes the files of all but the last so many published runs (the latest always stays) and returns their names."""
        fs, gone = self._fs(), []
        published = self.runs()
        for run_id in published[: max(len(published) - max(keep_last, 1), 0)]:
            if run_id not in published[-max(keep_last, 1) :] and fs.delete(self._path(run_id), True):
                gone.append(run_id)
        return gone

    def manifest(self, run_id: str) -> dict:
        if self._read(run_id, "COMPLETE") is None:
            raise ValueError(f"run {run_id} isn't complete")
        return json.loads(self._read(run_id, "MANIFEST"))

    def read(self, run_id: str | None = None, verify: bool = False) -> DataFrame:
        """A pinned run, or the latest; with verify its rows are held against the manifest's digest."""
        run_id = run_id or self.latest()
        if run_id is None:
            raise ValueError("nothing was published")
        manifest = self.manifest(run_id)
        rows = self.spark.read.parquet(str(self._path(run_id, "segments")))
        if verify:
            data, told = str(self._path(run_id, "segments")), manifest["segments"]
            if self._digest(rows) != manifest["digest"] or self._segments(rows, data, manifest["key"]) != told:
                raise ValueError(f"run {run_id} doesn't match its manifest")
        return rows

    def copy_to(self, other: Store, run_id: str) -> dict:
        """Exports a run to another root, verified on arrival."""
        rows = self.read(run_id, verify=True)
        made = other.publish(rows, run_id, other.latest(), self.manifest(run_id)["key"])
        if made["digest"] != self.manifest(run_id)["digest"]:
            raise ValueError(f"run {run_id} changed on its way")
        return made


def resolve(sets: DataFrame, name: str) -> str:
    """An index set's id from its URI, id, or a prefix of the id that only one has."""
    hit = F.col("index_set_id").startswith(name) | F.col("index_set_id").startswith("idx_" + name)
    found = sets.where((F.col("base_uri") == name) | hit).select("index_set_id", (F.col("index_set_id") == name).alias("exact")).distinct().limit(20).collect()
    exact = [r for r in found if r["exact"]] or found
    if len(exact) != 1:
        raise ValueError(f"{name!r} names {len(exact)} index sets")
    return exact[0]["index_set_id"]
