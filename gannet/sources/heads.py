"""What a HEAD request tells of each object, for roots that every executor mounts; and the first bytes of objects."""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "rel_key string, size_bytes long, last_modified timestamp, etag string, content_type string, storage_class string, metadata map<string,string>, head binary, error string"
_ARROW = pa.schema([("rel_key", pa.string()), ("size_bytes", pa.int64()), ("last_modified", pa.timestamp("us", "UTC")), ("etag", pa.string()), ("content_type", pa.string()), ("storage_class", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("head", pa.binary()), ("error", pa.string())])
#: Classes of failure; what isn't named is a failure of the provider.
FAILURES = {FileNotFoundError: "not_found", NotADirectoryError: "not_found", IsADirectoryError: "not_found", PermissionError: "access_denied", TimeoutError: "timeout"}


def failure(error: Exception) -> str:
    return FAILURES.get(type(error), "provider_error")


def _head(root: str, key: str, sidecar: str, first: int) -> dict:
    base, path = os.path.realpath(root), os.path.realpath(os.path.join(root, key.lstrip("/")))
    if os.path.commonpath([base, path]) != base:
        raise PermissionError(key)
    st = os.stat(path)
    if not stat.S_ISREG(st.st_mode):
        raise FileNotFoundError(key)
    token = hashlib.sha256(f"size={st.st_size};mtime={st.st_mtime_ns};mode={stat.filemode(st.st_mode)}".encode()).hexdigest()
    out = {"rel_key": key, "size_bytes": st.st_size, "last_modified": datetime.fromtimestamp(st.st_mtime, UTC), "etag": token}
    if first:
        with open(path, "rb") as f:
            out["head"] = f.read(first)
    if os.path.exists(path + sidecar):
        with open(path + sidecar, encoding="utf-8") as f:
            told = json.load(f)
        out |= {"content_type": told.get("content_type"), "storage_class": told.get("storage_class"), "metadata": list((told.get("user_metadata") or {}).items())}
    return out


def heads(keys: DataFrame, root: str, key: str = "rel_key", sidecar: str = ".meta.json", first: int = 0) -> DataFrame:
    """SCHEMA, a row for each key: facts of a regular file below root, and what a JSON file beside it adds.

    A file that can't be read is a row with the class of its failure. first: how many bytes of
    each file to read from its start; no more are read.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    rows.append(_head(root, name or "", sidecar, first) | {"rel_key": name})
                except (OSError, ValueError) as e:
                    rows.append({"rel_key": name, "error": failure(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return keys.select(F.col(key).cast("string").alias("rel_key")).mapInArrow(run, SCHEMA)


def enrichment(found: DataFrame, at: Column | None = None) -> DataFrame:
    """Heads as merge.enrich takes them: those that were read, with the time of reading."""
    stamp = (F.current_timestamp() if at is None else at).cast("timestamp_ntz")
    none = F.lit(None)
    return found.where("error is null").select("rel_key", none.cast("string").alias("archive_status"), none.cast("string").alias("restore_state"), none.cast("timestamp_ntz").alias("restore_expiry"), "content_type", stamp.alias("head_enriched_at"))


def failures(found: DataFrame) -> DataFrame:
    """How many keys failed, by class."""
    return found.where("error is not null").groupBy("error").agg(F.count("*").alias("keys"))
