"""Record streams of JSON lines, journals, framed byte streams, and URIs."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gannet.functions.globs import first_meta, is_glob, literal_prefix

ENVELOPE = "type string, ts string, job_id string, provider string, data string"


def envelope(rows: DataFrame, kind: str, job_id: str, provider: str, at: Column | None = None) -> DataFrame:
    """One JSON line for each row, in a typed envelope."""
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.struct(F.lit(kind).alias("type"), stamp.alias("ts"), F.lit(job_id).alias("job_id"), F.lit(provider).alias("provider"), F.struct("*").alias("data"))
    return rows.select(F.to_json(line).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)


def parse_lines(lines: DataFrame, schema: str, kinds: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Reads lines (column value) of three forms: an enveloped record, a bare object, a bare URI.

    Returns the records, with record_type (null for bare ones), and the lines that are none of these.
    """
    wanted = list(kinds)
    text = F.trim("value")
    boxed = F.from_json(text, "type string, data string")
    some = lines.where(text != "").select("value", boxed.alias("e"), F.when(text.startswith("{"), F.from_json(text, schema)).alias("bare"))
    is_box = F.col("e.type").isNotNull() & F.col("e.data").isNotNull()
    uri = F.when(text.rlike(r"^[a-z][a-z0-9+.-]*://\S+$"), F.from_json(F.to_json(F.struct(text.alias("source_uri"))), schema))
    record = F.when(is_box, F.from_json("e.data", schema)).otherwise(F.coalesce("bare", uri))
    read = some.select("value", F.when(is_box, F.col("e.type")).alias("record_type"), record.alias("r"))
    empty = F.to_json("r") == "{}"
    good = F.col("r").isNotNull() & ~empty
    records = read.where(good).select("record_type", "r.*")
    return (records.where(F.col("record_type").isNull() | F.col("record_type").isin(wanted)) if wanted else records), read.where(~F.coalesce(good, F.lit(False))).select("value")


def read_journal(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of journals (JSON lines: header, records with a sequence, footer with their count), and problems found."""
    rows = spark.read.schema(f"kind string, journal_id string, sequence long, records long, {schema}").json(path)
    body = rows.where("kind = 'record'").drop("kind", "records")
    seen = body.groupBy("journal_id").agg(F.count("*").alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count_distinct("sequence").alias("kinds"))
    ends = rows.where("kind = 'footer'").select("journal_id", F.col("records").alias("told"))
    bad = seen.join(ends, "journal_id", "full_outer")
    problem = (
        F.when(F.col("told").isNull(), "no footer")
        .when(F.coalesce("n", F.lit(0)) != F.col("told"), "wrong count")
        .when((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("kinds") != F.col("n")), "broken sequence")
    )
    return body, bad.select("journal_id", problem.alias("problem")).where("problem is not null")


@dataclass(frozen=True)
class Uri:
    scheme: str
    bucket: str
    key: str
    pattern: str | None

    @property
    def prefix(self) -> str:
        return literal_prefix(self.pattern) if self.pattern else self.key


def parse_uri(text: str) -> Uri:
    """s3://bucket/key, gs://bucket/key or file:///path; wildcards in the key make it a pattern."""
    m = re.fullmatch(r"(s3|gs)://([^/]+)(?:/(.*))?|(file)://(/.*)", text, re.S)
    if not m:
        raise ValueError(f"not a supported URI: {text!r}")
    scheme, bucket, key = (m[1], m[2], m[3] or "") if m[1] else ("file", "", m[5])
    if is_glob(key):
        return Uri(scheme, bucket, key[: first_meta(key)].rpartition("/")[0], key)
    return Uri(scheme, bucket, key, None)


def frames(name: str, chunks: Iterable[bytes]) -> Iterator[str]:
    """A byte stream as JSON lines: open, chunks in sequence, close with count and digest."""
    yield json.dumps({"type": "open", "name": name})
    digest, n, size = hashlib.sha256(), 0, 0
    for n, chunk in enumerate(chunks, 1):
        digest.update(chunk)
        size += len(chunk)
        yield json.dumps({"type": "chunk", "seq": n, "data": base64.b64encode(chunk).decode()})
    yield json.dumps({"type": "close", "chunks": n, "bytes": size, "sha256": digest.hexdigest()})


def unframe(lines: Iterable[str]) -> Iterator[bytes]:
    """The chunks; raises for a stream that is out of order, cut short or altered."""
    digest, n, size, state = hashlib.sha256(), 0, 0, "new"
    for line in lines:
        x = json.loads(line)
        if x["type"] == "open" and state == "new":
            state = "open"
        elif x["type"] == "chunk" and state == "open" and x["seq"] == n + 1:
            chunk = base64.b64decode(x["data"])
            n, size = n + 1, size + len(chunk)
            digest.update(chunk)
            yield chunk
        elif x["type"] == "close" and state == "open":
            if (x["chunks"], x["bytes"], x["sha256"]) != (n, size, digest.hexdigest()):
                raise ValueError("the stream was altered")
            state = "closed"
        else:
            raise ValueError(f"unexpected frame: {x['type']}")
    if state != "closed":
        raise ValueError("the stream was cut short")
