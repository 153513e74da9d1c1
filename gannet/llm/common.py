"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A session setting that lets Spark delete an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A single-process session may go without and gets a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gannet-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so later work never recomputes what came before.

    done: tables made by cut that nothing reads from now on; they are deleted, as are the shuffle files of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gannet-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    drop(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut wrote."""
    for t in tables:
        session = t.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(t.__dict__["_cut_path"])
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def crc_of_id(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; -1 for a null id, so such rows are never a hold-out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def with_row(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df's column "row" and then the columns of ddl."""
    return T.StructType([df.schema["row"], *T.StructType.fromDDL(ddl).fields])
