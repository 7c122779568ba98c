"""What several operators of this subpackage need: the shared folder, written
intermediates, column checks and the hold-out rule."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of working columns, so that they do not clash with a caller's.
OWN = "__lf_"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` of the session if it is set. Where it is unset, a
    local master uses a temporary folder and any other master the warehouse,
    which is shared by definition.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master:
            folder = "file://" + os.path.join(tempfile.gettempdir(), "lexforge-shared")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lexforge_shared"
    # with its scheme, so that Spark and the workers' own file access agree on the place
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    return str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/lexforge/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage in a way that survives the loss of any executor, which a
    cached or locally checkpointed frame does not.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexforge_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`written` (no-op for others)."""
    path = getattr(df, "_lexforge_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of text that one task of a full shuffle should get.
PART_BYTES = 128 << 20


def parts_for(df: DataFrame, text_col: str) -> int:
    """Partitions for a shuffle of whole rows: from the bytes of their texts, and
    no fewer than the session's shuffle partitions."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


def cleanup(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder. To be
    called when its results have been read."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lexforge/{sc.applicationId}")
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def part_files(df: DataFrame) -> list[str]:
    """Addresses of the data files of a frame made by :func:`written`."""
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(df._lexforge_path)
    found = folder.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(str(f.getPath().toString()) for f in found if f.getPath().getName().endswith(".parquet"))


def opened_store(address: str):
    """The file system of an address, for workers, and the path in it."""
    from pyarrow import fs

    if address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address.removeprefix("file:")
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from (null ids are held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def map_batches(df: DataFrame, fn: Callable[[Iterable], Iterable], schema: str) -> DataFrame:
    """``mapInArrow`` under one name, so that operators read alike."""
    return df.mapInArrow(fn, schema)


def pieces(text: str, size: int = 1 << 20):
    """A text in slices of bounded length (for state machines fed piecewise)."""
    for at in range(0, len(text), size):
        yield text[at : at + size]
