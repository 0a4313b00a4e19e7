"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where it is unset (local runs, tests) one of our own is made."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set(KEY, found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark context, however it was found here."""
    context = spark.sparkContext
    if getattr(context, "_tickloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    own = tempfile.mkdtemp(prefix="tickloom-package-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    target = f"{own}/tickloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    context._tickloom_shipped = True


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage and survives lost executors.

    It is deleted by ``drop``, or else when the driver's JVM ends."""
    spark = df.sparkSession
    path = fresh(spark, name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tickloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that are no longer read."""
    for df in tables:
        path = getattr(df, "_tickloom_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def uses(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """Notes which work tables a plan reads, so that ``release`` can delete them."""
    df._tickloom_uses = tables
    return df


def release(df: DataFrame) -> None:
    """Deletes the work tables of a plan that has been carried out and written."""
    drop(*getattr(df, "_tickloom_uses", ()))


#: A key is frequent if it has over one in so many rows: as many keys at most are frequent, whatever the table.
FREQUENT = 1000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has each key once; nulls where it lacks the key.

    count: the column of ``table`` that holds how many rows have the key; it isn't part of the result. Frequent keys, at
    most ``FREQUENT`` of them, are looked up in a broadcast, and their rows are spread instead of meeting in one task.
    """
    values = [c for c in table.columns if c not in keys and c != count]
    total = table.agg(F.sum(count)).first()[0] or 0
    often = table.filter(F.col(count) > max(1, total // FREQUENT)).select(*keys, F.struct(*values).alias("_often"))
    salt = F.when(F.col("_often").isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 62) - 1)))
    marked = rows.join(F.broadcast(often), keys, "left").withColumn("_salt", salt)
    met = marked.join(table.select(*keys, *values, F.lit(-1).cast("long").alias("_salt")), [*keys, "_salt"], "left")
    return met.select(*rows.columns, *[F.when(F.col("_often").isNull(), F.col(c)).otherwise(F.col(f"_often.{c}")).alias(c) for c in values])


def open_fs(uri: str):
    """(pyarrow file system, path) of a qualified URI; used on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
