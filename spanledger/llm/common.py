"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the word rules of this package know it, for Java and RE2 regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where it is unset and the session is local, as in
    tests, a temporary folder stands in. What this session has written there goes when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanledger-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/spanledger-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, *own: str):
    """docs with all columns but ``own`` renamed, so that none clashes with an operator's, and what names them back."""
    names = docs.columns
    inner = [n if n in own else f"x{i}" for i, n in enumerate(names)]
    return docs.toDF(*inner), lambda df: df.select(*[F.col(a).alias(b) for a, b in zip(inner, names)])


def place_of(doc_id: Column, docs: DataFrame) -> Column:
    """A key that orders rows as doc_id does, null last: a long for whole numbers, else text."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1))
    return F.coalesce(F.concat(F.lit("0"), doc_id.cast("string")), F.lit("1"))


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null text has none."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 48 bits of their MD5."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a number from 0 in ``order``, whose values must be distinct enough to deal into ranges.

    Ranges are numbered where they lie; only their row counts, one for each partition, meet in one place.
    """
    from pyspark.sql import Window

    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_own") - 1).drop("_part", "_own", "_base")  # a row for each shuffle partition
