"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: the ASCII white space 0x09-0x0D and 0x20.
SEPARATORS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

_OWN_DIR = "sonarium.checkpoint.dir"
#: Rows of keys (a few numbers each) up to which a side is broadcast; larger sides are shuffled. Both give the same rows.
FEW_KEYS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in spark.checkpoint.dir. Only in local mode, as
    in tests, is a temporary folder made where that is unset; elsewhere a
    machine's own folder would lose rows, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_DIR, None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sonarium-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.conf.set(_OWN_DIR, named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that written made and that no plan reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, most: int = FEW_KEYS) -> DataFrame:
    """df, a written table of keys, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it.

    Catalyst inlines a column that a lambda names, which would evaluate it for
    each element; a lambda variable holds the evaluated value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS + "+", -1), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
