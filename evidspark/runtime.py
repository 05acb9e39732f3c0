"""Session-level helpers shared by the whole package."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext, so Arrow functions find it."""
    sc = spark.sparkContext
    if getattr(sc, "_evidspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="evidspark_"), "evidspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("evidspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._evidspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset a local session gets a folder of its own, deleted at the end; on a
    cluster, whose executors don't share local folders, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        holder = getattr(sc, "_evidspark_shared", None)
        if holder is None:
            holder = sc._evidspark_shared = tempfile.TemporaryDirectory(prefix="evidspark_shared_")
        found = "file://" + holder.name
    return found.rstrip("/")


#: Tables written since the innermost `tidy` function began.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evidspark_path = path
    if (written := _written.get()) is not None:
        written.append(out)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    path = getattr(df, "_evidspark_path", None)
    if path:
        delete(df.sparkSession, path)


def tidy(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Delete all tables that a function has written when it ends, but the one that it returns."""

    @functools.wraps(build)
    def run(*args, **options) -> DataFrame:
        mine: list[DataFrame] = []
        token = _written.set(mine)
        kept = None
        try:
            out = build(*args, **options)
            kept = getattr(out, "_evidspark_path", None)
        finally:
            _written.reset(token)
            for df in mine:
                if df._evidspark_path != kept:
                    forget(df)
        if kept and (outer := _written.get()) is not None:
            outer.append(out)
        return out

    return run
