"""What the driver shares with the executors: a folder, tables written to it, and this package.

Written tables are read lazily, so nothing can tell when a plan that reads one is
done. Code that knows puts its steps into ``passing``: what is written inside
goes at its end, but for what it keeps. ``sweep`` deletes all tables that this
process has written and not yet deleted; call it when no result is read any more.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Tables written and not yet deleted, oldest first.
_written: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a local session gets a temporary folder; on a cluster
    the lack is an error, because a machine-local folder would lose rows.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="motifgrid-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever it is installed on the driver; once a session."""
    context = spark.sparkContext
    if getattr(context, "_motifgrid_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="motifgrid-"), "motifgrid.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.join("motifgrid", os.path.relpath(os.path.join(folder, name), home)))
    context.addPyFile(target)
    context._motifgrid_shipped = True


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: its lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._motifgrid_path = path
    _written.append(out)
    return out


def _located(spark: SparkSession, path: str):
    """A path as the file system knows it, and that file system."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(context._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any file system, none if it isn't there."""
    path, system = _located(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    target, system = _located(spark, path)
    system.delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(df, "_motifgrid_path", None)
    if path:
        remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x is not df]


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those put into the list that this gives."""
    before, kept = {id(x) for x in _written}, []
    yield kept
    held = {id(x) for x in kept}
    for df in [x for x in _written if id(x) not in before and id(x) not in held]:
        discard(df)


def sweep() -> None:
    """Delete every table that is still there."""
    for df in list(_written):
        discard(df)


def plain_path(path: str) -> str:
    """A path that Python's ``open`` takes; only mounted file systems have one."""
    for lead in ("file://", "file:"):
        if path.startswith(lead):
            return path[len(lead) :]
    if "://" in path:
        raise ValueError(f"{path}: binary files are read and written on mounted file systems only")
    return path
