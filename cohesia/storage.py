"""Lineage cutting through tables in the folder that all executors share.

Iterative operators must not keep an ever growing plan, and a result that several later steps
read must survive the loss of an executor.  Both are solved by writing the rows as Parquet into
the shared folder named by ``spark.checkpoint.dir`` and reading them back: the files give the
optimizer true sizes and no block lives on one executor only.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}
_app_folders: set[str] = set()
_PACKAGE_AT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> None:
    """Put the folder of this package on the path of Python workers, wherever the session was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _PACKAGE_AT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_PACKAGE_AT, *paths])


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``; where neither
    is set, on a single machine only, a temporary folder, removed at exit."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (None if spark.sparkContext.applicationId in _own_root else spark.sparkContext.getCheckpointDir())
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        folder = tempfile.mkdtemp(prefix="cohesia-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        _own_root[app] = f"file://{folder}"
    return _own_root[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, in a folder of the application that goes when the application ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_root(spark)}/cohesia/{app}"
    if app not in _app_folders:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(jpath)
        system.deleteOnExit(jpath)
        _app_folders.add(app)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back (same schema, no lineage)."""
    spark = df.sparkSession
    reach_workers(spark)
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back._cohesia_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Delete the files behind a frame made by :func:`cut`; other frames are left alone.

    Only for tables that no unfinished frame reads any more."""
    path = getattr(df, "_cohesia_path", None)
    if path is not None:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package made under the shared folder."""
    if not path.startswith(f"{shared_root(spark)}/cohesia/"):
        raise ValueError(f"{path} is none of this package's folders")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
