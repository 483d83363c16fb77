"""Tables that a job writes on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: The folder whose contents go when the work ends that this thread is at.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)
#: Paths of relations that are kept as long as an application runs.
_KEPT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one if all run in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sieveline-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{_SCRATCH.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    path = path or work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes what stands at a path of the shared folder, if anything does."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def _file(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared folder; None if there is none."""
    found, fs = _file(spark, path)
    if not fs.exists(found):
        return None
    stream = fs.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file of the shared folder as a whole: readers see what was there before or all of this."""
    target, fs = _file(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(target), how)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file of the shared folder as a whole unless there is one of that name already; of several writers one is told True."""
    target, fs = _file(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    none = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(target), none)
    except Py4JJavaError as e:
        fs.delete(staged, False)
        if fs.exists(target) and "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared folder, in order; none if there is no such folder."""
    found, fs = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    found, fs = _file(spark, path)
    return fs.getContentSummary(found).getLength()


@contextmanager
def scratch(spark: SparkSession):
    """Work paths that are made inside go when it ends, so what is to last must have been written elsewhere by then."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        delete(spark, folder)


def _stamp(spark: SparkSession, of: str) -> tuple:
    """Names, sizes and times of the files in a folder and in the folders there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(of)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, folders = [], [path]
    for depth in range(2):
        inner = [s for f in folders for s in fs.listStatus(f)]
        found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in inner]
        folders = [s.getPath() for s in inner if s.isDirectory()]
    return tuple(sorted(found))


def kept(spark: SparkSession, of: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A relation that is made from the tables in ``of`` once in an application's time, and again if these change."""
    key = (spark.sparkContext.applicationId, of, name, _stamp(spark, of))
    if key not in _KEPT:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])
