"""The folder that driver and executors share, for indexes, stores and streams."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where it is unset (tests), a local session gets a temporary folder of its
    own, which goes when the process ends; on a cluster an unset folder is an
    error, as executors share no local one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + _temporary()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="corvex-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system of the path, and the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    fs, target = file_system(spark, path)
    return fs.exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a path, by name."""
    fs, target = file_system(spark, path)
    return sorted(f.getPath().toString() for f in fs.listStatus(target) if f.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path with all below it."""
    fs, target = file_system(spark, path)
    fs.delete(target, True)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of each write as soon as it is done; else they lie until the driver's collector runs."""
    with conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextlib.contextmanager
def conf(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within it, a setting of the session has this value."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Creates a small file with this content unless one is there; whether this call created it.

    Of callers at the same time one succeeds: the file system creates a name at
    most once.  On a local disk the complete file gets its name by a link.
    """
    fs, target = file_system(spark, path)
    fs.mkdirs(target.getParent())
    if fs.getScheme() == "file":
        name = target.toUri().getPath()
        draft = f"{name}.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(content)
        try:
            os.link(draft, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
    try:
        out = fs.create(target, False)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes whenever a file below the path is added, removed or rewritten: a hash of names, sizes and times."""
    fs, target = file_system(spark, path)
    digest, files = hashlib.sha256(path.encode()), fs.listFiles(target, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    digest.update(repr(sorted(found)).encode())
    return digest.hexdigest()[:24]

