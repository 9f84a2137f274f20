"""Small files and whole tables through Hadoop's file systems: one URI means the same place to the driver and to every executor.

Reading, writing and leases go through the session's Hadoop configuration, so a folder can be on HDFS, in an object store's connector or on a mounted disk alike.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder to a name that isn't taken."""
    fs, a = _at(spark, source)
    _, b = _at(spark, target)
    if fs.exists(b):
        raise FileExistsError(target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't move {source} to {target}")


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames a table or file over another: the old one goes right before."""
    fs, a = _at(spark, source)
    _, b = _at(spark, target)
    fs.delete(b, True)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't move {source} to {target}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, spark._jvm.java.nio.charset.StandardCharsets.UTF_8)
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new file; false where there is one already. Which of several writers gets it, the file system decides: HDFS by its own create, a mounted disk by the
    operating system's (Hadoop's local file system looks first and creates then). A store whose connector can't create exclusively isn't a place for leases."""
    fs, where = _at(spark, path)
    fs.mkdirs(where.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            handle = os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        return True
    try:
        stream = fs.create(where, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e).lower():
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def write_json(spark: SparkSession, path: str, content: Any) -> None:
    """Written aside and moved into place, so readers see all of it or, for a moment, none, never a part."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    if not create(spark, aside, json.dumps(content, indent=2, sort_keys=True, default=str)):
        raise FileExistsError(aside)
    replace(spark, aside, path)


def find(spark: SparkSession, root: str, name: str) -> list[str]:
    """Paths of all files of a name below a folder, in order; none where the folder isn't there."""
    fs, where = _at(spark, root)
    if not fs.exists(where):
        return []
    out, files = [], fs.listFiles(where, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() == name:
            out.append(path.toString())
    return sorted(out)


@contextmanager
def lease(spark: SparkSession, path: str, wait: float = 30.0, stale: float = 3600.0, pause: float = 0.05) -> Iterator[None]:
    """Holds a file that only one writer can create. One older than `stale` seconds is of a writer that died and is taken over; after `wait` seconds TimeoutError.

    A lease names its holder, so that only the holder's own file is removed at the end, not that of a writer who took it over.
    """
    me, end = uuid.uuid4().hex, time.monotonic() + wait
    while not create(spark, path, me):
        try:
            fs, where = _at(spark, path)
            age = time.time() - fs.getFileStatus(where).getModificationTime() / 1000
        except Exception:  # it went meanwhile
            continue
        if age > stale:
            gone = f"{path}.{me}"
            try:
                move(spark, path, gone)  # of several that see it stale, one moves it
                remove(spark, gone)
            except Exception:
                pass
        elif time.monotonic() > end:
            raise TimeoutError(f"{path} is held")
        else:
            time.sleep(pause)
    try:
        yield
    finally:
        try:
            if read_text(spark, path) == me:
                remove(spark, path)
        except FileNotFoundError:
            pass
