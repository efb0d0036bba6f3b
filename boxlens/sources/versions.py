"""Versioned folders: a table is replaced by one atomic step, whatever number of files or folders it has.

A version is a folder of its own. It counts once an empty marker, named by its number and
folder, was created; that is a single create, so a reader sees either the old version or
the new one, on object stores as well. The version before stays for readers that have
begun; older ones are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MARKERS = "_versions"
KEPT = 2


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _markers(spark: SparkSession, path: str) -> list[str]:
    """Names of the markers, oldest first; two writers at once leave two of a number, and the greater name counts."""
    target, fs = _at(spark, f"{path.rstrip('/')}/{MARKERS}/*")
    return sorted(status.getPath().getName() for status in fs.globStatus(target) or ())


def current(spark: SparkSession, path: str) -> str:
    """Folder of the newest version; a path without versions is its own."""
    markers = _markers(spark, path)
    return f"{path.rstrip('/')}/{markers[-1].split('.')[1]}" if markers else path


def write_version(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Call ``write`` with a new folder and, if it ends well, make that folder the current version."""
    root, folder = path.rstrip("/"), f"v{uuid.uuid4().hex}"
    try:
        write(f"{root}/{folder}")
    except Exception:
        target, fs = _at(spark, f"{root}/{folder}")
        fs.delete(target, True)
        raise
    before = _markers(spark, path)
    number = int(before[-1].split(".")[0]) + 1 if before else 0
    marker, fs = _at(spark, f"{root}/{MARKERS}/{number:012d}.{folder}")
    if not fs.createNewFile(marker):
        raise OSError(f"cannot create {marker}")
    for old in before[: -(KEPT - 1)]:
        # the marker goes first, so no reader is sent to a folder that is being deleted
        for gone in (f"{MARKERS}/{old}", old.split(".")[1]):
            fs.delete(_at(spark, f"{root}/{gone}")[0], True)
