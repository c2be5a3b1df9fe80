"""Folders, files and tables that the driver and every executor can reach.

Operators that write files of their own (archives, indexes, token shards) put
them under the folder the cluster names in ``spark.checkpoint.dir``.  A task
writes each file under a name of its own attempt and returns that name as a row;
the rows are committed by Spark's Parquet writer, so only files of successful
attempts are ever read, and a lost executor merely leaves an unread file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from contextvine.session import shared_dir
from contextvine.session import stored as materialise

__all__ = ["attempt_name", "filesystem", "fresh", "materialise", "shared_dir", "shuffle_width", "trim", "trimmed"]


def fresh(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """``(filesystem, path)`` of a folder or file for code that runs in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name no other attempt of the task can have."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def trim() -> None:
    """Give memory that a finished task no longer needs back to the machine: idle workers keep what they hold."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A task function of batches that trims memory when its last batch is out."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
