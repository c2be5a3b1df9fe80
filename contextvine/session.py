"""Sessions, and getting this package to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 2500
#: Parquet's sizes for tables of pairs: dictionaries of 8 million values, and pages of 2 million, as a column's first page decides whether it has one.
BY_NUMBER = {"parquet.dictionary.page.size": 1 << 26, "parquet.page.size": 1 << 24, "parquet.page.row.count.limit": 1 << 21}
_shipped: set[str] = set()
_local: dict[str, str] = {}


def _temporary() -> str:
    """A folder of this process, gone at its end."""
    path = tempfile.mkdtemp(prefix="contextvine-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = _temporary()
    return _local[context.applicationId]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that a plan reads more than once, a trained model above all, and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    # schemas are not inferred again, so empty tables read back too
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def values_by_number(spark: SparkSession) -> None:
    """Files that this session writes hold columns of up to some million different values as numbers of a dictionary; sizes the session names itself stay.

    Values of six places, of which tables of pairs have a row for each pair, take 2 to 4 bytes instead of 8.
    """
    for name, size in BY_NUMBER.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(size))


def ship_package(spark: SparkSession) -> None:
    """Give the package's modules to the executors of this application, once, and bound its Arrow batches."""
    # rows of whole texts are large: smaller batches bound what a task and its worker hold
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(_temporary(), "contextvine.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("contextvine")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
