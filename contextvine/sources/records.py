"""Sequence records: FASTA, FASTQ and lists of files, plain or gzipped."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.symbols import normalise

FASTA, FASTQ, LISTS = (".fasta", ".fna", ".fa"), (".fastq", ".fq"), (".txt",)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, ord, seq_id, seq``: one row per record, split by the reader where a line starts with ``>``.

    The id is the rest of that line, in which ``>`` may stand, without leading ones.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^>+", "").alias("value")).where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s+", "")
    return raw.select("path", F.monotonically_increasing_id().alias("ord"), F.trim(F.regexp_replace(head, "\r", "")).alias("seq_id"), normalise(body).alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same from four-line records; qualities are dropped.

    The reader cuts at line starts with ``@``, so one file spreads over tasks.  A
    quality line may start so too: what is cut off there is a lone line, while a
    record has its ``+`` on the third.
    """
    raw = spark.read.option("lineSep", "\n@").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    rows = raw.select("path", F.monotonically_increasing_id().alias("ord"), lines.alias("l")).where(F.get("l", F.lit(2)).startswith("+"))
    return rows.select("path", "ord", F.regexp_replace(F.get("l", F.lit(0)), "^@", "").alias("seq_id"), normalise(F.get("l", F.lit(1))).alias("seq"))


def load_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Records of a FASTA or FASTQ file (also gzipped) or of the files a .txt list names."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(FASTA):
        return read_fasta(spark, path)
    if name.endswith(FASTQ):
        return read_fastq(spark, path)
    if name.endswith(LISTS):
        listed = [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]  # paths, not data
        if not listed:
            raise ValueError(f"{path} names no file")
        # one reader for all files of a kind
        plain = {p: p.lower().removesuffix(".gz") for p in listed}
        kinds = [(read_fasta, [p for p in listed if plain[p].endswith(FASTA)]), (read_fastq, [p for p in listed if plain[p].endswith(FASTQ)])]
        parts = [read(spark, paths) for read, paths in kinds if paths] + [load_sequences(spark, p) for p in listed if not plain[p].endswith(FASTA + FASTQ)]
        return reduce(DataFrame.unionByName, parts)
    raise ValueError(f"unknown kind of file: {path}")


def concatenated(records: DataFrame, per: str = "path") -> DataFrame:
    """One sequence per file: its records in order with an N between, ids joined by a bar."""
    gathered = records.groupBy(per).agg(F.array_sort(F.collect_list(F.struct("ord", "seq_id", "seq"))).alias("r"))
    return gathered.select(F.array_join(F.transform("r", lambda x: x["seq_id"]), "|").alias("seq_id"), F.array_join(F.transform("r", lambda x: x["seq"]), "N").alias("seq"))


def event_sequences(events: DataFrame) -> DataFrame:
    """A user's events in order as a sequence: click A, purchase C, error G, view T, signup N."""
    letter = F.translate(F.substring("event_type", 1, 1), "cpevs", "ACGTN")
    gathered = events.groupBy(F.col("user_id").cast("string").alias("seq_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", letter.alias("letter")))).alias("r"))
    return gathered.select("seq_id", F.array_join(F.transform("r", lambda x: x["letter"]), "").alias("seq"))


#: Symbols of the bytes of a text: ASCII letters read cyclically as A, C, G and T, N for the rest.
_CYCLE = np.full(256, ord("N"), dtype=np.uint8)
_CYCLE[[*range(65, 91), *range(97, 123)]] = np.resize(np.frombuffer(b"ACGT", dtype=np.uint8), 52)


#: Symbols of the bytes of a sequence, as ``normalise`` reads them.
_NORMAL = np.full(256, ord("N"), dtype=np.uint8)
for _from, _to in zip(b"ACGTUacgtu", b"ACGTTACGTT"):
    _NORMAL[_from] = _to


def recoded(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with a symbol for each character: that of its byte, of its first one where it has several."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets, begins = offsets - offsets[0], (data & 0xC0) != 0x80
    if not begins.all():
        offsets = np.append(0, np.cumsum(begins, dtype=np.int32))[offsets].astype(np.int32)
        data = data[begins]
    valid = None if not texts.null_count else pa.compute.is_valid(texts).buffers()[1]
    return pa.Array.from_buffers(pa.string(), len(texts), [valid, pa.py_buffer(offsets), pa.py_buffer(table[data])])


def normalised(seqs: list[str]) -> pa.Array:
    """What ``normalise`` makes of the sequences."""
    return recoded(pa.array([s if s.isascii() else s.upper() for s in seqs], pa.string()), _NORMAL)


def _cycled(text: pa.Array) -> pa.Array:
    return recoded(text, _CYCLE)


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores are dealt over all of them; more files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def document_sequences(documents: DataFrame) -> DataFrame:
    """``seq_id, seq, length``: whole texts as sequences: ASCII letters read cyclically as A, C, G, T, anything else as N; null text is left out."""
    documents = spread(documents.select("doc_id", "text")).where("text is not null")
    # computed once, not again in every filter that would be pushed below it
    symbols = F.arrow_udf(_cycled, StringType()).asNondeterministic()
    return documents.select(F.col("doc_id").cast("string").alias("seq_id"), symbols("text").alias("seq"), F.length("text").alias("length"))
