"""Ranges of block-gzip, plain and other gzip files give the records of the whole file."""

import gzip
import random

import pytest

from contextvine.sources import blocks
from contextvine.sources.records import load_sequences


def sample(kind, n=400):
    rng = random.Random(7)
    out = []
    for k in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 40, 700, 3000])))
        if kind == "fasta":
            out.append(f">id{k} >x @y\n" + "\n".join(seq[i : i + 61] for i in range(0, len(seq), 61)) + "\n")
        else:
            out.append(f"@id{k} z\n{seq}\n+\n{''.join(rng.choice('@+>I') for _ in seq)}\n")
    return "".join(out)


def records(df):
    return sorted((r.seq_id, r.seq) for r in df.select("seq_id", "seq").collect())


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_ranges_equal_the_whole_file(spark, tmp_path, kind):
    text = sample(kind)
    plain = tmp_path / f"a.{kind}"
    plain.write_text(text)
    want = records(load_sequences(spark, str(plain)))
    assert len(want) == 400
    (tmp_path / f"b.{kind}.gz").write_bytes(blocks.pack_blocks(text.encode()))
    (tmp_path / f"c.{kind}.gz").write_bytes(gzip.compress(text.encode()))
    for name, many in (("a", ""), ("b", ".gz"), ("c", ".gz")):
        for size in (10_000, 33_333, 70_001, 1 << 25):
            df = blocks.read_records(spark, str(tmp_path / f"{name}.{kind}{many}"), size)
            assert records(df) == want, (name, size)
            parts = df.rdd.getNumPartitions()
            assert parts > 1 if size < 70_000 and name != "c" else parts >= 1
    # any gzip reader reads blocks
    assert gzip.decompress((tmp_path / f"b.{kind}.gz").read_bytes()).decode() == text


def test_written_folder_and_nothing(spark, tmp_path):
    rows = [(f"s{k}", "ACGTN" * (k * 300)) for k in range(1, 60)] + [("empty", ""), ("null", None), (None, "ACG")]
    seqs = spark.createDataFrame(rows, "seq_id string, seq string").repartition(5)
    blocks.write_block_fasta(seqs, str(tmp_path / "w"))
    want = sorted(r for r in rows if None not in r)
    assert records(blocks.read_block_fasta(spark, str(tmp_path / "w"), 2000)) == want
    blocks.write_block_fasta(seqs.limit(0), str(tmp_path / "none"))
    assert blocks.read_block_fasta(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "empty.fa").write_text("")
    assert blocks.read_records(spark, str(tmp_path / "empty.fa")).collect() == []


def test_sequences_are_normalised_where_they_are_read(spark, tmp_path):
    """As the expression does, whose patterns cost more than reading."""
    from pyspark.sql import functions as F

    from contextvine.functions.symbols import normalise

    seqs = ["acgtuACGTU-nN*", "straußeﬅſ", "A\U0001f600C日é", "", "x" * 3000]
    (tmp_path / "a.fa").write_text("".join(f">{k}\n{s}\n" for k, s in enumerate(seqs)))
    read = blocks.read_records(spark, str(tmp_path / "a.fa"), 100)
    want = spark.createDataFrame([(str(k), s) for k, s in enumerate(seqs)], "seq_id string, seq string").select("seq_id", normalise(F.col("seq")).alias("seq"))
    assert records(read) == records(want)
    assert "regexp_replace" not in read._jdf.queryExecution().optimizedPlan().toString()
