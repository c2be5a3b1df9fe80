from pyspark.sql import functions as F

from contextvine.operators import training
from contextvine.sources import records

from .test_scoring import several


def test_a_file_is_trained_from_its_records(spark):
    """As from the sequence of all records, which is not made; an empty record counts its N."""
    seqs, _ = several(spark)
    rows = seqs.select(F.lit("f").alias("path"), F.monotonically_increasing_id().alias("ord"), "seq_id", "seq")
    rows = rows.unionByName(spark.createDataFrame([("f", 1 << 40, "none", ""), ("g", 0, "x", "ACACGT" * 9)], rows.schema)).cache()
    params = training.TrainingParams(max_depth=2, min_count=2)
    show = lambda df: sorted((r.model_id, r.context, r["count"], *(round(r[p], 9) for p in training.P), round(r.delta, 6)) for r in df.collect())
    found = show(training.train_files(rows, params))
    assert found == show(training.train_unpruned(records.concatenated(rows).select("seq_id", "seq"), params)) and len({r[0] for r in found}) == 2
