"""Scoring a stream of sequences against a static model table.

The join with the models is stateless: each micro-batch counts what its positions
look like, looks states up in the models and sums per sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import deepest, nll


def score_stream(sequences: DataFrame, models: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, score: str = "log", background_order: int = 0, both_strands: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Score every micro-batch of a stream of ``seq_id, seq`` and hand the scores to ``sink(scores, batch_id)``.

    A batch that is replayed after a failure has the same ``batch_id``, so a sink
    that writes by it stays exact.
    """
    order = deepest(models)

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(nll(batch, models, False, score, background_order, both_strands, order), batch_id)

    writer = sequences.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
