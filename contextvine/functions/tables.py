"""Table functions for SQL: search, subtrees and sampling over tables or views.

``register`` makes them known to a session::

    SELECT * FROM pattern_search(TABLE(seqs), array('ACG', 'TT'))
    SELECT * FROM model_subtree(TABLE(models), 'A')
    SELECT * FROM model_sample(TABLE(models) PARTITION BY (model_id), 100, 1)

They take any table with the named columns, in any order and with others beside them.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .symbols import P, SYMBOLS


class PatternSearch:
    """Every occurrence of some patterns, overlapping ones too; the empty one is found at every place and the end."""

    def eval(self, row, patterns: list) -> Iterator[tuple]:
        seq = row["seq"]
        if seq is None:
            return
        for pattern in sorted({p for p in patterns or [] if p is not None}):
            at = seq.find(pattern)
            while at >= 0:
                yield row["seq_id"], pattern, at
                at = seq.find(pattern, at + 1) if at < len(seq) else -1


class ModelSubtree:
    """Contexts that end with ``start``, itself included."""

    def eval(self, row, start: str) -> Iterator[tuple]:
        if row["context"].endswith(start or ""):
            yield row["model_id"], row["context"], row["count"]


class ModelSample:
    """A sequence drawn from each model; its table is partitioned by the model, whose contexts are held while it is drawn."""

    def __init__(self) -> None:
        self.states: dict[str, list[float]] = {}
        self.model_id, self.length, self.seed = None, 0, 0

    def eval(self, row, length: int, seed: int) -> None:
        self.model_id, self.length, self.seed = row["model_id"], length, seed
        self.states[row["context"]] = [row[p] for p in P]

    def terminate(self) -> Iterator[tuple]:
        if not self.states:
            return
        rng, out, order = random.Random(f"{self.seed}:{self.model_id}"), "", max(map(len, self.states))
        for _ in range(self.length):
            last = out[max(0, len(out) - order) :]
            state = next((last[k:] for k in range(len(last) + 1) if last[k:] in self.states), None)
            weights = self.states[state] if state is not None else [0.25] * 4
            out += rng.choices(SYMBOLS, weights)[0]
        yield self.model_id, out


FUNCTIONS = {
    "pattern_search": (PatternSearch, "seq_id string, pattern string, pos long"),
    "model_subtree": (ModelSubtree, "model_id string, context string, count long"),
    "model_sample": (ModelSample, "model_id string, seq string"),
}


def register(spark: SparkSession) -> None:
    """The functions under their names in this session."""
    for name, (handler, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
