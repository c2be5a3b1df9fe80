"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A profile lists a language's most frequent character n-grams in order of
frequency.  A document's own list is compared with each profile: an n-gram costs
the difference of its two ranks, or the profile's length where it is missing.
The language with the least sum wins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import trimmed

_BITS = 21  # a code point; up to three of them stand in one signed 64-bit key
_GAP = ord("_")


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or the gap if it is no letter."""
    table = np.full(0x110000, _GAP, dtype=np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str | None, most: int = 3) -> np.ndarray:
    """Keys of all n-grams (n up to ``most``) inside the words of a text; words carry a gap at either end."""
    if not text:
        return np.empty(0, dtype=np.int64)
    letters = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    letters = np.concatenate([[_GAP], letters, [_GAP]])
    gap = letters == _GAP
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    letters = letters[keep]
    gap = letters == _GAP
    out = [letters[~gap]]
    if not len(out[0]):
        return out[0]
    if most >= 2:
        out.append(letters[:-1] << _BITS | letters[1:])
    if most >= 3:
        inner = ~gap[1:-1]
        out.append((letters[:-2] << 2 * _BITS | letters[1:-1] << _BITS | letters[2:])[inner])
    return np.concatenate(out)


def ranked(keys: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` most frequent keys, most frequent first, ties to the smaller key."""
    found, counts = np.unique(keys, return_counts=True)
    if len(found) > length:
        # only keys as frequent as the last that fits can be in the list
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        chosen = counts >= least
        found, counts = found[chosen], counts[chosen]
    return found[np.argsort(-counts, kind="stable")][:length]


class Profiles:
    """Languages with their ranked n-grams, as one sorted table of keys and ranks."""

    def __init__(self, profiles: dict[str, list[int]], length: int) -> None:
        self.languages = sorted(profiles)
        self.length = length
        self.keys = np.array(sorted({k for p in profiles.values() for k in p}), dtype=np.int64)
        self.ranks = np.full((len(self.keys), len(self.languages)), -1, dtype=np.int64)
        for j, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.keys, np.array(profiles[language], dtype=np.int64)), j] = np.arange(len(profiles[language]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest possible."""
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == own)[:, None], self.ranks[at], -1)
        cost = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(own))[:, None]))
        return cost.sum(0) / (self.length * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and a score: how much further the second one is, a half if it is as near."""
        own = ranked(grams(text), self.length)
        if not len(own) or not self.languages:
            return "und", 0.0
        d = self.distances(own)
        order = np.argsort(d, kind="stable")
        if len(order) == 1:
            return self.languages[0], float(1 - d[0])
        first, second = float(d[order[0]]), float(d[order[1]])
        return self.languages[order[0]], second / (first + second) if second else 0.5


def learn_profiles(labelled: DataFrame, lang: str = "lang", text: str = "text", length: int = 300, sample_per_language: int = 2000, doc_id: str = "doc_id") -> Profiles:
    """Profiles of the languages of labelled rows.

    About ``sample_per_language`` rows of each language are read, chosen by a hash
    of the id (all where there are fewer).  A row without language is no example.
    """
    rows = labelled.where(F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Profiles({}, length)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_per_language / n))))
    chosen = rows.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 20)) < F.try_element_at(share, F.col(lang)) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        pending = 0

        def rows_of() -> Iterator[pa.RecordBatch]:
            for language, parts in held.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[language].append(grams(body))
                pending += len(held[language][-1])
                if pending > 8_000_000:
                    yield from rows_of()
                    held.clear()
                    pending = 0
        yield from rows_of()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Totals of a gram are in one partition, so the best of all are among each partition's best."""
        top: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for batch in batches:
            for language, gram, n in zip(*(c.to_pylist() for c in batch.columns)):
                top[language].append((-n, gram))
                if len(top[language]) > 8 * length:
                    top[language] = sorted(top[language])[:length]
        rows = [(k, gram, -n) for k, v in top.items() for n, gram in sorted(v)[:length]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])

    kind = "lang string, gram long, n long"
    totals = chosen.select(lang, text).mapInArrow(trimmed(count), kind).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in totals.coalesce(8).mapInArrow(trimmed(best), kind).collect():
        found[r.lang].append((-r.n, r.gram))
    return Profiles({k: [g for _, g in sorted(v)[:length]] for k, v in found.items()}, length)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns of ``docs`` and the prediction for each whole text.

    Null text, or text without a letter, is ``und`` with score 0; so is every text
    if nothing was learned.  Columns named like the results are replaced.  Rows
    are judged one by one, so repeated rows repeat and an empty table stays empty.
    """
    schema = docs.drop(predicted, score).schema
    names = list(schema.names)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for body in batch.column(at):
                language, s = profiles.predict(body.as_py())
                langs.append(language)
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, predicted, score])

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(trimmed(run), T.StructType([*schema.fields, T.StructField(predicted, T.StringType()), T.StructField(score, T.DoubleType())]))


def fold(doc_id: Column, parts: int) -> Column:
    """The fold of a row: crc32 of its id in decimal, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
