"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled documents is indexed with all its terms: per term a
posting list, cut in blocks of examples, with the largest weight of each block;
the most common terms, whose lists would be long, are columns of a matrix.  For a
document the blocks' upper bounds are summed over its terms; the blocks of highest
bound are scored, then all others whose bound can reach the k-th best similarity,
and what comes near it is summed again in double precision.  The votes of the
nearest, weighted by closeness, are turned into a probability by isotonic
regression over left-out votes of the examples.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, trimmed

_WORD = re.compile(r"\w+")

STEMS = (4,)  # lengths of beginnings of words that are terms besides the words: inflected forms share them


#: What of ASCII is no letter, digit or underscore is read as a space.
_ASCII = "".join(chr(c) if _WORD.match(chr(c)) else " " for c in range(128))
_BYTES = _ASCII.encode() + bytes(range(128, 256))


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case."""
    if not text:
        return []
    lower = text.lower()
    if lower.isascii():
        return lower.translate(_ASCII).split()
    parts = lower.encode("utf-8", "surrogatepass").translate(_BYTES).decode("utf-8", "surrogatepass").split()
    return [w for p in parts for w in ((p,) if p.isalnum() else _WORD.findall(p))]


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def count_terms(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words(text)).items():
        for t in terms_of(word):
            out[t] += n
    return out


class _Numbers(dict):
    """Numbers of terms; a word that is no term has the number of its longest beginning that is one, else ``none``."""

    def __init__(self, terms: list[str]) -> None:
        super().__init__(zip(terms, range(len(terms))))
        self.none = len(terms)

    def __missing__(self, word: str) -> int:
        for n in reversed(STEMS):
            if len(word) > n and (i := self.get(f"{word[:n]}*")) is not None:
                return i
        return self.none


class Vocabulary:
    """Places of a list of terms that holds the beginnings of its words."""

    def __init__(self, terms: list[str]) -> None:
        self.terms, self.at = terms, _Numbers(terms)
        # a word counts for the term it is or begins with and for the beginnings of that
        chains = [[i, *(self.at[f"{t[:n]}*"] for n in STEMS if n < len(t) - t.endswith("*"))] for i, t in enumerate(terms)]
        self.edges = np.cumsum([0, *map(len, chains), 0])
        self.places = np.fromiter(chain.from_iterable(chains), dtype=np.int64, count=self.edges[-1])

    def __reduce__(self):
        return Vocabulary, (self.terms,)

    def counts_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, term, count)`` of every term that a text holds, ascending."""
        seen = [Counter(words(t)) for t in texts]
        sizes = [len(s) for s in seen]
        word = np.fromiter(map(self.at.__getitem__, chain.from_iterable(seen)), dtype=np.int64, count=sum(sizes))
        times = np.fromiter(chain.from_iterable(s.values() for s in seen), dtype=np.int64, count=len(word))
        n, n_terms = self.edges[word + 1] - self.edges[word], max(1, len(self.terms))
        key, at = np.unique(np.repeat(np.repeat(np.arange(len(texts)), sizes), n) * n_terms + self.places[_ranges(self.edges[word], n)], return_inverse=True)
        return key // n_terms, key % n_terms, np.bincount(at, weights=np.repeat(times, n)).astype(np.int64)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms that a text holds, ascending, and how often."""
        return self.counts_of([text])[1:]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators; knots and their values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, w in zip(x[order], y[order], weight[order]):
        if blocks and blocks[-1][3] == a:  # equal inputs share a value
            blocks[-1][0] += b * w
            blocks[-1][1] += w
        else:
            blocks.append([b * w, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w2, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][3] = high
    knots = [k for b in blocks for k in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    values = [b[0] / b[1] for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
    return np.array(knots), np.array(values)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


#: A vector: ascending terms and their weights.
Sparse = tuple[np.ndarray, np.ndarray]


class BlockMaxIndex:
    """Examples as unit TF-IDF vectors; equal vectors stand once, with the examples that have them.

    Terms that more than ``common`` of the vectors hold, ``most_columns`` of them at
    most, are columns of a matrix; all others have posting lists cut in blocks.
    """

    def __init__(self, vectors: list[dict[int, float] | Sparse], labels: list[int], n_terms: int, block: int = 256, common: float = 0.03, most_columns: int = 4096, most_postings: int = 100_000) -> None:
        self.labels = np.array(labels, dtype=np.float64)
        groups: dict[bytes, list[int]] = {}
        distinct: list[Sparse] = []
        for i, v in enumerate(vectors):
            terms, weights = self._sparse(v)
            members = groups.setdefault(blake2b(terms.tobytes() + weights.tobytes(), digest_size=16).digest(), [])
            if not members:
                distinct.append((terms, weights))
            members.append(i)
        # examples with the same strongest terms stand together, so bounds of blocks differ
        order = sorted(range(len(distinct)), key=lambda i: (distinct[i][0][np.argsort(-distinct[i][1], kind="stable")[:3]].tolist(), i))
        held = list(groups.values())
        self.members = [np.array(held[i]) for i in order]
        distinct = [distinct[i] for i in order]
        self.block, self.n = block, len(distinct)
        self.n_blocks = -(-self.n // block)
        self.offsets = np.cumsum([0, *(len(t) for t, _ in distinct)])
        self.terms = np.concatenate([t for t, _ in distinct] or [np.empty(0)]).astype(np.int32)
        self.weights = np.concatenate([w for _, w in distinct] or [np.empty(0)]).astype(np.float64)
        self.n_terms, self.common, self.most_columns, self.most_postings = n_terms, common, most_columns, most_postings
        self._build()

    def __getstate__(self) -> dict:
        return {n: getattr(self, n) for n in ("labels", "members", "block", "n", "n_blocks", "offsets", "terms", "weights", "n_terms", "common", "most_columns", "most_postings")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._build()

    def _build(self) -> None:
        """The matrix and the lists; they are built where they are used, as they are larger than the vectors."""
        n_terms, block = self.n_terms, self.block
        seen = np.bincount(self.terms, minlength=n_terms)
        columns = np.argsort(-seen, kind="stable")[: self.most_columns]
        columns = columns[seen[columns] > self.common * self.n]
        self.column = np.full(n_terms, -1, dtype=np.int32)
        self.column[columns] = np.arange(len(columns))
        self.matrix = np.zeros((len(columns), self.n_blocks * block), dtype=np.float32)
        place = np.repeat(np.arange(self.n), np.diff(self.offsets))
        dense = self.column[self.terms] >= 0
        self.matrix[self.column[self.terms[dense]], place[dense]] = self.weights[dense]
        rare_terms, rare_places, rare_weights = self.terms[~dense], place[~dense], self.weights[~dense]
        by_term = np.lexsort((rare_places, rare_terms))
        rare_terms = rare_terms[by_term]
        self.places, self.values = rare_places[by_term].astype(np.int32), rare_weights[by_term]
        # a stretch is the part of a term's list in one block
        edge = np.flatnonzero(np.diff(rare_terms.astype(np.int64) * (self.n_blocks + 1) + self.places // block, prepend=-1))
        self.stretch_start = np.append(edge, len(rare_terms))
        self.stretch_block = self.places[edge] // block
        self.stretch_most = np.maximum.reduceat(self.values, edge) if len(edge) else np.empty(0)
        self.stretches = np.searchsorted(rare_terms[edge], np.arange(n_terms + 1)).astype(np.int32)
        self.postings = np.bincount(rare_terms, minlength=n_terms)
        self.slack = 4 * (len(columns) + 4) * 2.0**-24
        self.full = np.zeros(n_terms)  # a query's weights while it is scored

    @staticmethod
    def _sparse(v: dict[int, float] | Sparse) -> Sparse:
        if isinstance(v, dict):
            return np.array(sorted(v), dtype=np.int64), np.array([v[t] for t in sorted(v)], dtype=np.float64)
        return v

    def nearest(self, query: dict[int, float] | Sparse, k: int, without: int | None = None) -> list[tuple[float, int]]:
        """The ``k`` examples of largest positive cosine, ties to the earlier example: ``(similarity, example)``."""
        return self.nearest_of([query], k, [without])[0]

    def nearest_of(self, queries: list[dict[int, float] | Sparse], k: int, without: list[int | None]) -> list[list[tuple[float, int]]]:
        """The same for several queries at once."""
        queries = [self._sparse(q) for q in queries]
        out: list[list[tuple[float, int]]] = [[] for _ in queries]
        asked = [i for i, q in enumerate(queries) if len(q[0])] if self.n else []
        if not asked:
            return out
        common = np.zeros((len(asked), len(self.matrix) + 1), dtype=np.float32)  # the last place takes what is no column
        cost = np.zeros(len(asked), dtype=np.int64)
        for line, i in enumerate(asked):
            terms, weights = queries[i]
            common[line, self.column[terms]] = weights
            cost[line] = self.postings[terms].sum()
        common = common[:, :-1]
        scores = common @ self.matrix
        # as many queries at once as the lists they read allow
        group = (np.cumsum(cost) - cost) // self.most_postings
        for lines in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(group)) + 1):
            some = [asked[x] for x in lines]
            for i, found in zip(some, self._nearest([queries[i] for i in some], scores[lines], k, [without[i] for i in some])):
                out[i] = found
        return out

    def _nearest(self, queries: list[Sparse], scores: np.ndarray, k: int, without: list[int | None]) -> list[list[tuple[float, int]]]:
        size, shape = len(queries), (len(queries), self.n_blocks, self.block)
        terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        query = np.repeat(np.arange(size), [len(t) for t, _ in queries])
        rare = np.flatnonzero(self.postings[terms])
        first = self.stretches[terms[rare]]
        n = self.stretches[terms[rare] + 1] - first
        stretch, weight, query = _ranges(first, n), np.repeat(weights[rare], n), np.repeat(query[rare], n)
        cells = query * self.n_blocks + self.stretch_block[stretch]
        bound = scores.reshape(shape).max(2) + np.bincount(cells, weights=weight * self.stretch_most[stretch], minlength=size * self.n_blocks).reshape(size, -1)
        wanted = min(self.n, k + 1)  # one more than asked for, as a query may be an example itself
        head = min(self.n_blocks, -(-wanted // self.block) + 2)
        known = scores.astype(np.float64)
        known[:, self.n :] = -1.0
        open_ = np.zeros((size, self.n_blocks), dtype=bool)
        np.put_along_axis(open_, np.argpartition(-bound, head - 1, axis=1)[:, :head], True, axis=1)
        self._add(known, stretch, weight, query, open_.ravel()[cells])
        if head < self.n_blocks:
            least = self._kth(np.where(np.repeat(open_, self.block, axis=1), known, -1.0), wanted)
            more = ~open_ & (bound >= least[:, None] - self.slack)
            self._add(known, stretch, weight, query, more.ravel()[cells])
            known[~np.repeat(open_ | more, self.block, axis=1)] = -1.0
        least = self._kth(known, wanted)
        return [self._exact(q, np.flatnonzero((line >= low - self.slack) & (line > 0)), k, w) for q, line, low, w in zip(queries, known, least, without)]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> np.ndarray:
        at = scores.shape[1] - k
        return np.partition(scores, at, axis=1)[:, at]

    def _add(self, scores: np.ndarray, stretch: np.ndarray, weight: np.ndarray, query: np.ndarray, chosen: np.ndarray) -> None:
        """Add what the chosen stretches give to the scores of their queries."""
        stretch, weight, query = stretch[chosen], weight[chosen], query[chosen]
        lengths = self.stretch_start[stretch + 1] - self.stretch_start[stretch]
        at = _ranges(self.stretch_start[stretch], lengths)
        place = np.repeat(query * scores.shape[1], lengths) + self.places[at]
        scores += np.bincount(place, weights=np.repeat(weight, lengths) * self.values[at], minlength=scores.size).reshape(scores.shape)

    def _exact(self, query: Sparse, near: np.ndarray, k: int, without: int | None) -> list[tuple[float, int]]:
        """The ``k`` best of the examples ``near``, summed again in double precision."""
        if not len(near):
            return []
        terms, weights = query
        self.full[terms] = weights
        edges = list(zip(self.offsets[near].tolist(), self.offsets[near + 1].tolist()))
        parts = self.full[np.concatenate([self.terms[a:b] for a, b in edges])] * np.concatenate([self.weights[a:b] for a, b in edges])
        exact = np.add.reduceat(parts, np.cumsum([0, *(b - a for a, b in edges[:-1])]))
        self.full[terms] = 0.0
        best = sorted((-round(float(e), 12), int(i)) for p, e in zip(near, exact) for i in self.members[p][: k + 1] if e > 0 and i != without)[:k]
        return [(-e, i) for e, i in best]


class Model:
    """A vocabulary of terms with their weights, the index of examples and the calibration."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, examples: list[tuple[int | None, int, Sparse]], base_rate: float, k: int = 15) -> None:
        self.vocabulary = Vocabulary(vocabulary)
        self.weights, self.k = weights, k
        vectors = [self.vector(*counts) for _, _, counts in examples]
        labels = [y for _, y, _ in examples]
        self.ids = [i for i, _, _ in examples]
        self.index = BlockMaxIndex(vectors, labels, max(1, len(vocabulary)))
        self.labels = np.array(labels, dtype=np.float64)
        share = self.labels.mean() if labels else 0.0
        # the sample holds more toxic rows than the corpus: weights restore the rate of the labelled rows
        self.weight = {1: base_rate / share if share else 1.0, 0: (1 - base_rate) / (1 - share) if share < 1 else 1.0}
        votes = np.array([v for v, _ in self.votes(vectors, list(range(len(vectors))))])
        weights = np.array([self.weight[y] for y in labels])
        none = votes < 0
        mass, toxic = weights[none].sum(), (weights * self.labels)[none].sum() if labels else 0.0
        self.without = float((toxic + base_rate) / (mass + 1))
        self.knots, self.values = isotonic(votes[~none], self.labels[~none], weights[~none]) if (~none).any() else (np.array([0.0]), np.array([base_rate]))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> Sparse:
        raw = (1 + np.log(counts)) * self.weights[terms]
        return terms, raw / (math.sqrt((raw * raw).sum()) or 1.0)

    def votes(self, vectors: list[Sparse], without: list[int | None], at_once: int = 512) -> list[tuple[float, list[tuple[float, int]]]]:
        """Shares of toxic among the nearest, closer ones counting more; -1 where no example shares a term."""
        out = []
        for at in range(0, len(vectors), at_once):
            for near in self.index.nearest_of(vectors[at : at + at_once], self.k, without[at : at + at_once]):
                if not near:
                    out.append((-1.0, near))
                    continue
                closeness = np.array([self.weight[int(self.labels[e])] / (1.05 - min(1.0, s)) for s, e in near])
                out.append((float(closeness @ self.labels[[e for _, e in near]] / closeness.sum()), near))
        return out

    def scores(self, texts: list[str | None], at_once: int = 512) -> list[tuple[float, list[tuple[float, int]]]]:
        out = []
        for at in range(0, len(texts), at_once):
            some = texts[at : at + at_once]
            text, terms, counts = self.vocabulary.counts_of(some)
            edges = np.searchsorted(text, np.arange(len(some) + 1))
            voted = self.votes([self.vector(terms[a:b], counts[a:b]) for a, b in zip(edges, edges[1:])], [None] * len(some))
            out += [(self.without if vote < 0 else float(min(1.0, max(0.0, np.interp(vote, self.knots, self.values)))), near) for vote, near in voted]
        return out


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_toxic: int = 1500, sample_clean: int = 3000, sure_surprise: float = 15.0, sure_lift: float = 5.0, least_weight: float = 0.03, k: int = 15) -> Model:
    """Fit on a sample of at most about ``sample_toxic + sample_clean`` labelled rows, chosen by a hash of the id.

    ``labels`` holds the rows that may be learned from.  All terms of the sample
    count; their document frequencies come from all of ``docs``.  A term weighs its
    inverse document frequency times a factor: 1 from a log-likelihood ratio of
    ``sure_surprise`` and a frequency in toxic rows ``sure_lift`` times that in clean
    ones on, less below, and never less than ``least_weight``.  A label repeated for
    an id counts once, toxic if any row says so.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    base_rate = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
    limit = F.when(F.col("y") == 1, F.lit(min(1.0, sample_toxic / max(1, n_toxic)))).otherwise(F.lit(min(1.0, sample_clean / max(1, n_clean))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < limit * (1 << 20))
    # about sample_toxic + sample_clean rows of two numbers, whatever the size of the tables
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = count_terms(t)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([list(found)], pa.list_(pa.string())), pa.array([list(found.values())], pa.list_(pa.int32()))], names=["doc_id", "y", "terms", "counts"])

    sample = materialise(body.select("doc_id", "text", "y").mapInArrow(trimmed(tally), "doc_id long, y int, terms array<string>, counts array<int>"), "toxicity-sample")
    held = sample.toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    ids, y = held["doc_id"].to_pylist(), held["y"].to_numpy().astype(np.int64)
    lengths = pc.list_value_length(held["terms"]).to_numpy().astype(np.int64)
    coded = pc.list_flatten(held["terms"]).combine_chunks().dictionary_encode() if len(ids) else pa.array([], pa.string()).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    # frequent terms first: what most texts hold then lies close together in memory
    order = pc.sort_indices(coded.dictionary).to_numpy()
    order = order[np.argsort(-np.bincount(coded.indices.to_numpy(), minlength=len(order))[order], kind="stable")]
    vocabulary = coded.dictionary.take(pa.array(order)).to_pylist()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    terms = place[coded.indices.to_numpy()]
    counts = pc.list_flatten(held["counts"]).to_numpy() if len(ids) else np.empty(0)
    del held, coded
    toxic = np.repeat(y == 1, lengths)
    a, b = (np.bincount(terms[m], minlength=len(order)).astype(np.float64) for m in (toxic, ~toxic))
    factor = np.maximum(least_weight, _toxic_weight(a, b, int((y == 1).sum()), int((y == 0).sum()), sure_surprise, sure_lift))
    weights = inverse_frequencies(docs.select(F.col(text).alias("text")), vocabulary) * factor
    examples = []
    for i, label_, at, n in zip(ids, y.tolist(), (np.cumsum(lengths) - lengths).tolist(), lengths.tolist()):
        own = np.argsort(terms[at : at + n])
        examples.append((i, label_, (terms[at : at + n][own].astype(np.int32), counts[at : at + n][own])))
    del terms, counts, toxic
    return Model(vocabulary, weights, examples, base_rate, k)


def _toxic_weight(a: np.ndarray, b: np.ndarray, n1: int, n0: int, sure_surprise: float, sure_lift: float) -> np.ndarray:
    """From 0 to 1: how surely terms in ``a`` of ``n1`` toxic and ``b`` of ``n0`` clean rows are more frequent in toxic ones."""
    if not n1 or not n0:
        return np.ones(len(a))
    both, n = a + b, float(n1 + n0)
    part = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)
    surprise = 2 * (part(a, both * n1 / n) + part(b, both * n0 / n) + part(n1 - a, (n - both) * n1 / n) + part(n0 - b, (n - both) * n0 / n))
    lift = np.log(np.maximum(a * n0, 1e-300)) - np.log(np.maximum(b * n1, 1e-300))
    return np.clip(surprise / sure_surprise, 0, 1) ** 2 * np.clip(lift / math.log(sure_lift), 0, 1) ** 2


def inverse_frequencies(docs: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """Smoothed inverse document frequencies of a vocabulary over all rows of ``docs``."""
    known = Vocabulary(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            n += len(batch)
            for at in range(0, len(batch), 256):
                held += np.bincount(known.counts_of(batch.column(0).slice(at, 256).to_pylist())[1], minlength=len(held))
        met = np.flatnonzero(held)
        for at in range(0, len(met), 10_000):
            some = met[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], names=["term", "n"])

    if not vocabulary:
        return np.empty(0)
    found = docs.mapInArrow(trimmed(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found["term"].to_numpy(), found["n"].to_numpy()
    held, total = np.zeros(len(vocabulary)), n[term < 0].sum()
    held[term[term >= 0]] = n[term >= 0]
    return np.log((1 + total) / (1 + held)) + 1


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, evidence: int = 3) -> DataFrame:
    """One row per document: ``doc_id, score, predicted, evidence`` (ids of the nearest examples and their cosines).

    A null or empty text, like one without any term of the vocabulary, gets the
    calibrated rate of such examples.  Repeated rows repeat; empty stays empty.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # loaded once per worker, not per task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, ids, sims = [], [], []
            for s, near in model.scores(batch.column(1).to_pylist()):
                scores.append(s)
                ids.append([model.ids[e] for _, e in near[:evidence]])
                sims.append([c for c, _ in near[:evidence]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))], names=["doc_id", "score", "predicted", "evidence", "similarity"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, score double, predicted int, evidence array<long>, similarity array<double>")
