"""Maximum inner product search: anisotropic product quantisation, four-bit tables, exact reranking.

A vector is cut in subspaces of a few dimensions, each coded by one of 16
centroids, and what that leaves is coded once more.  Codes and centroids minimise a
score-aware loss: the part of the residual parallel to the vector, which shifts its
inner products with the queries it is near to, costs more than the orthogonal part.
A query's inner products with all centroids are a table; blocks of candidates are
scanned through the tables.  A score differs from its approximation by at most the
product of the norms of the query and of the residual.  Only the candidates that this
bound lets among the best of a query are scored on the original vectors, so the
result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .shared import trimmed

CENTROIDS = 16


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances to the centroids, less the squared norm of the vector itself."""
    return (book**2).sum(1) - 2 * (x @ book.T)


class AnisotropicQuantiser:
    """Layers of codebooks, 16 centroids per subspace, for vectors of one dimension; a layer codes what those before it leave."""

    def __init__(self, layers: list[list[np.ndarray]], bounds: list[int], eta: float) -> None:
        self.layers, self.bounds, self.eta = layers, bounds, eta

    @classmethod
    def fit(cls, sample: np.ndarray, sub_dims: int = 2, threshold: float = 0.2, rounds: int = 4, seed: int = 7, layers: int = 2) -> "AnisotropicQuantiser":
        """Fit on a bounded sample; ``threshold`` is the cosine from which inner products matter."""
        x = np.asarray(sample, dtype=np.float64)
        d = x.shape[1]
        out = cls([], [*range(0, d, sub_dims), d], max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))
        unit, rng, left = x / np.linalg.norm(x, axis=1, keepdims=True), np.random.default_rng(seed), x
        for _ in range(layers):
            books = out._fit_layer(left, unit, rounds, rng)
            out.layers.append(books)
            left = left - out._decode_layer(books, out._encode_layer(books, left, unit))
        return out

    def _fit_layer(self, x: np.ndarray, unit: np.ndarray, rounds: int, rng: np.random.Generator) -> list[np.ndarray]:
        books = []
        for a, b in zip(self.bounds, self.bounds[1:]):
            part = x[:, a:b]
            book = part[rng.choice(len(part), CENTROIDS, replace=len(part) < CENTROIDS)].copy()
            for _ in range(8):
                near = _distances(part, book).argmin(1)
                for c in range(CENTROIDS):
                    if (near == c).any():
                        book[c] = part[near == c].mean(0)
            books.append(book)
        for _ in range(rounds):
            codes = self._encode_layer(books, x, unit)
            along = ((x - self._decode_layer(books, codes)) * unit).sum(1)
            for s, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
                u, part, book = unit[:, a:b], x[:, a:b], books[s]
                rest = along - (u * (part - book[codes[:, s]])).sum(1)
                for c in range(CENTROIDS):
                    m = codes[:, s] == c
                    if not m.any():
                        continue
                    w = (self.eta - 1) * u[m]
                    left = m.sum() * np.eye(b - a) + w.T @ u[m]
                    right = part[m].sum(0) + (w * (rest[m] + (u[m] * part[m]).sum(1))[:, None]).sum(0)
                    book[c] = np.linalg.solve(left, right)
                along = rest + (u * (part - book[codes[:, s]])).sum(1)
        return books

    def _encode_layer(self, books: list[np.ndarray], x: np.ndarray, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        codes = np.stack([_distances(x[:, a:b], book).argmin(1) for book, a, b in zip(books, self.bounds, self.bounds[1:])], 1)
        along = ((x - self._decode_layer(books, codes)) * unit).sum(1)
        for _ in range(sweeps):
            for s, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
                parallel = (unit[:, a:b] * x[:, a:b]).sum(1)[:, None] - unit[:, a:b] @ books[s].T
                rest = along - np.take_along_axis(parallel, codes[:, s : s + 1], 1)[:, 0]
                loss = _distances(x[:, a:b], books[s]) + (self.eta - 1) * (rest[:, None] + parallel) ** 2
                codes[:, s] = loss.argmin(1)
                along = rest + np.take_along_axis(parallel, codes[:, s : s + 1], 1)[:, 0]
        return codes.astype(np.uint8)

    @staticmethod
    def _decode_layer(books: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(books)], 1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on the score-aware loss, layer after layer."""
        left = np.asarray(x, dtype=np.float64)
        unit = left / np.maximum(np.linalg.norm(left, axis=1, keepdims=True), 1e-300)
        codes = []
        for books in self.layers:
            codes.append(self._encode_layer(books, left, unit))
            left = left - self._decode_layer(books, codes[-1])
        return np.concatenate(codes, 1)

    def parts(self, codes: np.ndarray) -> list[np.ndarray]:
        """What each layer adds to the vectors."""
        n = len(self.bounds) - 1
        return [self._decode_layer(books, codes[:, k * n : (k + 1) * n]) for k, books in enumerate(self.layers)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.parts(codes))

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte: a row per pair of tables, a column per vector."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=np.uint8)], 1)
        return np.ascontiguousarray((codes[:, ::2] << 4 | codes[:, 1::2]).T)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries with packed vectors, from the tables alone."""
        tables = [book @ queries[:, a:b].T for books in self.layers for book, a, b in zip(books, self.bounds, self.bounds[1:])]
        if len(tables) % 2:
            tables.append(np.zeros_like(tables[0]))
        # a line per vector: what a code adds to all queries lies together in memory
        out = np.zeros((packed.shape[1], len(queries)), dtype=np.float32)
        line = np.empty_like(out)
        for s in range(0, len(tables), 2):
            pair = (tables[s][:, None, :] + tables[s + 1][None, :, :]).reshape(-1, len(queries)).astype(np.float32)
            out += pair.take(packed[s // 2], axis=0, out=line, mode="clip")
        return np.ascontiguousarray(out.T)


def usable(embedding: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return embedding.isNotNull() & F.forall(embedding, finite) & F.exists(embedding, lambda v: v != 0)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of a row, ties to the smaller place."""
    if k < len(scores):
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        return np.concatenate([above, level[: k - len(above)]])
    return np.arange(len(scores))


class CandidateBlock:
    """Coded candidates: each distinct vector once, with the sorted ids that have it."""

    def __init__(self, quantiser: AnisotropicQuantiser, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None = None) -> None:
        x = np.ascontiguousarray(x) + 0.0  # one zero only
        _, first, group = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1])))[:, 0], return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        self.quantiser, self.x, self.ids = quantiser, x[first], ids[order]
        self.starts = np.searchsorted(group[order], np.arange(len(first) + 1))
        self.counts = np.diff(self.starts)
        self.groups_of: dict[int, list[int]] = {}
        for i, g in zip(ids.tolist(), group.tolist()):
            self.groups_of.setdefault(i, []).append(g)
        codes = quantiser.encode(self.x) if codes is None else codes[first]
        parts = quantiser.parts(codes)
        self.packed = quantiser.pack(codes)
        # what a query's norm is multiplied by: the residual, and the rounding of the scan's sums
        self.error = np.linalg.norm(self.x - sum(parts), axis=1) + (codes.shape[1] + 8) * 2.0**-23 * sum(np.linalg.norm(p, axis=1) for p in parts)
        self.largest = np.linalg.norm(self.x, axis=1).max()
        self.met = self.scored = 0  # pairs scanned through the codes, and those of them scored exactly

    def _kth(self, scores: np.ndarray, counts: np.ndarray, k: int) -> float:
        """The ``k``-th largest score where each counts as often as ids have it."""
        order = np.argsort(-scores)
        at = np.searchsorted(np.cumsum(counts[order]), k)
        return scores[order[at]] if at < len(order) else -np.inf

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query_id, ids, scores)`` of the ``k`` largest inner products of each query, ties to the smaller id."""
        norms = np.linalg.norm(queries, axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            bounds = self.quantiser.scan(queries, self.packed) + norms[:, None] * self.error
        bounds[~np.isfinite(bounds)] = np.inf
        slack = norms * self.largest * queries.shape[1] * 2.0**-50
        for q, line in enumerate(bounds):
            own = self.counts
            if int(query_ids[q]) in self.groups_of:
                own = own.copy()
                for g in self.groups_of[int(query_ids[q])]:
                    own[g] -= 1
            near = _best(line, rerank)
            least = self._kth((self.x[near] * queries[q]).sum(1), own[near], k)
            near = np.flatnonzero(line >= least - slack[q])
            exact = (self.x[near] * queries[q]).sum(1)
            self.met, self.scored = self.met + len(line), self.scored + len(near)
            limit = self._kth(exact, own[near], k)
            near, exact = near[exact >= limit], exact[exact >= limit]
            some = np.minimum(self.counts[near], k + len(self.groups_of.get(int(query_ids[q]), ())))
            ids = np.concatenate([self.ids[a : a + n] for a, n in zip(self.starts[near], some)]) if len(near) else self.ids[:0]
            scores = np.repeat(exact, some)
            ids, scores = ids[ids != query_ids[q]], scores[ids != query_ids[q]]
            order = np.lexsort((ids, -scores))[:k]
            yield int(query_ids[q]), ids[order], scores[order]


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = 8192, query_rows: int = 65_536, rerank: int = 120, fit_rows: int = 8000, dimension: int | None = None) -> DataFrame:
    """The ``k`` candidates of largest inner product for each query: ``query_id, rank, vec_id, score``.

    Every usable vector of the table's dimension (that of its smallest id unless
    given) is a candidate but for the query's own id.  Rows that repeat an id and
    its vector count once; ties go to the smaller id.  Fewer candidates than ``k``
    give as many rows; an empty table gives none.  The quantiser is fitted on
    about ``fit_rows`` vectors chosen by a hash of the id; every vector is coded.
    ``rerank`` candidates of a block are scored exactly to find what the others
    must reach; all whose bound reaches it are scored too, so nothing is missed.

    A vector is coded once, where it is read.  Work is a grid of candidate blocks of
    about ``block_rows`` rows and query blocks of about ``query_rows``; a task holds
    one block of candidates with its codes and streams queries, so a block of queries
    may be far larger.  Vectors of single precision travel as such.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[embedding].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    schema = "query_id long, rank int, vec_id long, score double"
    if dimension is None:
        first = rows.orderBy("vec_id").select(F.size("embedding").alias("d")).head(1)
        if not first:
            return spark.createDataFrame([], schema)
        dimension = first[0].d
    rows = rows.where(F.size("embedding") == dimension)
    total = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < min(1.0, fit_rows / max(1, total)) * (1 << 20)).select("embedding").collect()
    if not sample:
        sample = rows.select("embedding").limit(fit_rows).collect()
    quantiser = AnisotropicQuantiser.fit(np.array([r.embedding for r in sample]))
    n_blocks = max(1, -(-total // block_rows))
    query = is_query & F.col("vec_id").isNotNull()
    n_query_blocks = max(1, -(-rows.where(query).count() // query_rows))
    unique = rows.dropDuplicates(["vec_id", "embedding"])
    cells = lambda n, place: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), place)).alias("cell")
    own, own_query = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)), F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n_query_blocks))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(batch), dimension)
            codes = [c.tobytes() for c in quantiser.encode(x)] if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], names=["vec_id", "embedding", "codes"])

    coded = unique.select("vec_id", "embedding").mapInArrow(trimmed(code), f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, codes binary")
    candidates = coded.select(cells(n_query_blocks, lambda q: own * n_query_blocks + q), F.lit(0).alias("role"), "vec_id", "embedding", "codes")
    queries = unique.where(query).select(cells(n_blocks, lambda b: b * n_query_blocks + own_query), F.lit(1).alias("role"), "vec_id", "embedding", F.lit(None).cast("binary").alias("codes"))
    dealt = candidates.unionByName(queries).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "cell").sortWithinPartitions("cell", "role", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, block = None, [], None
        for batch in batches:
            cells, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            batch_ids = batch.column(2).to_numpy()
            x = batch.column(3).flatten().to_numpy().astype(np.float64).reshape(len(batch), dimension)
            edges = np.flatnonzero(np.diff(cells * 2 + roles)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(batch)]):
                if cells[lo] != cell:
                    cell, parts, block = cells[lo], [], None
                if roles[lo] == 0:
                    codes = np.frombuffer(b"".join(batch.column(4).slice(lo, hi - lo).to_pylist()), dtype=np.uint8).reshape(hi - lo, -1)
                    parts.append((batch_ids[lo:hi], x[lo:hi], codes))
                    continue
                if not parts and block is None:
                    continue
                if block is None:
                    block, parts = CandidateBlock(quantiser, *(np.concatenate(p) for p in zip(*parts))), []
                for at in range(lo, hi, 64):
                    end = min(at + 64, hi)
                    out: list[list] = [[], [], []]
                    for q, near, exact in block.nearest(batch_ids[at:end], x[at:end], k, rerank):
                        out[0] += [q] * len(near)
                        out[1] += near.tolist()
                        out[2] += exact.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(trimmed(run), "query_id long, vec_id long, score double")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
