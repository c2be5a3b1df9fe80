"""Hard negatives from vantage-point trees over norm-augmented vectors.

A coordinate ``sqrt(M^2 - |x|^2)`` more gives all vectors the norm M; an anchor
has 0 there.  Its distance to a vector then is ``|a|^2 + M^2 - 2 a.x`` under the
root, which falls as the inner product rises, so a window of scores is an annulus
around the anchor.  A tree cuts its rows at the median distance from a vantage
point, again and again; distances from an anchor to the vantage points bound its
distance to every leaf.  Leaves that can't meet the annulus are left out, the others
are read nearest first until nothing nearer can come.

Rows are dealt to blocks of bounded size and a tree is built once per block and
stored.  Batches of anchors meet the blocks: those of their own label for positives,
then all for negatives; what the blocks find is merged per anchor.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, shuffle_width, trimmed
from .whitening import usable, whole_numbers

LEAF = 64
BLOCK_ROWS = 16_384
BATCH = 1024  # anchors that meet a block in one task
_SLACK = 1e-6  # of the norms: more than rounding moves a distance, also near 0


class VantageTree:
    """Rows ``(id, label, vector of whole numbers)`` in the order of a tree's leaves.

    ``vantage`` are rows, level by level, with two children each; ``low`` and ``high``
    bound the distance of a node's rows to its parent's vantage point.  A leaf has a
    vantage point of its own too, the row next to its middle.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, most: float, vantage: np.ndarray, low: np.ndarray, high: np.ndarray, bounds: np.ndarray) -> None:
        self.ids, self.labels, self.x, self.most = ids, labels, x, float(most)
        self.vantage, self.low, self.high, self.bounds = vantage, low, high, bounds
        self.points = x[vantage].astype(np.float64).T
        # sums of products are exact in doubles while they stay below 2^53
        top = np.abs(x).max(initial=0).astype(float)
        self.exact = top * top * max(1, x.shape[1]) < 2.0**53
        self.fast = x.astype(np.float64) if self.exact else x
        self.norm2 = (x.astype(np.float64) ** 2).sum(1)

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 7) -> "VantageTree":
        """Every row once; a row that repeats another wholly is left out."""
        order = np.lexsort((*x.T[::-1], labels, ids))
        ids, labels, x = ids[order], labels[order], x[order]
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1]) & (x[1:] == x[:-1]).all(1)
        ids, labels, x = ids[~again], labels[~again], x[~again]
        f = x.astype(np.float64)
        norm2 = (f**2).sum(1)
        most = float(np.sqrt(norm2.max(initial=0)))
        f = np.concatenate([f, np.sqrt(np.maximum(most**2 - norm2, 0))[:, None]], 1)
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        rng, place, bounds = np.random.default_rng(seed), np.arange(len(ids)), np.array([0, len(ids)])
        vantage, low, high = [], [], []
        for _ in range(depth):
            cuts = [0]
            for a, b in zip(bounds, bounds[1:]):
                # the farthest of the rows from one of them stands at an edge, where distances spread most
                rows = place[a:b]
                start = rows[rng.integers(len(rows))]
                point = rows[((f[rows] - f[start]) ** 2).sum(1).argmax()]
                away = np.sqrt(((f[rows] - f[point]) ** 2).sum(1))
                near = np.argsort(away, kind="stable")
                place[a:b], away, mid = rows[near], away[near], (b - a) // 2
                vantage.append(point)
                for part in (away[:mid], away[mid:]):
                    low.append(part.min(initial=np.inf))
                    high.append(part.max(initial=-np.inf))
                cuts += [a + mid, b]
            bounds = np.array(cuts)
        for a, b in zip(bounds, bounds[1:]):
            rows = place[a:b]
            if len(rows):
                point = rows[((f[rows] - f[rows].mean(0)) ** 2).sum(1).argmin()]
                away = np.sqrt(((f[rows] - f[point]) ** 2).sum(1))
                vantage.append(point)
                low.append(away.min())
                high.append(away.max())
        where = np.empty(len(ids), dtype=np.int64)
        where[place] = np.arange(len(ids))
        return cls(ids[place], labels[place], x[place], most, where[np.array(vantage, dtype=np.int64)], np.array(low), np.array(high), bounds)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        fit = next((t for t in (np.int16, np.int32) if np.abs(self.x).max(initial=0) <= np.iinfo(t).max), np.int64)
        np.savez(out, ids=self.ids, labels=self.labels, x=self.x.astype(fit), most=self.most, vantage=self.vantage, low=self.low, high=self.high, bounds=self.bounds)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "VantageTree":
        with np.load(io.BytesIO(data)) as held:
            parts = {k: held[k] for k in held.files}
        return cls(**{**parts, "x": parts["x"].astype(np.int64), "most": float(parts["most"])})

    def scores(self, anchors: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        """Exact inner products in whole numbers."""
        if self.exact and np.abs(anchors).max(initial=0) ** 2 * max(1, anchors.shape[-1]) < 2.0**53:
            return np.rint(self.fast[rows] @ anchors.astype(np.float64)).astype(np.int64)
        return self.x[rows].astype(np.int64) @ anchors

    def leaf_bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least and largest score each anchor can have in each leaf, and a margin for rounding."""
        a = anchors.astype(np.float64)
        norm2 = (a**2).sum(1)
        near = np.zeros((len(a), 1))
        far = np.full((len(a), 1), np.inf)
        to_point = np.sqrt(np.maximum(norm2[:, None] + self.most**2 - 2 * (a @ self.points), 0))
        at, width, leaves = 0, 1, len(self.bounds) - 1
        while width < leaves:
            d = np.repeat(to_point[:, at : at + width], 2, axis=1)
            low, high = self.low[2 * at : 2 * (at + width)], self.high[2 * at : 2 * (at + width)]
            near = np.maximum(np.repeat(near, 2, axis=1), np.maximum(d - high, low - d))
            far = np.minimum(np.repeat(far, 2, axis=1), d + high)
            at, width = at + width, 2 * width
        d, low, high = to_point[:, at:], self.low[2 * at :], self.high[2 * at :]
        near, far = np.maximum(near, np.maximum(d - high, low - d)), np.minimum(far, d + high)
        slack = _SLACK * (np.sqrt(norm2) + self.most + 1)[:, None]
        reach = norm2[:, None] + self.most**2
        with np.errstate(over="ignore", invalid="ignore"):
            return (reach - (far + slack) ** 2) / 2, (reach - np.maximum(near - slack, 0) ** 2) / 2, slack[:, 0]

    def nearest(self, anchor: np.ndarray, least: np.ndarray, most: np.ndarray, windows: list[tuple[int, int]], k: int, wanted) -> list[list[tuple[int, int]]]:
        """For each window of scores its first ``k`` rows ``(score, id)``, larger scores first, ties by smaller id.

        ``least`` and ``most``: a leaf's bounds of scores for this anchor; ``wanted``
        tells which of some rows may be returned.  One traversal serves all windows.
        """
        bottom, top = min(w[0] for w in windows), max(w[1] for w in windows)
        leaves = np.flatnonzero((most >= bottom) & (least <= top) & (self.bounds[1:] > self.bounds[:-1]))
        leaves = leaves[np.argsort(-most[leaves], kind="stable")]
        held_s, held_i = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        at, some = 0, 2
        while at < len(leaves):
            batch = leaves[at : at + some]
            rows = np.concatenate([np.arange(self.bounds[leaf], self.bounds[leaf + 1]) for leaf in batch])
            s = self.scores(anchor, rows)
            kept = (s >= bottom) & (s <= top)
            rows, s = rows[kept], s[kept]
            kept = wanted(rows)
            held_s, held_i = np.concatenate([held_s, s[kept]]), np.concatenate([held_i, self.ids[rows[kept]]])
            order = np.lexsort((held_i, -held_s))
            held_s, held_i = held_s[order], held_i[order]
            at, some = at + some, min(2 * some, 16)
            # what is left reaches at most this score; a window is full when its k-th is above it
            left = most[leaves[at]] if at < len(leaves) else -np.inf
            open_, needed = False, 0
            for n, (lo, hi) in enumerate(windows):
                first = int(np.searchsorted(-held_s, -hi, side="left"))
                last = min(first + k, int(np.searchsorted(-held_s, -lo, side="right")))
                found[n] = list(zip(held_s[first:last].tolist(), held_i[first:last].tolist()))
                full = last - first == k and held_s[last - 1] > left
                open_ |= not full and left >= lo
                needed = max(needed, first + k)
            if not open_:
                break
            # rows behind every window's k-th never return
            held_s, held_i = held_s[:needed], held_i[:needed]
        return found


def label_after(vec_id: Column, label: Column, divisor: int = 7, classes: int = 10) -> Column:
    """Labels of every ``divisor``-th id move to the next class: noise that mining has to stand."""
    return F.when(vec_id % divisor == 0, (label + 1) % classes).otherwise(label)


def usable_rows(embeddings: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """``vec_id, label, x``: rows with an id, a label and a whole vector, in whole numbers."""
    e = F.col("_e")
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("_e"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(e)).select("vec_id", "label", whole_numbers(e).alias("x"))


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``dims, bucket, salt, n_salts, tree``: every row of ``vec_id, label, x`` in a stored tree.

    Vectors of one length and labels of one hash bucket share blocks; a bucket with
    more than ``block_rows`` rows (its label or a group of copies may hold a third of
    them) is dealt to several by a hash of the id.  Rows that repeat wholly meet in a
    block and count once.  An empty table has no blocks.
    """
    spark = rows.sparkSession
    rows = materialise(rows.select("vec_id", "label", "x"), "negatives-rows")
    width = max(1, -(-rows.count() // block_rows))
    keyed = rows.withColumn("dims", F.size("x")).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(width)).cast("int"))
    # as many rows as blocks: the table's rows over block_rows at most for each length of vectors
    sizes = keyed.groupBy("dims", "bucket").agg((F.floor((F.count("*") - 1) / block_rows) + 1).cast("int").alias("n_salts"))
    placed = keyed.join(sizes, ["dims", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("n_salts")).cast("int"))

    def run(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, bucket, salt, n_salts = (k.as_py() for k in key)
        batches = [(b.column("vec_id").to_numpy(), b.column("label").to_numpy(), b.column("x").flatten().to_numpy().reshape(b.num_rows, dims)) for b in group]
        ids, labels, x = (np.concatenate(c) for c in zip(*batches))
        tree = VantageTree.build(ids, labels, x).to_bytes()
        yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "salt": pa.array([salt], pa.int32()), "n_salts": pa.array([n_salts], pa.int32()), "tree": pa.array([tree], pa.binary())})

    grouped = placed.select("dims", "bucket", "salt", "n_salts", "vec_id", "label", "x").groupBy("dims", "bucket", "salt", "n_salts")
    return materialise(grouped.applyInArrow(run, "dims int, bucket int, salt int, n_salts int, tree binary"), "negatives-trees")


def _meet(anchors: DataFrame, index: DataFrame, own_label: bool, per_anchor, schema: str, n_batches: int, width: int) -> DataFrame:
    """``per_anchor(tree, row of arrays, place)`` over every batch of anchors and every block it has to meet.

    A row of ``anchors`` names its batch and, where only its own label is wanted, its
    bucket.  Anchors go to blocks and trees to batches, so a cell holds a tree and a
    batch, whatever the tables hold.
    """
    blocks = index.select("dims", "bucket", "salt")
    keys = ["dims", "bucket"] if own_label else ["dims"]
    # a stated set of queries against all rows in blocks
    left = anchors.join(F.broadcast(blocks) if n_batches == 1 else blocks, keys)
    right = index.select(*(F.col(c).alias(c) for c in index.columns)).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
    cell = ["dims", "bucket", "salt", "batch"]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if one.num_rows and two.num_rows:
            tree = VantageTree.from_bytes(two["tree"][0].as_py())
            for row in per_anchor(tree, one):
                for column, value in zip(out, row):
                    column.append(value)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, out)})

    first, second = (df.repartition(width, *cell).groupBy(*cell) for df in (left, right))
    return first.cogroup(second).applyInArrow(run, schema)


def _vectors(table: pa.Table) -> np.ndarray:
    x = table["x"].combine_chunks()
    return x.flatten().to_numpy().reshape(table.num_rows, len(x[0]))


def mine(rows: DataFrame, anchors: Column, k_positive: int = 5, k_negative: int = 5, least_percent: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The first negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows``: ``vec_id, label, x`` (see ``usable_rows``); ``anchors``: a condition on
    them.  An anchor's positives are its first ``k_positive`` other rows of the same
    label by inner product, ties by smaller id; negatives are rows of another label
    whose score is at most the positive's and at least ``least_percent`` of it.

    Rows that repeat wholly count once.  Rows of one id that differ are rows of their
    own, but never an anchor's positive or negative if they have its id.  Vectors of
    different lengths don't meet.  Anchors without positive, and positives without a
    negative in the window, have no rows; nor has an empty table.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build_index(rows, block_rows)
    chosen = rows.where(anchors).select("vec_id", "label", "x").dropDuplicates()
    n = chosen.count()
    if not n:
        return spark.createDataFrame([], schema)
    n_batches = -(-n // BATCH)
    # as build_index dealt labels
    width = max(1, -(-rows.count() // block_rows))
    own = chosen.select(F.col("vec_id").alias("anchor_id"), "label", "x", F.size("x").alias("dims"), F.xxhash64("vec_id", "label", "x").alias("anchor"))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(width)).cast("int")).withColumn("batch", F.pmod(F.xxhash64("anchor"), F.lit(n_batches)).cast("int"))
    own = materialise(own, "negatives-anchors")
    tasks = max(shuffle_width(spark), min(index.count() * n_batches, 100_000))

    def positives(tree: VantageTree, table: pa.Table):
        x, ids, labels, keys = _vectors(table), *(table[c].to_numpy() for c in ("anchor_id", "label", "anchor"))
        least, most, _ = tree.leaf_bounds(x)
        everything = [(-(1 << 62), 1 << 62)]
        for k in range(len(x)):
            wanted = lambda r: (tree.labels[r] == labels[k]) & (tree.ids[r] != ids[k])  # noqa: B023, E731
            for score, i in tree.nearest(x[k], least[k], most[k], everything, k_positive, wanted)[0]:
                yield int(keys[k]), i, score

    def first(df: DataFrame, by: list[str], score: str, id_: str, k: int) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_))
        return df.withColumn("rank", nth).where(F.col("rank") <= k)

    met = _meet(own, index, True, positives, "anchor long, positive_id long, positive_score long", n_batches, tasks)
    found = first(met, ["anchor"], "positive_score", "positive_id", k_positive).select("anchor", "positive_id", "positive_score", F.col("rank").alias("nth"))
    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("positives"))
    asked = materialise(own.drop("bucket").join(windows, "anchor"), "negatives-windows")

    def negatives(tree: VantageTree, table: pa.Table):
        x, ids, labels, keys = _vectors(table), *(table[c].to_numpy() for c in ("anchor_id", "label", "anchor"))
        least, most, _ = tree.leaf_bounds(x)
        asked_for = table["positives"].to_pylist()
        for k in range(len(x)):
            scores = [p["positive_score"] for p in asked_for[k]]
            windows = [(-(-least_percent * s // 100), s) for s in scores]
            wanted = lambda r: (tree.labels[r] != labels[k]) & (tree.ids[r] != ids[k])  # noqa: B023, E731
            for p, rows_ in zip(asked_for[k], tree.nearest(x[k], least[k], most[k], windows, k_negative, wanted)):
                for score, i in rows_:
                    yield int(keys[k]), p["nth"], i, score

    met = _meet(asked, index, False, negatives, "anchor long, nth long, negative_id long, negative_score long", n_batches, tasks)
    best = first(met, ["anchor", "nth"], "negative_score", "negative_id", k_negative)
    each = asked.select("anchor", "anchor_id", F.explode("positives").alias("p")).select("anchor", "anchor_id", F.col("p.nth").cast("long").alias("nth"), "p.positive_id", "p.positive_score")
    return best.join(each, ["anchor", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
