"""Near duplicates: MinHash signatures in bands, verified on full shingle sets, joined by components.

Documents whose shingle sets are equal form a class; only the class's least
document goes on.  Signatures of many universal hash minima are cut in bands, in two
ways, and documents that agree on a band meet.  No bucket's pairs are ever listed:

1. each document is held against the least members of its buckets, of which the
   one it shares most bands with is verified on full texts; components follow;
2. buckets that still hold more than one component are compared in blocks by
   signature estimate, which joins components between which a link is possible to
   families; the documents of a family are compared on full texts, again in blocks,
   by counting intersections through shingle lists.  What lies in a key's largest
   component is never compared with itself.

Cells of blocks return forests, so nothing grows with the pairs of a bucket; and a
link between documents of one component changes nothing, so every link that
banding finds counts, whatever the size of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, shuffle_width, trimmed

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """64-bit hashes of the word shingles of a text, and MinHash signatures of their sets."""

    def __init__(self, words: int = 5, bands: int = 32, rows: int = 4, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        self.width, self.bands, self.rows = words, bands, rows
        letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) << _U(1) | _U(1)
        for upper in range(65, 91):  # A-Z alone are folded
            letters[upper] = letters[upper + 32]
        self.letters = letters
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        self.base = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)
        self.order = rng.integers(1, 1 << 62, words, dtype=np.uint64) << _U(1) | _U(1)
        n = bands * rows
        self.a = rng.integers(1, 1 << 31, n, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            base, inverse = _U(self.base), _U(pow(self.base, -1, 1 << 64))
            self.powers = np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, base, dtype=np.uint64))])
            self.inverse = np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, inverse, dtype=np.uint64))])

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of a text's shingles; the whole of a text of fewer words is one."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if not len(raw):
            return np.empty(0, dtype=np.uint64)
        self._grow(len(raw) + 1)
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = ~self.space[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.letters[raw] * self.powers[: len(raw)], out=sums[1:])
        words = _mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        n = max(1, len(words) - self.width + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(min(self.width, len(words))):
            out += _mix(words[j : j + n] * self.order[j])
        return np.unique(_mix(out + _U(min(self.width, len(words)))))

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of hash minima for each set, none of which is empty."""
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        x = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
        out = np.empty((len(sets), len(self.a)), dtype=np.uint32)
        held = np.empty_like(x)
        for i, (a, b) in enumerate(zip(self.a, self.b)):
            np.multiply(x, a, out=held)
            np.add(held, b, out=held)
            out[:, i] = np.minimum.reduceat(held, starts)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of each signature, the band's number mixed in.

        Minima are cut in bands twice, neighbours first and then every so many, so that
        no two bands have more than one minimum in common.
        """
        n = len(signatures)
        along, across = signatures.reshape(n, self.bands, self.rows), signatures.reshape(n, self.rows, self.bands).transpose(0, 2, 1)
        parts = np.concatenate([along, across], axis=1).astype(np.uint64)
        key = np.broadcast_to(np.arange(2 * self.bands, dtype=np.uint64), parts.shape[:2])
        for r in range(self.rows):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
        return key.view(np.int64)


_shinglers: dict[tuple, Shingler] = {}


def shingler(*settings: int) -> Shingler:
    if settings not in _shinglers:
        _shinglers[settings] = Shingler(*settings)
    return _shinglers[settings]


def sketch(docs: DataFrame, settings: tuple[int, ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, text_key, n_shingles, set_key`` (a digest of the set), ``signature`` and ``bands``; nulls for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shingler(*settings)
        for batch in batches:
            texts = batch.column(2)
            for at in range(0, len(texts), 256):
                sets = [s.shingles(t.as_py()) for t in texts.slice(at, 256)]
                full = [k for k, x in enumerate(sets) if len(x)]
                keys: list = [None] * len(sets)
                signatures: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if full:
                    found = s.signatures([sets[k] for k in full])
                    for k, sig, band in zip(full, found, s.band_keys(found)):
                        keys[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                        signatures[k] = sig.tobytes()
                        bands[k] = band
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), batch.column(1).slice(at, 256), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "signature", "bands"],
                )

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, text_key long, n_shingles long, set_key binary, signature binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, settings: tuple[int, ...], percent: int, width: int, chunk: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have ``100 * intersection >= percent * union``.

    The partners of one ``a`` are dealt in chunks of about ``chunk``; each chunk gets
    the text of ``a`` once, so an ``a`` of many partners fills many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, at, held = shingler(*settings), None, []
        for batch in batches:
            left, right = [], []
            for a, part, b, text in zip(*(batch.column(k) for k in range(4))):
                own = (a.as_py(), part.as_py())
                if own != at:
                    at, held = own, []
                x = s.shingles(text.as_py())
                if not b.is_valid:  # the texts of ``a`` come first
                    held.append(x)
                    continue
                for y in held:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        left.append(own[0])
                        right.append(b.as_py())
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    sizes = materialise(sizes, "near-chunks")
    leads = sizes.join(texts.withColumnRenamed("doc_id", "a").hint("merge"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    # dealt by the partner first: a hot ``a`` is no key of a join with texts
    partners = pairs.join(F.broadcast(sizes.where("parts > 1")), "a", "left") if sizes.where("parts > 1").count() <= MOST_HOT else pairs.join(sizes.hint("merge"), "a")
    partners = partners.withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).select("a", "part", "b")
    partners = partners.join(texts.withColumnRenamed("doc_id", "b").hint("merge"), "b").select("a", "part", "b", "text")
    dealt = leads.unionByName(partners).repartition(width, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(trimmed(run), "a long, b long")


#: Leads of several chunks that may be broadcast, two numbers each.
MOST_HOT = 200_000


class _Sets:
    """Union-find over the values of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.above = {int(v): int(v) for v in np.unique(values)}

    def top(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = x = self.above[self.above[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.top(x), self.top(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _cells(rows: DataFrame, key: str, width: int, weight: str | None = None, block: int = 1024, most_weight: int = 500_000) -> DataFrame:
    """Deal rows so that each two rows of a key that lie in different components meet in one cell ``(key, i, j)``.

    ``rows``: ``key, doc_id, component`` and more.  A key's largest component is not
    compared with itself: its blocks (``j`` below 0) meet only the blocks of the
    other rows, which also meet each other.  So rows travel as often as there are
    blocks of other rows, however large that component is.  A block holds about
    ``block`` rows, and no more than ``most_weight`` of ``weight``.
    """
    heavy = F.col(weight) if weight else F.lit(0)
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("n"), F.sum(heavy).alias("w"))
    sizes = materialise(sizes, "near-sizes")
    need = lambda n, w: F.greatest(F.ceil(n / block), F.ceil(w / most_weight)).cast("int")
    most = sizes.groupBy(key).agg(F.max(F.struct("n", (-F.col("component")).alias("c"), "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("components")).where("components > 1")
    most = most.select(key, (-F.col("top.c")).alias("main"), need(F.col("top.n"), F.col("top.w")).alias("main_blocks"), need(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("blocks"))
    placed = rows.join(materialise(most, "near-mains").hint("merge"), key)
    is_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("doc_id"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int")
    placed = placed.withColumn("own", F.when(is_main, -1 - own).otherwise(own))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    main = F.transform(to("blocks"), lambda o: cell(o, F.col("own")))
    rest = F.concat(F.transform(to("main_blocks"), lambda m: cell(F.col("own"), -1 - m)), F.transform(to("blocks"), lambda o: cell(F.least(o, F.col("own")), F.greatest(o, F.col("own")))))
    more = [c for c in rows.columns if c != key]
    dealt = placed.withColumn("cell", F.explode(F.when(is_main, main).otherwise(rest))).select(key, "cell.i", "cell.j", "own", *more)
    return dealt.repartition(width, key, "i", "j").sortWithinPartitions(key, "i", "j")


def _by_cell(batches: Iterator[pa.RecordBatch], compare) -> Iterator[pa.RecordBatch]:
    """Hand the rows of each cell to ``compare(rows, left, right)``, which returns links."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        own, i, j = rows.column("own").to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        # a block of few rows may be empty, and then its cells hold one side alone
        found = compare(rows, left, right) if len(left) and len(right) else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    last = None
    for batch in batches:
        keys = [batch.column(k).to_numpy() for k in range(3)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for lo, hi in zip([0, *change], [*change, len(batch)]):
            now = tuple(k[lo] for k in keys)
            if now != last and held:
                yield from flush()
            last = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from flush()


def possible_links(members: DataFrame, least_agree: int, width: int, block: int = 1024) -> DataFrame:
    """Links ``a, b`` that join all components of a bucket between which a link is possible.

    ``members``: ``key, doc_id, component, signature``.  Two documents
    may be linked if their signatures agree in ``least_agree`` places.  A cell
    returns a forest over its components, never its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(rows: pa.Table, left: np.ndarray, right: np.ndarray) -> list:
            comp = rows.column("component").to_numpy()
            if comp.min() == comp.max():
                return []
            ids = rows.column("doc_id").to_numpy()
            sigs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint32).reshape(len(rows), -1)
            sets, out = _Sets(comp), []
            for x in left:
                other = right[comp[right] != comp[x]]
                near = other[(sigs[other] == sigs[x]).sum(1) >= least_agree]
                out += [(int(ids[x]), int(ids[y])) for y in near if sets.join(int(comp[x]), int(comp[y]))]
            return out

        return _by_cell(batches, compare)

    return _cells(members, "key", width, block=block).mapInArrow(trimmed(run), "a long, b long").distinct()


def exact_links(members: DataFrame, settings: tuple[int, ...], percent: int, width: int, block: int = 1024) -> DataFrame:
    """Links between components of a family, from full sets: a forest per cell of all pairs that qualify.

    ``members``: ``family, doc_id, component, n_shingles, text``.  A cell counts the
    intersections of a document with all others at once, through lists of the
    documents that hold each shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shingler(*settings)

        def compare(rows: pa.Table, left: np.ndarray, right: np.ndarray) -> list:
            comp, ids = rows.column("component").to_numpy(), rows.column("doc_id").to_numpy()
            if comp.min() == comp.max():
                return []
            full = [s.shingles(t.as_py()) for t in rows.column("text")]
            sizes = np.array([len(x) for x in full])
            owner = np.repeat(np.arange(len(right)), sizes[right])
            every = np.concatenate([full[k] for k in right])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            sets, out = _Sets(comp), []
            for x in left:
                other = np.flatnonzero([sets.top(int(c)) for c in comp[right]] != np.int64(sets.top(int(comp[x]))))
                if not len(other):
                    continue
                lo, hi = np.searchsorted(every, full[x]), np.searchsorted(every, full[x], side="right")
                n = hi - lo
                ends = np.cumsum(n)
                at = np.repeat(lo - ends + n, n) + np.arange(ends[-1])
                common = np.bincount(owner[at], minlength=len(right))[other]
                linked = other[100 * common >= percent * (sizes[x] + sizes[right[other]] - common)]
                out += [(int(ids[x]), int(ids[right[y]])) for y in linked if sets.join(int(comp[x]), int(comp[right[y]]))]
            return out

        return _by_cell(batches, compare)

    return _cells(members, "family", width, "n_shingles", block).mapInArrow(trimmed(run), "a long, b long").distinct()


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, slack: float = 5.2, block: int = 1024, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    A text without words, or null, has an empty set: it is linked with nothing and
    kept.  Rows that repeat a ``doc_id`` are one node of the links.  A row without
    id is never linked: its component is null and it is kept.  An empty table gives
    no rows.  A link at the threshold shares no band of one cut with probability
    ``(1 - 0.75 ** rows) ** bands``, five in a million here, and none of both cuts
    with about one in a hundred million; ``slack`` is the number
    of standard deviations by which a link's estimate may fall short.
    """
    spark = docs.sparkSession
    settings, width = (words, bands, rows), shuffle_width(spark)
    sketches = materialise(sketch(docs, settings, doc_id, text), "near-sketches")
    classes = materialise(sketches.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("least")), "near-classes")
    # one row per class from here on, with the bands of its least document
    least = classes.select(F.col("least").alias("doc_id"), F.col("set_key").alias("of"))
    heads = sketches.where("set_key is not null").join(least.hint("merge"), "doc_id").where("set_key = of")
    buckets = materialise(heads.select("doc_id", F.explode("bands").alias("key")).distinct(), "near-bands")
    shared = buckets.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = materialise(buckets.join(materialise(shared, "near-buckets").hint("merge"), "key"), "near-members")
    candidates = materialise(members.select("doc_id").distinct(), "near-candidates")
    if candidates.count() <= broadcast_rows:  # ids alone, so some megabytes at most
        chosen = F.broadcast(candidates)
    else:
        chosen = candidates.hint("merge")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = source.join(chosen, "doc_id", "left_semi")
    # rows that repeat an id: one text of each of its sets stands for it
    again = materialise(sketches.where("set_key is not null and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "near-repeated")
    if again.head(1):
        keep = heads.join(again.hint("merge"), "doc_id", "left_semi").groupBy("doc_id", "set_key").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key")
        some = source.withColumn("text_key", F.xxhash64("text")).join(keep.hint("merge"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
        found = found.join(again.hint("merge"), "doc_id", "left_anti").unionByName(some.drop("text_key").join(chosen, "doc_id", "left_semi"))
    texts = materialise(found, "near-texts")

    # first round: the lead a document shares most bands with
    votes = members.where("doc_id <> lead").groupBy("doc_id", "lead").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("lead")).alias("lead"))).alias("top"))
    pairs = materialise(best.select((-F.col("top.lead")).alias("a"), F.col("doc_id").alias("b")), "near-pairs")
    links = materialise(verified(pairs, texts, settings, percent, width, block).distinct(), "near-links")
    found = materialise(components(links), "near-components")

    # second round: what buckets with several components still hide
    placed = members.select("key", "doc_id", "size").join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = materialise(placed, "near-placed")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    mixed = materialise(placed.join(materialise(several, "near-mixed").hint("merge"), "key"), "near-mixed-members")
    n = bands * rows
    share = percent / 100
    least_agree = int(np.floor(n * share - slack * np.sqrt(n * share * (1 - share))))
    signatures = heads.select("doc_id", "signature").dropDuplicates(["doc_id", "signature"])
    signed = mixed.join(signatures.hint("merge"), "doc_id").select("key", "doc_id", "component", "signature")
    possible = materialise(possible_links(signed, least_agree, width, block), "near-possible")
    if possible.head(1):
        # families: components that a chain of possible links joins; any link is inside one
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        families = materialise(components(stars.unionByName(possible)).select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "near-families")
        inside = mixed.select("doc_id", "component").distinct().join(families.hint("merge"), "doc_id")
        inside = materialise(inside, "near-inside")
        mixed_families = inside.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("family")
        weights = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
        inside = inside.join(materialise(mixed_families, "near-mixed-families").hint("merge"), "family", "left_semi").join(weights.hint("merge"), "doc_id").join(texts.hint("merge"), "doc_id")
        inside = inside.select("family", "doc_id", "component", "n_shingles", "text")
        # full sets are larger than signatures, so blocks are smaller
        late = materialise(exact_links(inside, settings, percent, width, max(1, block // 4)), "near-late-links")
        if late.head(1):
            # every node of a component links to its least, so the settled stars stand for the first round
            found = materialise(components(stars.unionByName(late)), "near-components")

    placed = classes.join(found.withColumnRenamed("node", "least").hint("merge"), "least", "left").select("set_key", F.coalesce("component", "least").alias("component"))
    placed = materialise(placed, "near-classes")
    result = sketches.select("doc_id", "n_shingles", "set_key").join(placed.hint("merge"), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
