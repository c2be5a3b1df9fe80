"""Hard negatives, whitening and packing by squares: brute force, round trips and edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextvine.llm.hard_negatives import VantageTree, label_after, mine, usable_rows
from contextvine.llm.queries import QUERIES, vocabulary
from contextvine.llm.square_packing import SquarePacker, square_pack
from contextvine.llm.whitening import whiten

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def clashing(df):
    for name in ("x", "c", "dims", "bucket", "salt", "batch", "anchor", "rank", "n", "deviation", "component", "slot", "cell"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def brute_negatives(rows, k=5):
    rows = sorted({(i, label, tuple(x)) for i, label, x in rows})
    out = set()
    for a, own, v in rows:
        if a % 100:
            continue
        score = lambda x: sum(p * q for p, q in zip(v, x))  # noqa: B023, E731
        others = [(-score(x), i, label) for i, label, x in rows if i != a and len(x) == len(v)]
        for s, p, _ in sorted(o for o in others if o[2] == own)[:k]:
            window = sorted(o[:2] for o in others if o[2] != own and 80 * -s <= 100 * -o[0] <= 100 * -s)
            out |= {(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(window[:k])}
    return out


def test_negatives_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(1500)]
    # a third are copies of one anchor's vector, over several labels; some vectors are far away
    rows += [(i, rows[100][1], i % 3) for i in range(1500, 2200)] + [(i, [50.0 * v for v in rows[i - 2200][1]], 1) for i in range(2200, 2300)]
    held = usable_rows(clashing(spark.createDataFrame(rows, VECTORS)))
    got = [tuple(r) for r in mine(held, F.col("vec_id") % 100 == 0, block_rows=300).collect()]
    want = brute_negatives([tuple(r) for r in held.select("vec_id", "label", "x").collect()])
    assert len(got) == len(set(got)) and set(got) == want


def test_negatives_on_edges(spark):
    rows = [
        (0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (100, [0.0, 0.0], 1), (200, [], 2), (201, [], 2), (202, [], 3), (300, [1.0], 4), (1, [1.0, 0.5], 0), (2, [0.9, 0.5], 1), (3, [0.9, 0.5], 1), (3, [0.9, 0.5], 1),
        (4, [0.9, None], 1), (5, [NAN, 0.5], 1), (6, [INF, 0.5], 1), (8, None, 1), (9, [0.9, 0.5], None), (None, [0.9, 0.5], 1), (10, [0.0, 0.0], 1), (11, [0.0, 0.0], 2), (12, [-0.9, -0.5], 0),
    ]
    held = usable_rows(spark.createDataFrame(rows, VECTORS))
    got = [tuple(r) for r in mine(held, F.col("vec_id") % 100 == 0).collect()]
    want = brute_negatives([(r.vec_id, r.label, r.x) for r in held.collect()])
    assert len(got) == len(set(got)) and set(got) == want and {r[0] for r in got} == {0, 100, 200}
    assert mine(held.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert mine(held, F.col("vec_id") == 999).collect() == []
    moved = spark.createDataFrame([(7, 9), (8, 9), (14, None)], "i long, label int").select(label_after(F.col("i"), F.col("label")).alias("l"))
    assert [r.l for r in moved.collect()] == [0, 9, None]


def test_tree_reads_few_leaves_and_survives_storage():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (40, 16))
    x = np.rint(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 20, (4000, 16))).astype(np.int64)
    tree = VantageTree.from_bytes(VantageTree.build(np.arange(4000), np.zeros(4000, dtype=np.int64), x, leaf=16).to_bytes())
    assert sorted(tree.ids.tolist()) == list(range(4000)) and np.diff(tree.bounds).max() <= 16
    read = []
    plain = tree.scores
    tree.scores = lambda anchor, rows: read.append(len(rows)) or plain(anchor, rows)
    for a in range(20):
        least, most, _ = tree.leaf_bounds(x[a : a + 1])
        found = tree.nearest(x[a], least[0], most[0], [(-(1 << 62), 1 << 62)], 5, lambda rows: np.ones(len(rows), dtype=bool))[0]
        s = x @ x[a]
        assert found == [(int(s[i]), int(i)) for i in np.lexsort((np.arange(4000), -s))[:5]]
    assert sum(read) < 0.5 * 20 * 4000


def whitened_by_numpy(x):
    distinct = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(distinct.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    return distinct, values, (x - distinct.mean(0)) @ vectors / np.sqrt(values)


def test_whitening_by_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], dtype=np.float64))
    distinct, values, want = whitened_by_numpy(x)
    got = QUERIES["op13_whitening"](spark, sf_dir).orderBy("component", "vec_id").collect()
    assert len(got) == 4 * len(rows)
    for k in range(4):
        part = got[k * len(rows) : (k + 1) * len(rows)]
        mine_, theirs = np.array([r.whitened for r in part]), want[:, k]
        assert np.allclose(mine_ * np.sign(mine_ @ theirs), theirs, atol=1e-9)
        assert part[0].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    n, sums = len(distinct), distinct.sum(0).astype(int).tolist()
    assert [r.deviation for r in got[: len(rows)]] == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert all(r.n == n and r.identity_error < 1e-9 for r in got)


def test_whitening_far_from_the_origin_and_edges(spark):
    rng = np.random.default_rng(1)
    # a mean of 10^7 and copies that hold a third of the rows; the third dimension is the sum of two
    e = rng.normal(0, [3, 1], (300, 2)) + 1e7
    e = np.column_stack([e, e.sum(1)]).tolist()
    rows = [(i, v, 0) for i, v in enumerate(e)] + [(i, e[0], 0) for i in range(300, 450)]
    odd = [(900, None, 0), (901, [1.0, None, 2.0], 0), (902, [NAN, 1.0, 1.0], 0), (903, [1.0, INF, 1.0], 0), (904, [1.0], 0), (905, [], 0)]
    df = clashing(spark.createDataFrame(rows + odd + [(None, e[1], 0)], "vec_id long, embedding array<double>, label int"))
    got = whiten(df).collect()
    x = np.floor(256 * np.array([r[1] for r in rows]))
    distinct = np.unique(x, axis=0)
    assert {r.n for r in got} == {len(distinct)} and {r.component for r in got} <= {1, 2, 3} and len({r.vec_id for r in got}) == 451
    assert max(r.identity_error for r in got) < 1e-4
    total = {r.vec_id: int(r.deviation) for r in got}
    n, sums = len(distinct), [int(s) for s in distinct.astype(object).sum(0)]
    assert all(total[i] == sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums)) for i in (0, 7, 449))
    for none in (df.limit(0), df.where("vec_id = 3"), df.where("vec_id = 905")):
        assert whiten(none).collect() == []


def test_square_rule():
    # two gaps of 6 are open and one of 7: a piece of 3 takes a common gap and leaves the counts evener
    packer = SquarePacker(10)
    for gap in (6, 6, 7):
        packer.counts[gap] += 1
        packer.open[gap].append(packer.n)
        packer.n += 1
    for length in range(1, 8):
        squares = {}
        for gap in np.flatnonzero(packer.counts):
            if gap >= length:
                after = packer.counts.copy()
                after[gap] -= 1
                after[gap - length] += gap > length
                squares[int(gap)] = int((after**2).sum())
        assert packer.best_gap(length) == min(squares, key=lambda g: (squares[g], g))
    assert packer.best_gap(8) is None and packer.place(8) == (3, 0)


def check_packed(got, texts, size):
    """Every id of every document once, in order, no sequence too long, no gap between pieces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // size)
        assert all(r.length == size for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_sequence), sum(r.length for r in got)


def test_square_packing_of_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sequences, total = check_packed(QUERIES["op11_square_packing"](spark, sf_dir).collect(), texts, 2048)
    assert sequences <= -(-total // 2048) + 2


def test_square_packing_on_edges(spark, edge):
    rows = edge.collect()
    once = clashing(edge.where("doc_id is not null").dropDuplicates(["doc_id"]))
    check_packed(square_pack(once, vocabulary("byte_bpe_50k.json"), size=64, cell_pieces=4).collect(), {r.doc_id: r.text for r in once.collect()}, 64)
    got = square_pack(edge, vocabulary("byte_bpe_50k.json")).collect()
    assert sum(r.piece == 0 for r in got) == len(rows)
    assert square_pack(edge.limit(0), vocabulary("byte_bpe_50k.json")).collect() == []
