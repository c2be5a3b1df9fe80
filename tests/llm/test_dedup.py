import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextvine.llm.components import components
from contextvine.llm.exact_dedup import ExtendibleIndex, exact_dedup
from contextvine.llm.near_dedup import Shingler, near_dedup
from tests.llm.conftest import EDGE


def test_index_splits_and_survives_its_file():
    rng, index = random.Random(1), ExtendibleIndex(5, 4)
    keys = [rng.getrandbits(59) for _ in range(2000)] + [7] * 20
    for place, k in enumerate(keys):
        index.insert((k, place, 1, 1, True))
    back = ExtendibleIndex.from_bytes(index.to_bytes())
    assert back.depth > 5 and len(back.lookup(7)) == 20 and all(back.lookup(k) for k in keys) and not back.lookup(8)
    assert all(len(held) <= 4 or len({e[0] for e in held}) == 1 for _, held in back.buckets)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i is not None and i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("key_bits, capacity", [(63, 256), (3, 2)])
def test_exact_dedup_on_edges(edge, key_bits, capacity):
    got = [tuple(r) for r in exact_dedup(edge, key_bits=key_bits, capacity=capacity).collect()]
    assert sorted(got, key=str) == brute_exact([(r[0], r[1]) for r in EDGE])
    assert exact_dedup(edge.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 480)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_near(rows):
    sets = brute_sets(rows)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations([i for i in sets if i is not None], 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {i: (len(s), None if i is None else find(i)) for i, s in sets.items()}


def check_near(df, rows, **options):
    want = brute_near(rows)
    got = near_dedup(df, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_near_dedup_on_edges(edge):
    check_near(edge, [(r[0], r[1]) for r in EDGE])
    assert near_dedup(edge.limit(0)).count() == 0


def test_families_cut_in_blocks(spark):
    """Chains of copies that drift apart: ends are not linked with each other, all are one component."""
    rng, rows = random.Random(5), []
    for family in range(4):
        words = [f"w{rng.randrange(9999)}" for _ in range(60)]
        for copy in range(25):
            rows.append((1000 * family + copy, " ".join(words)))
            words[rng.randrange(60)] = f"x{rng.randrange(9999)}"
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(df, rows, block=8)
    check_near(df.withColumn("text", F.col("text")), rows, broadcast_rows=0)


def test_shingle_sizes_and_estimates():
    s = Shingler()
    for text, n in [("", 0), (" \n", 0), ("a", 1), ("A b c d", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a a", 1)]:
        assert len(s.shingles(text)) == n
    assert (s.shingles("A B\tc\nd E") == s.shingles("a b c d e")).all() and len(s.shingles("É b c d e f g")) == 3
    x, y = (" ".join(f"w{k}" for k in range(a, a + 400)) for a in (0, 40))
    a, b = s.signatures([s.shingles(x), s.shingles(y)])
    assert abs((a == b).mean() - 356 / 436) < 0.12


@pytest.mark.parametrize("size, pairs", [(7, 40_000), (70, 18_000), (700, 4000)])
def test_pairs_at_the_threshold_meet(size, pairs):
    """Pairs of sets at a similarity of exactly 0.75: all share a band, and no estimate falls below the slack."""
    s, rng = Shingler(), np.random.default_rng(size)
    own = size // 7
    shared, bands, least = size - own, 0, 128
    for at in range(0, pairs, 2000):
        x = rng.integers(0, 1 << 63, (2000, shared + 2 * own), dtype=np.uint64) << np.uint64(1)
        a = s.signatures(list(x[:, : shared + own]))
        b = s.signatures(list(np.concatenate([x[:, :shared], x[:, shared + own :]], axis=1)))
        bands += int((s.band_keys(a) == s.band_keys(b)).any(1).sum())
        least = min(least, int((a == b).sum(1).min()))
    slack = 5.2 * np.sqrt(128 * 0.75 * 0.25)
    assert bands == pairs and least >= np.floor(128 * 0.75 - slack)


def test_hot_lead_and_repeated_rows(spark):
    """Hundreds of near copies of one text, in chunks of a few; rows that repeat; ids with several texts."""
    rng, rows = random.Random(8), []
    base = [f"w{k}" for k in range(80)]
    for copy in range(300):
        words = list(base)
        words[rng.randrange(80)] = f"x{copy}"
        rows.append((copy, " ".join(words)))
    far = [f"y{k}" for k in range(60)]
    close = [*far[:-1], "z"]
    rows += [(1000, " ".join(far)), (1001, " ".join(close))] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(df, rows, block=8)
    # an id whose rows hold two texts links with what either is close to
    two = [(5, " ".join(base)), (5, " ".join(far)), (7, " ".join([*base[:-1], "q"])), (9, " ".join(close)), (11, "alone")]
    got = {r.component_id for r in near_dedup(spark.createDataFrame(two, "doc_id long, text string")).collect() if r.doc_id != 11}
    assert got == {5}
