"""Suffix arrays, nodes, links and the search index against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from contextvine.operators import suffix_array as S
from contextvine.operators import words


def letters(seed, n, of="ACGTN"):
    rng = random.Random(seed)
    return "".join(rng.choice(of) for _ in range(n))


@pytest.fixture(scope="module")
def seqs(spark):
    block = letters(1, 130)
    rows = [("empty", ""), ("null", None), ("one", "A"), ("same", "A" * 150), ("cacac", "CACAC"), ("random", letters(2, 300, "ACGT")), ("repeats", block + "N" + block + "C" + block[40:]), ("tandem", "ACGTTGCA" * 20)]
    return spark.createDataFrame(rows, "seq_id string, seq string").withColumn("code", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def array(seqs):
    return S.suffix_array(seqs)


def texts(seqs):
    return {r.seq_id: r.seq for r in seqs.collect() if r.seq}


def test_order_and_common_prefixes(seqs, array):
    got = {}
    for r in array.table.collect():
        got.setdefault(r.seq_id, {})[r.place] = (r.pos, r.lcp)
    want = texts(seqs)
    assert got.keys() == want.keys() and len(array.names) > 2
    for name, text in want.items():
        order = sorted(range(len(text)), key=lambda i: text[i:])
        shared = [0]
        for a, b in zip(order, order[1:]):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            shared.append(n)
        assert [got[name][k] for k in range(len(text))] == list(zip(order, shared)), name


def test_nodes_and_links(seqs, array):
    nodes = S.tree_nodes(array).cache()
    want = {(r.seq_id, r.label): r.n for r in words.substring_labels(seqs.where("seq is not null").select("seq_id", "seq")).collect() if r.label}
    held = texts(seqs)
    rows = [(r.seq_id, held[r.seq_id][r.start : r.start + r.length], r.n) for r in nodes.collect()]
    assert len(rows) == len(want) and {(i, t): n for i, t, n in rows} == want
    links = S.suffix_links(nodes, array).collect()
    assert len(links) == len(want)
    for r in links:
        label = held[r.seq_id][r.start : r.start + r.length]
        if r.length == 1:
            assert (r.link_start, r.link_length) == (None, 0)
        elif (r.seq_id, label[1:]) in want:
            assert r.link_length == r.length - 1 and held[r.seq_id][r.link_start : r.link_start + r.link_length] == label[1:]
        else:
            assert r.n == 1 and r.link_length is None  # only a leaf's link can lie inside an edge


def test_index_equals_a_scan(spark, seqs, tmp_path):
    path, held = str(tmp_path / "index"), texts(seqs)
    plain = seqs.where("seq is not null").select("seq_id", "seq")
    S.write_index(plain, path)
    cut = [held["repeats"][5:29], held["repeats"][5:30], held["repeats"][10:90], held["same"][:60], held["tandem"][3:80]]
    patterns = spark.createDataFrame([(p,) for p in ("A", "CA", "N", "", "ACGTTGCAACGT", "T" * 40, "AX", "a", None, "A", *cut)], "pattern string")
    rows = lambda df: sorted((r.seq_id, r.pattern, r.pos) for r in df.select("seq_id", "pattern", "pos").collect())
    want = rows(words.search(plain, patterns.where("pattern is not null")))
    assert rows(S.search_index(spark, path, patterns)) == want
    for name, text in held.items():
        for p in cut:
            assert [i for i in range(len(text)) if text.startswith(p, i)] == [pos for i, q, pos in want if (i, q) == (name, p)]
    found = S.search_index(spark, path, patterns.where("pattern = 'CA'"))
    assert "PushedFilters: [" in found._jdf.queryExecution().toString() and "GreaterThanOrEqual(code" in found._jdf.queryExecution().toString()
    assert S.search_index(spark, path, patterns.limit(0)).collect() == []


def test_nothing(spark, seqs):
    for none in (seqs.limit(0), seqs.where("seq_id in ('empty', 'null')")):
        array = S.suffix_array(none)
        assert array.table.collect() == [] and S.suffix_links(S.tree_nodes(array), array).collect() == []
