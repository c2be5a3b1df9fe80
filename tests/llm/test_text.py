import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextvine.llm import ann, langid, secrets, toxicity, warc
from tests.llm.conftest import EDGE


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("top", F.lit("clash")).withColumn("payload", F.lit("clash"))


PAGES = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nX: y", None), (4, "é", ""), (5, "z", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "big", "ü" * 300_000), (7, "t", "<p>x</p>"), (7, "t", "<p>x</p>"), (None, "n", "only here")]


def test_archives_round_trip(spark):
    written = warc.write_archives(pages_frame(spark, PAGES))
    got = sorted((tuple(r) for r in warc.read_archives(warc.normalise_archives(written), block_records=2).collect()), key=str)
    top = {}
    for i, _, h in PAGES:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        raw, first = (h or "").encode(), i is not None and i == top[h or ""]
        want.append((i, len(raw), warc.digest32(raw), "response" if first or top[h or ""] == -1 else "revisit", None if first or top[h or ""] == -1 else top[h or ""]))
    assert got == sorted(want, key=str)
    empty = warc.write_archives(pages_frame(spark, PAGES).limit(0))
    assert warc.read_archives(warc.normalise_archives(empty)).count() == 0


def test_sidecar_is_read_in_ranges(tmp_path):
    records = [warc.record("response", k, f"u{k}", bytes([65 + k % 26]) * (k * 700), warc.digest32(b"")) for k in range(50)]
    raw = zlib.compressobj(6, zlib.DEFLATED, 31)
    source, out, side = io.BytesIO(raw.compress(b"".join(records)) + raw.flush()), io.BytesIO(), io.BytesIO()
    for entry in warc.normalised(source, out):
        side.write(warc.sidecar_entry(*entry))
    assert len(side.getvalue()) == 50 * warc.ENTRY.size

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.taken += len(got)
            return got

    for first, n in ((0, 50), (17, 10), (45, 10)):
        Counted.taken = 0
        entries = warc.read_sidecar(Counted(side.getvalue()), first, n)
        assert Counted.taken <= n * warc.ENTRY.size
        members = list(warc.read_members(io.BytesIO(out.getvalue()), entries, most_bytes=2000))
        assert [zlib.decompress(m, 31) for _, m in members] == records[first : first + n]


def test_each_member_stands_alone():
    records = [warc.record("response", k, f"u{k}", bytes([65 + k]) * (k * 70_000), warc.digest32(b"")) for k in range(5)]
    whole, out = zlib.compressobj(6, zlib.DEFLATED, 31), io.BytesIO()
    source = io.BytesIO(whole.compress(b"".join(records)) + whole.flush())
    index = warc.normalise(source, out)
    raw = out.getvalue()
    assert [zlib.decompress(raw[at : at + n], 31) for at, n, _, _ in index] == records and index[-1][0] + index[-1][1] == len(raw)
    assert b"".join(warc.inflate(io.BytesIO(raw), 1000)) == b"".join(records)  # many members, small pieces
    with pytest.raises(EOFError):
        list(warc.inflate(io.BytesIO(raw[:-10])))


def test_language(spark, edge):
    rng, rows = random.Random(6), []
    syllables = {"aa": ["ka", "li", "mo", "ta"], "bb": ["sch", "ung", "er", "eit"], "cc": ["çã", "õe", "nh", "os"]}
    for i in range(240):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(30)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(df.where("doc_id < 120"), length=50)
    assert all(r.lang == r.lang_pred and 0.5 <= r.score <= 1 for r in langid.identify(df, profiles).collect())
    judged = langid.identify(edge, profiles).collect()
    assert len(judged) == len(EDGE) and set(judged[0].asDict()) == {*edge.columns, "lang_pred"}
    for r in judged:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.score <= 1
    nothing = langid.learn_profiles(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"} and langid.identify(df.limit(0), profiles).count() == 0
    assert spark.range(1).select(langid.fold(F.lit(17), 3).alias("f")).head().f == zlib.crc32(b"17") % 3


def test_out_of_place_distance():
    p = langid.Profiles({"x": [1, 2, 3], "y": [9, 8, 1]}, 3)
    # against x: ranks 0, 2, 1 for 1, 3, 2; against y: 1 is two places off, the others are missing
    assert p.distances(np.array([1, 3, 2])).tolist() == pytest.approx([2 / 9, 8 / 9])


KINDS = {"assign": (re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}


def brute_spans(text):
    out = []
    for n, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        out += [(m.start(), n, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def test_secret_spans(spark, edge):
    rng = random.Random(7)
    parts = ["password=", "Token : ", "api_key='", "SECRET\":\"", "abc", "abcdef", "AKIA", "ABCDEFGHIJ012345", "0123456789abcdef", "é👍", " ", "\n", "=", "apikey", "passwd:", "bearer "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), "en", f"s{i % 5}") for i in range(400)] + [(9000 + r[0] if r[0] is not None else None, r[1], r[2], r[3]) for r in EDGE]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("hash", F.lit("clash")).withColumn("owner", F.lit("clash"))
    got = secrets.secret_scan(df).collect()
    assert len(got) == len(rows)
    want = sorted((i, *(sum(s[2] == k for s in brute_spans(t or "")) for k in KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_spans(t or "")).encode()).hexdigest()) for i, t, *_ in rows if i is not None)
    assert sorted(tuple(r)[:5] for r in got if r.doc_id is not None) == want
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            assert set(f"{k}:{a}:{b}" for a, _, k, b in brute_spans(rows[r.doc_id][1])) <= set(r.spans.split(",")) | {""}
    assert secrets.secret_scan(edge.limit(0)).count() == 0


def test_ownership_tells_examples_from_live_values(spark):
    rows = [(i, "password=sharedvalue1", f"owner{i}") for i in range(6)] + [(10, "x token=onlymine77 y", "owner1"), (11, "token=example_value", "owner2"), (12, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_live, r.n_copied) for r in secrets.secret_scan(df).collect()}
    assert got == {**{i: (0, 1) for i in range(6)}, 10: (1, 0), 11: (0, 1), 12: (0, 0)}
    redacted = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert redacted == {**{i: t for i, t, _ in rows}, 10: "x [SECRET] y"}


def test_nearest_examples_are_exact():
    rng = random.Random(8)
    unit = lambda v: {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()}
    vectors = [unit({rng.randrange(40): rng.random() + 0.1 for _ in range(rng.randint(1, 6))}) for _ in range(300)]
    index = toxicity.BlockMaxIndex(vectors, [i % 2 for i in range(300)], 40, block=16)
    for q in vectors[:60]:
        brute = sorted((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors))
        want = [(i, -s) for s, i in brute if s < 0][:10]
        assert [(i, pytest.approx(s)) for s, i in index.nearest(q, 10)] == want
    assert index.nearest({}, 5) == []


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.0, 0.1, 0.2, 0.2, 0.9]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]), np.ones(5))
    assert np.interp([0, 0.1, 0.2, 0.9], x, y).tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1])


def test_toxicity(spark, edge):
    rng = random.Random(9)
    clean = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(rng.choice(clean) for _ in range(40)) + (" " + rng.choice(["vile", "nasty", "viler"]) if i % 7 == 0 else ""), int(i % 7 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held_out = [(got[i].predicted, y) for i, _, y in rows if i >= 400]
    assert sum(p == y for p, y in held_out) >= 0.97 * len(held_out)
    judged = toxicity.score(edge, model).collect()
    assert len(judged) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in judged)
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.learn(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}


def test_toxicity_finds_a_copy_without_frequent_toxic_words(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(200)]) for _ in range(30)) + (" vile" if i % 7 == 0 and i != 210 else ""), int(i % 7 == 0)) for i in range(420)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, rows[210][1]), (1001, rows[5][1])], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for copy, example in ((1000, 210), (1001, 5)):
        assert got[copy].evidence[0] == example and got[copy].similarity[0] == pytest.approx(1.0)


def test_nearest_with_lists_and_columns():
    rng = random.Random(14)
    unit = lambda v: {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()}
    vectors = [unit({int(400 * rng.random() ** 3): rng.random() + 0.1 for _ in range(rng.randint(1, 12))}) for _ in range(400)]
    vectors += vectors[:100]  # equal ones
    index = toxicity.BlockMaxIndex(vectors, [0] * 500, 400, block=16)
    assert 0 < len(index.matrix) < 400 and len(index.places)
    for i, q in enumerate(vectors[:120]):
        brute = sorted((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), j) for j, v in enumerate(vectors) if j != i)
        assert [(j, pytest.approx(s)) for s, j in index.nearest(q, 10, i)] == [(j, -s) for s, j in brute if s < 0][:10]


def brute_search(rows, k, is_query):
    out = []
    for i, q in sorted(rows.items()):
        if is_query(i):
            near = sorted(((-float((np.array(q, dtype=np.float64) * np.array(v, dtype=np.float64)).sum()), j) for j, v in rows.items() if j != i))[:k]
            out += [(i, n + 1, j) for n, (_, j) in enumerate(near)]
    return out


def test_search(spark):
    rng = np.random.default_rng(10)
    vectors = {i: rng.normal(size=16).astype(np.float32).tolist() for i in range(900)}
    for i in range(300, 340):  # equal vectors: ties by id
        vectors[i] = vectors[300]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] * 16), (2005, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([*vectors.items(), *list(vectors.items())[:3], *bad], "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0, block_rows=200).orderBy("query_id", "rank").collect()]
    want = brute_search(vectors, 20, lambda i: i % 20 == 0)
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.98 * len(want)
    assert [r for r in got if r[0] in (300, 320)] == [r for r in want if r[0] in (300, 320)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id < 5"), F.lit(True)).collect()
    assert len(few) == 20 and max(r["rank"] for r in few) == 4


def test_search_finds_all_among_near_copies(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 32))
    x[::3] = x[0] + 0.02 * rng.normal(size=(1000, 32))
    x[1::30] = x[1]  # and exact copies
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = dict(enumerate(x.tolist()))
    df = spark.createDataFrame([*vectors.items()], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    want = brute_search(vectors, 20, lambda i: i % 50 == 0)
    found = len({(q, i) for q, _, i in got} & {(q, i) for q, _, i in want}) / len(want)
    assert found == 1.0 and got == want, found


def test_codes_leave_few_candidates_to_exact_scores(spark):
    rng = np.random.default_rng(13)
    given = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").orderBy("vec_id").collect()]
    for x in (np.array(given), rng.normal(size=(20_000, 64))):
        x = x.astype(np.float32).astype(np.float64)
        ids, asked = np.arange(len(x)), np.arange(0, len(x), 20)[:200]
        block = ann.CandidateBlock(ann.AnisotropicQuantiser.fit(x[:8000]), ids, x)
        found = {q: near.tolist() for q, near, _ in block.nearest(asked, x[asked], 20, 120)}
        for q in asked:
            s = x @ x[q]
            s[q] = -np.inf
            assert set(found[int(q)]) == set(np.lexsort((ids, -s))[:20].tolist())
        assert block.scored <= 0.1 * block.met, block.scored / block.met


def test_anisotropic_loss_keeps_inner_products():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    error = {}
    for name, threshold in (("plain", 0.0), ("aware", 0.4)):
        q = ann.AnisotropicQuantiser.fit(x, threshold=threshold)
        r = x - q.decode(q.encode(x))
        error[name] = np.abs((r * x).sum(1)).mean()
        codes = q.encode(x[:50])
        assert np.allclose(q.scan(x[:5], q.pack(codes)), x[:5] @ q.decode(codes).T, atol=1e-5)
    assert error["aware"] < error["plain"]


def test_many_spans_in_one_text(spark):
    """Ten thousand matches in one text: places and redaction take time in proportion to it."""
    import time

    parts = [(f"éa{k} " * (k % 3), f"token={k:010d}") for k in range(10_000)]
    df = spark.createDataFrame([(1, "".join(f"{a}{b} " for a, b in parts), "s")], "doc_id long, text string, source string")
    secrets.secret_scan(df).collect()  # code is compiled
    start = time.time()
    row = secrets.secret_scan(df).collect()[0]
    took = time.time() - start
    assert row.n_assign == 10_000 and row.n_live == 10_000 and took < 20
    start = time.time()
    redacted = secrets.redact(df).collect()[0].text
    assert redacted == "".join(f"{a}[SECRET] " for a, _ in parts) and time.time() - start < 30


def test_repositories_decide(spark):
    rows = [(k, f"token=same{'q' * 8} and token=own{k:09d}", "one") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id0 string").withColumnRenamed("_id0", "source").withColumn("_id0", F.lit(1)).withColumn("_KEY0", F.lit(2)).withColumn("_spans0", F.lit(3))
    assert {(r.n_live, r.n_copied) for r in secrets.secret_scan(df, most_repositories=5).collect()} == {(1, 1)}
    assert {(r.n_live, r.n_copied) for r in secrets.secret_scan(df, most_repositories=6).collect()} == {(2, 0)}
    kept = secrets.redact(df, most_repositories=5)
    assert kept.columns == df.columns and {r.text for r in kept.collect()} == {"token=sameqqqqqqqq and [SECRET]"}
