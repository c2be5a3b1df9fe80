import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from contextvine.llm.bpe import WordBpe, encode_decode
from contextvine.llm.encoding import PieceEncoder, slices
from contextvine.llm.packing import TierPacker, pack
from contextvine.llm.wavelet import ShardReader, ShardWriter, WaveletMatrix, filesystem, read_shards, write_shards
from tests.llm.conftest import EDGE

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "b ", "  ", " \n", "\n", "\t", "x1", "'s", "'S", "é", "<|endoftext|>", " ", "\xa0", "\x1c", "!", "...", " don't", " 12ab", "　", "\r\n", "ab.\nCd", "x&&&", "日本", "👍", "ΣΑΣ", "İ", "é", "<|startoftext|>", "_", "\x00", "ß", "thing,"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_pieces_equal_the_library():
    encoder, tokenizer = PieceEncoder(BYTE, cache_size=50), library(BYTE)
    sample = texts(4000, 1)
    want = [e.ids for e in tokenizer.encode_batch(sample, add_special_tokens=False)]
    array, got = pa.array(sample), []
    for a, b in slices(array, 500):
        got += encoder.encode_array(array.slice(a, b - a))
    assert [g.tolist() for g in got] == want
    assert [g.tolist() for g in encoder.encode_batch([None, ""])] == [[], []]


def test_known_words_are_bounded_by_bytes():
    """Paragraphs without spaces, all different, among short words: ids stay right and little is held."""
    rng = random.Random(4)
    long = ["".join(rng.choice("abcdeé.") for _ in range(3000)) + "ä" for _ in range(60)]
    sample = [f"{w} w{k} {w[:100]} ok" for k, w in enumerate(long)] * 2
    encoder, tokenizer = PieceEncoder(BYTE, cache_bytes=20_000), library(BYTE)
    want = [e.ids for e in tokenizer.encode_batch(sample, add_special_tokens=False)]
    for k in range(0, len(sample), 4):
        assert [g.tolist() for g in encoder.encode_batch(sample[k : k + 4])] == want[k : k + 4]
        # what was held before, and one batch
        assert encoder.known.nbytes <= 20_000 + sum(len(t.encode()) + 100 for t in sample[k : k + 4]) and encoder.ids.nbytes <= 4 * encoder.known.nbytes
    assert all(len(x) <= 65 for x in [*encoder.stems, *encoder.marks])


def test_backtracking_equals_the_library():
    codec, tokenizer, rng = WordBpe(WORDS, cache_size=50), library(WORDS), random.Random(2)
    sample = texts(3000, 3) + ["".join(rng.choice("abetionshr") for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    for text, e in zip(sample, tokenizer.encode_batch(sample, add_special_tokens=False)):
        ids = codec.encode(text)
        assert ids.tolist() == e.ids, text
        assert codec.decode(ids).decode() == tokenizer.decode(e.ids, skip_special_tokens=False)
        assert codec.decimals(ids).decode() == " ".join(map(str, e.ids))


def test_encode_decode_on_edges(edge):
    tokenizer, want = library(WORDS), []
    for i, t, *_ in EDGE:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, encode_decode(edge, WORDS).collect()), key=str) == sorted(want, key=str)
    assert encode_decode(edge.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("n, top", [(1, 2), (7, 8), (3000, 50257), (1025, 3)])
def test_wavelet_queries(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint16)
    m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 16).to_bytes())
    assert (m.decode() == ids).all()
    for i in {0, n // 2, n - 1}:
        token, at = int(ids[i]), np.flatnonzero(ids == ids[i])
        assert m.access(i) == token and m.count(token) == len(at) and m.rank(token, i) == (ids[:i] == token).sum()
        assert m.select(token, len(at) - 1) == at[-1]
        assert top > 100 or m.occurrences(token)[:50] == at[:50].tolist()
    assert m.count(60000) == 0
    with pytest.raises(IndexError):
        m.access(n)


def with_end(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_shards_on_edges(edge):
    tokenizer, want, start = library(BYTE), [], 0
    for i, t, *_ in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = with_end(tokenizer, t)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = write_shards(edge, BYTE, shards=3)
    assert sorted(map(tuple, read_shards(manifest).collect()), key=str) == sorted(want, key=str)
    count = 0
    for row in manifest.collect():
        fs, at = filesystem(row.path)
        with fs.open_input_file(at) as f:
            count += ShardReader(f).count(0)
    assert count >= len(EDGE)
    assert read_shards(write_shards(edge.limit(0), BYTE)).count() == 0


def test_shard_places(tmp_path):
    import pyarrow.fs as fs

    ids, local = np.random.default_rng(3).integers(0, 40, 5000).astype(np.uint16), fs.LocalFileSystem()
    out = ShardWriter(local.open_output_stream(str(tmp_path / "s")), 16, block_ids=700)
    for at in range(0, 5000, 130):
        out.add(at, ids[at : at + 130])
    assert out.close() == 5000
    with local.open_input_file(str(tmp_path / "s")) as f:
        reader = ShardReader(f)
        assert len(reader.blocks) > 5 and [reader.access(i) for i in (0, 699, 780, 4999)] == ids[[0, 699, 780, 4999]].tolist()
        assert list(reader.occurrences(7)) == np.flatnonzero(ids == 7).tolist() and reader.count(7) == (ids == 7).sum()
        with pytest.raises(IndexError):
            reader.access(5000)


def gapless(parts):
    at = 0
    for a, n in sorted(parts):
        assert a == at and n > 0
        at += n
    return at


def test_packer_places_every_id_once():
    rng = random.Random(4)
    for trial in range(20):
        lengths = [rng.choice([1, 2, 255, 256, 257, 700, 1024, 1025, 5000, rng.randint(1, 3000)]) for _ in range(rng.randint(0, 60))]
        windows, by_doc = TierPacker().pack(lengths), defaultdict(list)
        for w in windows:
            size = sum(n for n, _, _ in w)
            assert size <= 1024 and size & (size - 1) == 0
            for n, doc, at in w:
                by_doc[doc].append((at, n))
        assert [gapless(by_doc[k]) for k in range(len(lengths))] == lengths


def test_packing_on_edges(edge):
    tokenizer = library(BYTE)
    ids = defaultdict(list)
    for i, t, *_ in EDGE:
        ids[i].append(with_end(tokenizer, t))
    by_sequence, total, groups = defaultdict(list), 0, defaultdict(int)
    for r in pack(edge, BYTE).collect():
        one = ids[r.doc_id][0]
        assert zlib.crc32(one[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(one)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        groups[r.step_group] += r.length
        total += r.length
    assert total == sum(len(x) for v in ids.values() for x in v)
    assert all(n & (n - 1) == 0 for n in map(gapless, by_sequence.values())) and max(groups.values()) <= 8192
    assert pack(edge.limit(0), BYTE).count() == 0


def test_every_code_point_as_the_library_has_it():
    """Code points between letters, digits and marks: those up to U+323AF one by one, the others in steps."""
    from tokenizers import Tokenizer

    ours, library = WordBpe(WORDS), Tokenizer.from_file(WORDS)
    points = [c for c in [*range(1, 0x323B0), *range(0x323B0, 0x110000, 997)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 256):
        text = " ".join(f"8{chr(c)}a{chr(c)}́!" for c in points[at : at + 256])
        assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(points[at])
    text = "8᠋ॶa\U00025dd2᷷ⷣ"
    assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
