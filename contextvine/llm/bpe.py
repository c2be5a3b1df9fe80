"""Exact BPE by backtracking over longest token matches, and decoding through an offset table.

For a word, an Aho-Corasick automaton over the vocabulary gives every token that
matches anywhere.  The encoder takes the longest match and goes on; a token may
follow another only if the pair is compatible, that is if merging would never
join them across their border.  Where no compatible token remains it steps back
to the next shorter match of the token before.  A border once found hopeless is
never tried again, so the work is linear in the word.  The library's own normaliser
and pre-tokeniser give the words of text that is not ASCII.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import _BYTE_LETTER, _LETTERS
from .shared import trimmed

_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Text of these is in normal form already, and every table lowers it letter by letter alike: ASCII, Latin letters but U+0130,
#: Russian letters, kana, CJK ideographs, Hangul syllables and common marks.
_STABLE = re.compile("[\x00-\x7fÀ-ÖØ-öø-įĲ-ſЀ-џぁ-ゖァ-ヺ一-鿕가-힣–—‘’“”„…«»¿¡°€。、，！？]+")
_codecs: dict[str, "WordBpe"] = {}
END = "\x00"  # stands for the end-of-word suffix while matching; never a byte letter


class WordBpe:
    """A word-level BPE vocabulary (lower case, words end with a suffix) from its file.

    ``encode(text)`` equals the library's ids without special tokens added;
    ``decode(ids)`` equals its decoding with special tokens kept.
    """

    def __init__(self, path: str, cache_size: int = 400_000, longest: int = 64) -> None:
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("another kind of vocabulary file")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocab: dict[str, int] = model["vocab"]
        inner = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) and t != suffix else t
        self.ids = {inner(t): i for t, i in vocab.items() if t not in self.special}
        # what each pair merges into and when; how each token was merged, if it was
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = (rank, c)
            if c in self.parts:
                raise ValueError("a token has two merges")
            self.parts[c] = (rank, a, b)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if len(token.rstrip(END)) == 1 or i in self.parts:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.marks = {m: np.array([self.ids[m + END]], dtype=np.uint16 if max(self.ids.values()) < 1 << 16 else np.uint32).tobytes() for m in ".,;:!?"}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # chunks of at most ``longest`` characters are remembered
        self.cache_size, self.longest = cache_size, longest
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        top = max([*vocab.values(), *self.special.values()]) + 1
        names = [""] * top
        for t, i in {**vocab, **self.special}.items():
            names[i] = t
        self.text_table = OffsetTable([n.encode() + b" " for n in names])
        self.digit_table = OffsetTable([b"%d " % i for i in range(top)])

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between the two tokens: the pair-compatibility table, filled as pairs occur."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, latest first, and look for an earlier merge across the border.

        Beside the border stand, at each moment of merging, the last part of the
        left token and the first part of the right one.  A merge across the border
        happens if its rank comes before the merge that takes either part away;
        of equal merges the one further left comes first.
        """
        # when the part beside the border was merged away: never yet
        left_until = right_until = float("inf")
        while True:
            if (joined := self.merged.get((left, right))) is not None:
                rank = joined[0]
                # the left part goes in a merge to the left of the border, so it wins a tie; the right part loses one
                if rank < left_until and rank <= right_until:
                    return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # the later merge is undone first; of equal ranks the one further right happened later
            if b is None or a is not None and a[0] > b[0]:
                left_until, left = a[0], a[2]
            else:
                right_until, right = b[0], b[1]

    def word(self, letters: str) -> list[int]:
        """Ids of one pre-token, given in byte letters."""
        text = letters + END
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            if end != n - 2:  # the last letter is one symbol with the suffix
                at[end + 1 - match[0]].append(match)
        # matches of a start come with growing length, so each list is in that order
        hopeless = bytearray(n + 1)
        stack: list[tuple[int, int, int]] = []  # start, index of the match taken, token
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            last = stack[-1][2] if stack else None
            while k >= 0:
                size, token = at[pos][k]
                if not hopeless[pos + size] and (last is None or self.fits(last, token)):
                    break
                k -= 1
            if k >= 0:
                stack.append((pos, k, token))
                pos += size
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                if not stack:
                    raise ValueError("a word has no encoding")
                hopeless[pos] = 1
                pos, k, _ = stack.pop()
                k -= 1
        return [t for _, _, t in stack]

    def chunk(self, chunk: str) -> bytes:
        """Ids of text without white space; a mark after letters is a pre-token of its own."""
        if match := _LETTERS.fullmatch(chunk):
            stem, mark = match.groups()
            if mark:
                if (known := self.words.get(stem) or self.older.get(stem)) is None:
                    known = self.chunk(stem)
                    if len(stem) <= self.longest:
                        self.words[stem] = known
                return known + self.marks[mark]
            pieces = [stem if chunk.isascii() else "".join(map(_BYTE_LETTER.__getitem__, stem.encode()))]
        elif chunk.isascii():
            pieces = [p if p.isprintable() else "".join(map(_BYTE_LETTER.__getitem__, p.encode())) for p in self.split.findall(chunk)]
        else:
            # classes of code points are the library's own; its pieces come in byte letters
            pieces = [p for p, _ in self.pre_tokenize(chunk)]
        out: list[int] = []
        for piece in pieces:
            out += self.word(piece)
        return np.array(out, dtype=np.uint16 if len(self.text_table) <= 1 << 16 else np.uint32).tobytes()

    def _plain(self, text: str) -> list[bytes]:
        """Ids of a stretch without special tokens, as the ids of its chunks."""
        if text.isascii() or _STABLE.fullmatch(text):
            text = text.lower()
            chunks = [c for c in self.space.split(text) if c] if _SEPARATORS.search(text) else text.split()
        else:
            # the library's normal form, in which runs of white space are one space
            chunks = [c for c in self.normalize(text).split(" ") if c]
        found = list(map(self.words.get, chunks))
        if None in found:
            fresh = {}
            for c in {c for c, f in zip(chunks, found) if f is None}:
                known = self.older.get(c)
                fresh[c] = self.chunk(c) if known is None else known
            found = [fresh[c] if f is None else f for c, f in zip(chunks, found)]
            self.words |= {c: ids for c, ids in fresh.items() if len(c) <= self.longest}
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if len(self.words) > self.cache_size:
            self.older, self.words = self.words, {}
        text, out, at = text or "", [], 0
        kind = np.uint16 if len(self.text_table) <= 1 << 16 else np.uint32
        if self.at_special is not None and "<" in text:
            for m in self.at_special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(np.array([self.special[m[0]]], dtype=kind).tobytes())
                at = m.end()
        out += self._plain(text[at:] if at else text)
        return np.frombuffer(b"".join(out), dtype=kind)

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts joined by one space, in UTF-8."""
        return self.text_table.join(ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        return self.digit_table.join(ids)


class OffsetTable:
    """All token texts in one run of bytes with the offset of each: joining is one gather."""

    def __init__(self, texts: list[bytes]) -> None:
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def join(self, ids: np.ndarray, piece: int = 1 << 16) -> bytes:
        """The texts after each other, each closed by a space but for the last."""
        out = []
        for at in range(0, len(ids), piece):
            part = ids[at : at + piece]
            start = self.offsets[part]
            size = self.offsets[part.astype(np.int64) + 1] - start
            ends = np.cumsum(size)
            out.append(self.bytes[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


def codec(path: str) -> WordBpe:
    """The codec of this Python worker for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = WordBpe(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; null text is empty (no tokens).

    Rows are independent: repeated rows and ids repeat in the result, an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            for a in range(0, len(texts), 512):
                columns: list[list] = [[], [], []]
                for t in texts.slice(a, 512):
                    ids = bpe.encode(t.as_py())
                    columns[0].append(len(ids))
                    columns[1].append(hashlib.sha256(bpe.decimals(ids)).hexdigest())
                    columns[2].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
