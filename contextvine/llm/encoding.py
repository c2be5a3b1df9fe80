"""Whole-text byte-level BPE through the ``tokenizers`` library, one word at a time.

The pre-tokeniser of the vocabulary never joins a visible character and a space
that follows it, so a text falls into pieces (a run of white space and the word
after it) whose ids simply follow each other.  Arrow splits a batch at its spaces
and numbers its different words; ids of words are kept in a bounded cache of the
Python worker, only unseen words reach the library, and the ids of the batch are
gathered from those of its words.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = re.compile(r"\s*\S+|\s+$")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for Python, not for the pre-tokeniser
#: Longer letters and marks are not remembered, and all known words together hold at most so many bytes (with their places).
LONGEST, CACHE_BYTES = 64, 16_000_000
#: Letters whose class no Unicode version changed; a word of them, with one mark after it.
_L = "A-Za-zÀ-ÖØ-öø-ſ"
_LETTERS = re.compile(f"([{_L}]+)([.,;:!?]?)")
#: Letters; then perhaps ASCII marks but the apostrophe with at most one line end after them, and letters; then perhaps a mark.
_PARTS = re.compile(f"([{_L}]+)(?:([!-&(-/:-@[-`{{-~]+\n?|\n)([{_L}]*))??([.,;:!?]?)")
#: White space beside a space, at either end, or other than space and line end: such a text is split with more care.
_CAREFUL = r"  | \n|\n |^[ \n]|[ \n]$|[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_BYTE_LETTER = _byte_letters()
_encoders: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """``encode_batch(texts)`` gives for each text its ids as an unsigned array.

    A null text has no ids.  Ids equal ``Tokenizer.encode(text,
    add_special_tokens=False).ids``: special tokens written in a text count.

    Known words are one Arrow array, their ids one run of numbers with the place
    of each word's; words not met for long make room for new ones.  They are bounded
    by number and by bytes, so texts without spaces don't fill the memory.
    """

    def __init__(self, path: str, cache_size: int = 250_000, chunk_chars: int = 200_000, cache_bytes: int = CACHE_BYTES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("Ġ")
        self.tokenize = self.tokenizer.model.tokenize
        self.code = "H" if self.dtype == np.uint16 else "I"
        self.marks = {m: np.array([vocabulary[m]], dtype=self.dtype).tobytes() for m in ".,;:!?"}
        self.cache_size, self.chunk_chars, self.cache_bytes = cache_size, chunk_chars, cache_bytes
        self.known = pa.array([], pa.large_string())
        self.ids = np.empty(0, dtype=self.dtype)
        self.begins, self.sizes = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
        self.met, self.turn = np.empty(0, dtype=np.int64), 0  # when each word was last seen
        self.stems: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def letters(self, text: str) -> bytes:
        """Ids of letters alone, a space before them included, by the library's model."""
        shown = text.replace(" ", "Ġ") if text.isascii() else "".join(map(_BYTE_LETTER.__getitem__, text.encode()))
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    @staticmethod
    def remember(known: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(key) <= LONGEST:
            known[key] = ids
        return ids

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that each follow one space and hold none."""
        if len(self.stems) > self.cache_size // 4:
            self.stems = {}
        if len(self.marks) > 100_000:
            self.marks = {m: self.marks[m] for m in ".,;:!?"}
        stems, marks, letters, match, remember = self.stems, self.marks, self.letters, _PARTS.fullmatch, self.remember
        out: list[bytes | None] = []
        rest = []
        for k, w in enumerate(words):
            if (found := match(w)) is None:
                rest.append(k)
                out.append(None)
                continue
            stem, middle, second, mark = found.groups()
            if (known := stems.get(stem)) is None:
                known = remember(stems, stem, letters(" " + stem))
            if middle:
                if (between := marks.get(middle)) is None:
                    between = remember(marks, middle, self.whole(middle))
                known += between
                if second:
                    # a word's later part has entries of its own, told from whole words by a space
                    if (after := stems.get(" " + second)) is None:
                        after = remember(stems, " " + second, letters(second))
                    known += after
            out.append(known + marks[mark] if mark else known)
        at = 0
        while at < len(rest):
            chars, end = 0, at
            while end < len(rest) and chars < self.chunk_chars:
                chars += len(words[rest[end]]) + 1
                end += 1
            text = " " + " ".join(words[k] for k in rest[at:end])
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            starts = np.flatnonzero(self.opens[ids])
            raw, size = ids.tobytes(), ids.itemsize
            bounds = [*(starts * size).tolist(), len(raw)]
            if len(starts) != end - at:
                raise ValueError("a word's ids do not begin with its space")
            for i, k in enumerate(rest[at:end]):
                out[k] = raw[bounds[i] : bounds[i + 1]]
            at = end
        return out

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of some different words stands among the known ones, learning those that are not."""
        self.turn += 1
        if len(self.known) > self.cache_size or self.known.nbytes > self.cache_bytes:
            # those met last stay, half of what is allowed, their ids close up
            recent = np.argsort(-self.met, kind="stable")[: self.cache_size // 2]
            held = np.cumsum(pc.binary_length(self.known).to_numpy(zero_copy_only=False)[recent] + 8)
            keep = np.sort(recent[held <= self.cache_bytes // 2])
            sizes = self.sizes[keep].astype(np.int64)
            ends = np.cumsum(sizes)
            self.ids = self.ids[np.repeat(self.begins[keep] - ends + sizes, sizes) + np.arange(sizes.sum())]
            self.known, self.sizes, self.begins, self.met = self.known.take(pa.array(keep)), self.sizes[keep], ends - sizes, self.met[keep]
        found = pc.index_in(words, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if new.any():
            unseen = words.filter(pa.array(new))
            learned = self.of_words(unseen.to_pylist())
            sizes = np.fromiter(map(len, learned), dtype=np.int64, count=len(learned)) // self.ids.itemsize
            at[new] = len(self.known) + np.arange(len(learned))
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
            self.met = np.concatenate([self.met, np.zeros(len(learned), dtype=np.int64)])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(learned), dtype=self.dtype)])
            self.known = pa.concat_arrays([self.known, unseen])
        self.met[at] = self.turn
        return at

    def encode_array(self, texts: pa.Array) -> list[np.ndarray]:
        """``encode_batch`` for a bounded Arrow array of strings."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        careful = pc.match_substring_regex(texts, _CAREFUL)
        for s in self.special:
            careful = pc.or_(careful, pc.match_substring(texts, s))
        careful = pc.or_(careful, pc.equal(pc.binary_length(texts), 0))
        out: list[np.ndarray | None] = [None] * len(texts)
        odd = careful.to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.frombuffer(self.careful(texts[k].as_py()), dtype=self.dtype)
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        words = pc.split_pattern(texts.take(pa.array(plain)) if len(plain) < len(texts) else texts, " ")
        del texts
        starts = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
        numbered = words.flatten().dictionary_encode()
        del words
        index = numbered.indices.to_numpy(zero_copy_only=False).copy()
        # the first word of a text follows no space: it gets an entry of its own
        heads, which = np.unique(index[starts], return_inverse=True)
        bare = [self.whole(numbered.dictionary[h].as_py()) for h in heads.tolist()]
        index[starts] = len(numbered.dictionary) + which
        places = self.places(numbered.dictionary)
        del numbered
        head_sizes = np.array([len(x) // self.ids.itemsize for x in bare], dtype=np.int32)
        raw = np.concatenate([self.ids, np.frombuffer(b"".join(bare), dtype=self.dtype)])
        begins = np.concatenate([self.begins[places], len(self.ids) + np.cumsum(head_sizes) - head_sizes]).astype(np.int32)
        size = np.concatenate([self.sizes[places], head_sizes])[index]
        # one gather: each word's place among the known ids less its place in the result, spread over its ids
        ends = np.cumsum(size, dtype=np.int32)
        shift = begins[index]
        shift -= ends
        shift += size
        at = np.repeat(shift, size)
        at += np.arange(len(at), dtype=np.int32)
        ids = raw[at]
        edges = np.append(ends[starts] - size[starts], ends[-1])
        for j, k in enumerate(plain.tolist()):
            out[k] = ids[edges[j] : edges[j + 1]]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.encode_array(pa.array(texts, pa.large_string()))

    def careful(self, text: str) -> bytes:
        if any(s in text for s in self.special) or _SEPARATORS.search(text):
            return self.whole(text)
        return self.pieces(text)

    def pieces(self, text: str) -> bytes:
        """A text in which white space stands beside a space."""
        parts = _PIECE.findall(text)
        plain = {p for p in parts if p[0] == " " and len(p) > 1 and not p[1].isspace()}
        ids = dict(zip(plain, self.of_words([p[1:] for p in plain])))
        return b"".join(ids[p] if p in ids else self.whole(p) for p in parts)


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def slices(texts: pa.Array, most_bytes: int = 3_000_000):
    """Ranges of an Arrow array of strings of a bounded size each (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes)))
        yield at, min(end, len(texts))
        at = end
