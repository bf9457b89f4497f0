"""Splits texts into chunks that tokenise alone, and keeps the ids of chunks seen before.

A chunk is a run without spaces and line feeds, together with the one space or line feed before it. Where white space
stands otherwise (two in a row, at the ends, other kinds) or a special token may stand, the text is left whole. Texts are
split and their chunks told apart in Arrow, so that Python sees each different chunk of a batch once.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pretoken pattern of the byte-level vocabulary (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a text may not have if its chunks are to tokenise alone, for RE2.
_ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]|[ \n][ \n]|<\||^[ \n]|[ \n]$"
#: Latin letters, of which none changes under composition and each has one lower-case letter, and ASCII punctuation after them.
_PLAIN_WORD = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@\\[-`{-~]*)")


def tokenizer(path: str):
    """The tokenizers library's tokenizer in a file, one thread, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, col: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about so many bytes of text each; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size + 1) // most, prepend=0)).tolist()
    for lo, hi in itertools.pairwise([0, *cut, batch.num_rows]):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of some runs, one run after the other."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not total or int(start.max()) < 1 << 30) else np.int64
    return np.repeat((start - (ends - n)).astype(kind), n) + np.arange(total, dtype=kind)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, place of each word of the texts among them, where each text's words end, 0 first).

    A-Z are lower-cased; words are runs without ASCII white space.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    named = words.values.dictionary_encode()
    codes = named.indices.to_numpy()
    keep = (pc.binary_length(named.dictionary).to_numpy(zero_copy_only=False) > 0)[codes]  # white space at the ends leaves empty words
    return named.dictionary, codes[keep], np.concatenate([[0], np.cumsum(keep)])[words.offsets.to_numpy()]


class ChunkEncoder:
    """encode(texts) gives the ids of each text as little-endian uint32 bytes, as whole() would.

    whole: ids of a list of texts; parts: the same for a list of chunks. spaced: whether the space before a chunk bears on
    its ids. A chunk is named by its text without the space, after a line feed by that and its text, and after
    nothing by NUL and its text. Beyond `size` known chunks, those that the batch in hand doesn't have are forgotten.
    """

    def __init__(self, whole: Callable[[list[str]], Iterable], parts: Callable[[list[str]], Iterable[list[int]]], spaced: bool, size: int = 800_000):
        self.whole, self.parts, self.spaced, self.size = whole, parts, spaced, size
        self.known = pa.array([], pa.string())
        self.ids, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _text(self, name: str) -> str:
        if not self.spaced or name[0] == "\n":
            return name
        return name[1:] if name[0] == "\0" else " " + name

    def _add(self, names: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, names])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])

    def _places(self, names: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy()
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        new, ids, counts = names.take(pa.array(missing)), [], []
        if len(self.known) + len(new) > self.size:
            met = np.flatnonzero(at >= 0)
            kept, count = self.ids[ragged(self.start[at[met]], self.count[at[met]])], self.count[at[met]]
            self.known, self.ids, self.start, self.count = self.known[:0], self.ids[:0], self.start[:0], self.count[:0]
            self._add(names.take(pa.array(met)), kept, count)
            at = at.copy()
            at[met] = np.arange(len(met))
        at = at.copy()
        at[missing] = len(self.known) + np.arange(len(missing))
        for lo in range(0, len(new), 30_000):  # lists of ids are large, so few at a time
            some = new.slice(lo, 30_000)
            got = list(self.parts([self._text(x) for x in some.to_pylist()]))
            count = np.fromiter(map(len, got), np.int64, len(got))
            ids.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(count.sum())))
            counts.append(count)
        self._add(new, np.concatenate(ids), np.concatenate(counts))
        return at

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        some = np.flatnonzero(odd)
        for i, ids in zip(some.tolist(), self.whole(texts.take(pa.array(some)).to_pylist()) if len(some) else ()):
            out[i] = np.asarray(ids, "<u4").tobytes()
        own = np.flatnonzero(~odd)
        if not len(own):
            return out
        plain = pc.replace_substring(texts.take(pa.array(own)), "\n", " \n" if self.spaced else " ")
        if self.spaced:
            plain = pc.binary_join_element_wise("\0", plain, "")
        words = pc.split_pattern(plain, " ")
        named = words.values.dictionary_encode()
        at = self._places(named.dictionary)[named.indices.to_numpy()]
        n = self.count[at]
        raw = self.ids[ragged(self.start[at], n)].astype("<u4").tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(n)])[words.offsets.to_numpy()]).tolist()
        for i, lo, hi in zip(own.tolist(), ends, ends[1:]):
            out[i] = raw[lo:hi]
        return out


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


class _LibraryParts:
    """Ids of chunks from the library. Plain words go to its model without the steps before it, which leave them as they are
    but for case and the names of bytes; the others go through all its steps, many at a time, a special token between them."""

    def __init__(self, t, spaced: bool):
        from .bpe import byte_names

        self.t, self.model, self.spaced, self.tails = t, t.model, spaced, {}
        self.names = dict(enumerate(byte_names()))
        self.special = next(((i, a.content) for i, a in t.get_added_tokens_decoder().items() if a.special), None)

    def _ids(self, named: str) -> list[int]:
        """Ids of a pretoken whose bytes are named."""
        return [x.id for x in self.model.tokenize(named)]

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(chunks)
        stems: dict[str, list[int]] = {}
        odd, tails, feed, space = [], self.tails, self._ids(self.names[10]), self.names[32]
        for k, m in enumerate(map(_PLAIN_WORD.fullmatch, chunks)):
            if not m:
                odd.append(k)
                continue
            before, stem, tail = m.groups()
            if not self.spaced:
                stem = stem.lower()
            if not stem.isascii():
                stem = stem.encode().decode("latin-1").translate(self.names)
            if before == " ":
                stem = space + stem
            ids = stems.get(stem)
            if ids is None:
                ids = stems[stem] = self._ids(stem)
            if tail:
                if tail not in tails:
                    if len(tails) > 100_000:
                        tails.clear()
                    tails[tail] = self._ids(tail)
                ids = ids + tails[tail]
            out[k] = feed + ids if before == "\n" else ids
        for k, ids in zip(odd, self._others([chunks[k] for k in odd])):
            out[k] = ids
        return out

    def _others(self, texts: list[str], group: int = 24) -> list[list[int]]:
        if self.special is None or any("<|" in x for x in texts):
            return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for e in self.t.encode_batch_fast([self.special[1].join(texts[i : i + group]) for i in range(0, len(texts), group)], add_special_tokens=False):
            ids, lo = e.ids, 0
            for cut in [k for k, x in enumerate(ids) if x == self.special[0]]:
                out.append(ids[lo:cut])
                lo = cut + 1
            out.append(ids[lo:])
        return out


def library_encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary file, on the tokenizers library."""
    if (path, spaced) not in _ENCODERS:
        t = tokenizer(path)
        _ENCODERS[path, spaced] = ChunkEncoder(lambda xs: [e.ids for e in t.encode_batch_fast(xs, add_special_tokens=False)], _LibraryParts(t, spaced), spaced)
    return _ENCODERS[path, spaced]
