"""Byte-level BPE encoding and decoding.

A pretoken's bytes form a doubly linked list of symbols. A heap holds the merges possible between neighbours by rank and
place; an entry whose symbols are no longer there is skipped. Decoding concatenates the vocabulary's strings. Special
tokens of the file are split off first, as the tokenizers library does by default.

Null and empty texts have no ids and decode to the empty text; very long texts are encoded whole. Rows that repeat give rows that repeat; columns other than
the identifier and the text are not read, and may be named as they like. An empty table gives an empty result. The vocabulary is a file whose path is a parameter; each Python worker reads it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import BYTE_LEVEL, ChunkEncoder, slices, vocabulary
from .common import documents, released


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class BytePairs:
    """A byte-level BPE vocabulary: encode one text or many, decode ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_names()
        of_byte = {c: b for b, c in enumerate(names)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.first = [vocab[c] for c in names]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: bytes(of_byte[c] for c in s) for s, i in [*vocab.items(), *self.special.items()]}
        self.pretoken = regex.compile(BYTE_LEVEL)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}
        self.chunks = ChunkEncoder(lambda xs: map(self.encode, xs), lambda xs: map(self._plain, xs), True)

    def word(self, pretoken: str) -> list[int]:
        """Ids of one pretoken."""
        symbols = [self.first[b] for b in pretoken.encode("utf-8")]
        n, merge = len(symbols), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if m := merge((symbols[i], symbols[i + 1])):
                heap.append((m[0], i, symbols[i], symbols[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge((new, symbols[k])):
                    heapq.heappush(heap, (m[0], i, new, symbols[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merge((symbols[h], new))):
                heapq.heappush(heap, (m[0], h, symbols[h], new, m[1]))
        return [s for s in symbols if s >= 0]

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pretoken.findall(text):
            ids = self.known.get(p)
            if ids is None:
                ids = self.word(p)
                if len(p) < 40:
                    if len(self.known) > 300_000:
                        self.known.clear()
                    self.known[p] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if not self.split:
            return self._plain(text)
        out: list[int] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_BY_PATH: dict[str, BytePairs] = {}


def byte_pairs(path: str) -> BytePairs:
    if path not in _BY_PATH:
        _BY_PATH[path] = BytePairs(path)
    return _BY_PATH[path]


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id_col, ids (little-endian uint32 binary) and, if asked for, the decoded text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(path)
        for batch in batches:
            for part in slices(batch):
                ids = model.chunks.encode(part.column(1))
                cols = [part.column(0), pa.array(ids, pa.binary())]
                if with_text:
                    cols.append(pa.array([model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "decoded"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary" + ", decoded string" * with_text)
    return got.withColumnRenamed("id", id_col)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode_column(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
