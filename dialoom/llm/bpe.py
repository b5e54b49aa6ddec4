"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

The vocabulary comes from a tokenizer file (JSON: vocabulary, merges, added tokens) whose path is a parameter. The file is
read once by the driver and its content, of fixed size, goes to the tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import pieces, small_batches

# fixed values: the pattern that byte-level BPE of this kind cuts texts with
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED, LONGEST = 1 << 17, 64       # pieces that a worker remembers, and the longest of them


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Bpe:
    """One tokenizer: ``encode`` gives ids as little-endian unsigned 32-bit integers, ``decode`` the bytes of ids."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.single = [vocab[letters[b]] for b in range(256)]
        raw = {c: b for b, c in letters.items()}
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(raw[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = {token: np.uint32(i).astype("<u4").tobytes() for token, i in added.items()}
        self.cut = regex.compile(PIECES).findall
        self.at_added = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None
        self.known = lru_cache(CACHED)(self.packed)

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the merge of lowest rank, the leftmost first, until no neighbours can be merged.

        The queue holds (rank, place, the pair it was made for); an entry whose symbols have changed since is stale and is
        passed over. ``prev`` and ``next`` link the symbols that are left.
        """
        n = len(symbols)
        if n < 2:
            return symbols
        merges, prev, next_ = self.merges, list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, ab = heapq.heappop(queue)
            j = next_[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = ab, -1
            after = next_[i] = next_[j]
            if after >= 0:
                prev[after] = i
                if m := merges.get((ab, symbols[after])):
                    heapq.heappush(queue, (m[0], i, ab, symbols[after], m[1]))
            if (before := prev[i]) >= 0 and (m := merges.get((symbols[before], ab))):
                heapq.heappush(queue, (m[0], before, symbols[before], ab, m[1]))
        return [s for s in symbols if s >= 0]

    def packed(self, piece: str) -> bytes:
        single = self.single
        return np.array(self.merge([single[b] for b in piece.encode()]), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        known, packed = self.known, self.packed
        return b"".join([known(p) if len(p) <= LONGEST else packed(p) for p in self.cut(text)])

    def encode(self, text: str) -> bytes:
        if self.at_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        parts = [p for p in self.at_added.split(text) if p]
        return b"".join([self.added[p] if p in self.added else self._plain(p) for p in parts])

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings one after the other; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def _bpe(spec: str) -> Bpe:
    return Bpe(spec)


def _tokens(spec):
    def run(batches):
        bpe = _bpe(spec.value)
        for batch in batches:
            for rows, texts in pieces(batch, 1):
                ids = [bpe.encode(t.decode("utf-8", "replace")) if t else b"" for t in texts]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)),
                                                 pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(rows)), lists, pa.array([bpe.decode(i) for i in ids], pa.string())],
                                                 names=["id", "ids", "decoded"])
    return run


def _digests(spec):
    def run(batches):
        bpe = _bpe(spec.value)
        for batch in batches:
            for rows, texts in pieces(batch, 1):
                ids = [bpe.encode(t.decode("utf-8", "replace")) if t else b"" for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(rows.start, len(rows)), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                     pa.array([hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids], pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _spec(docs: DataFrame, path: str):
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())       # a vocabulary file: its size does not depend on the data


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row, other columns are not looked at.

    A null or empty text has no ids and decodes to the empty string. Strings of added tokens in a text become these
    tokens. No column is needed besides id and text; ids may be null or repeated; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_tokens(_spec(docs, path)), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of what ``encode`` gives, made in the same pass.

    The ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        _digests(_spec(docs, path)), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
