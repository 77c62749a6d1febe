"""Byte-level BPE encoding and decoding over a contiguous rank array.

A word (the longest run the split pattern gives) is held as two parallel arrays:
its parts and, for each part, the rank of merging it with its right neighbour.
The smallest rank is found by scanning the array, the boundary behind it is
deleted and the ranks of the two neighbours are looked up again, until no merge
is left. The scan beats any heap for words of a few dozen bytes; longer words
use a heap over the same ranks with the same result.

Inputs: null text encodes like the empty text (no ids). Text of any length is
encoded whole. Added tokens of the vocabulary file that occur in the text become
their own id, as in the tokenizers library. Repeated rows give repeated results;
extra columns of the input are carried by ``encode`` and never read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, pieces, release_memory, slices

#: Fixed value: how byte-level vocabularies split text into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words above this many bytes use the heap.
SHORT_WORD = 128
#: Words remembered by a worker, in two generations of this size (bounded memory).
REMEMBERED = 150_000
#: The vocabulary file is broadcast; a larger one is refused.
MAX_VOCABULARY_BYTES = 64 << 20
_NONE = 1 << 60


def _byte_of_symbol() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves, the other bytes for characters from 256 on, in order."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file in the tokenizers JSON format."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        symbols = _byte_of_symbol()
        ids: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = lambda s: bytes(symbols[c] for c in s) if all(c in symbols for c in s) else s.encode()
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.base = [ids[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.shift = max(self.bytes_of).bit_length()
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left] << self.shift | ids[right]] = (rank, ids[left + right])
        self.words = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _scan(self, parts: list[int]) -> list[int]:
        merges, shift = self.merges, self.shift
        ranks = [merges.get(a << shift | b, (_NONE,))[0] for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            parts[i] = merges[parts[i] << shift | parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get(parts[i - 1] << shift | parts[i], (_NONE,))[0]
            if i < len(ranks):
                ranks[i] = merges.get(parts[i] << shift | parts[i + 1], (_NONE,))[0]
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        merges, shift, n = self.merges, self.shift, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(hit[0], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (hit := merges.get(a << shift | b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = merges[a << shift | b][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (hit := merges.get(parts[left] << shift | parts[right])):
                    heapq.heappush(heap, (hit[0], left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        base = self.base
        parts = [base[b] for b in word.encode()]
        return tuple(self._scan(parts) if len(parts) <= SHORT_WORD else self._heap(parts))

    def _missing(self, word: str) -> tuple[int, ...]:
        found = self.old.get(word) or self.word(word)
        if len(word) <= SHORT_WORD:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for k, piece in enumerate(self.cut(text or "") if self.cut else [text or ""]):
            if k % 2:
                out.append(self.added[piece])
                continue
            for w in self.words(piece):
                out += self.young.get(w) or self._missing(w)
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.text_of.__getitem__, ids)).encode()).hexdigest()


_loaded: dict[int, ByteBpe] = {}


def _vocabulary(df: DataFrame, path: str):
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def _coder(shared) -> ByteBpe:
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(shared.value)
    return _loaded[key]


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` without ``text``, with its token ids as ``ids`` (array<int>, empty for a null text) and ``n_tokens``.

    A column of the input that is already named so is replaced.
    """
    shared = _vocabulary(docs, vocabulary_path)

    @F.arrow_udf("array<int>")
    def token_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(shared)
        for texts in batches:
            found = [pa.array([coder.encode(t) for t in part.to_pylist()], pa.list_(pa.int32())) for part in pieces(texts, SLICE_BYTES // 8)]
            yield pa.concat_arrays(found)
            del found
            release_memory()

    rest = [c for c in docs.columns if c not in (text, ids, "n_tokens")]
    out = docs.select(*(F.col(f"`{c}`") for c in rest), token_ids.asNondeterministic()(F.col(f"`{text}`")).alias(ids))
    return out.withColumn("n_tokens", F.size(ids).cast("long"))


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids as ``text`` in place of ``ids`` (null ids: null)."""
    shared = _vocabulary(encoded, vocabulary_path)

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(shared)
        for rows in batches:
            yield pa.array([None if r is None else coder.decode(r) for r in rows.to_pylist()], pa.string())

    rest = [c for c in encoded.columns if c not in (text, ids)]
    return encoded.select(*(F.col(f"`{c}`") for c in rest), decoded(F.col(f"`{ids}`")).alias(text))


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text (encoded, then decoded from the ids)."""
    shared = _vocabulary(docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    ids = coder.encode(text)
                    rows.append((len(ids), coder.digest(ids), hashlib.sha256(coder.decode(ids).encode()).hexdigest()))
                n, a, b = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
