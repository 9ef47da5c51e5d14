"""Byte-level BPE: encoding by a queue of merges over a linked list of symbols, decoding by vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import body, slices
from tickloom.llm.tokens import Cache

# Unicode white space, and the pattern that parts text before merging.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^WS\p{L}\p{N}]+|[WS]+(?![^WS])|[WS]+".replace("WS", SPACE)
#: The same cuts next to white space alone: every cut of PIECES inside a chunk depends on the chunk only.
CHUNKS = r" ?[^WS]+|[WS]+(?![^WS])|[WS]+".replace("WS", SPACE)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Bpe:
    """One vocabulary file: ``encode`` and ``decode`` texts; kept once per worker, with bounded caches."""

    _of: dict[str, Bpe] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        import re

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
        of_letter = {c: b for b, c in enumerate(letters)}
        self.strings = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.strings[i] = bytes(of_letter[c] for c in token)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            self.strings[t["id"]] = t["content"].encode()
        self.cut_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.chunks, self.pieces = re.compile(CHUNKS).findall, regex.compile(PIECES).findall
        of_piece = Cache(lambda piece: np.array(self.merge(piece.encode()), "<u4").tobytes()).__getitem__
        self.of_chunk = Cache(lambda chunk: b"".join(map(of_piece, self.pieces(chunk)))).__getitem__

    def merge(self, piece: bytes) -> list[int]:
        """Apply the merges by rank, leftmost first: a heap of candidate pairs over a doubly linked list.

        A popped pair is stale, and skipped, when one of its symbols has gone or changed since.
        """
        ids = [self.byte_ids[b] for b in piece]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, new, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(heap, (*found, i, new, ids[k]))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(heap, (*found, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut_added and (parts := self.cut_added.split(text))[1:]:
            return b"".join(self.added[p] if p in self.added else b"".join(map(self.of_chunk, self.chunks(p))) for p in parts)
        return b"".join(map(self.of_chunk, self.chunks(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id, ids`` (array of integers). Null text is empty and has no ids; a null id stays null; repeated rows repeat."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)
        for part in slices(batches):
            ids = [np.frombuffer(bpe.encode(t), "<u4") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return _rows(docs).mapInArrow(task, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The inverse of ``encode``: ``doc_id, text``. Null ids give an empty text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)
        for part in batches:
            texts = [bpe.decode(np.array(i or [], "<u4").tobytes()) for i in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(task, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; edge cases as in ``encode``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = Bpe.load(path), hashlib.sha256
        for part in slices(batches):
            ids = list(map(bpe.encode, part.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([sha(i).hexdigest() for i in ids], pa.string()),
                pa.array([sha(bpe.decode(i).encode()).hexdigest() for i in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _rows(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
