"""Token ids by whole words: each distinct word is encoded once per worker while it stays in a bounded cache."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Words in each of the two halves of a cache.
CACHED = 400_000
#: Words that a table of hashes holds: about 30 bytes each.
HASHED = 1 << 20
#: Small letters of one and two bytes, which no tokenizer's lower-casing or composing changes.
SMALL = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
LETTERS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
#: Marks that may end a word; an apostrophe may belong to the letters behind it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Cache(dict):
    """A mapping that computes what it lacks; of old entries only those used again stay."""

    def __init__(self, compute: Callable, limit: int = CACHED, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Ids of texts as little-endian 32-bit integers, by a tokenizer that lower-cases and never joins
    what ASCII white space parts, nor a letter and a full stop or comma behind it."""

    _of: dict[str, Cache] = {}
    _sizes: dict[str, int] = {}

    def __init__(self, path: str, cached: int = CACHED):
        if path not in self._of:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()

            model, added = tok.model, [t.content.lower() for t in tok.get_added_tokens_decoder().values()]
            pieces = (lambda t: [x for x, _ in tok.pre_tokenizer.pre_tokenize_str(t)]) if tok.pre_tokenizer else (lambda t: [t])
            shown = {c: "".join(pieces(c)) for c in SMALL}  # a letter as the model's alphabet spells it
            plain = (tok.normalizer is None or tok.normalizer.normalize_str(SMALL) == SMALL) and pieces(SMALL) == ["".join(shown.values())] and not any(
                set(t) <= set(SMALL) for t in added)
            marks = [c for c in MARKS if not any(c in t for t in added)] if plain else []
            apart = [c for c in marks if [pieces("z" + c), pieces("z" + c + c)] == [["z", *pieces(c)], ["z", *pieces(c + c)]]
                     and (tok.normalizer is None or tok.normalizer.normalize_str("z" + c) == "z" + c)]
            spelt, split = str.maketrans(shown), re.compile(b"(" + LETTERS + b")([" + re.escape("".join(apart)).encode() + b"]*)" if apart else b"(" + LETTERS + b")()").fullmatch

            def compute(word: bytes) -> bytes:
                found = split(word) if plain else None
                if found:
                    if found[2]:  # letters and marks are pieces of their own
                        return self._of[path][found[1]] + self._of[path][found[2]]
                    text = word.decode()  # one piece that nothing changes: the model alone, a third of the time
                    return array("I", [x.id for x in model.tokenize(text if text.isascii() else text.translate(spelt))]).tobytes()
                if len(word) > 1 and word[-1] in b".," and 97 <= word[-2] <= 122:
                    return self._of[path][word[:-1]] + self._of[path][word[-1:]]
                return np.array(tok.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            self._of[path], self._sizes[path] = Cache(compute, cached), tok.get_vocab_size(with_added_tokens=True)
        self.cache, self.size = self._of[path], self._sizes[path]
        self.cache.limit = cached

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts."""
        get = self.cache.__getitem__
        return [b"".join(map(get, lower(text).split())) for text in texts.cast(pa.binary()).to_pylist()]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without white space."""
        return [self.cache[lower(w)] for w in words]


class WordTable:
    """Ids of words by their 64-bit hashes, in arrays; of more than ``limit`` words the half that was used last stays. The end is the first id."""

    _of: dict[str, WordTable] = {}

    def __init__(self, tokens: WordIds, limit: int = HASHED):
        self.tokens, self.limit, self.now = tokens, limit, 0
        self.flat = np.array([tokens.size - 1], np.uint16 if tokens.size <= 1 << 16 else np.uint32)
        self.h, self.rows = np.zeros(0, np.int64), np.zeros((0, 3), np.int32)  # where its ids begin, how many they are, when it was used

    @classmethod
    def of(cls, path: str) -> WordTable:
        """The table of this process, with few words in the cache beside it."""
        if path not in cls._of:
            cls._of[path] = cls(WordIds(path, CACHED // 2))
        return cls._of[path]

    def find(self, h: np.ndarray, words: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each of the sorted hashes begin, how many they are, and all ids; ``words`` gives the words of numbered hashes, lower-cased."""
        at = np.searchsorted(self.h, h)
        new = np.ones(len(h), bool) if not len(self.h) else self.h[np.minimum(at, len(self.h) - 1)] != h
        if new.any():
            coded = [self.tokens.cache[w] for w in words(np.flatnonzero(new))]
            size = np.fromiter(map(len, coded), np.int32, len(coded)) >> 2
            rows = np.stack([len(self.flat) + np.cumsum(size, dtype=np.int32) - size, size, np.zeros_like(size)], axis=1)
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(coded), "<u4").astype(self.flat.dtype)])
            self.h, self.rows = np.insert(self.h, at[new], h[new]), np.insert(self.rows, at[new], rows, axis=0)
            at += np.cumsum(new) - new
        self.now += 1
        self.rows[at, 2] = self.now
        found, flat = self.rows[at], self.flat
        if len(self.h) > self.limit:
            self._shrink()
        return found[:, 0], found[:, 1], flat

    def _shrink(self) -> None:
        kept = np.sort(np.argsort(-self.rows[:, 2], kind="stable")[:self.limit // 2])
        self.h, self.rows = self.h[kept], self.rows[kept]
        begin, size = self.rows[:, 0].copy(), self.rows[:, 1]
        after = np.cumsum(size)
        self.flat = np.concatenate([self.flat[:1], self.flat[np.repeat(begin - after + size, size) + np.arange(size.sum())]])
        self.rows[:, 0] = 1 + after - size


def lower(text: bytes) -> bytes:
    """Lower-cased, unless special tokens or combining marks (first bytes CC, CD) could make that differ from the tokenizer's order."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()
