"""Encoders of the public vocabulary files, as the tasks of several operators use them.

Each gives exactly what the named library gives for the file; the tests compare
them on random and awkward strings. They live in module state, so that a Python
worker loads a vocabulary once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from sys import getsizeof

import numpy as np

# A task has one core: the library's own threads would only take turns on it.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

#: How byte-level vocabularies split text before merging. FIXED VALUES: part of the file format.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_symbol() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies, by rule: a byte that prints stands for
    itself, the others follow from code point 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteEncoder:
    """Ids of a byte-level BPE file, as the tokenizers library gives them without added tokens.

    Where the file's ids are in the order of its merges, the merges are run by tiktoken, which is
    several times as fast and gives the same ids; any other file, and any text tiktoken refuses,
    goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = self._ranked(json.load(open(path, encoding="utf-8")))

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = (
            spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex")
            and not before.get("add_prefix_space") and not model.get("ignore_merges")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        )
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        in_order = all(model["vocab"].get(a + b) == 256 + n for n, (a, b) in enumerate(merges))
        if not plain or not in_order:
            return None
        of = byte_of_symbol()
        ranks = {bytes(of[c] for c in s): n for s, n in model["vocab"].items() if s not in special}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except BaseException as refused:  # a panic of the Rust side is no Exception
                if isinstance(refused, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                    raise
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


class ChunkTable:
    """Sequences of numbers by string, in flat arrays, bounded by the bytes they take.

    What is over the limit is forgotten as a whole, before more is learned. Strings beyond LONGEST
    characters hardly come twice; they are kept only until the next forgetting, which their bytes hasten."""

    #: Bytes of a dictionary entry beside its string, and of its place in the arrays.
    ENTRY, LONGEST = 120, 256

    def __init__(self, limit: int, kind):
        self.limit, self.kind = limit, kind
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.length, self.start = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.filled, self.held, self.long = np.zeros(8192, self.kind), 0, 0, False

    def learn(self, keys: list[str], lengths: np.ndarray, new: np.ndarray) -> None:
        first = len(self.number)
        while first + len(keys) > len(self.length):
            self.length, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.start))
        if self.filled + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.filled], np.zeros(max(len(new), len(self.flat)), self.kind)])
        self.number.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.length[first:first + len(keys)] = lengths
        self.start[first:first + len(keys)] = self.filled + np.cumsum(lengths) - lengths
        self.flat[self.filled:self.filled + len(new)] = new
        self.filled += len(new)
        self.held += sum(map(getsizeof, keys)) + self.ENTRY * len(keys) + 2 * new.nbytes
        self.long = self.long or max(map(len, keys)) > self.LONGEST

    def places(self, keys: list[str], values_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Numbers of the keys. Those that are new are learned: ``values_of`` them is how many values each
        has, and all values in a row."""
        new = set(keys).difference(self.number)
        if new:
            if self.held > self.limit or self.long and self.held > self.limit // 4:
                self.forget()
                new = set(keys)
            ordered = sorted(new)
            self.learn(ordered, *values_of(ordered))
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))


class WordEncoder:
    """Ids of a BPE file with word ends, as the tokenizers library gives them.

    Its pre-tokens never cross white space, so a normalised text is looked up chunk by chunk in a
    bounded cache, and only new chunks go to the library. Strings of special tokens are found
    before normalisation, as the library does.
    """

    #: Bytes of the chunks kept in a worker; what a single text adds comes on top.
    CACHED_BYTES = 160 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        plain = spec | {"normalizer": None, "added_tokens": []}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.inner = Tokenizer.from_str(json.dumps(plain | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        size = 1 + max([*spec["model"]["vocab"].values(), *self.special.values()])
        self.strings = [""] * size
        for s, n in (spec["model"]["vocab"] | self.special).items():
            self.strings[n] = s
        symbols = byte_of_symbol()
        self.bytes_of = np.array([sum(c in symbols for c in s.removesuffix(self.suffix)) for s in self.strings], np.int64)
        self.ends_word = np.array([s.endswith(self.suffix) for s in self.strings])
        self.known = ChunkTable(self.CACHED_BYTES, np.uint32)

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = [c.ids for c in self.plain.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([len(c) for c in codes], np.int64), np.array([n for c in codes for n in c], np.uint32)

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Normalised texts between special tokens, (text, None), and those tokens, ("", id)."""
        found, at = [], 0
        for m in self.at_special.finditer(text):
            found += [(self.normalised(text[at:m.start()]), None), ("", self.special[m[0]])]
            at = m.end()
        return [*found, (self.normalised(text[at:]), None)]

    def normalised(self, text: str) -> str:
        """By the library; in ASCII only letter case and white space change, and runs of spaces
        may stay, since they separate chunks as one space does."""
        if text.isascii():
            text = text.lower()
            for space in "\t\n\v\f\r":
                text = text.replace(space, " ")
            return text
        return self.library.normalizer.normalize_str(text)

    def chunk_ids(self, text: str) -> np.ndarray:
        """Ids of a normalised text."""
        known = self.known
        n = known.places(text.split(" "), self._encoded)
        lengths = known.length[n]
        before = np.cumsum(lengths) - lengths
        return known.flat[np.arange(lengths.sum()) + np.repeat(known.start[n] - before, lengths)]

    def ids(self, text: str) -> np.ndarray:
        parts = [np.array([n], np.uint32) if n is not None else self.chunk_ids(s) for s, n in self.segments(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        """As the library does where the file names no decoder: the tokens' strings, spaced."""
        strings = self.strings
        return " ".join([strings[n] for n in ids.tolist()])


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
