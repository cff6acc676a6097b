"""Exact token counts of every prefix, by dynamic programming.

A merge vocabulary encodes a string the same way wherever each two neighbouring
tokens would also be made of just the two. So the last token of a prefix is the
one token that ends there and stands rightly beside the last token of the prefix
before it, and the count is one more than there. One pass over a text so gives the
count of every prefix: where a budget of tokens ends, and what any truncation
costs, is then looked up and never encoded again.

Pieces of the vocabulary hold spaces only in front, so a text falls into segments
(spaces, then other characters) that are encoded independently; the counts of a
segment's prefixes are kept in a cache bounded in bytes. A segment without a space, however
long, is worked through in stretches, of which the next needs the last few prefixes only.

Defined cases: a null text is an empty one, with no tokens; rows that repeat a key
are counted each on its own; an empty table gives no rows; other columns are not
read. Counts are those of sentencepiece without begin and end tokens, strings of
special tokens being ordinary text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .encoders import ChunkTable
from .shared import Rows, own_columns, strings

LIMIT = 4096
#: Characters of the texts whose new segments are learned together.
GROUP_CHARS = 4 << 20
SPACE = "▁"
ONE = (1,)
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceCounter:
    """Prefix counts under a sentencepiece BPE model."""

    #: Bytes of the segments kept in a worker, and pairs of tokens, about 100 bytes each.
    CACHED_BYTES, PAIRS = 200 << 20, 600_000
    #: Characters of a segment whose counts are Python objects at a time.
    STRETCH = 1 << 16

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        ordinary = [n for n in ids if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n) or model.is_unused(n))]
        self.score = {model.id_to_piece(n): model.get_score(n) for n in ordinary}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.score):
            raise ValueError("pieces with a space after other characters are not supported")
        # Pieces that the merges never make of their characters end no prefix.
        real = [p for p in self.score if len(p) == 1 or self.merged(p) == [p]]
        self.code = {p: n for n, p in enumerate(real)}
        # Lengths of the pieces, longest first, by how they end: in these two characters, or in these three.
        two: dict[str, set[int]] = {}
        three: dict[str, set[int]] = {}
        for p in real:
            if len(p) > 1:
                two.setdefault(p[-2:], {1}).add(len(p))
            if len(p) > 2:
                three.setdefault(p[-3:], {1}).add(len(p))
        for end, found in three.items():
            if 2 in two.get(end[-2:], ()):
                found.add(2)
        self.two = {end: tuple(sorted((n for n in found if n < 3), reverse=True)) for end, found in two.items()}
        self.three = {end: tuple(sorted(found, reverse=True)) for end, found in three.items()}
        self.longest = max(map(len, real), default=1)
        self.fits: dict[int, bool] = {}
        self.known = ChunkTable(self.CACHED_BYTES, np.int32)

    def merged(self, text: str) -> list[str]:
        """The merges of one or two tokens' characters: best score first, leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for n in range(len(parts) - 1):
                s = score.get(parts[n] + parts[n + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, n
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: str, right: str) -> bool:
        """Whether the two tokens' characters together make just these two."""
        return self.merged(left + right) == [left, right]

    def counts(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many prefixes each segment has, and the tokens of each, the shortest first. The segments are
        sorted: what one has in common with the one before is not worked through again."""
        code, fits, two, three, tokens = self.code, self.fits, self.two, self.three, len(self.code)
        found, lengths, before = array("i"), np.array([len(s) for s in segments], np.int64), ""
        # Of each prefix from ``base`` on: its last token, where that begins, all tokens.
        last, begin, counts, base = [0], [0], [0], 0
        for segment in segments:
            if base:
                last, begin, counts, base, before = [0], [0], [0], 0, ""
            shared, most = 0, min(len(before), len(segment))
            while shared < most and before[shared] == segment[shared]:
                shared += 1
            del last[shared + 1:], begin[shared + 1:], counts[shared + 1:]
            told, before = 0, segment
            for end in range(shared + 1, len(segment) + 1):
                sizes = three.get(segment[end - 3:end]) if end > 2 else None
                if sizes is None:
                    sizes = two.get(segment[end - 2:end], ONE) if end > 1 else ONE
                for size in sizes:
                    if size > end:
                        continue
                    start = end - size
                    text = segment[start:end]
                    token = code.get(text)
                    if token is None:
                        if size > 1:
                            continue
                        token = tokens + ord(text)  # outside the vocabulary: never merged
                    if start:
                        pair = last[start - base] << 24 | token
                        fitting = fits.get(pair)
                        if fitting is None:
                            if len(fits) >= self.PAIRS:
                                fits.clear()
                            fitting = fits[pair] = self.stands(segment[begin[start - base]:start], text)
                        if not fitting:
                            continue
                    last.append(token)
                    begin.append(start)
                    # A character outside the vocabulary is spelled in its bytes.
                    counts.append(counts[start - base] + (1 if token < tokens else len(text.encode())))
                    break
                else:
                    raise AssertionError(f"no token ends at {end} of {segment!r}")
                if len(counts) > self.STRETCH + self.longest:
                    drop = len(counts) - self.longest
                    found.extend(counts[told + 1 - base:drop])
                    told, base = base + drop - 1, base + drop
                    del last[:drop], begin[:drop], counts[:drop]
            found.extend(counts[told + 1 - base:])
        return lengths, np.frombuffer(found, np.int32) if found else np.zeros(0, np.int32)

    @staticmethod
    def segments(text: str) -> tuple[list[str], int]:
        """A text's segments, and its characters with the space put before it; the text is not empty."""
        spaced = SPACE + text.replace(" ", SPACE)
        # Single spaces are by far the usual case: then each part but the first has one before it.
        found = SEGMENT.findall(spaced) if SPACE * 2 in spaced else [SPACE + p for p in spaced.split(SPACE)[1:]]
        if spaced[-1] == SPACE and SPACE * 2 not in spaced:
            found[-1] = SPACE
        return found, len(spaced)

    def prepare(self, texts: list[str]) -> None:
        """Learn the segments of several texts together: the more are sorted at once, the more is shared."""
        self.known.places(list({s for t in texts if t for s in self.segments(t)[0]}), self.counts)

    def _segments(self, text: str) -> tuple[np.ndarray, int]:
        """Numbers of a text's segments."""
        found, size = self.segments(text)
        return self.known.places(found, self.counts), size

    def total(self, text: str) -> int:
        """Tokens of the whole text: its counts' last, segment by segment."""
        if not text:
            return 0
        n, _ = self._segments(text)
        known = self.known
        return int(known.flat[known.start[n] + known.length[n] - 1].sum())

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ... up to the whole text."""
        if not text:
            return np.zeros(1, np.int32)
        n, size = self._segments(text)
        flat, lengths, start = self.known.flat, self.known.length[n], self.known.start[n]
        whole = flat[start + lengths - 1]
        before = np.cumsum(lengths) - lengths
        counts = flat[np.arange(size) + np.repeat(start - before, lengths)]
        counts = counts + np.repeat(np.cumsum(whole) - whole, lengths)
        counts[0] = 0  # the space put before a text counts for nothing if no text follows
        return counts.astype(np.int32)


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most so many tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def _schema(keep: bool) -> pa.Schema:
    return pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()),
        ("fit_chars", pa.int64()), *([("steps", pa.binary())] if keep else []),
    ])


def prepared(counter: PieceCounter, batch: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
    """Keys and texts of a batch; the texts are prepared in groups of bounded size."""
    group: list[tuple[int | None, str]] = []
    size = 0
    for key, text in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
        group.append((key, text or ""))
        size += len(text or "")
        if size > GROUP_CHARS:
            counter.prepare([t for _, t in group])
            yield from group
            group, size = [], 0
    counter.prepare([t for _, t in group])
    yield from group


def _run(model: str, budget: int, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, out = piece_counter(model), Rows(_schema(keep))
        for batch in batches:
            for key, text in prepared(counter, batch):
                total = counter.total(text)
                counts = counter.prefixes(text) if keep or total > budget else None
                fit = len(text) if total <= budget else longest_within(counts, budget)
                row = (key, len(text.encode()), len(text), total, fit)
                if keep:  # one more character changes the count by less than 17 either way
                    steps = np.diff(counts).astype(np.int8).tobytes()
                    yield from out.add((*row, steps), 64 + len(steps))
                else:
                    yield from out.add(row)
        yield from out.rest()

    return run


def prefix_table(docs: DataFrame, model: str, budget: int = LIMIT, keep_steps: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, fit_chars[, steps]).

    ``fit_chars`` is the length of the longest prefix within the budget. ``steps`` holds, one signed
    byte per character, by how much it changes the count: their running sum is the count of every
    prefix, for ``tokens_at`` and ``chars_within``."""
    columns = "doc_id long, n_bytes long, n_chars long, n_tokens long, fit_chars long" + ", steps binary" * keep_steps
    return own_columns(docs, doc_id=key, text=text).mapInArrow(_run(model, budget, keep_steps), columns)


@pandas_udf(LongType())
def tokens_at(steps, chars):
    """Tokens of the prefix of so many characters, from the stored steps."""
    return steps.combine(chars, lambda s, n: int(np.frombuffer(s, np.int8)[:max(n, 0)].sum(dtype=np.int64)))


@pandas_udf(LongType())
def chars_within(steps, budget):
    """Characters of the longest prefix within a budget of tokens, from the stored steps."""
    return steps.combine(budget, lambda s, n: longest_within(np.concatenate([[0], np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64)]), n))


def digest(docs: DataFrame, model: str) -> DataFrame:
    return prefix_table(docs, model, keep_steps=False).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_chars", "fit_chars"
    )
