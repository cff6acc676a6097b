"""Benchmark decontamination by one automaton over the test items.

Texts and items are normalised alike: A-Z in lower case, words of digits, letters
a-z and everything beyond ASCII, one space between words. The windows of all items
(runs of so many words; a shorter item is one window) are the patterns of one
Aho-Corasick automaton. A text is scanned once, from its first byte to its last, in
stretches across which the automaton keeps its state. What it finds is told as words,
as items, and as passages of the original text, in code points.

The windows travel to the tasks, so their size is measured: beyond ``block_bytes`` they
are dealt into several blocks by hash, of which a worker holds one automaton at a
time, and every text is scanned for each block. The driver holds one block at a time.

Defined cases: a null text has no words and no hit; an empty text or item, or one of
signs alone, likewise; an item of fewer words than a window is one window; rows that
repeat an item's key are the same item, and the windows of each text count for it;
the words of items without a key are hits, but such items are not counted or named; rows that
repeat a document are scanned each on its own; without items nothing is hit; an
empty table gives no rows; further columns are carried along under any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Rows, own_columns, spread, strings, written

WINDOW = 10
#: Bytes of windows in one automaton, which takes about 45 times as many in memory.
BLOCK_BYTES = 4 << 20
#: Bytes of a text that are scanned at a time.
STRETCH = 1 << 20
SPACE = 32
#: What a byte is in a normalised text. Bytes of characters beyond ASCII stay.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE for b in range(256)
)


def stretches(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in the text's bytes, bytes in normal form, which of them stay when runs of spaces become
    one). A space is put before the text, at place -1, and after it."""
    data, after_space = b" " + text.encode().translate(NORMAL) + b" ", False
    for at in range(0, len(data), STRETCH):
        part = np.frombuffer(data, np.uint8, min(STRETCH, len(data) - at), at)
        space = part == SPACE
        keep = np.ones(len(part), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        keep[0] = not (space[0] and after_space)
        after_space = bool(space[-1])
        yield at - 1, part, keep


def words(text: str | None) -> list[str]:
    """The words of a text, as the automaton sees them: a character per byte."""
    return b"".join(part[keep].tobytes() for _, part, keep in stretches(text or "")).decode("latin-1").split(" ")[1:-1]


def windows(text: str | None, width: int) -> Iterator[str]:
    found = words(text)
    size = min(width, len(found))
    return (" ".join(found[n:n + size]) for n in range(len(found) - size + 1 if size else 0))


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, as intervals that don't touch."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.concatenate([new[1:], [True]])]


class Automaton:
    """Windows of a block, and the items that each is from."""

    def __init__(self, block: list[tuple[str, list[str]]]):
        import ahocorasick

        self.search = ahocorasick.Automaton()
        self.items = [items for _, items in block]
        self.words = np.array([w.count(" ") + 1 for w, _ in block], np.int64)
        for n, (window, _) in enumerate(block):
            self.search.add_word(f" {window} ", n)
        if not block:
            self.search.add_word("  ", 0)  # in no normalised text; without any word there is no automaton
        self.search.make_automaton()

    def scan(self, text: str) -> tuple[int, np.ndarray, np.ndarray, set[int]]:
        """Number of words; first and end of the runs of hit words; windows that occur."""
        search, spaces, length = None, 0, 0
        firsts, ends, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
        for _, part, keep in stretches(text):
            kept = part[keep]
            normal = kept.tobytes().decode("latin-1")
            if search is None:
                search = self.search.iter(normal)
            else:
                search.set(normal, False)
            here = np.flatnonzero(kept == SPACE) + length
            if hits := list(search):
                at, which = np.array(hits, np.int64).T
                end = spaces + np.searchsorted(here, at)  # words before the space that ends the window
                first, end = merged(end - self.words[which], end)
                firsts.append(first)
                ends.append(end)
                found.update(np.unique(which).tolist())
            spaces, length = spaces + len(here), length + len(kept)
        return spaces - 1, np.concatenate(firsts), np.concatenate(ends), found


def passages(text: str, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of words lie in the text, as half-open intervals of code points."""
    starts, stops, seen, chars, before = [], [], 0, 0, SPACE
    for at, part, _ in stretches(text):
        space = part == SPACE
        was_space = np.concatenate([[before == SPACE], space[:-1]])
        points = chars + np.cumsum((part & 0xC0) != 0x80) - 1  # of each byte, counted from the space at the front
        opens, closes = np.flatnonzero(~space & was_space), np.flatnonzero(space & ~was_space)
        closed = seen - (before != SPACE)
        here = first[(first >= seen) & (first < seen + len(opens))]
        starts += (points[opens[here - seen]] - 1).tolist()
        here = end[(end > closed) & (end <= closed + len(closes))]
        stops += (points[closes[here - closed - 1]] - 1).tolist()
        seen, chars, before = seen + len(opens), int(points[-1]) + 1, int(part[-1])
    return list(zip(starts, stops, strict=True))


FOUND = "struct<n_words: bigint, n_hit: bigint, items: array<string>, passages: array<struct<start: bigint, end: bigint>>>"
FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


class Block:
    """Windows on their way to the tasks: a broadcast under a name of its own."""

    def __init__(self, windows: list[tuple[str, list[str]]], spark: SparkSession):
        self.name, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(windows)

    def __eq__(self, other):
        return self.name == other.name

    def __hash__(self):
        return hash(self.name)


@lru_cache(maxsize=1)
def automaton(block: Block) -> Automaton:
    """A worker keeps one. The broadcast is read from its file, since ``value`` would keep it too."""
    return Automaton(block.sent.load_from_path(block.sent._path))


def scanned(texts: list[str], blocks: list[Block]) -> list[dict]:
    """Each text against every block."""
    found = [{"n_words": 0, "first": [], "end": [], "items": set()} for _ in texts]
    for block in blocks:
        patterns = automaton(block)
        for text, row in zip(texts, found, strict=True):
            row["n_words"], first, end, which = patterns.scan(text)
            if which:
                row["first"].append(first)
                row["end"].append(end)
                row["items"].update(item for n in which for item in patterns.items[n])
    for text, row in zip(texts, found, strict=True):
        first, end = row.pop("first"), row.pop("end")
        row |= {"n_hit": 0, "passages": []}
        if first:
            first, end = merged(np.concatenate(first), np.concatenate(end))
            row["n_hit"], row["passages"] = int((end - first).sum()), [{"start": a, "end": b} for a, b in passages(text, first, end)]
        row["items"] = sorted(row["items"])
    return found


def item_windows(benchmark: DataFrame, width: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item) of all items; the item is the key as a string."""
    schema = pa.schema([("window", pa.string()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for item, whole in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
                for window in windows(whole, width):
                    yield from out.add((window, item), len(window))
        yield from out.rest()

    own = own_columns(benchmark, item=key, text=text).select(F.col("item").cast("string"), "text")
    return own.mapInArrow(run, "window string, item string").distinct()


def blocks_of(pairs: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The windows with their items, in blocks of about so many bytes."""
    size = pairs.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    count = spread(size, block_bytes)
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(count)))
    for n in range(count):
        block: dict[str, list[str]] = {}
        for window, item in dealt.filter(F.col("block") == n).select("window", "item").collect():
            block.setdefault(window, []).extend([] if item is None else [item])
        yield sorted(block.items())


def _finder(blocks: list[Block]) -> Callable:
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(scanned([t or "" for t in strings(batch)], blocks), FOUND_ARROW)

    return F.arrow_udf(find, FOUND)


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(row, found): each document's own columns, and what of the benchmark its text holds: ``n_words``,
    ``n_hit`` (words inside occurrences of windows), ``items`` (their keys as strings, sorted) and
    ``passages`` (the stretches of hit words, in code points of the original text)."""
    pairs = written(item_windows(benchmark, width, item_key, item_text), "windows")
    blocks = [Block(windows, docs.sparkSession) for windows in blocks_of(pairs, block_bytes)]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), _finder(blocks)(F.col(f"`{text}`")).alias("found"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, most_hit: float = 0.0, **names) -> DataFrame:
    """The documents of whose words at most this share is inside windows of the benchmark."""
    share = F.col("found.n_hit") <= F.col("found.n_words") * F.lit(most_hit)
    return contamination(docs, benchmark, **names).filter(share).select("row.*")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(own_columns(docs, doc_id="doc_id", text="text"), benchmark)
    return found.select(
        "row.doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )
