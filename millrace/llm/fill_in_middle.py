"""Fill-in-the-middle transformation with memoized content-defined chunks.

A text's UTF-8 bytes are cut into chunks where a rolling hash of the last few bytes
says so, between a least and a largest size, so a passage that many documents share
falls into the same chunks wherever it stands. What is known of a chunk is a summary:
its bytes, how many code points begin in it, whether a marker stands in it, and its
first and last bytes. Summaries are kept in a cache under the chunk itself, so a
shared chunk is verified by its content, and they combine: counts add up, and a marker
that lies across a boundary shows in the last bytes of one and the first of the next.

A cut after so many code points is then located by the running sum of the chunks'
counts and lies inside one chunk, which alone is looked at; a character that a chunk
boundary divides belongs to the chunk in which it begins. Only counts and places go
back to the plan, which slices the text by bytes and puts it together.

The form and the two cuts follow from the document's key. ``restored`` rebuilds the
exact text from output and form alone: a text that holds a marker stays plain, so the
markers of an output are those put there.

Defined cases: a null text is an empty one; an empty text is plain; rows that repeat a
key are cut by the same numbers; a null key counts as the empty string in the hash; an
empty table gives no rows; further columns are carried along under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import own_columns, strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
EDGE = len(PREFIX) - 1
#: Per cent of the documents that are transformed, and of these in suffix-first form.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of the rolling hash, and of a chunk: at least, at most, and one in so many places is a cut.
ROLL, LEAST, MOST, ONE_IN = 32, 256, 8192, 1024
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 20
#: Bytes of chunks whose summaries are kept in a worker, with about as much again for the summaries.
CACHED_BYTES = 48 << 20
BASE = 0x9E3779B97F4A7C15
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int) -> np.ndarray:
    powers = np.full(STRETCH, base % 2**64, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


POWERS, INVERSES = _powers(BASE), _powers(pow(BASE, -1, 2**64))
THRESHOLD = np.uint64(2**64 // ONE_IN)


def candidates(data: np.ndarray) -> np.ndarray:
    """Places after which a stretch may be cut: the hash of the bytes before them is small."""
    if len(data) < ROLL:
        return np.zeros(0, np.int64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[:len(data)], out=sums[1:])
    rolled = (sums[ROLL:] - sums[:-ROLL]) * INVERSES[:len(data) - ROLL + 1]
    rolled = (rolled ^ (rolled >> np.uint64(29))) * SPREAD
    return np.flatnonzero(rolled < THRESHOLD) + ROLL


def chunks(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks. A cut depends only on the bytes since the one before."""
    at = 0
    while at < len(data):
        base, stop = at, min(at + STRETCH, len(data))
        places = candidates(np.frombuffer(data, np.uint8, stop - base, base)) + base
        # The last chunk of a stretch is cut again as the first of the next one, unless the text ends.
        while at < stop and (stop == len(data) or at + MOST <= stop):
            n = int(np.searchsorted(places, at + LEAST))
            end = min(at + MOST, stop)
            if n < len(places) and places[n] < end:
                end = int(places[n])
            yield at, end
            at = end


@dataclass(slots=True)
class Summary:
    points: int
    marked: bool
    head: bytes
    tail: bytes


def summarised(chunk: bytes) -> Summary:
    points = int(((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80).sum())
    return Summary(points, any(m in chunk for m in MARKERS), chunk[:EDGE], chunk[-EDGE:])


class ChunkCache:
    """Summaries by content, bounded by the bytes of the chunks."""

    def __init__(self, limit: int = CACHED_BYTES):
        self.limit, self.held, self.known = limit, 0, {}
        self.hits = self.misses = 0

    def __call__(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            self.misses += 1
            found = summarised(chunk)
            if self.held + len(chunk) > self.limit:
                self.known.clear()
                self.held = 0
            self.known[chunk] = found
            self.held += len(chunk)
        else:
            self.hits += 1
        return found


CACHE = ChunkCache()


def place_of(data: bytes, start: int, end: int, points: int) -> int:
    """The byte at which the code point begins that so many of the chunk's come before."""
    return start + int(np.flatnonzero((np.frombuffer(data, np.uint8, end - start, start) & 0xC0) != 0x80)[points])


def located(text: str, first: int, second: int, cache: ChunkCache) -> tuple[int, int, int, int, int, bool]:
    """(n, smaller cut, larger cut, their places in bytes, whether a marker stands in the text)."""
    data = text.encode()
    bounds, counts, marked, tail = [], [], False, b""
    for start, end in chunks(data):
        known = cache(data[start:end])
        marked = marked or known.marked or any(m in tail + known.head for m in MARKERS)
        tail = (tail + known.tail)[-EDGE:]
        bounds.append((start, end))
        counts.append(known.points)
    reach = np.cumsum(np.array(counts, np.int64))
    n = int(reach[-1]) if counts else 0
    low, high = sorted((first % (n + 1), second % (n + 1)))
    places = []
    for cut in (low, high):
        if cut == n:
            places.append(len(data))
            continue
        k = int(np.searchsorted(reach, cut, side="right"))
        places.append(place_of(data, *bounds[k], cut - (int(reach[k - 1]) if k else 0)))
    return n, low, high, *places, marked


CUTS = "struct<n: bigint, low: bigint, high: bigint, low_byte: bigint, high_byte: bigint, marked: boolean>"
CUT_FIELDS = [("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("low_byte", pa.int64()), ("high_byte", pa.int64()), ("marked", pa.bool_())]


def cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    rows = [located(t or "", a, b, CACHE) for t, a, b in zip(strings(text), first.to_pylist(), second.to_pylist(), strict=True)]
    columns = list(zip(*rows, strict=True)) or [()] * len(CUT_FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, CUT_FIELDS, strict=True)], names=[n for n, _ in CUT_FIELDS])


def drawn(key: Column, count: int, seed: str) -> list[Column]:
    """Unsigned 32-bit numbers that follow from the key."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(count)]


def transformed(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1:") -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output): each document's own columns, its code points,
    and its text in the form drawn for it, with the code points of the parts (null if plain)."""
    row, names = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), ("h1", "h2", "h3", "h4")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(row.alias("row"), whole.alias("whole"), *[h.alias(n) for h, n in zip(drawn(F.col(f"`{key}`"), 4, seed), names, strict=True)])
    rows = rows.withColumn("cut", F.arrow_udf(cuts, CUTS)("whole", "h1", "h2"))
    plain = (F.col("cut.n") == 0) | F.col("cut.marked") | (F.col("h3") % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    data, low, high = F.col("whole").cast("binary"), F.col("cut.low_byte").cast("int"), F.col("cut.high_byte").cast("int")
    prefix, middle, suffix = (
        F.substring(data, start + 1, length).cast("string") for start, length in
        ((F.lit(0), low), (low, high - low), (high, F.octet_length("whole") - high))
    )
    made = F.when(F.col("form") == "plain", F.col("whole")).when(
        F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    ).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    whole_form = F.col("form") == "plain"
    return rows.withColumn("form", form).select(
        "row", F.col("cut.n").alias("n"), "form", F.when(~whole_form, F.col("cut.low")).alias("prefix_chars"),
        F.when(~whole_form, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"), made.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed."""
    parts = F.split(output, "<[PSM]>", -1)  # nothing before the first marker, then the parts as they stand
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def digest(docs: DataFrame) -> DataFrame:
    made = transformed(own_columns(docs, doc_id="doc_id", text="text"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
