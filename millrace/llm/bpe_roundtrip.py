"""BPE encoding by tree concatenation, and decoding.

A long text is normalised, cut into halves of halves without looking for a good
place, and the leaves are encoded in parallel, as rows of their own. Two
neighbours are joined by encoding a window around the cut anew: the window starts
and ends at tokens of the two sides and is taken if its first token is the left
side's and its last token the right side's. Until both agree, it grows. Then every
two neighbouring tokens of the joined sequence stand beside each other in some
right encoding, which makes the whole right, since merges work on neighbours
alone. A window never needs to go beyond white space, across which nothing merges.

Defined cases: a null text is an empty one (no ids, empty decoded text); rows that
repeat a key are encoded each on its own, but equal long texts once; an empty table
gives no rows; strings of special tokens become these tokens, as in the library; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoders import WordEncoder, word_encoder
from .shared import Rows, own_columns, strings

#: Characters of a leaf. Longer texts are cut.
LEAF = 16_384
#: Bytes of either side that a window has at first.
WINDOW = 64
#: Characters of the longest ending that the vocabulary's pattern splits off ('re, 've, 'll).
LONGEST_CONTRACTION = 3

ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
ENCODED_COLUMNS = "doc_id long, n_tokens long, ids binary, decoded string"


@dataclass
class Node:
    """Ids of a stretch of text, with its first and last chunk (what lies before the first and after
    the last white space) and their numbers of tokens. Without white space both are the whole."""

    ids: np.ndarray
    head: str
    tail: str
    head_n: int
    tail_n: int
    whole: bool


def leaf(coder: WordEncoder, text: str) -> Node:
    ids = coder.chunk_ids(text)
    if " " not in text:
        return Node(ids, text, text, len(ids), len(ids), True)
    head, tail = text[:text.index(" ")], text[text.rindex(" ") + 1:]
    return Node(ids, head, tail, len(coder.chunk_ids(head)), len(coder.chunk_ids(tail)), False)


def special(token: int) -> Node:
    """A special token: nothing merges with it on either side."""
    return Node(np.array([token], np.uint32), "", "", 0, 0, False)


def join(coder: WordEncoder, left: Node, right: Node) -> Node:
    cut, skip = len(left.ids) - left.tail_n, right.head_n
    middle = join_chunks(coder, left.tail, left.ids[cut:], right.head, right.ids[:skip])
    ids = np.concatenate([left.ids[:cut], middle, right.ids[skip:]])
    chunk, n = left.tail + right.head, len(middle)
    head, head_n = (chunk, n) if left.whole else (left.head, left.head_n)
    tail, tail_n = (chunk, n) if right.whole else (right.tail, right.tail_n)
    return Node(ids, head, tail, head_n, tail_n, left.whole and right.whole)


def join_chunks(coder: WordEncoder, a: str, a_ids: np.ndarray, b: str, b_ids: np.ndarray) -> np.ndarray:
    """Ids of a + b, which hold no white space, from the ids of each."""
    if not a or not b:
        return a_ids if a else b_ids
    left, right = a.encode(), b.encode()
    a_ends, b_ends = np.cumsum(coder.bytes_of[a_ids]), np.cumsum(coder.bytes_of[b_ids])
    window = WINDOW
    while True:
        # The window begins where token i of a does and ends where token j of b does.
        i = int(np.searchsorted(a_ends, len(left) - window, side="left"))
        j = int(np.searchsorted(b_ends, window, side="left"))
        start = int(a_ends[i - 1]) if i else 0
        all_left, all_right = i == 0, j >= len(b_ids) - 1
        end = len(right) if all_right else int(b_ends[j])
        try:
            text = (left[start:] + right[:end]).decode()
        except UnicodeDecodeError:  # a token that ends inside a character
            text = None
        if text is not None:
            if all_right or coder.ends_word[b_ids[j]]:
                ids = np.array(coder.plain.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                ids = open_ended(coder, text)
            if len(ids) and (all_left or ids[0] == a_ids[i]) and (all_right or ids[-1] == b_ids[j]):
                return np.concatenate([a_ids[:i], ids, b_ids[j + 1:] if not all_right else b_ids[:0]])
        if all_left and all_right:
            raise AssertionError("the whole text is always agreed on")
        window *= 2


def open_ended(coder: WordEncoder, text: str) -> np.ndarray:
    """Ids of a text whose last word goes on: only that word is encoded without its end. None if it
    is so short that what follows may split it otherwise."""
    at = coder.plain.pre_tokenizer.pre_tokenize_str(text)[-1][1][0]
    if len(text) - at <= LONGEST_CONTRACTION:
        return np.zeros(0, np.uint32)
    closed = coder.plain.encode(text[:at], add_special_tokens=False).ids if at else []
    return np.array([*closed, *coder.inner.encode(text[at:], add_special_tokens=False).ids], np.uint32)


def halves(text: str, leaf_chars: int) -> list[str]:
    """The leaves of a text: halves of halves, until none is over the limit."""
    if len(text) <= leaf_chars:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf_chars) + halves(text[middle:], leaf_chars)


def tree(coder: WordEncoder, nodes: list[Node]) -> Node:
    while len(nodes) > 1:
        pairs = [join(coder, a, b) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = pairs + nodes[2 * len(pairs):]
    return nodes[0]


def _row(coder: WordEncoder, key: int | None, ids: np.ndarray) -> tuple:
    return key, len(ids), ids.astype("<u4").tobytes(), coder.decode(ids)


def _short(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = word_encoder(vocabulary), Rows(ENCODED)
        for batch in batches:
            for key, text in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
                row = _row(coder, key, coder.ids(text or ""))
                yield from out.add(row, len(row[2]) + 2 * len(row[3]))
        yield from out.rest()

    return run


LEAVES = pa.schema([("copy", pa.binary()), ("leaf", pa.int64()), ("special", pa.int64()), ("text", pa.string())])


def _leaves(vocabulary: str, leaf_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = word_encoder(vocabulary), Rows(LEAVES)
        for batch in batches:
            for copy, text in zip(*(strings(batch.column(c)) for c in range(2)), strict=True):
                n = 0
                for normal, token in coder.segments(text):
                    for part in halves(normal, leaf_chars):
                        yield from out.add((copy, n, token, part), 2 * len(part))
                        n += 1
        yield from out.rest()

    return run


NODES = pa.schema([
    ("copy", pa.binary()), ("leaf", pa.int64()), ("ids", pa.binary()), ("head", pa.string()),
    ("tail", pa.string()), ("head_n", pa.int64()), ("tail_n", pa.int64()), ("whole", pa.bool_()),
])
NODE_COLUMNS = "copy binary, leaf long, ids binary, head string, tail string, head_n long, tail_n long, whole boolean"


def _nodes(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = word_encoder(vocabulary), Rows(NODES)
        for batch in batches:
            for copy, n, token, text in zip(*(strings(batch.column(c)) for c in range(4)), strict=True):
                node = leaf(coder, text) if token is None else special(token)
                row = (copy, n, node.ids.tobytes(), node.head, node.tail, node.head_n, node.tail_n, node.whole)
                yield from out.add(row, len(row[2]) + 64)
        yield from out.rest()

    return run


def _joined(vocabulary: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        coder, rows = word_encoder(vocabulary), rows.sort_values("leaf")
        nodes = [Node(np.frombuffer(r.ids, np.uint32), r.head, r.tail, r.head_n, r.tail_n, r.whole) for r in rows.itertuples()]
        row = _row(coder, None, tree(coder, nodes).ids)
        return pd.DataFrame([(rows.copy_of.iloc[0], *row[1:])], columns=["copy_of", *ENCODED.names[1:]])

    return run


def encoded(
    docs: DataFrame, vocabulary: str, leaf_chars: int = LEAF, text: str = "text", key: str = "doc_id", made: dict[str, Column] | None = None,
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of whole texts; ids are little-endian unsigned 32-bit integers.
    ``made`` are the columns to return beside the key instead, from ``n_tokens``, ``ids`` and ``decoded``;
    they are made once for equal long texts."""
    made = made or {name: F.col(name) for name in ENCODED.names[1:]}
    columns = [c.alias(n) for n, c in made.items()]
    rows = own_columns(docs, doc_id=key, text=text)
    long = F.coalesce(F.char_length("text") > leaf_chars, F.lit(False))
    short = rows.filter(~long).mapInArrow(_short(vocabulary), ENCODED_COLUMNS).select("doc_id", *columns)
    # A long text is known by its content. However many rows hold it, each task sends a leaf of it once.
    named = rows.filter(long).select("doc_id", F.unhex(F.md5("text")).alias("copy"), "text")
    leaves = named.select("copy", "text").mapInArrow(_leaves(vocabulary, leaf_chars), "copy binary, leaf long, special long, text string")
    distinct = leaves.groupBy("copy", "leaf").agg(F.first("special").alias("special"), F.first("text").alias("text"))
    nodes = distinct.mapInArrow(_nodes(vocabulary), NODE_COLUMNS).withColumnRenamed("copy", "copy_of")
    joined = nodes.groupBy("copy_of").applyInPandas(_joined(vocabulary), "copy_of binary, n_tokens long, ids binary, decoded string")
    of_rows = named.select("doc_id", "copy").join(joined.select("copy_of", *columns), F.col("copy") == F.col("copy_of"))
    return short.unionByName(of_rows.select("doc_id", *made))


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    return encoded(docs, vocabulary, made={
        "n_tokens": F.col("n_tokens"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)})
