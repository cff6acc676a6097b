"""Similarity self-join on word n-grams by chosen paths.

Texts are sets of n-gram hashes. In each of several independent runs a set picks
each of its tokens with probability 1 / (threshold * size), by a hash that all
sets share: two similar sets pick a common token with a chance of at least
1 - 1/e. Sets that picked the same token share a bucket. Small buckets are
compared pair by pair on sketches of 64 min-hashes; a bucket that is too large is
split again, by tokens picked anew along its path, and one that is still large
after the deepest level, because its sets really are alike, is compared in tiles.
As many runs are made as the target recall needs for pairs that are split once
more. What a bucket emits is not its pairs but edges that connect its candidates.

Candidates that hang together are then verified: groups, in tiles of a few hundred
sets if they are large, get exact intersections of whole sets as matrix products.
A tile emits, for each text, how many documents it is linked to, and edges that
connect the linked ones. So a group of k near copies costs k * k comparisons of
numbers, but never k * k rows.

Equal texts are one set, and count with their copies: from the first grouping on, a
text is one row, however many rows of the table hold it. Texts themselves are fetched
again only for candidates, one row for each, by their hashes: a filter of the
candidates' hashes keeps all other texts out of the shuffle, at every size.

Of a class one row stays: that with the smallest key, null keys last, and of equal keys
that with the smallest content. Defined cases: a text of fewer words than an n-gram is
one n-gram; null texts and texts without a word are linked with nothing, and stay; rows
that repeat a key are further copies if the text is the same, and texts of their own if
not; the class of texts that all lack a key has no class id, but one of them stays; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import components, spanning_between, spanning_edges
from .shared import HashFilter, Rows, dropped, own_columns, spread, strings, written
from .shingles import BASE, WORDS, mixed, shingles

THRESHOLD = 0.8
TARGET_RECALL = 0.9999
#: Min-hashes of a sketch, one byte each, and how far below the threshold an estimate may lie:
#: five standard deviations at the threshold.
SKETCH, MARGIN = 64, 0.25
#: Sets of a bucket that are compared directly, levels at which larger ones are split, and sets of a tile.
BUCKET, LEVELS, TILE = 4096, 4, 256
ROWS_PER_TASK = 400_000
#: Pairs of sketches that are compared at a time, 64 bytes each.
COMPARED = 1 << 15
SKETCH_FACTORS = mixed(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has met with this chance, if its bucket is split
    once more: a run then succeeds with 1 - exp(-(1 - 1/e))."""
    once = 1 - math.exp(-1)
    return math.ceil(math.log(1 - recall) / math.log(math.exp(-once)))


def sketch(tokens: np.ndarray) -> bytes:
    lowest = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        part = tokens[at:at + 4096]
        lowest = np.minimum(lowest, (part[None, :] * SKETCH_FACTORS[:, None]).min(axis=1))
    return (mixed(lowest) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def picked(tokens: np.ndarray, path: np.uint64, threshold: float) -> np.ndarray:
    """Paths on which a set goes on from ``path``: one per token it picks there."""
    if not len(tokens):
        return tokens
    seed = mixed(np.array([path], np.uint64))[0]
    chance = min(1.0, 1 / (threshold * len(tokens)))
    drawn = mixed(tokens ^ seed)
    chosen = drawn <= np.uint64(min(int(chance * 2.0**64), 2**64 - 1))
    return mixed(drawn[chosen] + seed)


def start_of_run(run: int) -> np.uint64:
    return np.uint64((run + 1) * BASE % 2**64)


SETS = pa.schema([
    ("doc_id", pa.int64()), ("content", pa.binary()), ("size", pa.int32()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64())),
])


def _sets(words: int, threshold: float, runs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(SETS)
        for batch in batches:
            for key, content, text in zip(*(strings(batch.column(c)) for c in range(3)), strict=True):
                tokens = shingles(text, words)
                paths = [picked(tokens, start_of_run(r), threshold) for r in range(runs)]
                row = (key, content, len(tokens), sketch(tokens), np.concatenate(paths).view(np.int64))
                yield from out.add(row, 512)
        yield from out.rest()

    return run


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("path", pa.int64())])


def alike(sizes: np.ndarray, sketches: np.ndarray, others: np.ndarray, other_sketches: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, by size and by estimate."""
    linked = np.empty((len(sizes), len(others)), bool)
    step = max(1, COMPARED // max(1, len(others)))
    for at in range(0, len(sizes), step):
        same = (sketches[at:at + step, None, :] == other_sketches[None, :, :]).sum(axis=2, dtype=np.int16)
        s = sizes[at:at + step, None]
        linked[at:at + step] = (same >= SKETCH * (threshold - MARGIN)) & (
            np.minimum(s, others[None, :]) >= threshold * np.maximum(s, others[None, :]) - 1e-9)
    return linked


def _buckets(threshold: float, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (path, uid, size, sketch), sorted by path: candidate edges (a, b), and rows (a, path) of
    buckets over the limit, of which no more than the limit is ever held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(FOUND)
        path, held, size = None, [], 0  # of the bucket that is being read

        def close() -> Iterator[pa.RecordBatch]:
            if 2 <= size <= limit:
                uids, sizes, sketches = (np.concatenate([h[k] for h in held]) for k in range(3))
                linked = alike(sizes, sketches, sizes, sketches, threshold)
                for i, j in spanning_edges(linked):
                    yield from out.add((uids[i], uids[j], None))

        for batch in batches:
            paths = batch.column(0).to_numpy()
            uids, sizes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            column = batch.column(3).cast(pa.binary(SKETCH))
            sketches = np.frombuffer(column.buffers()[1], np.uint8, len(paths) * SKETCH, column.offset * SKETCH).reshape(-1, SKETCH)
            cuts = np.flatnonzero(paths[1:] != paths[:-1]) + 1
            bounds = np.concatenate([[0], cuts, [len(paths)]])
            # Buckets of one row inside the batch need nothing; only the first and last may go on.
            wanted = np.flatnonzero((np.diff(bounds) > 1) | np.isin(np.arange(len(bounds) - 1), [0, len(bounds) - 2]))
            for k in wanted.tolist():
                lo, hi = int(bounds[k]), int(bounds[k + 1])
                if paths[lo] != path:
                    yield from close()
                    path, held, size = paths[lo], [], 0
                size += hi - lo
                held.append((uids[lo:hi].copy(), sizes[lo:hi].copy(), sketches[lo:hi].copy()))
                if size > limit:  # hand all of it back, to be split
                    for part in held:
                        for uid in part[0].tolist():
                            yield from out.add((uid, None, path))
                    held = []
            if len(bounds) > 2 and (len(wanted) == 0 or wanted[-1] != len(bounds) - 2):
                yield from close()
                path, held, size = None, [], 0
        yield from close()
        yield from out.rest()

    return run


def _deeper(words: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(pa.schema([("path", pa.int64()), ("uid", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())]))
        for batch in batches:
            for uid, size, sketched, paths, text in zip(*(strings(batch.column(c)) for c in range(5)), strict=True):
                tokens = shingles(text, words)
                for path in np.array(paths, np.int64).view(np.uint64):
                    for further in picked(tokens, path, threshold).view(np.int64):
                        yield from out.add((further, uid, size, sketched), 128)
        yield from out.rest()

    return run


def _tiles(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Candidate edges between the two blocks of a tile, or inside one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blocks = [rows[rows.block == b] for b in sorted(rows.block.unique())]
        a, b = blocks[0], blocks[-1]
        parts = [(x.uid.to_numpy(), x["size"].to_numpy(), np.frombuffer(b"".join(x.sketch), np.uint8).reshape(-1, SKETCH)) for x in (a, b)]
        (ua, na, sa), (ub, nb, sb) = parts
        linked = alike(na, sa, nb, sb, threshold)
        edges = spanning_edges(linked) if len(blocks) == 1 else spanning_between(linked)
        return pd.DataFrame([(ua[i], ub[j]) for i, j in edges], columns=["a", "b"], dtype="int64")

    return run


def tiled(rows: DataFrame, group: str, uid: str, blocks: str) -> DataFrame:
    """The rows of each group with ``block``, once for every tile (``low``, ``high``) of two blocks
    that theirs is part of."""
    block = F.pmod(F.xxhash64(uid), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    return rows.withColumn("block", block).withColumn("other", other).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    ).drop("other", blocks)


def texts_of(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """(content, text), a row for each content of ``wanted``, a written table. Rows of other texts are
    not shuffled, and of equal ones each task sends one at most."""
    known = HashFilter(wanted.select(F.xxhash64("content")))
    return known.marked(contents, F.xxhash64("content")).filter("maybe").groupBy("content").agg(F.first("text").alias("text"))


def candidate_edges(
    texts: DataFrame, contents: DataFrame, words: int, threshold: float, bucket: int, levels: int
) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): edges that connect all texts which may be similar; and the written tables they are read from."""
    rows = texts.select(F.explode("paths").alias("path"), "uid", "size", "sketch")
    edges, tables = None, []
    for level in range(levels):
        partitions = spread(rows.count(), ROWS_PER_TASK, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = written(
            rows.repartition(partitions, "path").sortWithinPartitions("path")
            .mapInArrow(_buckets(threshold, bucket), "a long, b long, path long"),
            "found",
        )
        tables.append(found)
        pairs = found.filter("b is not null").select("a", "b")
        edges = pairs if edges is None else edges.unionByName(pairs)
        large = found.filter("path is not null").select(F.col("a").alias("uid"), "path")
        if large.isEmpty():
            return edges, tables
        if level < levels - 1:
            paths = large.groupBy("uid").agg(F.collect_list("path").alias("more"))  # a few per text
            again = written(paths.join(texts.select("uid", "size", "sketch", "content"), "uid"), "large")
            with_text = again.join(texts_of(again, contents), "content")
            rows = written(
                with_text.select("uid", "size", "sketch", "more", "text")
                .mapInArrow(_deeper(words, threshold), "path long, uid long, size int, sketch binary"),
                "deeper",
            )
            dropped(again)
            tables.append(rows)
    members = large.join(texts.select("uid", "size", "sketch"), "uid")
    counts = large.groupBy("path").agg(F.ceil(F.count("*") / bucket).cast("long").alias("blocks"))
    tiles = tiled(members.join(counts, "path"), "path", "uid", "blocks")
    return edges.unionByName(tiles.groupBy("path", "low", "high").applyInPandas(_tiles(threshold), "a long, b long")), tables


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, exactly, as products of 0/1 matrices."""
    both = [*sets, *others]
    tokens = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    values, column, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(others)))
    width = 8192
    for first in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        m = np.zeros((len(both), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - first] = 1
        total += m[:len(sets)] @ m[len(sets):].T
    return total


def _verified(words: int, threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rows (uid, other, links): documents linked to uid's text in this tile, and connecting edges."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("uid").sort_values("uid")
        blocks = [rows[rows.block == b] for b in sorted(rows.block.unique())]
        found = []
        if len(blocks) == 2 or rows.low.iloc[0] == rows.high.iloc[0]:
            a, b = blocks[0], blocks[-1]
            sets = [[shingles(t, words) for t in x.text] for x in ((a, b) if len(blocks) == 2 else (a,))]
            left, right = sets[0], sets[-1]
            common = overlaps(left, right)
            union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - common
            linked = common >= threshold * union - 1e-9
            ua, ub = a.uid.to_numpy(), b.uid.to_numpy()
            if len(blocks) == 1:
                np.fill_diagonal(linked, False)
                edges = spanning_edges(linked)
            else:
                edges = spanning_between(linked)
                found += [(u, None, n) for u, n in zip(ub, a.copies.to_numpy() @ linked, strict=True) if n]
            found += [(u, None, n) for u, n in zip(ua, linked @ b.copies.to_numpy(), strict=True) if n]
            found += [(ua[i], ub[j], 0) for i, j in edges]
        return pd.DataFrame(found, columns=["uid", "other", "links"]).astype({"uid": "int64", "other": "Int64", "links": "int64"})

    return run


def near_duplicates(
    docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = TARGET_RECALL,
    text: str = "text", key: str = "doc_id", bucket: int = BUCKET, levels: int = LEVELS, tile: int = TILE,
) -> DataFrame:
    """One row per document: (doc_id, content, class_id, text_id, copies, n_shingles, n_links, kept),
    where ``content`` is the md5 of the text.

    ``class_id`` is the smallest key that links lead to, ``text_id`` the smallest key with the same
    text, ``copies`` the documents with that text, ``n_links`` the other documents that are at least
    as similar as the threshold, those with the same text included. ``kept`` tells the one row of its
    class that stays, with all rows that repeat its key and text."""
    own = own_columns(docs, doc_id=key, text=text).withColumn("content", F.unhex(F.md5("text"))).select("doc_id", "content", "text")
    sets = written(
        own.mapInArrow(_sets(words, threshold, runs_for(recall)), "doc_id long, content binary, size int, sketch binary, paths array<long>"),
        "sets",
    )
    texts = sets.filter("size > 0").groupBy("content").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min(F.struct("size", "sketch", "paths")).alias("s"))
    texts = written(
        texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "content", "copies", "s.size", "s.sketch", "s.paths"), "texts"
    )
    rows = written(sets.select("doc_id", "content", "size"), "rows")
    dropped(sets)
    contents = own.select("content", "text")
    edges, tables = candidate_edges(texts, contents, words, threshold, bucket, levels)
    candidates = components(edges)
    narrow = written(texts.select("uid", "doc_id", "content", "copies"), "narrow")
    dropped(texts, *tables)

    sizes = candidates.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("long").alias("blocks"))
    members = written(
        candidates.join(sizes, "component").join(narrow.select(F.col("uid").alias("node"), "content", "copies"), "node"), "members")
    with_text = members.join(texts_of(members, contents), "content").select(
        F.col("node").alias("uid"), "component", "blocks", "copies", "text")
    found = written(
        tiled(with_text, "component", "uid", "blocks").groupBy("component", "low", "high")
        .applyInPandas(_verified(words, threshold), "uid long, other long, links long"),
        "verified",
    )
    dropped(candidates, members)
    groups = components(found.filter("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    classed = narrow.join(groups.withColumnRenamed("node", "uid"), "uid", "left").join(links, "uid", "left").withColumn(
        "component", F.coalesce("component", "uid")
    )
    survivor = F.min(F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "content"))
    survivors = classed.groupBy("component").agg(survivor.alias("first"))
    classed = classed.join(survivors, "component").select(
        "content", "first", F.col("doc_id").alias("text_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")
    )
    rows = rows.select("doc_id", F.col("content").alias("md5"), F.when(F.col("size") > 0, F.col("content")).alias("content"), F.col("size").cast("long").alias("n_shingles"))
    stays = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("md5") == F.col("first.content")))
    return rows.join(classed, "content", "left").select(
        "doc_id", F.col("md5").alias("content"), F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("text_id", "doc_id").alias("text_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "n_shingles",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), stays.alias("kept"),
    )


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, one row of each class, with their own columns. Texts without a word are
    linked with nothing, so all their rows stay.

    Only rows whose key and text may be those of a linked document are shuffled; a filter of these
    tells them, and all others stay where they are."""
    idkey = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    linked = near_duplicates(docs, text=text, key=key).filter("n_links > 0")
    linked = written(linked.select(idkey.alias("idkey"), "content", "kept").distinct(), "linked")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(
        row.alias("row"), F.col(f"`{key}`").alias("doc_id"), F.unhex(F.md5(F.col(f"`{text}`"))).alias("content"),
        F.coalesce(F.col(f"`{text}`").rlike(r"[^\t-\r ]"), F.lit(False)).alias("has_word"),
    ).withColumn("idkey", idkey)
    hashed = F.xxhash64("idkey", "content")
    marked = HashFilter(linked.select(hashed)).marked(named, hashed)
    alone = marked.filter(~F.col("maybe") | ~F.col("has_word")).select("row.*")
    rest = marked.filter(F.col("maybe") & F.col("has_word")).groupBy("idkey", "content").agg(F.first("row").alias("row"))
    rest = rest.join(linked, ["idkey", "content"], "left").filter(F.coalesce("kept", F.lit(True)))
    return alone.unionByName(rest.select("row.*"))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("content")
