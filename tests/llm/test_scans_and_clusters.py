"""Decontamination, fill-in-the-middle and centroid clustering, beside brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from compare import differences, open_tables
from pyspark.sql import functions as F

from millrace.llm import catalogue, centroid_clustering, decontamination, fill_in_middle

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_fill_in_middle", "op13_centroid_clustering"])
def test_same_as_sql(spark, sf_dir, name):
    assert differences(catalogue.queries()[name](spark, sf_dir), open_tables(sf_dir), catalogue.statements()[name]) == []


# Decontamination


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute_contamination(docs, items, width=10):
    windows = {}
    for key, text in items:
        w = words(text)
        k = min(width, len(w))
        for n in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[n:n + k]), set()).update([] if key is None else [str(key)])
    sizes = {len(w) for w in windows}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for n in range(len(w) - k + 1):
                if (run := tuple(w[n:n + k])) in windows:
                    found |= windows[run]
                    hit.update(range(n, n + k))
        yield key, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.fixture(scope="module")
def tests_of(spark, awkward):
    """Items cut from the documents, short ones, ones without words, without keys, and repeated keys."""
    long = [r.text for r in awkward.filter("length(text) > 200 and length(text) < 5000").orderBy("text").collect()]
    rows = [(n, " ".join(t.split()[5:5 + 12 + 5 * n]).upper()) for n, t in enumerate(long[:6])]
    rows += [(7, "One, TWO!"), (8, ""), (9, None), (10, "!!"), (None, " ".join(long[7].split()[:11])), (3, " ".join(long[8].split()[:15])),
             (3, " ".join(long[8].split()[:15])), (11, "Σίσυφος"), (12, "x x x x x x x x x x x"), (101, " ".join(long[0].split()[5:15]))]
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "item_id long, text string, `row` string, window int")


def test_contamination_of_awkward_documents(awkward, nothing, tests_of):
    docs, items = ([(r[0], r[1]) for r in x.collect()] for x in (awkward, tests_of))
    want = sorted(brute_contamination(docs, items), key=repr)
    assert sum(r[5] for r in want) > 10 and any(r[3] > 1 for r in want)
    assert rows_of(decontamination.digest(awkward, tests_of)) == want
    assert decontamination.digest(nothing, tests_of).count() == 0
    assert not any(r.contaminated for r in decontamination.digest(awkward, tests_of.limit(0)).collect())
    assert decontamination.contamination(awkward, tests_of).select("row.*").columns == awkward.columns


def test_windows_in_blocks_and_texts_in_stretches_change_nothing(awkward, tests_of, monkeypatch):
    pairs = decontamination.item_windows(tests_of)
    assert sum(1 for _ in decontamination.blocks_of(pairs, 500)) > 5
    want = decontamination.contamination(awkward, tests_of).select("row.text", "found").collect()
    blocked = decontamination.contamination(awkward, tests_of, block_bytes=500).select("row.text", "found").collect()
    assert sorted(blocked, key=repr) == sorted(want, key=repr)
    automaton = decontamination.Automaton(next(decontamination.blocks_of(pairs, 1 << 20)))
    monkeypatch.setattr(decontamination, "automaton", lambda block: block)
    for stretch in (1, 7, 64):
        monkeypatch.setattr(decontamination, "STRETCH", stretch)
        texts = [r.text for r in want if r.text is not None and len(r.text) < 5000]
        assert decontamination.scanned(texts, [automaton]) == [r.found.asDict(recursive=True) for r in want if r.text is not None and len(r.text) < 5000]


def test_passages_are_places_of_the_original_text(awkward, tests_of):
    windows = {run for r in tests_of.collect() for run in decontamination.windows(r.text, 10)}
    seen = 0
    for r in decontamination.contamination(awkward, tests_of).filter("found.n_hit > 0").select("row.text", "found").collect():
        total = 0
        for a, b in r.found.passages:
            passage = decontamination.words(r.text[a:b])
            total += len(passage)
            runs = {" ".join(passage[n:n + k]) for k in (1, 2, 10) for n in range(len(passage))}
            assert runs & windows and WORDS.fullmatch(r.text[a]) and WORDS.fullmatch(r.text[b - 1])
            seen += 1
        assert total == r.found.n_hit
    assert seen > 10


def test_clean_documents_stay_as_they_are(awkward, tests_of):
    clean = decontamination.without_contaminated(awkward, tests_of)
    dirty = decontamination.digest(awkward, tests_of).filter("contaminated").count()
    assert clean.columns == awkward.columns and clean.count() == awkward.count() - dirty


# Fill in the middle


def brute_middle(key, text):
    text, n = text or "", len(text or "")
    h = sha(f"1:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
    form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return key, n, form, None if plain else a, None if plain else b - a, sha(out), sha(text)


def test_middles_of_awkward_documents(spark, awkward, nothing):
    rng = random.Random(4)
    parts = ["<P>", "<S", "<M>", ">", "<", "P>", "é", "中", "\U0001f600", "a", "b c ", "\n"]
    texts = ["".join(rng.choices(parts[1:2] + parts[3:], k=rng.randint(0, 30))) for _ in range(150)] + ["".join(rng.choices(parts, k=9)) for _ in range(50)]
    mixed = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, `cut` string")
    for docs in (awkward, mixed):
        got = rows_of(fill_in_middle.digest(docs))
        assert got == sorted((brute_middle(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.digest(nothing).count() == 0
    assert fill_in_middle.transformed(awkward).select("row.*").columns == awkward.columns


def test_chunks_cover_a_text_and_follow_its_content(monkeypatch):
    rng = np.random.default_rng(2)
    shared, data = rng.bytes(60_000), []
    for n in range(3):
        data.append(rng.bytes(5000 + 777 * n) + shared + rng.bytes(3000))
    sets = [{d[a:b] for a, b in fill_in_middle.chunks(d)} for d in data]
    assert len(sets[0] & sets[1] & sets[2]) > 20
    for d in [*data, b"", b"a", b"a" * 300_000, b"ab" * 40_000]:
        found = list(fill_in_middle.chunks(d))
        assert [a for a, _ in found] == [0, *[b for _, b in found]][:len(found)] and b"".join(d[a:b] for a, b in found) == d
        assert all(fill_in_middle.LEAST <= b - a <= fill_in_middle.MOST for a, b in found[:-1])
        monkeypatch.setattr(fill_in_middle, "STRETCH", 20_000)  # places do not depend on how a text is hashed
        assert list(fill_in_middle.chunks(d)) == found
        monkeypatch.undo()


def test_chunk_summaries_are_shared_and_bounded():
    cache, rng = fill_in_middle.ChunkCache(100_000), random.Random(1)
    shared = "".join(rng.choices("abcdé \n", k=20_000))
    for n in range(30):
        own = "".join(rng.choices("xyz中", k=3000))
        text = own + shared + ("<P" if n % 2 else "") + "<" + own
        split = rng.randrange(len(text))
        n_chars, low, high, low_byte, high_byte, marked = fill_in_middle.located(text, split, 7 * split, cache)
        assert (n_chars, marked) == (len(text), "<P>" in text) and {low, high} == {split % (n_chars + 1), 7 * split % (n_chars + 1)}
        assert (low_byte, high_byte) == (len(text[:low].encode()), len(text[:high].encode()))
        assert cache.held <= 100_000 and cache.held == sum(map(len, cache.known))
    assert cache.hits > 200


@pytest.mark.parametrize("at", range(250, 262))
def test_a_marker_across_chunks_is_seen(monkeypatch, at):
    monkeypatch.setattr(fill_in_middle, "MOST", 256)
    text = "é" + "a" * (at - 2) + "<M>" + "b" * 500
    assert fill_in_middle.located(text, 0, 0, fill_in_middle.ChunkCache())[5]
    assert not fill_in_middle.located(text.replace("M", "m"), 0, 0, fill_in_middle.ChunkCache())[5]


# Centroid clustering


def brute_clusters(rows, k=8, rounds=10):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(1024 * x) for x in v]))
    order = sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        found = []
        for _, v in kept:
            found.append(min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)))
        return found

    for _ in range(rounds):
        members = {}
        for (_, v), (_, n) in zip(kept, assign(), strict=True):
            members.setdefault(n, []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centroids)]
    final = assign()
    inertia = {}
    for d, n in final:
        inertia[n] = inertia.get(n, 0) + d
    names = [sha(",".join(map(str, c))) for c in centroids]
    return [(key, n, d, inertia[n], sum(inertia.values()), names[n]) for (key, _), (d, n) in zip(kept, final, strict=True)]


VECTORS = "vec_id long, embedding array<float>, cluster string, `q` int, label int"


def vectors(kind: str) -> list[tuple]:
    rng = random.Random(kind)
    rows = []
    for n in range(240):
        centre = n % 5
        v = [float(np.float32(rng.gauss(centre if kind == "groups" else 0, 0.3))) for _ in range(64)]
        if kind == "ties":
            v = [float(rng.choice([-1, 1])) if p < 3 else 0.0 for p in range(64)]
        rows.append((n, v, "c", n, 1))
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None), (None, None, None, None, None), (500, [], "c", 1, 1), (501, [1.0] * 63, "c", 1, 1),
             (502, [1.0] * 63 + [None], "c", 1, 1), (503, [1.0] * 63 + [math.nan], "c", 1, 1), (504, [1.0] * 63 + [-math.inf], "c", 1, 1)]
    return rows


@pytest.mark.parametrize("kind", ["groups", "flat", "ties"])
def test_clusters_equal_brute_force(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = centroid_clustering.digest(df)
    assert rows_of(got) == sorted(brute_clusters([r[:2] for r in rows]), key=repr)
    assert dict(got.dtypes)["cluster"] == "int"


@pytest.mark.parametrize("count", [0, 1, 5])
def test_clusters_of_few_vectors(spark, count):
    rows = vectors("flat")[:count]
    got = centroid_clustering.digest(spark.createDataFrame(rows, VECTORS))
    assert rows_of(got) == sorted(brute_clusters([r[:2] for r in rows]), key=repr)


def test_the_pivot_table_spares_distances_and_decides_nothing():
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(2000, 64)) * 40 + rng.integers(0, 9, (2000, 1)) * 500).astype(np.int64)
    centroids, pivots = data[:8], centroid_clustering.far_apart(data[:100], 8)
    found, distance, exact = centroid_clustering.nearest(data, centroid_clustering.to_pivots(data, pivots), centroids, centroid_clustering.to_pivots(centroids, pivots))
    every = ((data[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert exact < 0.5 * every.size


def test_numbers_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(1, [3e38] * 64, "c", 1, 1)], VECTORS)
    with pytest.raises(Exception, match="beyond"):
        centroid_clustering.digest(df).collect()


def test_rounds_collect_a_row_per_centroid_and_component(spark):
    df = spark.createDataFrame(vectors("groups"), VECTORS)
    rows, found = centroid_clustering.clustered(df, centroids=4, rounds=2)
    assert found.values.shape == (4, 64) and rows.agg(F.count_distinct("cluster")).first()[0] <= 4
