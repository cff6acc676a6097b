"""Encoding, files, packing and counts, against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe_roundtrip, packing, prefix_counts, token_files
from millrace.llm.encoders import byte_encoder, word_encoder

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = ["a", "b", "the", "'s", "'", "re", "'ve", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "é", "İ", "Σ", "ß",
         "1", "23", "²", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<s>", "!", "##", "\U0001f600", "中", "ﬁ", "‍",
         "\x00", "ZZ", "_", "▁", "tion", "international"]


def random_texts(count: int, length: int, seed: int, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randint(0, length))) for _ in range(count)]


def test_encoders_equal_the_library():
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for text in random_texts(1500, 25, 1):
        assert byte_encoder(BYTE).ids(text).tolist() == byte.encode(text, add_special_tokens=False).ids, text
        ids = word.encode(text, add_special_tokens=False).ids
        assert word_encoder(WORD).ids(text).tolist() == ids, text
        assert word_encoder(WORD).decode(np.array(ids)) == word.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("window", [1, 2, 64])
@pytest.mark.parametrize("parts", [PARTS, ["'", "s", "t", "!", "d"], list("abcdefgh"), ["中", "é", "internationalization"]])
def test_tree_concatenation_is_exact(monkeypatch, window, parts):
    monkeypatch.setattr(bpe_roundtrip, "WINDOW", window)
    coder, library = word_encoder(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(window)
    for text in random_texts(250, 60, window, parts):
        nodes = []
        for normal, token in coder.segments(text):
            leaves = bpe_roundtrip.halves(normal, rng.choice([1, 3, 9]))
            nodes += [bpe_roundtrip.leaf(coder, x) if token is None else bpe_roundtrip.special(token) for x in leaves]
        assert bpe_roundtrip.tree(coder, nodes).ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_prefix_counts_equal_encoding_every_prefix():
    library, counter = sentencepiece.SentencePieceProcessor(model_file=PIECE), prefix_counts.piece_counter(PIECE)
    for text in random_texts(400, 20, 2):
        assert counter.prefixes(text).tolist() == [len(library.encode(text[:n])) for n in range(len(text) + 1)], text
        assert counter.total(text) == len(library.encode(text))


def unspaced(rng: random.Random, length: int) -> str:
    return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(length))


@pytest.mark.parametrize("make", [lambda: word_encoder.__wrapped__(WORD), lambda: prefix_counts.PieceCounter(PIECE)])
def test_caches_are_bounded_in_bytes_for_texts_without_spaces(make):
    """Two thousand new texts without a space hold no more than the limit and what one of them adds."""
    coder, rng = make(), random.Random(9)
    coder.known.limit = 8 << 20
    encode = coder.ids if hasattr(coder, "ids") else coder.total
    most = 0
    for _ in range(2000):
        encode(unspaced(rng, 1500))
        arrays = coder.known.flat.nbytes + coder.known.length.nbytes + coder.known.start.nbytes
        most = max(most, arrays + sum(map(sys.getsizeof, coder.known.number)))
    assert most < 12 << 20
    assert encode("a b c d") is not None and coder.known.held < 9 << 20


def test_counts_of_a_long_text_without_a_space(monkeypatch):
    library, counter = sentencepiece.SentencePieceProcessor(model_file=PIECE), prefix_counts.PieceCounter(PIECE)
    monkeypatch.setattr(prefix_counts.PieceCounter, "STRETCH", 20)
    rng = random.Random(3)
    texts = ["".join(rng.choices(["ab", "tion", "the", "中", "é", "7", "in"], k=120)) for _ in range(8)]
    texts += [texts[0] + "x", texts[0][:90], texts[0] + " and " + texts[1]]
    counter.prepare(texts)
    for text in texts:
        assert counter.total(text) == len(library.encode(text))
        assert counter.prefixes(text)[::40].tolist() == [len(library.encode(text[:n])) for n in range(0, len(text) + 1, 40)]
    monkeypatch.undo()
    long = unspaced(rng, 150_000)
    assert prefix_counts.PieceCounter(PIECE).total(long) == len(library.encode(long))


def test_equal_long_texts_are_encoded_once(spark, monkeypatch):
    text = "some words of a long text " * 40
    df = spark.range(300, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(text)).otherwise(F.concat(F.lit(text), F.col("id").cast("string"))).alias("text"))
    got = bpe_roundtrip.encoded(df, WORD, leaf_chars=100)
    library = Tokenizer.from_file(WORD)
    want = [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in df.collect()]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"partial_first\(text", plan)  # a task sends a leaf once, however many rows hold it


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_roundtrip_of_awkward_documents(awkward, nothing):
    library = Tokenizer.from_file(WORD)
    want = []
    for row in awkward.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows_of(bpe_roundtrip.digest(awkward, WORD)) == sorted(want, key=repr)
    assert bpe_roundtrip.digest(nothing, WORD).count() == 0


def test_token_files_of_awkward_documents(awkward, nothing, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(token_files, "FILE_TOKENS", 20_000)
    library = Tokenizer.from_file(BYTE)
    own = [(r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")) for r in awkward.collect()]
    got = sorted((tuple(r) for r in token_files.digest(awkward, BYTE).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((k for k, _ in own), key=lambda k: -1 if k is None else k)
    start = 0
    for _, at, n, _ in got:
        assert at == start
        start += n
    assert sorted(((k, len(i), zlib.crc32(i)) for k, i in own), key=repr) == sorted(((r[0], r[2], r[3]) for r in got), key=repr)
    assert token_files.digest(nothing, BYTE).count() == 0


@pytest.mark.parametrize("high", [2, 256, 70_000, 2**32])
def test_variable_length_codes_round_trip(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 3, 4, 5, 1001):
        values = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        control, data = token_files.pack(values)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == values).all()


def test_most_frequent_ids_get_the_lowest_ranks(spark, given, tmp_path):
    token_files.write_token_files(given, BYTE, str(tmp_path / "files"))
    ranks = spark.read.parquet(str(tmp_path / "files/ranks")).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks)))
    assert all(a["count"] >= b["count"] for a, b in zip(ranks, ranks[1:]))


def check_packing(docs, capacity, end_id, placed):
    library = Tokenizer.from_file(BYTE)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, end_id], "<u4"))
    in_sequence = defaultdict(list)
    found = defaultdict(list)
    for r in placed:
        in_sequence[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id].append(r)
    for parts in in_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length >= 1
            end += length
        assert end <= capacity
    assert found.keys() == texts.keys()
    for key, ids in texts.items():
        want = []
        for x in ids:
            first = len(x) % capacity or capacity
            bounds = [0, *range(first, len(x) + 1, capacity)]
            want += [(p, a, b - a, zlib.crc32(x[a:b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))]
        assert sorted(want) == sorted((r.piece, r.start, r.length, r.ids_crc32) for r in found[key])
    total = sum(len(x) for ids in texts.values() for x in ids)
    return len(in_sequence), -(-total // capacity)


def test_packing_of_awkward_documents(awkward, nothing, monkeypatch):
    used, least = check_packing(awkward, 1024, 2, packing.digest(awkward, BYTE).collect())
    assert used <= least * 1.05 + 1
    assert packing.digest(nothing, BYTE).count() == 0


def test_rounds_of_packing_come_close_to_the_bound(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 4000).tolist()
    items = spark.createDataFrame([(n, int(x)) for n, x in enumerate(lengths)], "uid long, length long")
    placed = packing.packed(items, 1024, items_per_task=300).collect()
    assert sorted(r.uid for r in placed) == list(range(4000))
    used = len({r.sequence_id for r in placed})
    assert used <= sum(lengths) / 1024 * 1.02 + 1


def test_packed_sequences_hold_the_tokens(given):
    placed = packing.pack_documents(given, BYTE).cache()
    sequences = packing.sequences(placed)
    assert sequences.filter("octet_length(ids) <> 4 * length or length > 1024").count() == 0
    assert sequences.agg(F.sum("length")).first()[0] == placed.agg(F.sum("length")).first()[0]


def test_counts_of_awkward_documents(awkward, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "")), len(library.encode(r.text or "")) > 4096) for r in awkward.collect()]
    got = prefix_counts.digest(awkward, PIECE)
    assert rows_of(got.select("doc_id", "n_bytes", "n_tokens", "over_limit")) == sorted(want, key=repr)
    assert prefix_counts.digest(nothing, PIECE).count() == 0


def test_stored_steps_answer_budgets(spark, given):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = given.limit(40)
    table = prefix_counts.prefix_table(docs, PIECE, budget=50)
    got = table.withColumn("fit", prefix_counts.chars_within("steps", F.lit(50))).withColumn("at", prefix_counts.tokens_at("steps", F.lit(30)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        counts = [len(library.encode(texts[r.doc_id][:n])) for n in range(min(len(texts[r.doc_id]), 400) + 1)]
        assert r.at == counts[min(30, len(counts) - 1)]
        if r.n_tokens > 50:
            assert r.fit == r.fit_chars == max(n for n, c in enumerate(counts) if c <= 50)
        else:
            assert r.fit == r.fit_chars == len(texts[r.doc_id])
