from __future__ import annotations

import random

import pytest

SYLLABLES = {"en": "the er on tion ing and hand at".split(), "fr": "é eau que ment tre oi la le".split(),
             "de": "sch ung keit ß ä der und lich".split()}


def prose(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, special tokens, copies and near copies,
    repeated rows, and columns whose names the operators use themselves."""
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "12 34 !!", "one two", "a" * 60_000, "<|endoftext|> <s> ﻿ 　 \x00 é \U0001f600",
             "x " * 30_000, "Σίσυφος ΑΣ İ ﬁ"]
    for n in range(60):
        texts.append(prose(rng, ("en", "fr", "de")[n % 3], rng.randint(3, 300)))
    words = prose(rng, "en", 200).split()
    for n in range(25):
        changed = words.copy()
        changed[rng.randrange(200)] = f"other{n}"
        texts.append(" ".join(changed))
    texts += [texts[20]] * 5
    rows = []
    for n, text in enumerate(texts):
        lang = None if n % 7 == 0 else ("en", "fr", "de")[n % 3]
        source = None if n % 5 == 0 else "hot" if n % 3 else f"s{n % 4}"
        rows.append((n, text, lang, source, n))
    rows += [rows[15], rows[15], (None, "null key text", "en", None, 1), (None, None, None, None, None)]
    # Names that the operators use inside, or return.
    return [(*r, n, "x", [n], n, 1.5) for n, r in enumerate(rows)]


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, `shard` int, `hits` string, `row` array<int>, "
          "`n_words` int, `odd.name` double")


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
