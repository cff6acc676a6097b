"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each place of the codewords a
binary classifier on hashed character n-grams tells which of the two halves of the
languages a text belongs to: the log ratio of the halves' n-gram frequencies,
averaged over the text. Decoding is loss-weighted: a codeword's distance is the sum
of exp(-bit * margin) over the places, each weighted by how often its classifier
was right about that language in training. The nearest codeword is the prediction;
if the next one is hardly farther, the text is flagged as ambiguous. If even the
nearest is half as far as for a text that tells nothing, the text is in no known
language; the half is counted from what the clean training documents keep to.

Few languages get the exhaustive code, many a seeded random one, chosen among
several for its smallest distance.

Learned from a bounded sample (SAMPLE documents at most in expectation, chosen by a
hash of the key, half of them evenly from all languages, so that a rare one is not
left out) of the documents with a language whose crc32(key) mod 4 is not 2; the sample
is written once. Applied to whole texts of all. Defined cases: a null text or one without a letter is
``und`` with score 0 and not known; without any training document every text is
``und``, but with a letter known, as nothing tells otherwise; with one language in
training it is always that; a null key is neither held out nor learned
from; rows that repeat a key are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import dropped, strings, written

SAMPLE, SAMPLE_TASKS = 20_000, 24
BUCKETS, GRAMS = 1 << 14, (1, 2, 3)
#: Codes of more languages than this are random, of this many places per doubling of the languages.
EXHAUSTIVE, PLACES, SEED = 6, 12, 7
#: Margins are cut to this before the loss; a score below AMBIGUOUS means two codewords are near.
MARGIN, SMOOTH, AMBIGUOUS = 4.0, 0.5, 0.55
UNKNOWN = "und"
#: Share of the training documents whose distance sets the limit, and the steps it is measured in.
CLEAN, STEPS, STEP = 0.99, 200, 0.01
STRETCH = 1 << 20

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def _letters(codes: np.ndarray) -> np.ndarray:
    found = _LETTER[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]):
        found[codes == c] = chr(c).isalpha()
    return found


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of lower-case letters, runs of anything else being one space. None
    without a letter."""
    counts, seen = np.zeros(BUCKETS, np.int64), False
    carried = np.array([32], np.uint64)
    text = text or ""
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at:at + STRETCH].lower().encode("utf-32-le"), np.uint32)
        letter = _letters(codes)
        seen |= bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint64)
        # The last characters of the stretch before take part in its first n-grams.
        whole = np.concatenate([carried, codes])
        fresh = np.concatenate([np.zeros(len(carried), bool), np.ones(len(codes), bool)])
        keep = np.concatenate([[True], (whole[1:] != 32) | (whole[:-1] != 32)])
        whole, fresh = whole[keep], fresh[keep]
        for n in GRAMS:
            if len(whole) < n:
                continue
            h = np.full(len(whole) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + whole[k:k + len(h)] * np.uint64(0xC2B2AE3D27D4EB4F)
            h = h[fresh[n - 1:]]
            counts += np.bincount(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
        carried = whole[-(max(GRAMS) - 1):]
    return counts if seen else None


def codewords(languages: int, seed: int = SEED) -> np.ndarray:
    """One row of +1 and -1 per language; places are distinct splits of the languages in two."""
    if languages <= 1:
        return np.zeros((languages, 0), np.int8)
    if languages <= EXHAUSTIVE:
        splits = [s for k in range(1, languages) for s in combinations(range(1, languages), k)]
        code = np.full((languages, len(splits)), 1, np.int8)
        for place, s in enumerate(splits):
            code[list(s), place] = -1
        return code
    rng, places = np.random.default_rng(seed), PLACES * int(np.ceil(np.log2(languages)))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, places))
        split = np.abs(code.sum(axis=0, dtype=int)) < languages
        apart = min((code[a] != code[b])[split].sum() for a, b in combinations(range(languages), 2)) if languages <= 64 else (
            ((places - code.astype(int) @ code.T.astype(int)) // 2 + places * np.eye(languages, dtype=int)).min())
        if apart > far:
            best, far = code[:, split], apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x places
    weights: np.ndarray  # buckets x places
    trust: np.ndarray  # languages x places; rows sum to 1
    limit: float = np.inf  # distance beyond which a text is in none of the languages

    def margins(self, counts: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(counts)
        n = counts[used]
        return np.clip((n @ self.weights[used]) * (4.0 / n.sum()), -MARGIN, MARGIN)

    def distances(self, counts: np.ndarray) -> np.ndarray:
        """Loss-weighted distances from the codewords; 1 if a text tells nothing."""
        return (self.trust * np.exp(-self.code * self.margins(counts))).sum(axis=1)

    def decode(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """Nearest codeword's language, how much nearer it is than the next (0.5 to 1), and whether it
        is near enough for the text to be in that language."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, True
        distance = self.distances(counts)
        first, second = np.argsort(distance, kind="stable")[:2]
        return self.languages[first], float(distance[second] / (distance[first] + distance[second])), bool(distance[first] <= self.limit)


SUMS = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("value", pa.float64())])


def _sums(of: Callable[[str, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per language and place, sums of a vector of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
                counts = grams(text)
                if counts is not None:
                    sums[lang] = sums.get(lang, 0) + of(lang, counts)
        for lang, values in sums.items():
            used = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(values[used].astype(float))], schema=SUMS)

    return run


def _table(sample: DataFrame, of: Callable[[str, np.ndarray], np.ndarray], places: int) -> dict[str, np.ndarray]:
    """Sums over the sample: languages x places numbers on the driver."""
    rows = sample.mapInArrow(_sums(of), "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in rows.collect():
        found.setdefault(row.lang, np.zeros(places))[row.place] = row.value
    return found


def held_out(key: str) -> Column:
    """Documents never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _frequencies(lang: str, counts: np.ndarray) -> np.ndarray:
    return np.round(counts / counts.sum(), 9)


def sample_shares(counts: dict[str, int], sample: int) -> dict[str, float]:
    """Which share of each language's documents to learn from, so that they are at most so many together:
    half of them dealt out evenly over the languages, half by their documents."""
    total = sum(counts.values())
    return {x: min(1.0, (sample / len(counts) + sample * n / total) / 2 / n) for x, n in counts.items()}


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", sample: int = SAMPLE) -> Model:
    usable = docs.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{lang}`").isNotNull() & ~held_out(key)).select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    shares = sample_shares(dict(map(tuple, usable.groupBy("lang").count().collect())), sample)
    if shares:
        place = F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(1 << 40))
        share_of = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        usable = usable.filter(place < F.element_at(share_of, F.col("lang")) * (1 << 40))
    rows = written(usable.select("lang", "text").repartition(SAMPLE_TASKS), "sample")
    counts = _table(rows, _frequencies, BUCKETS)
    languages = sorted(counts)
    code = codewords(len(languages))
    shares = np.array([counts[x] / counts[x].sum() for x in languages]).reshape(len(languages), BUCKETS)
    smooth = SMOOTH / BUCKETS
    weights = np.zeros((BUCKETS, code.shape[1]))
    for place in range(code.shape[1]):
        up, down = (shares[code[:, place] == side].mean(axis=0) for side in (1, -1))
        weights[:, place] = np.log((up + smooth) / (down + smooth))
    model = Model(languages, code, weights, np.full(code.shape, 1 / max(code.shape[1], 1)))
    if len(languages) > 1:
        number = {x: n for n, x in enumerate(languages)}

        def right(lang: str, counts: np.ndarray) -> np.ndarray:
            return np.append(model.margins(counts) * code[number[lang]] > 0, 1.0)

        hits = _table(rows, right, code.shape[1] + 1)
        trust = np.array([hits[x][:-1] / hits[x][-1] for x in languages])
        model.trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-12)

        def step(lang: str, counts: np.ndarray) -> np.ndarray:
            return np.eye(1, STEPS, min(int(model.distances(counts).min() / STEP), STEPS - 1))[0]

        shares = np.cumsum(sum(_table(rows, step, STEPS).values()))
        clean = (np.searchsorted(shares, CLEAN * shares[-1]) + 1) * STEP
        model.limit = max(clean, (clean + 1) / 2)  # half way to a text that tells nothing
    dropped(rows)
    return model


def predicted(text: Column, model: Model, spark: SparkSession) -> Column:
    """(lang_pred, score, ambiguous, known) of whole texts, as a column. ``known`` is false for what is
    in none of the model's languages."""
    shared = spark.sparkContext.broadcast(model)  # buckets x places numbers

    @pandas_udf("lang_pred string, score double, ambiguous boolean, known boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        known, found = shared.value, []
        for text in texts:
            counts = grams(text)
            lang, score, near = (UNKNOWN, 0.0, counts is not None) if counts is None or not known.languages else known.decode(counts)
            found.append((lang, score, lang != UNKNOWN and score < AMBIGUOUS, near))
        return pd.DataFrame(found, columns=["lang_pred", "score", "ambiguous", "known"])

    return of(text)


def digest(docs: DataFrame) -> DataFrame:
    model = train(docs)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), predicted(F.col("`text`"), model, docs.sparkSession).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")
