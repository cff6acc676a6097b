"""Quality rules as a learned decision list.

Statistics of whole texts are computed in one pass. From labelled ones, sequential
covering learns rules for poor texts, one after another: a rule is a conjunction of
thresholds, grown on two thirds of the examples that no earlier rule covers (by
information gain), pruned on the rest, and accepted only if it is precise there. The
list becomes ordered Spark conditionals, which name the first rule that fires.

Learned from a bounded sample: labelled documents that pass the base rules, at most
SAMPLE in expectation, chosen by a hash of the key. Defined cases: a null text is an
empty one; a key that is labelled more than once counts as good if any label says
so; null labels and keys are not learned from; without labels there are no rules,
and the base rules alone decide; rows that repeat a key are judged each; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import own_columns, written

SAMPLE, SEED = 50_000, 11
#: Base rules: fewer words, or a larger percentage of repeated words, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
MAX_RULES, MAX_CONDITIONS, CUTS = 24, 4, 48
#: What a rule must reach on the pruning examples: precision and covered poor texts.
PRECISION, COVER = 0.98, 3
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks")
#: What rules may test, as a ratio of two statistics.
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeated": ("n_repeat_words", "n_words"), "words_per_line": ("n_words", "n_lines"), "distinct": ("n_distinct", "n_words"),
    "upper": ("n_upper", "n_words"), "marks_per_word": ("n_marks", "n_words"), "words": ("n_words", None),
}


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window found at least twice."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids[:count]
    for k in range(1, width):  # pairs are numbered anew, so that codes never overflow
        _, code = np.unique(code * len(number) + ids[k:k + count], return_inverse=True)
    twice = np.bincount(code)[code] > 1
    inside = np.zeros(len(words), bool)
    for k in range(width):
        inside[k:k + count] |= twice
    return int(inside.sum())


def statistics(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()  # bytes are split at exactly the six ASCII spaces
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), len(text) - sum(data.count(s) for s in SPACES), sum(data.count(s) for s in SYMBOLS),
        len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)),
        sum(map(bytes.isupper, words)), data.count(b"!") + data.count(b"?"),
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, statistics...): the documents' own columns in one struct, whatever their names."""

    @pandas_udf(", ".join(f"{s} long" for s in STATISTICS))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t or "") for t in texts], columns=list(STATISTICS))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), of(F.col(f"`{text}`")).alias("s")).select("row", "s.*")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    return F.col(over).cast("double") if under is None else F.col(over) / F.greatest(F.col(under), F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.cut if self.above else x[self.name] <= self.cut

    def column(self) -> Column:
        return feature(self.name) > self.cut if self.above else feature(self.name) <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    inside = np.ones(n, bool)
    for condition in rule:
        inside &= condition.holds(x)
    return inside


def _grow(x: dict[str, np.ndarray], poor: np.ndarray) -> Rule:
    """Conditions added one by one, each with the largest gain of information about poor texts."""
    rule: Rule = ()
    inside = np.ones(len(poor), bool)
    while len(rule) < MAX_CONDITIONS and (~poor & inside).any() and (poor & inside).any():
        before = np.log2((poor & inside).sum() / inside.sum())
        best, gain = None, 1e-9
        for name in FEATURES:
            values = x[name][inside]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS), method="lower"))
            upto = np.searchsorted(cuts, values)  # values <= cuts[k] have upto <= k
            of_poor = np.cumsum(np.bincount(upto[poor[inside]], minlength=len(cuts)))
            of_all = np.cumsum(np.bincount(upto, minlength=len(cuts)))
            for above in (False, True):
                p = of_poor[-1] - of_poor if above else of_poor
                t = of_all[-1] - of_all if above else of_all
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / t) - before), 0.0)
                k = int(gains.argmax())
                if gains[k] > gain and t[k] < len(values):
                    # Halfway to the next value seen: the same examples, but not the tightest cut.
                    cut = (cuts[k] + values[values > cuts[k]].min()) / 2
                    best, gain = Condition(name, above, float(cut)), gains[k]
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], poor: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that does best on examples it was not grown on, its precision
    and the poor texts it covers there."""
    best = ((), 0.0, 0)
    worth = -np.inf
    for length in range(len(rule), 0, -1):
        inside = _covered(rule[:length], x, len(poor))
        p, n = int((poor & inside).sum()), int((~poor & inside).sum())
        if p + n and p / (p + n) >= PRECISION and p - 20 * n > worth:
            worth, best = p - 20 * n, (rule[:length], p / (p + n), p)
    return best


def learn(x: dict[str, np.ndarray], poor: np.ndarray, seed: int = SEED) -> list[Rule]:
    rng, rules = np.random.default_rng(seed), []
    failed = 0
    while poor.any() and len(rules) < MAX_RULES and failed < 3:
        grows = rng.permutation(len(poor)) % 3 != 0
        rule = _grow({k: v[grows] for k, v in x.items()}, poor[grows])
        rule, _, covered = _prune(rule, {k: v[~grows] for k, v in x.items()}, poor[~grows])
        if not rule or covered < COVER:
            failed += 1
            continue
        rules.append(rule)
        rest = ~_covered(rule, x, len(poor))
        x, poor, failed = {k: v[rest] for k, v in x.items()}, poor[rest], 0
    return rules


def fired(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 0; null if none does."""
    chosen = None
    for number, rule in enumerate(rules):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        chosen = F.when(holds, F.lit(number)) if chosen is None else chosen.when(holds, F.lit(number))
    return F.lit(None).cast("int") if chosen is None else chosen.cast("int")


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules for label 0 from statistics of labelled documents."""
    said = own_columns(labels, doc_id=key, quality=label).filter("doc_id is not null and quality is not null")
    said = said.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    examples = stats.filter(~base_failed()).join(said, "doc_id").select(
        "doc_id", (F.col("quality") == 0).alias("poor"), *[feature(name).alias(name) for name in FEATURES])
    count = examples.count()
    if count > sample:
        examples = examples.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) < int(sample / count * (1 << 40)))
    rows = examples.toPandas().sort_values(["doc_id", "words"], kind="stable")  # numbers of the sample
    return learn({name: rows[name].to_numpy(float) for name in FEATURES}, rows.poor.to_numpy(bool))


def judgement(rules: list[Rule]) -> dict[str, Column]:
    """base_failed, rule (the text of the first that holds) and kept, from the statistics."""
    said = F.array(*[F.lit(" and ".join(map(str, rule))) for rule in rules]) if rules else F.array().cast("array<string>")
    number = fired(rules)
    return {"base_failed": base_failed(), "rule": F.when(number.isNotNull(), F.get(said, number)), "kept": ~base_failed() & number.isNull()}


def statistics_table(docs: DataFrame) -> DataFrame:
    return written(with_statistics(docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))).select(
        F.col("row.doc_id").alias("doc_id"), *STATISTICS), "statistics")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = statistics_table(docs)
    return stats.withColumns(judgement(train(stats, labels))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
