"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
the last gives the pieces of packed sequences, the others documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decision_lists, jaccard_join, language_codes, packing, surrogates
from millrace.llm.shared import written
from millrace.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any letter, and those that decoding finds to be in none of the known languages, go."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    language = language_codes.predicted(F.col("`text`"), language_codes.train(docs), spark)
    found = docs.select(row.alias("row"), language.alias("language"))
    return found.filter("language.known").select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or one of the learned rules go; null texts have no words and fail.
    The statistics are computed once: documents are written with them, and the rules learned from that."""
    judged = written(decision_lists.with_statistics(docs), "judged")
    numbers = judged.select(F.col("row.doc_id").alias("doc_id"), *decision_lists.STATISTICS)
    rules = decision_lists.train(numbers, table(spark, sf_dir, "labels"))
    return judged.filter(decision_lists.judgement(rules)["kept"]).select("row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: that with the smallest doc_id, and if all lack one,
    that with the smallest content. Null texts and texts without a word are linked with nothing."""
    return jaccard_join.first_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become surrogates; the number of characters follows the text."""
    treated = surrogates.pseudonymised(docs, surrogates.DEMONSTRATION_KEY).select(*[F.col(f"`{c}`") for c in docs.columns])
    return treated.withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packing.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language identification", identify_language),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("personal data", replace_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Learned models and token ids have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
