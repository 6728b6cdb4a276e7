"""A corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import table, written
from siltstone.llm.decontaminate import uncontaminated
from siltstone.llm.langid import identified
from siltstone.llm.linededup import without_repeated_lines
from siltstone.llm.packing import pack
from siltstone.llm.simhash import one_of_each
from siltstone.llm.token_files import default_vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language of mean marginal 0.5 or more stay, with all their columns; null and empty
    texts go. The field is learned from docs; if no row has a label, every document with a letter stays."""
    return identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar lines the first by doc_id stays (null last; ties: file, row, line); n_chars follows
    the text. Documents of which no line is left go; those that had none stay. Texts of any length, repeated rows alike."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints the smallest doc_id stays (null counts as largest), of repeated rows the first.
    Texts without words, null ones among them, share fingerprint zero."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go whole; null texts hold none, an empty benchmark removes none."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 ids; a null or empty text is its end id. No documents give no pieces."""
    return pack(docs, default_vocabulary())


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: MinHash, the conditional random field and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written to the shared folder and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
