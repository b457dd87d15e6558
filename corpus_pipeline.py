"""From raw documents to packed training sequences: five stages, each one operator of setloom.llm.

Every stage reads what the one before it wrote. All but the last return the columns of documents;
extra columns of the input are dropped at the first stage, so names cannot clash later. Rows may
repeat, ids too, and any column may be null; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from setloom.llm import language_id, line_dedup, mixing, packing, simhash
from setloom.llm.common import read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; und ones (null, empty and letterless texts) and those of a very low score go. Repeated rows are judged alike."""
    return language_id.identified_documents(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones or are like them; one that loses lines and is left with white space only goes. Repeated rows lose the same lines."""
    return line_dedup.deduplicated_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: that of the smallest doc_id, null last, then of the least text hash. Null, empty and wordless texts are one group."""
    return simhash.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: over-weighted sources cut, under-weighted ones repeated. Wordless texts have no size and go; a null source is a source."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in the sequences; null texts are empty, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Language scores, SimHashes and token ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
