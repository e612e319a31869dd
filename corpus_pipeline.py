"""From raw documents to packed training sequences, in five stages.

Each stage takes the session, the documents that the stage before kept and the
folder of the input tables.  All but the last return the columns of documents,
further ones included, whatever their names; n_chars follows the text.

A null or empty text is a document without words: the classifier scores it as
such, line deduplication leaves it alone, all of them are one group of near
duplicates, they leak nothing, and the one that stays is packed as the end id
alone.  Null ids stay null and count as the last of a group.  Repeated rows are
one document to line deduplication and one group to near_dedup, which keeps one.
Ties go to the smaller doc_id, then to the smaller hash of the text.  An empty
table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm.common import let_go, saved, table
from headwater.llm.decontaminate import with_leaks
from headwater.llm.linededup import dedup
from headwater.llm.neardup import one_of_each
from headwater.llm.packing import pack
from headwater.llm.quality import classify

TOKENIZER = "word_bpe_49k.json"


OWN = ("doc_id", "text")


def hidden(docs: DataFrame) -> DataFrame:
    """Columns other than ``OWN`` under names that no operator uses; what the stage before left in the driver goes."""
    let_go(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`").alias(c if c in OWN else f"__in_{i}") for i, c in enumerate(docs.columns)])


def shown(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, by their own names."""
    return found.select(*[F.col(c if c in OWN else f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return shown(classify(hidden(docs), table(spark, sf_dir, "labels")).where("predicted = 1"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that an earlier one has."""
    found = shown(dedup(hidden(docs)), docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar at 0.8 or more."""
    return shown(one_of_each(hidden(docs)), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return shown(with_leaks(hidden(docs), table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with a checksum of each piece's ids."""
    import public_tokenizers

    let_go(spark)
    pieces = pack(docs, public_tokenizers.path(TOKENIZER))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL cannot fit the classifier; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
