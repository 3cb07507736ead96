"""A training corpus from documents: quality, line dedup, near-dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage to the shared folder and reads it
back as the next one's docs. All but the last return the columns of documents. No stage has SQL: the first and the third are
a fitted model and a similarity search; the rows of run() are tested against brute-force stages 2 to 5 over the first's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loggrove.llm import bpe, common, contamination, linededup, neardup, quality
from loggrove.llm.queries import vocabulary_path

ORACLE_SQL = None


def _as_documents(out: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents again, from (text, row) of an operator: n_chars by the text that is left, the others as they came."""
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in like.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns from the labels of this table's rows.

    Null and empty texts are judged as empty ones, repeated rows alike; without labels nothing goes. Other columns stay as they
    are, whatever their names. An empty table stays empty.
    """
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    kept = quality.score(docs, model, row=True).where("predicted = 1")
    return kept.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which no word is left.

    Null texts become empty ones and stay, as empty ones do; rows that repeat id and text get the same result. n_chars is that
    of the text that is left, other columns stay as they are, whatever their names. An empty table stays empty.
    """
    cut = linededup.dedup(docs, row=True)
    return _as_documents(cut.where("n_removed = 0 or text rlike '\\\\S'"), docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the smallest id.

    Texts without words (null, empty) are their own classes and stay; rows that repeat id and text stay or go together; rows
    without an id go if a document with one is in their class. Columns stay as they are. An empty table stays empty.
    """
    gone = neardup.classes(docs, text_hash=True).where("not kept").select("doc_id", "text_h").distinct()
    text_h = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (text_h == gone["text_h"]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark are cut out; the rest of a document stays.

    Null texts become empty ones; documents stay, even those of which nothing is left. n_chars is that of the text that is
    left, other columns stay as they are, whatever their names. An empty table, or an empty benchmark, changes nothing.
    """
    return _as_documents(contamination.cut(docs, common.table(spark, sf_dir, "benchmark"), row=True), docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): token ids of each document, with digests of ids and of what they decode to.

    Null and empty texts have no ids; repeated rows stay; extra columns go. An empty table stays empty.
    """
    return bpe.digests(docs, vocabulary_path("word_bpe_49k.json"), with_ids=True)


STAGES = [(f.__name__, f) for f in (quality_classifier, line_dedup, minhash_near_dedup, decontamination, bpe_codec)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: documents through all stages, in order; each output is a table of its own in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
