"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
reread as the next stage's docs.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segtable.llm import langid, lines, minhash, packing, superkmers
from segtable.llm.base import release, written


def _carried(docs: DataFrame) -> Column | None:
    """All columns but doc_id and text, as they are; they travel with the document."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else None


def _restored(docs: DataFrame, got: DataFrame) -> DataFrame:
    """``got`` (doc_id, kept, carry) with the columns of ``docs``; n_chars counts the new text."""
    cols = {c: F.col(f"carry.`{c}`") for c in docs.columns if c not in ("doc_id", "text")} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("kept").cast("long")
    return got.select(*(cols[c].alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; ``lang`` is what it found.

    Rejected are texts that are null or have no letter, and those of which no language is more
    likely than a guess (score under 0.15).
    """
    found = langid.predict(docs, langid.train(docs), keep=True)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.15))
    return kept.select(*((F.col("lang_pred") if c == "lang" else F.col(c)).alias(c) for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    return _restored(docs, lines.drop_repeated_lines(docs, carry=_carried(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the least doc_id."""
    gone = minhash.near_classes(docs).where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that occur earlier; all else of a text stays as it is."""
    return _restored(docs, superkmers.remove_repeated_words(docs, carry=_carried(docs), spacing=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' words in sequences."""
    return packing.pack_sequences(packing.word_counts(docs))


STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("packing", pack),
]
#: Language identification and MinHash classes can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each but the last is written to the shared folder.

    What a stage has read is deleted once its own result is written; the last is read by the result.
    """
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            if k:
                release(before)
            before = docs
    return docs
