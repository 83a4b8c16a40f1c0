"""From raw documents to token ids: five stages, each written and read again.

language ID -> near duplicates -> benchmark decontamination -> personal data -> pieces
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import decontam, jaccard, langid, pieces, pii
from repolith.llm.common import discard, fresh, staged, stopped_batches, table
from repolith.llm.queries import tokenizer_file

#: A document whose language is less sure than this, or unknown, is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.  The classifier learns from a bounded sample of labelled rows.

    Null and empty texts, and texts without a letter, are rejected; without a labelled row all
    are, as nothing can be learned.  A very long text is judged whole; repeated rows fare alike; an
    empty table stays empty; all columns stay as they are, whatever their names.
    """
    stopped_batches(spark)
    rest, same = fresh("_rest", docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    guess = langid.predict(docs.select(same.alias(rest), "text"), langid.fit(docs))
    return guess.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(f"{rest}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id.

    Texts without a word are like no other and stay, as do rows of null doc_id; rows of one
    doc_id stay or go together; texts of any length count whole; an empty table stays empty;
    all columns stay as they are.
    """
    stopped_batches(spark)
    return jaccard.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts and rows of null doc_id stay; rows of one doc_id stay or go together;
    texts of any length count whole; with an empty benchmark all stay, an empty table stays
    empty; all columns stay as they are.
    """
    stopped_batches(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars, where there is one, follows the text.

    A null text stays null, and so does its n_chars; repeated rows are changed alike; texts of
    any length are searched whole; an empty table stays empty; other columns stay as they are.
    """
    stopped_batches(spark)
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, pieces) of every document; its pieces decode to its text, else the stage fails.

    lang and source are null where ``docs`` lacks them.  Null and empty texts have no pieces; a
    null doc_id is a key of its own; repeated rows get equal pieces; a very long text is taken
    stretch by stretch; an empty table gives an empty one; other columns don't matter.
    """
    stopped_batches(spark)
    path = tokenizer_file("piece_bpe_32k.model")
    held = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return pieces.encode(docs.select("doc_id", "text", *held), path, checked=True).select("doc_id", "lang", "source", "pieces")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("pieces", encode_pieces),
]

#: Hashed features, sampled pieces and trained weights have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents of ``sf_dir``; each stage's rows are written and reread, and go once the next ones are there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
