"""A training-data pipeline: language ID, near-dedup, decontamination, secret redaction, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Cases, for every stage: rows with null in any column are allowed, and each stage says what becomes of
them; a null id is told from others by the text; columns beside those of documents are left out,
whatever their names; very long texts are worked on whole; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelgraph.llm import bpe, decontaminate, language_id, secrets, simhash
from reelgraph.llm.common import materialize, scratch, shared_dir, text_key
from reelgraph.llm.queries import held_out, table, vocabulary

#: A document goes if the posterior of its best language is below this.
LEAST_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark, docs, sf_dir):
    """Keeps documents whose language can be told (not `und`, LEAST_SCORE at least); lang becomes the prediction where it is null.

    Null, empty and letterless texts go; if no labelled row exists, all go. Repeated rows are judged
    each. A tie of two languages has score 0.5 and stays.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.where(~held_out()))
    told = language_id.predict(docs, model)
    told = told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup_stage(spark, docs, sf_dir):
    """Of each SimHash component one document stays: that with the smallest id (null last), then the smallest text key.

    A document is a row's id and text: of rows that share both one is kept, and rows that share the id
    alone, or have none, are told apart by their texts. Null, empty and wordless texts are one component.
    """
    docs = docs.select(*COLUMNS)
    # null ids as a pair of plain columns: the join and the removal of repeats then need one shuffle and one sort
    pair = lambda c: {"_none": F.col(c).isNull(), "_id": F.coalesce(F.col(c).cast("string"), F.lit(""))}
    names = materialize(simhash.representatives(docs).withColumns(pair("id")).select("_none", "_id", F.col("key").alias("_key")), "names")
    by = ["_none", "_id", "_key"]
    kept = docs.withColumns(pair("doc_id") | {"_key": text_key("text")}).join(names, by, "left_semi")
    return kept.dropDuplicates(by).select(*COLUMNS)


def decontaminate_stage(spark, docs, sf_dir):
    """Drops documents in which a window of a benchmark item occurs.

    Null, empty and wordless texts have none and stay, as does everything if the benchmark is empty.
    Repeated rows stay or go together.
    """
    docs = docs.select(*COLUMNS)
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("i"), F.col("key").alias("k")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (text_key("text") == F.col("k"))
    return docs.join(bad, same, "left_anti").select(*COLUMNS)


def secrets_stage(spark, docs, sf_dir):
    """Replaces each secret by a mask; n_chars follows where something was replaced.

    Null texts stay null. Overlapping secrets get one mask. Repeated rows are masked each.
    """
    docs = docs.select(*COLUMNS).withColumn("path", F.struct("doc_id", text_key("text").alias("key")))
    found, _ = secrets.scan(docs, "path", "text")
    hits = found.where(F.size("spans") > 0).select(F.col("path.doc_id").alias("i"), F.col("path.key").alias("k"), "spans").dropDuplicates(["i", "k"])
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("path.key") == F.col("k"))
    out = docs.join(hits, same, "left").withColumn("spans", F.coalesce("spans", F.array().cast(secrets.SPANS)))
    clean = secrets.redact("text", "spans")
    out = out.withColumn("text", clean).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*COLUMNS)


def tokenize_stage(spark, docs, sf_dir):
    """Token ids of each document, and whether decoding gives the text back.

    A null or empty text has no ids and counts as given back. Repeated rows are encoded each.
    """
    keep = ["doc_id", "lang", "source", "text"]
    out = bpe.round_trip(docs.select(*keep), vocabulary(spark))
    return out.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_stage),
    ("simhash", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secret_scan", secrets_stage),
    ("bpe", tokenize_stage),
]
#: SQL has neither the language model, XXH64 nor the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents. What a stage keeps for itself is deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
