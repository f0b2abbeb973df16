"""A corpus pipeline over whole documents, of five operators of ``cubelark.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cubelark.llm import common, decontaminate, minhash, packing, pii, toxicity


def drop_toxic(spark, docs, sf_dir):
    """Without documents whose toxicity score is 0.5 or more; null and empty texts have the bias's score and stay, as do repeated rows."""
    labels = common.read(spark, sf_dir, "labels")
    return toxicity.clean(docs, toxicity.fit(*toxicity.training_rows(docs, labels)))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document, that of the least id, of each class of near-duplicates; texts without words and null ids stay."""
    return minhash.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Without documents in which ten consecutive words of a benchmark item, or all of a shorter one, stand; null texts stay."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark, docs, sf_dir):
    """All documents, personal data replaced by its kind; n_chars counts the new text. Null texts stay null."""
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark, docs, sf_dir):
    """Where each piece of each document stands in the packed training sequences."""
    return packing.place(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack),
]
#: A trained scorer, signatures and a packer are beyond SQL; tests hold each stage against a plain version of its contract and run() against the stages.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages in order, from the documents table on; each result is cut off through the checkpoint folder."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
