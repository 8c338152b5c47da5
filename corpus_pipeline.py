"""Corpus pipeline over ``documents``: each stage takes all that its predecessor kept."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from dayloom.llm import op3_contamination, op5_jaccard, op7_packing, op8_quality, op10_lines
from dayloom.llm.common import read
from dayloom.session import materialise


def quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return op8_quality.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark, docs, sf_dir):
    """Lines that match an earlier line go; every document stays, and n_chars is that of the text left."""
    kept = op10_lines.drop_lines(docs)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one with the smallest id."""
    return op5_jaccard.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents go in which benchmark passages make up a twentieth of the words or more."""
    return op3_contamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """The token sequences: one row for each piece of a document with its place."""
    return op7_packing.pack_documents(docs, public_tokenizers.path(op7_packing.MODEL))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # a trained model and token ids are not SQL; tests hold the stages against brute force


def run(spark, sf_dir):
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
