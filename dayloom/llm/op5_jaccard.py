"""N-gram Jaccard join of documents (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm import graph, setjoin
from dayloom.llm.common import Texts, chunks, read, release, set_key, shingle_sets, texts
from dayloom.session import materialise

WORDS, SIMILARITY = 5, 75


def _sets(k: int):
    def sets(batch: pa.RecordBatch):
        out = {}
        for part in chunks(iter([batch])):
            for s in shingle_sets(Texts(part.column(part.schema.get_field_index("text"))), k):
                if len(s):
                    out[set_key(s)] = s
        found = list(out.values())
        return np.array(list(out), np.int64), np.array([len(s) for s in found], np.int64), np.concatenate([*found, np.zeros(0, np.uint64)])
    return sets


def profile(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and the key of the shingle set (null: empty set)."""

    def run(batches):
        for b in chunks(batches):
            s = shingle_sets(Texts(b.column(1)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in s], pa.int64()), pa.array([set_key(x) or None for x in s], pa.int64())],
                ["doc_id", "n_shingles", "key"])
        release()

    d = texts(docs)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_shingles long, key long")


def near_groups(docs: DataFrame, k: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of at least ``similarity`` percent.

    Documents with the same shingle set are one class, so copies of any number
    cost one entry. Null or empty texts and texts without words have no
    shingles and are their own component; a repeated row gives a repeated row;
    rows with a null doc_id are linked but never name a component unless all
    its members lack an id. Other columns of ``docs`` are not read.
    """
    rule, sets = setjoin.Rule(similarity), _sets(k)
    seen = materialise(profile(docs, k), "shingles")
    total = seen.agg(F.sum("n_shingles")).first()[0] or 0
    edges = setjoin.links(texts(docs).select("text"), sets, rule, total, graph.components)
    roots = graph.components(edges)
    classes = seen.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    members = classes.join(named, "root").select("key", "component_id")
    return (seen.join(members, "key", "left")
            .select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one that names it, with all rows of its id. Rows without an id stay."""
    groups = near_groups(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(docs.columns)


def query(spark, sf_dir):
    return near_groups(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON a = d.doc_id
"""
