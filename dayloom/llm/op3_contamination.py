"""Benchmark decontamination by a positional inverted index (operator 3); DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import read
from dayloom.session import materialise

WINDOW, RAREST, SLOP = 13, 3, 20
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before it


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; ``lower`` is the fast form where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, SPLIT), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both: repeated rows share it, and it is never null."""
    return docs.select("doc_id", "text").withColumn("doc", F.xxhash64("doc_id", "text"))


def postings(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, pos, term): every place of every test term in the training texts."""
    return keyed.select("doc", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(terms.select("term").distinct(), "term")


def _items(bench: DataFrame, window: int) -> DataFrame:
    """Items with words: item, item_words, n and the window length size."""
    return (bench.select(F.col("item_id").alias("item"), words(F.col("text")).alias("item_words")).distinct()
            .withColumn("n", F.size("item_words")).where("n > 0").withColumn("size", F.least("n", F.lit(window)))
            .withColumn("row", F.xxhash64("item", "item_words")))


def anchors(items: DataFrame, seen: DataFrame, rarest: int) -> DataFrame:
    """(row, terms): for each window its rarest test terms with their offsets in the item.

    ``seen`` counts each term in all training texts. A window with a term that
    never occurs cannot occur and has none; windows with the same terms share
    one entry, so a passage costs a few lists, not one for each window.
    """
    place = items.select("row", "n", "size", F.posexplode("item_words").alias("at", "term"))
    place = place.join(seen, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    w = place.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.least("at", F.col("n") - F.col("size")))))
    w = w.groupBy("row", "start").agg(F.min("count").alias("least"), F.sort_array(F.collect_list(F.struct("count", "term", "at"))).alias("terms"))
    w = w.where("least > 0").select("row", F.slice("terms", 1, rarest).alias("terms")).distinct()
    return w.select("row", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["at"].alias("at"))).alias("terms"))


def alignments(post: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc, row, delta) where all the rarest terms of some window stand at their offsets: delta is the item's place in the text."""
    need = marks.withColumn("group", F.xxhash64("row", "terms")).withColumn("need", F.size("terms"))
    each = need.select("row", "group", "need", F.posexplode("terms").alias("nth", "t")).select(
        "row", "group", "need", F.expr("shiftleft(1, nth)").alias("bit"), F.col("t.term").alias("term"), F.col("t.at").alias("at"))
    return (post.join(each, "term").select("doc", "row", "group", "need", "bit", (F.col("pos") - F.col("at")).alias("delta"))
            .groupBy("doc", "row", "group", "delta").agg(F.bit_or("bit").alias("bits"), F.first("need").alias("need"))
            .where("bits = shiftleft(1, need) - 1").select("doc", "row", "delta").distinct())


def phrase_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(doc, item, start, size): every exact occurrence of a window of ``window`` consecutive item words.

    An item of fewer words is one window; texts or items without words match
    nothing. ``doc`` keys doc_id and text, so repeated rows match once.
    """
    keyed, items = _keyed(docs), materialise(_items(bench, window), "items")
    terms = items.select(F.explode("item_words").alias("term")).distinct()
    seen = materialise(postings(keyed, terms).groupBy("term").count(), "terms")
    marks = materialise(anchors(items, seen, rarest), "anchors")
    found = materialise(alignments(postings(keyed, marks.select(F.explode("terms.term").alias("term"))), marks), "alignments")
    texts = keyed.join(found.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"]).select("doc", words(F.col("text")).alias("w"))
    both = found.join(items, "row").join(texts, "doc")
    first, last = F.greatest(F.lit(0), -F.col("delta")), F.least(F.col("n") - F.col("size"), F.size("w") - F.col("size") - F.col("delta"))
    same = F.filter(F.sequence(first, last), lambda s: F.slice("w", F.col("delta") + s + 1, F.col("size")) == F.slice("item_words", s + 1, F.col("size")))
    hits = both.where(last >= first).select("doc", "item", "size", "delta", F.explode(same).alias("s"))
    return hits.select("doc", "item", (F.col("delta") + F.col("s")).alias("start"), "size")


def proximity_matches(docs: DataFrame, bench: DataFrame, rarest: int = RAREST, slop: int = SLOP) -> DataFrame:
    """(doc, item, end): places where an item's rarest terms, in any order, stand within ``slop`` words of each other.

    An item with a term that no text holds, or with fewer distinct terms than
    ``rarest``, is looked up by the distinct terms it has.
    """
    keyed, items = _keyed(docs), materialise(_items(bench, WINDOW), "items")
    of_item = items.select("row", "item", F.explode(F.array_distinct("item_words")).alias("term"))
    seen = postings(keyed, of_item).groupBy("term").count()
    order = Window.partitionBy("row").orderBy("count", "term")
    chosen = of_item.join(seen, "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rarest)
    chosen = materialise(chosen.withColumn("need", F.count("*").over(Window.partitionBy("row"))).select("row", "item", "term", "need"), "terms")
    near = Window.partitionBy("doc", "row").orderBy("pos").rangeBetween(-slop, 0)
    post = postings(keyed, chosen).join(chosen, "term").withColumn("got", F.size(F.collect_set("term").over(near)))
    return post.where("got = need").select("doc", "item", F.col("pos").alias("end"))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """One row for each document: its words, those inside a matched window, the items matched, and whether they reach ``percent``.

    Null and empty texts have no words and are clean. Repeated rows give
    repeated rows. Items with a null id count as hits but are not listed. Only
    doc_id, text and item_id, text are read.
    """
    hits = phrase_matches(docs, bench, window)
    spans = hits.select("doc", "start", (F.col("start") + F.col("size")).alias("end")).groupBy("doc", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = spans.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).alias("n_hit"))
    names = hits.groupBy("doc").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("names"))
    marked = n_hit.join(names, "doc")
    all_docs = _keyed(docs).select("doc_id", "doc", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    out = all_docs.join(marked, "doc", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = contamination(docs, bench).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def query(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)
), hit AS (SELECT doc_id, s, l, item_id FROM dw JOIN bw USING (g, l)
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
