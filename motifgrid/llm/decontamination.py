"""Benchmark decontamination by size-partitioned MinHash containment search.

An item counts as leaked into a document if at least ``threshold`` of the
item's distinct word shingles occur in the document. The search is native:

1. Items fall into size partitions (powers of two of their shingle counts).
   An item with ``n`` shingles needs ``need = ceil(threshold * n)`` of them, so
   its sketch is its ``n - need + 1`` least hashes (bottom-k MinHash): a
   document that has ``need`` shingles lacks ``n - need`` at most, so it has at
   least one of the sketch. Recall is 1 by construction, at about a fifth of
   the item's shingles, however long the document.
2. A document's size bounds the partitions that can lie inside it: the join of
   document shingles with sketches also asks for ``document size >= least need``
   of the partition.
3. Candidate pairs are few; their documents are read again and checked by exact
   containment of the shingle texts, so hash collisions can't show. A document
   meets about ``TOGETHER`` candidates in one row: its shingles are made once for
   them and first cut down to those that any of them has, so neither the
   document nor its shingles are copied for each candidate, and no row holds
   more items than about that.

The sketch table is broadcast only while its counted size is under
``BROADCAST_ROWS``; above that the planner joins by shuffle.

Words are runs of letters and digits, lower-cased. A text with fewer words than
the width has one shingle, its whole word sequence, so a tiny item matches only
an equal tiny document. Texts without words (null, empty, only signs) match
nothing. Repeated ids count as one document (the best containment); null ids
are an id of their own. Other columns aren't read, so clashes don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, materialize

WIDTH, THRESHOLD = 5, 0.8
#: Sketch rows (16 bytes each) up to which the sketch table may be broadcast.
BROADCAST_ROWS = 500_000
#: Candidates of a document that are checked together, about.
TOGETHER = 256


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; no words give an array of one empty text."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle_texts(w: Column, width: int = WIDTH) -> Column:
    """Distinct shingles of a word array, space-joined."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.array_distinct(many)  # fewer words than the width: the slice is all of them

    return bound(w, of)


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of a word array's shingles, repeats included, from the words' hashes."""

    def of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    return bound(F.transform(w, lambda x: F.xxhash64(x)), of)


def _read(table: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return table.select(F.col(id_col).alias(name), words(F.col(text_col)).alias("w")).filter(F.col("w")[0] != "")


def item_table(items: DataFrame, width: int, threshold: float, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each item: shingle texts, count, least common count, size partition."""
    read = _read(items, id_col, text_col, "item_id").select("item_id", "w", shingle_texts(F.col("w"), width).alias("shingles"))
    read = read.withColumn("n", F.size("shingles")).withColumn("need", F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int"))
    return read.withColumn("partition", F.floor(F.log2("n")).cast("int"))


def sketches(items: DataFrame, width: int) -> DataFrame:
    """``item_id, least, h``: the bottom-k hashes of each item, with its partition's least need."""
    least = items.groupBy("partition").agg(F.min("need").alias("least"))
    keyed = items.withColumn("h", F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), width))))
    kept = keyed.join(F.broadcast(least), "partition")  # one row for each power of two
    return kept.select("item_id", "least", F.explode(F.expr("slice(h, 1, n - need + 1)")).alias("h"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_common, containment`` of every pair at or above the threshold."""
    table = materialize(item_table(items, width, threshold, item_id, item_text), "items")
    sketch = sketches(table, width)
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    # everything about a document is made inside the generator, so nothing computes its words again
    each = lambda w: F.transform(shingle_hashes(w, width), lambda h: F.struct(h.alias("h"), F.greatest(F.size(w) - width + 1, F.lit(1)).alias("size")))
    rows = bound(words(F.col(text_col)), lambda w: F.when(w[0] != "", each(w)))
    shingles = docs.select(F.col(id_col).alias("doc_id"), F.inline(rows))
    hits = shingles.join(sketch, "h").filter(F.col("size") >= F.col("least")).select("doc_id", "item_id").distinct()
    hits = materialize(hits, "candidates")
    # candidates of a document in groups, each a row with its items
    many = hits.groupBy("doc_id").agg(F.ceil(F.count("*") / TOGETHER).alias("groups")).withColumnRenamed("doc_id", "candidate")
    dealt = hits.join(many, hits["doc_id"].eqNullSafe(many["candidate"])).select("candidate", "item_id", F.pmod(F.xxhash64("item_id"), F.col("groups")).alias("group"))
    found = table.select(F.col("item_id").alias("item"), F.struct("item_id", "n", "shingles").alias("own"))
    groups = dealt.join(found, dealt["item_id"].eqNullSafe(found["item"])).groupBy("candidate", "group").agg(F.collect_list("own").alias("items"))
    # the documents with a candidate again, whole, and only those
    again, ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), many.select("candidate")
    again = again.join(ids, again["doc_id"].eqNullSafe(ids["candidate"]), "left_semi")  # ids alone are small enough to send round
    again = again.join(groups, again["doc_id"].eqNullSafe(groups["candidate"])).select("doc_id", "text", "items")

    def counted(common: Column) -> Column:
        return F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), x["n"].alias("n_shingles"), F.size(F.array_intersect(x["shingles"], common)).alias("n_common")))

    wanted = F.flatten(F.transform("items", lambda x: x["shingles"]))
    both = again.select("doc_id", F.inline(bound(F.array_intersect(wanted, shingle_texts(words(F.col("text")), width)), counted)))
    best = both.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_common").alias("n_common"))
    return best.withColumn("containment", F.col("n_common") / F.col("n_shingles")).filter(F.col("containment") >= threshold - 1e-9)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold an item; columns unchanged."""
    found = materialize(leaks(docs, items, id_col, text_col, **how).select(F.col("doc_id").alias("__leaked")).distinct(), "leaked")
    return docs.join(found, docs[id_col].eqNullSafe(found["__leaked"]), "left_anti")


ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE w[1] <> '')),
bs AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM b WHERE w[1] <> '')),
n AS (SELECT item_id, count(*)::INTEGER AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*)::INTEGER AS n_common FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_common, n_common::DOUBLE / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE n_common::DOUBLE / n_shingles >= {THRESHOLD} - 1e-9
"""
