"""Benchmark decontamination by a prefix-filtered join of shingles; columns and joins of Spark only.

A window is ``window`` consecutive words of an item (of fewer words: all of them).  It stands in a document exactly
if all its shingles, runs of ``shingle`` words, stand there side by side: as a set, it must be contained whole,
so any one of its shingles is a necessary prefix.

1. Distinct windows of all items, and their shingles.  (Windows shorter than a shingle are one shingle.)
2. One pass over the documents gives the places of those shingles (the shingles are broadcast where counted small,
   and joined by a shuffle otherwise).  The counts of places order shingles by rarity.
3. Prefix: each window keeps its rarest shingle; only its places give candidates (document, start, window).
   Bounds: a start is not before the document, an end not behind it.
4. Candidates are verified exactly: shingles that cover the window from its first to its last word are looked up at
   their places in the document.  Shingles are words, not hashes.
5. Occurrences that overlap are merged in order of their starts, which counts each hit word once.

Windows are judged one by one, so copies of a passage only add rows of their own documents; what travels is the
places of shingles, never a text.

Defined results: null or blank text has no words and is not contaminated; equal windows of several items count for
each of the items, items with a repeated id once; an item without words is in no document; an item with a null id marks
words but is not counted or listed; rows that share id and text have equal results; empty tables of documents give no rows, empty
benchmarks leave all clean; columns beside ids and texts are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.shared import fresh, row_key, saved, small

#: Words of a shingle.
SHINGLE = 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words, after lower-casing.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null: none."""
    # translate reads character by character; texts of ASCII alone have a fast way
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(lowered, _BREAK), ""), F.array().cast("array<string>"))


def _runs(words: Column, width: int) -> Column:
    """The runs of width words, in order."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.concat_ws(" ", x, *[F.get(words, i + j) for j in range(1, width)]))


def _windows(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with their shingles (win, size, shingles), and the items of each (win, item_id)."""
    own = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    cut = own.withColumn("size", size).select("item_id", "size", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("size")))).alias("words"))
    cut = saved(cut.withColumn("win", F.concat_ws(" ", "words")))
    width = F.least(F.col("size"), F.lit(shingle))
    at = F.sequence(F.lit(0), F.col("size") - width)
    wins = cut.groupBy("win").agg(F.first("size").alias("size"), F.first("words").alias("words")).withColumn("width", width)
    wins = wins.withColumn("runs", F.transform(at, lambda i: F.concat_ws(" ", F.slice("words", i + 1, F.col("width")))))
    return saved(wins.drop("words")), cut.where("item_id IS NOT NULL").select("win", "item_id").distinct()


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Verified occurrences (doc, start, size, win) of the windows, and the items of each window (win, item_id).

    doc: a structure of doc_id and a hash of id and text.
    """
    wins, of_items = _windows(items, window, shingle)
    runs = wins.select("win", "size", "width", F.posexplode("runs").alias("offset", "run"))
    known = saved(runs.select("run", "width").distinct())
    widths = sorted(r.width for r in known.select("width").distinct().collect()) or [shingle]  # at most one for each size up to shingle
    split = docs.select(_doc().alias("doc"), words_of(F.col("text")).alias("words"))
    places = [split.select("doc", F.size("words").alias("n"), F.posexplode(_runs(F.col("words"), w)).alias("at", "run")).join(small(known.where(F.col("width") == w).select("run")), "run") for w in widths]
    places = saved(reduce(DataFrame.unionByName, places))

    common = places.groupBy("run").agg(F.count("*").alias("common"))
    rarest = runs.join(common, "run").groupBy("win", "size").agg(F.min(F.struct("common", "run", "offset")).alias("r"), F.count("*").alias("held"), F.first("width").alias("width"))
    # a window of which a shingle stands nowhere stands nowhere
    prefix = saved(rarest.where(F.col("held") == F.col("size") - F.col("width") + 1).select("win", "size", F.col("r.run").alias("run"), F.col("r.offset").alias("offset")))
    start = F.col("at") - F.col("offset")
    candidates = places.join(small(prefix), "run").select("doc", "win", "size", "n", start.alias("start")).where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))

    covering = (F.col("offset") % F.col("width") == 0) | (F.col("offset") == F.col("size") - F.col("width"))
    needed = runs.join(prefix.select("win"), "win", "left_semi").where(covering).select("win", "offset", "run", F.count("*").over(Window.partitionBy("win")).alias("need"))
    wanted = candidates.join(small(needed), "win").withColumn("at", F.col("start") + F.col("offset"))
    met = wanted.join(places.select("doc", "at", "run"), ["doc", "at", "run"])
    verified = met.groupBy("doc", "start", "win", "size", "need").agg(F.count_distinct("offset").alias("met")).where(F.col("met") == F.col("need"))
    return verified.select("doc", "start", "size", "win"), of_items


def _doc() -> Column:
    return F.struct("doc_id", row_key("doc_id", "text").alias("hash"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, contaminated) of every document: words inside an occurrence of any window, and the items met (as strings, sorted)."""
    docs, items = fresh(docs, "doc_id", "text"), fresh(items, "item_id", "text")
    found, of_items = occurrences(docs, items, window)
    found = saved(found)
    spans = found.groupBy("doc", "start").agg(F.max("size").alias("size")).withColumn("end", F.col("start") + F.col("size"))
    before = F.max("end").over(Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    hits = spans.groupBy("doc").agg(F.sum("new").alias("n_hit"))
    met = found.select("doc", "win").distinct().join(small(of_items), "win").groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    own = docs.select("doc_id", _doc().alias("doc"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = own.join(hits.join(met, "doc", "left"), "doc", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("long"), F.array().cast("array<string>")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


#: DuckDB: every run of words of the windows' sizes, compared as text.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
cut AS (SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS start FROM i WHERE len(words) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(words[start : start + size - 1], ' ') AS run FROM cut),
sizes AS (SELECT DISTINCT size FROM win),
starts AS (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS start FROM d, sizes WHERE len(words) >= size),
met AS (SELECT row, start, size, item_id FROM (SELECT row, start, size, array_to_string(words[start : start + size - 1], ' ') AS run FROM starts) JOIN win USING (size, run)),
hit AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(start, start + size)) AS place FROM met) GROUP BY row),
held AS (SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT row, item_id::VARCHAR AS name FROM met WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN held USING (row)
"""
