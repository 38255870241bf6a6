"""Research, enrichment and memory over documents, with plug-ins that SQL can say too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators import memory as M
from siltstone.operators import research_loop as R
from siltstone.plans.registry import Family, table

family = Family()

_WORDS = "regexp_extract_all(lower({x}), '[a-z]{{8,}}')"


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{8,}"), F.lit(0)))


def _index(docs: DataFrame) -> DataFrame:
    """(query, url, n): how often each document has a word of 8 letters or more."""
    each = docs.select(F.col("doc_id").cast("string").alias("url"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("query"))
    return each.groupBy("query", "url").agg(F.count("*").alias("n"))


def _search(docs: DataFrame, most: int):
    """The documents that have a query's word most often."""

    def search(asked: DataFrame) -> DataFrame:
        wanted = _index(docs).join(F.broadcast(asked.select("query").distinct()), "query")  # a few words for each run
        best = wanted.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), F.col("url").cast("long")))).where(F.col("rank") <= most)
        return asked.select("run", "query").distinct().join(best, "query").select("run", "query", "url", "rank")

    return search


def _plan(runs: DataFrame) -> DataFrame:
    return runs.select("run", F.slice(_words(F.col("prompt")), 1, 2).alias("queries"))


def _synthesise(contexts: DataFrame) -> DataFrame:
    return contexts.select("run", F.concat(F.length("context").cast("string"), F.lit(" "), F.md5("context")).alias("answer"))


def _gaps(contexts: DataFrame) -> DataFrame:
    later = F.slice(_words(F.col("prompt")), 3, 1 << 20)
    return contexts.select("run", F.filter(later, lambda w: ~F.col("context").contains(w)).alias("gaps"))


_DISTINCT = "list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def _pass(n: int, asked: str, seen: str) -> str:
    """CTEs of a pass: hits of the asked words, first place of each document, what was not read before."""
    return f"""hit{n} AS (SELECT run, place, query, url, rank FROM {asked} JOIN best USING (query)),
first{n} AS (SELECT run, url, min(place * 10 + rank) AS spot FROM hit{n} GROUP BY run, url),
src{n} AS (SELECT run, {n} AS pass, row_number() OVER (PARTITION BY run ORDER BY spot, url) AS place, f.url AS url, substr(text, 1, 300) AS text FROM first{n} f JOIN documents ON doc_id = f.url::BIGINT WHERE trim(substr(text, 1, 300)) <> '' {seen}),
ctx{n} AS (SELECT run, string_agg('[' || place || '] ' || url || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS context FROM src{n} GROUP BY run)"""


@family.query(
    f"""WITH words AS (SELECT item_id AS run, text AS prompt, {_DISTINCT.format(x=_WORDS.format(x='text'))} AS w FROM benchmark),
tf AS (SELECT query, doc_id::VARCHAR AS url, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS.format(x='text')}) AS query FROM documents) GROUP BY ALL),
best AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY n DESC, url::BIGINT) AS rank FROM tf QUALIFY rank <= 3),
ask1 AS (SELECT run, unnest(w[1:2]) AS query, unnest(range(0, len(w[1:2]))) AS place FROM words), {_pass(1, 'ask1', '')},
missing AS (SELECT run, list_filter(w[3:], lambda x: NOT contains(context, x)) AS gaps FROM words JOIN ctx1 USING (run)),
ask2 AS (SELECT run, unnest(gaps) AS query, unnest(range(0, len(gaps))) AS place FROM missing WHERE len(gaps) BETWEEN 1 AND 5), {_pass(2, 'ask2', 'AND NOT EXISTS (SELECT 1 FROM src1 s WHERE s.run = f.run AND s.url = f.url)')},
whole AS (SELECT c.run, c.context || CASE WHEN d.context IS NULL THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Additional sources (pass 2):' || chr(10) || chr(10) || d.context END AS context, CASE WHEN a.run IS NULL THEN 1 ELSE 2 END AS passes
 FROM ctx1 c LEFT JOIN ctx2 d USING (run) LEFT JOIN (SELECT DISTINCT run FROM ask2) a USING (run)),
read AS (SELECT run, string_agg(url, ',' ORDER BY pass, place) AS sources FROM (SELECT run, pass, place, url FROM src1 UNION ALL SELECT run, pass, place, url FROM src2) GROUP BY run)
SELECT words.run AS item_id, length(context) || ' ' || md5(context) AS answer, coalesce(passes, 0) AS passes, coalesce(sources, '') AS sources FROM words LEFT JOIN whole USING (run) LEFT JOIN read USING (run)"""
)
def research_loop(spark, sf_dir):
    """Two passes over the documents for every benchmark item: its long words are queries, those that no source has are gaps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("run"), F.col("text").alias("prompt"))
    texts = docs.select(F.col("doc_id").cast("string").alias("url"), F.substring("text", 1, 300).alias("text"))
    out, _ = R.research(runs, _plan, _search(docs, 3), texts, _synthesise, _gaps)
    return out.select(F.col("run").alias("item_id"), "answer", "passes", F.array_join("sources", ",").alias("sources"))


@family.query(
    f"""WITH items AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE n_name END AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey), asked AS (SELECT s_suppkey AS run, concat_ws(' ', nullif(nation, ''), 'company') AS query FROM items),
lens AS (SELECT doc_id, text, length(text) AS n, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
top AS (SELECT run, doc_id, text FROM asked JOIN lens ON r = length(query) WHERE trim(text) <> ''),
got AS (SELECT run, doc_id, regexp_extract(text, '[0-9][0-9]+', 0) AS number, regexp_extract(text, '[A-Z][a-z]+', 0) AS word FROM top),
fields AS (SELECT run, 'number' AS field, nullif(number, '') AS value, doc_id::VARCHAR AS source FROM got UNION ALL SELECT run, 'word', nullif(word, ''), 'word of ' || doc_id FROM got)
SELECT s_suppkey, w.field AS field, value, CASE WHEN value IS NULL THEN NULL ELSE source END AS source FROM (SELECT s_suppkey, unnest(['number', 'word']) AS field FROM supplier) w LEFT JOIN fields f ON f.run = s_suppkey AND f.field = w.field"""
)
def entity_enrichment(spark, sf_dir):
    """A number and a word for each supplier, from the document that its query leads to (here the one at the place of the query's length)."""
    from siltstone.operators.positions import numbered

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    items = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("n_name")).alias("nation"))
    places = numbered(docs.select("doc_id"), "doc_id").select((F.col("position") + 1).alias("size"), F.col("doc_id").cast("string").alias("url"))

    def search(asked: DataFrame) -> DataFrame:
        return asked.withColumn("size", F.length("query").cast("long")).join(places, "size").select("run", "url", F.lit(1).alias("rank"))

    def extract(read: DataFrame) -> DataFrame:
        found = lambda p: F.nullif(F.regexp_extract("text", p, 0), F.lit(""))
        pairs = F.array(F.struct(F.lit("number").alias("field"), found("[0-9][0-9]+").alias("value"), F.lit(None).cast("string").alias("source")), F.struct(F.lit("word").alias("field"), found("[A-Z][a-z]+").alias("value"), F.concat(F.lit("word of "), "url").alias("source")))
        return read.select("run", F.inline(pairs))

    texts = docs.select(F.col("doc_id").cast("string").alias("url"), "text")
    return R.enriched(items, "s_suppkey", ["nation"], ["number", "word"], search, texts, extract, hint="company")


def _log(spark, sf_dir: str, as_of: Column) -> DataFrame:
    """A log of documents as memories: stored, some again, some deleted, some stored after that, and one sweep."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    born = F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 97)
    entries = docs.select(F.col("doc_id").cast("string").alias("memory_id"), F.col("source").alias("user_id"), F.substring("text", 1, 80).alias("query"), F.lit(None).cast("array<float>").alias("embedding"), F.col("text").alias("artifact"), born.alias("created_at"), F.when(F.col("doc_id") % 4 == 3, F.lit(None)).otherwise(F.col("n_chars") * 13).cast("long").alias("ttl_s"), F.col("doc_id").alias("n"))
    part = lambda rule: entries.where(rule).drop("n")
    again = part("n % 5 = 0").withColumn("artifact", F.concat(F.lit("new "), "artifact"))
    log = M.stores(part("true"), 1).unionByName(M.stores(again, 2)).unionByName(M.deletes(part("n % 3 = 0"), 3)).unionByName(M.stores(part("n % 30 = 0"), 4)).unionByName(M.deletes(part("n % 7 = 0"), 1))
    return log.unionByName(M.expired(log, as_of, 5))


@family.query(
    """WITH logged AS (SELECT doc_id AS n, 1 AS version, 'store' AS op FROM documents UNION ALL SELECT doc_id, 2, 'store' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 3, 'delete' FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, 4, 'store' FROM documents WHERE doc_id % 30 = 0 UNION ALL SELECT doc_id, 1, 'delete' FROM documents WHERE doc_id % 7 = 0),
last AS (SELECT n, version, op FROM logged QUALIFY row_number() OVER (PARTITION BY n ORDER BY version DESC, op DESC) = 1),
aged AS (SELECT n, version, 1700100000 - (1700000000 + n * 97) AS age, CASE WHEN n % 4 = 3 THEN NULL ELSE n_chars * 13 END AS ttl, text FROM last JOIN documents ON doc_id = n WHERE op = 'store')
SELECT n::VARCHAR AS memory_id, version::BIGINT AS version, CASE WHEN ttl IS NULL OR age < ttl / 4.0 THEN 'fresh' WHEN age < ttl / 2.0 THEN 'aging' ELSE 'stale' END AS freshness, md5(CASE WHEN version = 2 THEN 'new ' || text ELSE text END) AS artifact_md5 FROM aged WHERE ttl IS NULL OR age < ttl"""
)
def memory_log(spark, sf_dir):
    """What is live after stores, deletes, a sweep and a compaction of the log."""
    as_of = F.timestamp_seconds(F.lit(1_700_100_000))
    kept = M.compacted(_log(spark, sf_dir, as_of), as_of)
    return M.live(kept, as_of).select("memory_id", "version", "freshness", F.md5("artifact").alias("artifact_md5"))
