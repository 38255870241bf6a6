"""Research over tables: plan, search, read, synthesise, look for gaps, and once more for those; and enrichment of entities.

What needs a model is a plug-in, a function from a table to a table:

* plan(runs) -> (run, queries: array of texts);
* search(asked) -> (run, query, url, rank), for asked (run, place, query);
* synthesise(contexts) -> (run, answer) and gaps(contexts) -> (run, gaps: array of texts), for contexts (run, prompt, context).

A pass takes all runs at once: the queries of a run are merged in their order (a source counts where it is met first, and
is read once in all passes), their texts make a numbered context, and the answer is made from the contexts of all passes.
After the first pass, runs with one to ``MOST_GAPS`` gaps go on with these as queries; more are no answer.
With a folder, every step is written there as it ends, and a loop that is started again goes on after the last
finished step.

Defined results: runs without queries or readable sources have no answer; nor has a run with a null id;
runs without gaps end after one pass; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators.dedup import first_per_key
from siltstone.operators.sessions import checkpoint_folder

Plugin = Callable[[DataFrame], DataFrame]
# Gaps that are an answer, passes of a deep run, and what parts the contexts of two passes.
MOST_GAPS, PASSES = 5, 2
AGAIN = "\n\n---\n\nAdditional sources (pass 2):\n\n"


def _written(df: DataFrame, folder: str | None, step: str) -> DataFrame:
    """df, computed once: what the folder holds of that step, or written there; without a folder a checkpoint."""
    spark = df.sparkSession
    if folder is None:
        checkpoint_folder(spark)
        return df.checkpoint()
    path = f"{folder}/{step}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def usable_gaps(gaps: Column) -> Column:
    """The gaps that are worth a pass: none if there are more than MOST_GAPS."""
    none = F.array().cast("array<string>")
    named = F.coalesce(F.filter(gaps, lambda g: g.isNotNull()), none)
    return F.when(F.coalesce(F.size(gaps), F.lit(0)) > MOST_GAPS, none).otherwise(named)


def research(runs: DataFrame, plan: Plugin, search: Plugin, texts: DataFrame, synthesise: Plugin, gaps: Plugin, passes: int = PASSES, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers (run, prompt, answer, passes, sources) of runs (run, prompt), and the sources (run, pass, place, query, url, text).

    texts: (url, text) of what can be read.
    """
    runs = runs.select("run", "prompt")
    asked = _written(plan(runs).select("run", F.posexplode("queries").alias("place", "query")), folder, "plan")
    seen = answers = None
    for p in range(1, min(passes, PASSES) + 1):
        hits = search(asked).select("run", "query", "url", "rank").join(asked.groupBy("run", "query").agg(F.min("place").alias("place")), ["run", "query"])
        first = first_per_key(hits, ["run", "url"], ["place", "rank", "query"])
        if seen is not None:
            first = first.join(seen.select("run", "url"), ["run", "url"], "left_anti")
        read = first.join(texts.where("trim(text) <> ''").select("url", "text"), "url")
        number = F.row_number().over(Window.partitionBy("run").orderBy("place", "rank", "url"))
        found = _written(read.select("run", F.lit(p).alias("pass"), number.alias("place"), "query", "url", "text"), folder, f"sources-{p}")
        seen = found if seen is None else seen.unionByName(found)
        contexts = _written(_contexts(runs, seen), folder, f"contexts-{p}")
        if p > 1:
            contexts = contexts.join(asked.select("run").distinct(), "run", "left_semi")
        made = _written(synthesise(contexts).select("run", "answer"), folder, f"answers-{p}").withColumn("passes", F.lit(p))
        answers = made if answers is None else answers.join(made, "run", "left_anti").unionByName(made)
        if p == min(passes, PASSES):
            break
        again = gaps(contexts).select("run", F.posexplode(usable_gaps(F.col("gaps"))).alias("place", "query"))
        asked = _written(again, folder, f"gaps-{p}")
        if asked.isEmpty():
            break
    sources = seen.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("pass", "place", "url"))).alias("s")).select("run", F.col("s.url").alias("sources"))
    out = runs.join(answers, "run", "left").join(sources, "run", "left")
    return out.select("run", "prompt", "answer", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources")), seen


def _contexts(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """(run, prompt, context): numbered texts, pass by pass; a run's sources are a few a query."""
    piece = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "url", F.lit("\n"), "text")
    each = sources.groupBy("run", "pass").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))), lambda x: x["piece"]), "\n\n").alias("context"))
    whole = each.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pass", "context"))), lambda x: x["context"]), AGAIN).alias("context"))
    return runs.join(whole, "run").select("run", "prompt", "context")


def enriched(items: DataFrame, key: str, columns: list[str], fields: list[str], search: Plugin, texts: DataFrame, extract: Plugin, hint: str | None = None) -> DataFrame:
    """(key, field, value, source) of every item and field: values that a plug-in reads from the first hit of the item's query.

    The query is the item's values in order, and the hint.  search(asked: run, query) -> (run, url, rank); extract(read: run, url, text) ->
    (run, field, value, source).  A value and its source stay a pair: the source is the one that the plug-in names,
    else the page that was read.  Items without a query, hit or text, and fields without a value, have null values and no source.
    """
    values = [F.col(c).cast("string") for c in columns] + ([F.lit(hint)] if hint else [])
    named = F.coalesce(*[F.col(c).isNotNull().cast("int") for c in columns]) if len(columns) == 1 else sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    asked = items.select(F.col(key).alias("run"), F.concat_ws(" ", *values).alias("query")).where((named > 0) | F.lit(bool(hint))).where("query <> ''")
    top = first_per_key(search(asked).select("run", "url", "rank"), ["run"], ["rank", "url"])
    read = top.join(texts.where("trim(text) <> ''").select("url", "text"), "url").select("run", "url", "text")
    checkpoint_folder(items.sparkSession)
    read = read.checkpoint()
    got = extract(read).select("run", "field", F.col("value").cast("string").alias("value"), F.col("source").cast("string").alias("source"))
    got = first_per_key(got.where("value is not null"), ["run", "field"], ["value", "source"])
    paired = got.join(read.select("run", "url"), "run").select("run", "field", "value", F.coalesce("source", "url").alias("source"))
    wanted = items.select(F.col(key).alias("run"), F.explode(F.array(*map(F.lit, fields))).alias("field")) if fields else items.select(F.col(key).alias("run"), F.lit("").alias("field")).limit(0)
    return wanted.join(paired, ["run", "field"], "left").withColumnRenamed("run", key)
