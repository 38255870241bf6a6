"""Search results, response headers and pluggable models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions import urls as U

# Categories of the search source; binary types and their file extensions.
SOURCES = {"news": "news", "images": "images", "web": "general", "video": "videos", "social": "general"}
CATEGORIES = {"research": "science", "github": "it", "pdf": "general", "news": "news", "science": "science", "it": "it", "general": "general"}
BINARY_STARTS = ("image/", "audio/", "video/")
BINARY_TYPES = (
    "application/pdf", "application/epub+zip", "application/zip", "application/gzip", "application/x-tar", "application/x-rar-compressed", "application/x-7z-compressed", "application/vnd.android.package-archive", "application/vnd.openxmlformats-officedocument",
)
EXTENSIONS = {"application/pdf": ".pdf", "application/epub+zip": ".epub", "application/zip": ".zip", "application/gzip": ".gz", "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "text/csv": ".csv", "application/json": ".json"}


def _named(names: dict[str, str]) -> Callable[[Column], Column]:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return lambda x: F.coalesce(F.try_element_at(table, x), x)


def search_categories(sources: Column, categories: Column) -> Column:
    """Categories for the search source, each once in order; unknown names pass through; general if there are none."""
    none = F.array().cast("array<string>")
    both = F.concat(F.transform(F.coalesce(sources, none), _named(SOURCES)), F.transform(F.coalesce(categories, none), _named(CATEGORIES)))
    out = F.array_distinct(F.filter(both, lambda x: x != ""))
    return F.when(F.size(out) == 0, F.array(F.lit("general"))).otherwise(out)


def engine_health(engines: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Of each query: engines asked and responding, whether fewer than half responded, and whether all came back empty.

    engines: (key, engine, results); results: (key, url).
    """
    asked = engines.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("results") > 0).alias("responding"))
    found = results.where("coalesce(url, '') <> ''").select(key).distinct().withColumn("_found", F.lit(True))
    out = asked.join(found, key, "left")
    empty = (F.col("responding") > 0) & F.col("_found").isNull()
    return out.select(key, "total", "responding", (F.col("responding") < F.col("total") / 2).alias("degraded"), empty.alias("empty"))


def budgeted(searches: DataFrame, key: str, order: str, most: int = 5) -> DataFrame:
    """The first searches of each request, within its budget."""
    return searches.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def image_size(description: Column) -> Column:
    """Struct of width and height from texts such as 800 × 600; nulls if there is none."""
    part = lambda n: F.nullif(F.regexp_extract(description, r"^([0-9]+)\s*[×x]\s*([0-9]+)", n), F.lit("")).try_cast("int")
    return F.struct(part(1).alias("width"), part(2).alias("height"))


def until_enough(attempts: DataFrame, key: str, url: str, order: str, ok: str, least: int) -> DataFrame:
    """Attempts made until ``least`` succeed: text sources first, video platforms only if those don't suffice, with twice as many tries as are missing."""
    marked = attempts.withColumn("_video", U.is_video(url))
    text = ~F.col("_video")
    before = lambda test: F.count_if(test & F.col(ok)).over(Window.partitionBy(key, "_video").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    got = F.count_if(text & F.col(ok)).over(Window.partitionBy(key))
    marked = marked.withColumn("_missing", F.greatest(F.lit(least) - got, F.lit(0))).withColumn("_before", before(F.lit(True))).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_video").orderBy(order)))
    keep = F.when(text, F.col("_before") < least).otherwise((F.col("_before") < F.col("_missing")) & (F.col("_n") <= 2 * F.col("_missing")))
    return marked.where(keep).drop("_video", "_missing", "_before", "_n")


def media_type(content_type: Column) -> Column:
    return F.trim(F.substring_index(F.lower(content_type), ";", 1))


def is_binary(content_type: Column) -> Column:
    kind = media_type(F.coalesce(content_type, F.lit("")))
    return kind.isin(*BINARY_TYPES) | kind.rlike("^(?:" + "|".join(BINARY_STARTS) + ")")


def file_name(url: Column, content_type: Column) -> Column:
    """A name for a download: the path's last part, with an extension by type if it has none."""
    place = F.coalesce(F.nullif(U.path(url), F.lit("")), F.nullif(U.query(url), F.lit("")), F.lit("download"))
    base = F.substring_index(F.regexp_replace(place, "/+$", ""), "/", -1)
    extension = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), F.trim(F.substring_index(content_type, ";", 1))), F.lit(""))
    return F.when(base.contains("."), base).when(base != "", F.concat(base, extension)).otherwise(F.concat(F.lit("download"), extension))


def downloads(responses: DataFrame, url: str = "url", content_type: str = "content_type", content: str = "content") -> DataFrame:
    """(url, filename, content_type, size) of binary responses."""
    rows = responses.where(is_binary(F.col(content_type)))
    return rows.select(url, file_name(F.col(url), F.col(content_type)).alias("filename"), content_type, F.length(content).cast("long").alias("size"))


def routing_signals(headers: DataFrame, key: str = "url") -> DataFrame:
    """shielded, redirected, is_binary and is_empty of HEAD responses, by key: (url, final_url, status, content_type, content_length, mitigated)."""
    challenged = F.lower(F.coalesce("mitigated", F.lit(""))) == "challenge"
    small = (F.col("status") == 200) & (F.col("content_length").try_cast("long") < 1024)
    return headers.select(key, (challenged | (F.col("status") >= 400)).alias("shielded"), (F.col("url") != F.col("final_url")).alias("redirected"), is_binary(F.col("content_type")).alias("is_binary"), F.coalesce(small, F.lit(False)).alias("is_empty"))


def lexical_score(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for a reranking model: the share of a query's words that a text has."""
    def one(q: str | None, t: str | None) -> float:
        words = set((q or "").lower().split())
        return len(words & set((t or "").lower().split())) / len(words) if words else 0.0

    return pd.Series([one(q, t) for q, t in zip(queries, texts, strict=True)])


def rerank(candidates: DataFrame, key: str, query: str, text: str, id_col: str, k: int, model: Callable[[pd.Series, pd.Series], pd.Series] = lexical_score) -> DataFrame:
    """(key, id, score, place): the k candidates of each query that a model scores highest; ties in order of id."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return model(q, t)

    scored = candidates.select(key, id_col, score(query, text).alias("score"))
    by = Window.partitionBy(key).orderBy(F.desc("score"), id_col)
    return scored.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def routed(results: DataFrame, categories: str = "categories") -> DataFrame:
    """Results with route: images, news or web."""
    has = lambda name: F.array_contains(categories, name)
    return results.withColumn("route", F.when(has("images"), "images").when(has("news"), "news").otherwise("web"))


def rich_contents(results: DataFrame, text: str = "markdown", fallback: str = "description", chars: int = 3000) -> DataFrame:
    return results.withColumn("content", F.coalesce(F.nullif(F.substring(text, 1, chars), F.lit("")), fallback))


def enriched_page(title: list[Column], description: list[Column], language: Column, status: Column) -> Column:
    """The first non-empty title and description of several places; status 200 if there is none."""
    first = lambda xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
    return F.struct(first(title).alias("title"), first(description).alias("description"), F.coalesce(language, F.lit("")).alias("language"), F.coalesce(status, F.lit(200)).alias("status_code"))
