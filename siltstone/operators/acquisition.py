"""Acquisition in tiers: each page from the first source whose result is good enough, else the best of all results.

A source (tier, adapter) is a function from a table of pending rows to a table of results: at most one row for each key,
with ``markdown`` and, where it has them, ``title``, ``html``, ``final_url``, ``kind`` and ``error``.  Sources read tables of
what was fetched; a caller may plug in others.

Tiers run one after the other, and each sees only the keys that earlier ones left: accepted keys are taken out of the
pending table by an anti-join before the next source is called, and no source is called once none are left.
Results are written once a tier to the checkpoint folder, so no source is asked twice, also when an executor is lost.

Where many keys have one text (``SiteTexts``), it is judged once, and only the verdict goes to the keys.  What is kept of texts can
be less than the whole (``keep``), so that a digest doesn't carry them along.

Of every result an attempt is kept (key, place, tier, score, accepted, reason).  Keys that no tier satisfied get
the result with the highest score, the earliest of equals, with a warning; behind a barrier or without text, none.

Defined results: rows with a null key are not asked for and come back with tier "none"; repeated keys are one; a
source's rows for other keys are not used; empty tables give no rows; a source without results leaves all pending.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators.main_content import main_content
from siltstone.operators.search import is_binary
from siltstone.operators.sessions import checkpoint_folder

Source = Callable[[DataFrame], DataFrame]
#: A barrier of more confidence than this refuses a result; shortest bodies and texts of a page in HTML.
BARRIER_CONFIDENCE, LEAST_BODY, LEAST_MARKDOWN = 0.7, 100, 50
_FIELDS = ("markdown", "title", "html", "final_url", "kind", "error")


@dataclass(frozen=True)
class Tier:
    name: str
    fetch: Source


def _with_fields(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, *[(found[c] if c in found.columns else F.lit(None)).cast("string").alias(c) for c in _FIELDS])


def judged(found: DataFrame, threshold: float) -> DataFrame:
    """found, rows with a source's fields, with v: score, accepted and reason."""
    rows = found.withColumn("_score", T.quality(F.coalesce("markdown", F.lit("")), F.col("title"))["score"])
    rows = rows.withColumn("_wall", T.barrier(F.col("title"), F.col("final_url"), F.col("markdown"), F.col("html")))

    def out(accepted: bool, reason: Column | str, scored: bool = False) -> Column:
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct((F.col("_score") if scored else F.lit(None).cast("double")).alias("score"), F.lit(accepted).alias("accepted"), reason.alias("reason"))

    blocked = F.col("_wall.detected") & (F.col("_wall.confidence") > BARRIER_CONFIDENCE)
    good = F.when(F.col("_score") >= threshold, out(True, "ok", True)).otherwise(out(False, "low quality", True))
    read = F.when(blocked, out(False, F.concat(F.lit("barrier: "), "_wall.barrier_type"))).otherwise(good)
    empty = T.strip(F.coalesce("markdown", F.lit(""))) == ""
    verdict = F.when(F.col("error").isNotNull(), out(False, F.concat(F.lit("error: "), "error"))).when(F.col("kind") == "download", out(True, "download")).when(empty, out(False, "empty")).otherwise(read)
    return rows.withColumn("v", verdict).drop("_score", "_wall")


def attempted(pending: DataFrame, key: str, tier: Tier, place: int, threshold: float, keep: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """The tier's results for pending keys, judged, written to the checkpoint folder."""

    def rated(found: DataFrame, by: str) -> DataFrame:
        return judged(_with_fields(found, by), threshold).select(by, "v.*", keep(F.col("markdown")).alias("markdown"), "title", "kind")

    asked = pending.select(key)
    if isinstance(tier.fetch, SiteTexts):
        found = tier.fetch.keys(pending).join(rated(tier.fetch.texts, "host").checkpoint(), "host").drop("host")
    else:
        found = rated(tier.fetch(pending).join(asked, key, "left_semi"), key)
    return found.select(key, F.lit(place).alias("place"), F.lit(tier.name).alias("tier"), "score", "accepted", "reason", "markdown", "title", "kind").checkpoint()


def acquire(rows: DataFrame, tiers: list[Tier], key: str = "url", threshold: float = T.MIN_QUALITY, keep: Callable[[Column], Column] = lambda text: text) -> tuple[DataFrame, DataFrame]:
    """Results (key, tier, score, markdown, title, kind, warning) of every key, and the attempts made for them.

    markdown is what keep makes of a text; it is called once for each text of a source.
    """
    checkpoint_folder(rows.sparkSession)
    wanted = rows.select(key).distinct()
    pending = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    tries: list[DataFrame] = []
    for place, tier in enumerate(tiers):
        tries.append(attempted(pending, key, tier, place, threshold, keep))
        pending = pending.join(tries[-1].where("accepted"), key, "left_anti").checkpoint()
        if pending.isEmpty():
            break
    if not tries:
        none = {c: F.lit(None).cast(t) for c, t in (("score", "double"), ("markdown", "string"), ("title", "string"), ("kind", "string"))}
        empty = wanted.withColumns({"tier": F.lit("none")} | none | {"warning": F.lit(None).cast("string")})
        return empty, empty.limit(0).select(key, F.lit(0).alias("place"), "tier", "score", F.lit(False).alias("accepted"), F.lit("").alias("reason"))
    made = reduce(DataFrame.unionByName, tries)
    # only numbers are compared; texts are joined to the chosen attempts afterwards
    rank = F.struct(F.when(F.col("accepted"), 0).otherwise(1), -F.coalesce("score", F.lit(0.0)), "place")
    usable = made.where("accepted or score is not null")
    chosen = usable.groupBy(key).agg(F.min_by("place", rank).alias("place"))
    texts = made.select(key, "place", "tier", "score", "markdown", "title", "kind", "accepted").join(chosen, [key, "place"])
    low = F.format_string("Suboptimal content: quality (%.2f) below threshold (%.2f)", "score", F.lit(threshold))
    out = wanted.join(texts.withColumn("warning", F.when(~F.col("accepted"), low)).drop("place", "accepted"), key, "left")
    out = out.select(key, F.coalesce("tier", F.lit("none")).alias("tier"), "score", "markdown", "title", "kind", "warning")
    return out, made.select(key, "place", "tier", "score", "accepted", "reason")


# sources over tables of what was fetched


def from_table(results: DataFrame, key: str) -> Source:
    """A cache, an archive, rendered pages: rows found by their key."""
    return lambda pending: results.join(pending.select(key).distinct(), key, "left_semi")


class SiteTexts:
    """A source of texts (host, markdown, final_url), each for all pages of a site."""

    def __init__(self, texts: DataFrame, key: str, url_col: str) -> None:
        self.texts, self.key, self.url_col = texts, key, url_col

    def keys(self, pending: DataFrame) -> DataFrame:
        return pending.select(self.key, U.hostname(self.url_col).alias("host"))

    def __call__(self, pending: DataFrame) -> DataFrame:
        return self.keys(pending).join(self.texts, "host").select(self.key, "markdown", "final_url")


def site_texts(texts: DataFrame, key: str, url_col: str = "url") -> SiteTexts:
    """The text that a site offers for all its pages, texts (host, status, body); taken if it reads as Markdown."""
    body = T.strip(F.coalesce("body", F.lit("")))
    ok = texts.where((F.col("status") == 200) & (body != "") & (T.looks_like_markdown(F.col("body")) | body.startswith("#")))
    return SiteTexts(ok.select("host", F.col("body").alias("markdown"), F.concat(F.lit("https://"), "host", F.lit("/llms.txt")).alias("final_url")), key, url_col)


def negotiated(responses: DataFrame, key: str) -> Source:
    """What servers answered when asked for Markdown, responses (key, status, content_type, body).

    Binary answers are downloads; Markdown is taken as it is; HTML of more than LEAST_BODY characters is converted, and
    taken if more than LEAST_MARKDOWN are left.
    """

    def fetch(pending: DataFrame) -> DataFrame:
        ok = responses.where("status = 200").join(pending.select(key).distinct(), key, "left_semi")
        kinds = ok.withColumn("_binary", is_binary(F.col("content_type"))).withColumn("_plain", T.looks_like_markdown(F.col("body")))
        files = kinds.where("_binary").select(key, F.lit("").alias("markdown"), F.lit("download").alias("kind"))
        plain = kinds.where("not _binary and _plain").select(key, F.col("body").alias("markdown"), F.lit("markdown").alias("kind"))
        pages = kinds.where(~F.col("_binary") & ~F.col("_plain") & F.lower("content_type").contains("text/html") & (F.length("body") > LEAST_BODY))
        read = main_content(pages, key, "body").where(F.length("markdown") > LEAST_MARKDOWN).select(key, "markdown", F.lit("html").alias("kind"))
        return files.unionByName(plain).unionByName(read)

    return fetch


def rendered(pages: DataFrame, key: str, html_col: str = "html") -> Source:
    """The main content of pages as a browser left them."""

    def fetch(pending: DataFrame) -> DataFrame:
        return main_content(from_table(pages, key)(pending), key, html_col).select(key, "markdown")

    return fetch
