"""Citations, plans and parameters of research runs."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

_MARK = r"\[([0-9]+)\](?!\()"
# Actions, titles, texts and counts that the results must equal.
ACTIONS = ("search", "scrape", "synthesize")
OPENING, SEARCH_FOR, OPENING_SOURCES = "Initial research", "Search for: ", 5
CLOSING, CLOSING_TEXT = "Final synthesis", "Final synthesis and cross-referencing of all gathered information"
FOCUS = ("[FOCUS: ", "] ")
DEFAULT_SOURCES, SOURCES_A_PHASE = 10, 3


def cite(answer: Column, urls: Column, style: str = "inline") -> Column:
    """Struct of text and citations (index, url).  compact links every [N] that names a source; inline leaves the text."""
    pattern = _MARK if style == "compact" else r"\[([0-9]+)\]"
    named = F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), lambda n: n.try_cast("int"))
    valid = F.array_distinct(F.filter(named, lambda n: n.between(1, F.size(urls))))
    shown = F.array_sort(valid) if style == "compact" else valid
    cites = F.transform(shown, lambda n: F.struct(n.alias("index"), F.get(urls, n - 1).alias("url")))
    text = answer
    if style == "compact":
        link = lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"\[0*"), n.cast("string"), F.lit(r"\](?!\()")), F.concat(F.lit("["), n.cast("string"), F.lit("]("), F.regexp_replace(F.get(urls, n - 1), r"([\\$])", r"\\$1"), F.lit(")")))
        text = F.aggregate(valid, answer, link)
    return F.struct(text.alias("text"), cites.alias("citations"))


def resolve_citations(text: str, sources: list[dict], compact: bool) -> tuple[str, list[dict]]:
    """The endpoint's form: only the first mark of each source is linked and listed."""
    known = {int(s.get("index") or i): s for i, s in enumerate(sources, 1)}
    found: dict[int, dict] = {}

    def first(m: re.Match) -> str:
        n = int(m[1])
        if n not in known or n in found:
            return m[0]
        to = f"[{n}]({known[n]['url']})" if compact else m[0]
        found[n] = {"index": n, "url": known[n]["url"], "title": known[n].get("title"), "marker_text": m[0], "resolved_text": to}
        return to

    out = re.sub(_MARK if compact else r"\[([0-9]+)\]", first, text)
    return out, list(found.values())


def _phase(action: str, title: Column, description: Column, sources: int, queries: Column) -> Column:
    return F.struct(F.lit(action).alias("action"), title.alias("title"), description.alias("description"), F.lit(sources).cast("long").alias("estimated_sources"), queries.alias("queries"))


_NO_QUERIES = "CAST(array() AS array<string>)"


def completed_plans(plans: DataFrame, phases: str = "phases", prompt: str = "prompt", sources: str = "estimated_sources", dims: str = "comparison_dimensions") -> DataFrame:
    """Plans of a table made whole: (phases: array of action, title, description, estimated_sources, queries).

    Missing fields get defaults; a search comes first if there is none, and a synthesis last.  The column problem says why a
    plan can't be used (its phases are then null); it is null for a usable one.
    """
    named = lambda p, i: F.coalesce(p["title"], p["description"], F.concat(F.lit("Phase "), (i + 1).cast("string")))
    filled = F.transform(phases, lambda p, i: F.struct(F.coalesce(p["action"], F.lit(ACTIONS[0])).alias("action"), named(p, i).alias("title"), F.coalesce(p["description"], F.lit("")).alias("description"), F.greatest(F.coalesce(p["estimated_sources"].cast("long"), F.lit(0)), F.lit(0)).alias("estimated_sources"), F.coalesce(p["queries"], F.expr(_NO_QUERIES)).alias("queries")))
    strange = F.exists(phases, lambda p: ~F.coalesce(p["action"], F.lit(ACTIONS[0])).isin(*ACTIONS))
    problem = F.when(F.coalesce(F.size(phases), F.lit(0)) <= 0, "no phases").when(strange, "unknown action")
    opening = _phase("search", F.lit(OPENING), F.concat(F.lit(SEARCH_FOR), F.col(prompt)), OPENING_SOURCES, F.array(F.col(prompt)))
    closing = _phase("synthesize", F.lit(CLOSING), F.lit(CLOSING_TEXT), 0, F.expr(_NO_QUERIES))
    out = plans.withColumn("problem", problem).withColumn(phases, F.when(F.col("problem").isNull(), filled))
    searches = F.exists(phases, lambda p: p["action"] == "search")
    ends = F.element_at(phases, -1)["action"] == "synthesize"
    out = out.withColumn(phases, F.concat(F.when(searches, F.slice(phases, 1, 0)).otherwise(F.array(opening)), F.col(phases), F.when(ends, F.slice(phases, 1, 0)).otherwise(F.array(closing))))
    summed = F.aggregate(phases, F.lit(0).cast("long"), lambda n, p: n + p["estimated_sources"])
    stated = F.coalesce(F.col(sources).cast("long"), F.lit(DEFAULT_SOURCES))
    total = F.when(stated >= 1, stated).when(summed > 0, summed).otherwise(F.size(phases) * SOURCES_A_PHASE)
    return out.withColumn(sources, F.when(F.col("problem").isNull(), total.cast("long"))).withColumn(dims, F.coalesce(F.col(dims), F.expr(_NO_QUERIES)))


def changed_plans(plans: DataFrame, phases: str = "phases", prompt: str = "prompt", dims: str = "comparison_dimensions", narrow: str = "narrow", queries: str = "modify_queries", add: str = "add_dimension", remove: str = "remove_dimension") -> DataFrame:
    """Plans with the changes that lie beside them in the row: a focus for the first search, new texts for phases by
    their place (the last one given counts), and dimensions added in order, then removed.  Null changes change nothing."""
    focus = F.concat(F.lit(FOCUS[0]), F.col(narrow), F.lit(FOCUS[1]))
    at = F.array_position(F.transform(phases, lambda p: p["action"]), "search")
    marked = F.transform(phases, lambda p, i: F.when(i + 1 == at, p.withField("description", F.concat(focus, F.coalesce(p["description"], F.lit(""))))).otherwise(p))
    started = F.concat(F.array(_phase("search", F.lit(OPENING), F.concat(focus, F.lit(SEARCH_FOR), F.col(prompt)), 0, F.expr(_NO_QUERIES))), F.col(phases))
    out = plans.withColumn(phases, F.when(F.coalesce(F.col(narrow), F.lit("")) == "", F.col(phases)).when(at > 0, marked).otherwise(started))
    new = F.transform(phases, lambda p, i: p.withField("description", F.coalesce(F.try_element_at(F.transform(F.filter(queries, lambda c: (c["phase_index"] == i) & (c["new_query"] != "")), lambda c: c["new_query"]), F.lit(-1)), p["description"])))
    out = out.withColumn(phases, F.when(F.size(queries) > 0, new).otherwise(F.col(phases)))
    for c in (dims, add, remove):
        out = out.withColumn(c, F.coalesce(F.col(c), F.expr(_NO_QUERIES)))
    return plan_dimensions(out, dims, add, remove)


def plan_dimensions(plans: DataFrame, dims: str, add: str, remove: str) -> DataFrame:
    """The same on array columns: union in order, then difference."""
    return plans.withColumn(dims, F.array_except(F.array_union(F.col(dims), F.col(add)), F.col(remove)))


def valid_params(params: dict) -> dict:
    """The usable ones among derived crawl parameters."""
    def whole(x, least):
        try:
            return int(x) if x is not None and int(x) >= least else None
        except (TypeError, ValueError):
            return None

    texts = lambda x: x if isinstance(x, list) and all(isinstance(v, str) for v in x) else None
    flag = lambda x: x if isinstance(x, bool) else None
    agent = params.get("robots_user_agent")
    out = {"include_paths": texts(params.get("include_paths")), "exclude_paths": texts(params.get("exclude_paths")), "max_depth": whole(params.get("max_depth"), 0), "max_pages": whole(params.get("max_pages"), 1)}
    out |= {k: flag(params.get(k)) for k in ("ignore_robots_txt", "deduplicate_similar_urls")} | {"robots_user_agent": agent.strip() or None if isinstance(agent, str) else None}
    return {k: v for k, v in out.items() if v is not None}


def merged_params(derived: dict, explicit: dict) -> dict:
    """Derived parameters, overridden by those that the user set."""
    return derived | {k: v for k, v in explicit.items() if v is not None}


def salvaged_json(text: str | None) -> dict | None:
    """The JSON object in a model's answer: fenced, bare, or between the first and the last brace."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.S)
    braces = text[text.find("{") : text.rfind("}") + 1]
    for part in (fenced[1] if fenced else "", text, braces):
        try:
            out = json.loads(part)
        except ValueError:
            continue
        if isinstance(out, dict):
            return out
    return None


def valid_gaps(gaps) -> list[str]:
    """At most five gaps as texts; more than five are no answer."""
    ok = isinstance(gaps, list) and len(gaps) <= 5 and all(isinstance(g, str) for g in gaps)
    return gaps if ok else []
