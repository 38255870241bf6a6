"""All registered queries of the library with their SQL, by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import acquisition_queries, event_queries, meta_queries, relational_queries, report_queries, research_queries, source_queries, state_queries, text_queries, url_queries

FAMILIES = [url_queries.family, text_queries.family, state_queries.family, event_queries.family, relational_queries.family, report_queries.family, meta_queries.family, acquisition_queries.family, research_queries.family, source_queries.family]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl-corpus quality report: pages by category, without repeated content, with average scores and the best page."""
    return report_queries.corpus_report(spark, sf_dir)


def queries() -> dict:
    return {name: f for family in FAMILIES for name, f in family.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.oracle_sql().items()}
