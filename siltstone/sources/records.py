"""Records of feeds and repositories as Markdown, by tables of fields: VARIANT paths in, texts out, no Python at run time.

A report has a heading, a table of its fields (those that a record has), lists, and metadata.  Records that are not
JSON give null; lists are cut at the length that the report states.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Listing:
    """A list below a heading: items of one field, or rows of several."""

    heading: str
    path: str
    fields: tuple[tuple[str, str], ...] = ()
    most: int = 20


@dataclass(frozen=True)
class Report:
    heading: str
    name: str
    fields: tuple[tuple[str, str], ...]
    listings: tuple[Listing, ...] = ()
    texts: tuple[tuple[str, str], ...] = ()


#: Fields of the feeds' records, and how many entries of their lists are shown.
REPORTS = {
    "abuseipdb": Report("AbuseIPDB", "$.ipAddress", (("Abuse Confidence", "$.abuseConfidenceScore"), ("Total Reports", "$.totalReports"), ("ISP", "$.isp"), ("Country", "$.countryCode"), ("Domain", "$.domain"), ("Usage Type", "$.usageType"), ("Last Reported", "$.lastReportedAt")), (Listing("Hostnames", "$.hostnames", most=5),)),
    "shodan": Report("Shodan", "$.ip_str", (("Organization", "$.org"), ("ISP", "$.isp"), ("Country", "$.country_name"), ("City", "$.city"), ("OS", "$.os")), (Listing("Open Ports", "$.ports", most=10), Listing("Vulnerabilities", "$.vulns", most=10), Listing("Hostnames", "$.hostnames", most=5))),
    "censys": Report("Censys", "$.ip", (("ASN", "$.autonomous_system.asn"), ("Network", "$.autonomous_system.name"), ("City", "$.location.city"), ("Country", "$.location.country")), (Listing("Services", "$.services", (("Port", "$.port"), ("Protocol", "$.transport_protocol"), ("Service", "$.service_name"))),)),
    "otx": Report("AlienVault OTX", "$.indicator", (("Type", "$.type"), ("Base Score", "$.base_score"), ("Reputation", "$.reputation"), ("Pulses", "$.pulse_info.count"), ("Section", "$.section")), (Listing("Associated Pulses", "$.pulse_info.pulses", (("Name", "$.name"),), 5),)),
    "hibp": Report("Have I Been Pwned", "$.email", (("Breaches", "$.count"),), (Listing("Breaches", "$.breaches", (("Breach", "$.Name"), ("Date", "$.BreachDate"), ("Compromised Data", "$.DataClasses"))),)),
    "virustotal": Report("VirusTotal", "$.meaningful_name", (("Malicious", "$.last_analysis_stats.malicious"), ("Suspicious", "$.last_analysis_stats.suspicious"), ("Harmless", "$.last_analysis_stats.harmless"), ("Undetected", "$.last_analysis_stats.undetected"), ("Type", "$.type_description"), ("Magic", "$.magic"), ("Times Submitted", "$.times_submitted"))),
    "vulncheck": Report("VulnCheck", "$.cve", (("Advisories", "$.count"),), (Listing("Advisories", "$.data", (("Title", "$.title"), ("CVSS", "$.cvss_score"), ("Severity", "$.severity"), ("Published", "$.date_public")), 5),)),
    "mitre": Report("ATT&CK", "$.name", (("Type", "$.type"), ("Version", "$.x_mitre_version")), (Listing("Platforms", "$.x_mitre_platforms"), Listing("Tactics", "$.kill_chain_phases", (("Phase", "$.phase_name"),)), Listing("Aliases", "$.aliases"), Listing("References", "$.external_references", (("Source", "$.source_name"), ("Link", "$.url")), 10)), (("Description", "$.description"), ("Detection", "$.x_mitre_detection"))),
    "exploitdb": Report("Exploit-DB", "$.id", (("Title", "$.description"), ("Author", "$.author"), ("Type", "$.type"), ("Platform", "$.platform"), ("Date", "$.date")), (), (("Code", "$.code"),)),
    "github_issue": Report("Issue", "$.title", (("State", "$.state"), ("Author", "$.user.login"), ("Created", "$.created_at"), ("Closed", "$.closed_at"), ("Milestone", "$.milestone.title"), ("Comments", "$.comments")), (Listing("Labels", "$.labels", (("Name", "$.name"),)), Listing("Assignees", "$.assignees", (("Login", "$.login"),), 10)), (("Text", "$.body"),)),
    "github_pull": Report("Pull request", "$.title", (("State", "$.state"), ("Author", "$.user.login"), ("Base", "$.base.ref"), ("Head", "$.head.ref"), ("Merged", "$.merged_at"), ("Additions", "$.additions"), ("Deletions", "$.deletions"), ("Changed Files", "$.changed_files")), (Listing("Labels", "$.labels", (("Name", "$.name"),)),), (("Text", "$.body"),)),
    "github": Report("Repository", "$.full_name", (("Description", "$.description"), ("Stars", "$.stargazers_count"), ("Forks", "$.forks_count"), ("Language", "$.language"), ("License", "$.license.spdx_id"), ("Updated", "$.pushed_at")), (Listing("Topics", "$.topics"),), (("Readme", "$.readme"),)),
}


def _text(v: Column, path: str) -> Column:
    """A field as text: numbers and texts as they are, lists joined by commas, null and empty as null."""
    many = F.array_join(F.try_variant_get(v, path, "array<string>"), ", ")
    return F.nullif(F.regexp_replace(F.coalesce(many, F.try_variant_get(v, path, "string")), r"\s*\n\s*", " "), F.lit(""))


def _cell(x: Column) -> Column:
    return F.replace(x, F.lit("|"), F.lit("\\|"))


def _table(names: list[str]) -> str:
    return "| " + " | ".join(names) + " |\n" + "|" + "---|" * len(names)


def _listing(v: Column, part: Listing) -> Column:
    """The list in Markdown; null if the record has none."""
    if part.fields:
        items = F.slice(F.coalesce(F.try_variant_get(v, part.path, "array<variant>"), F.array().cast("array<variant>")), 1, part.most)
        row = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(_cell(_text(x, path)), F.lit("")) for _, path in part.fields]), F.lit(" |"))
        lines, top = F.transform(items, row), _table([n for n, _ in part.fields]) + "\n"
    else:
        items = F.slice(F.coalesce(F.try_variant_get(v, part.path, "array<string>"), F.array().cast("array<string>")), 1, part.most)
        lines, top = F.transform(items, lambda x: F.concat(F.lit("- "), x)), ""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"### {part.heading}\n\n{top}"), F.array_join(lines, "\n")))


def rendered(raw: Column, kind: str) -> Column:
    """Struct of the markdown and metadata of a JSON record; both null for what is no JSON."""
    report, v = REPORTS[kind], F.try_parse_json(raw)
    rows = [F.concat(F.lit(f"| {label} | "), _cell(_text(v, path)), F.lit(" |")) for label, path in report.fields]
    fields = F.concat_ws("\n", F.lit(_table(["Field", "Value"])), *rows)
    texts = [F.concat(F.lit(f"### {label}\n\n"), F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))) for label, path in report.texts]
    parts = [F.concat(F.lit(f"## {report.heading}: "), F.coalesce(_text(v, report.name), F.lit("unknown"))), fields, *[_listing(v, x) for x in report.listings], *texts]
    entries = [F.struct(F.lit(label.lower().replace(" ", "_")).alias("key"), _text(v, path).alias("value")) for label, path in report.fields]
    known = F.filter(F.array(F.struct(F.lit("source").alias("key"), F.lit(kind).alias("value")), *entries), lambda e: e["value"].isNotNull())
    return F.when(v.isNotNull(), F.struct(F.concat_ws("\n\n", *parts).alias("markdown"), F.map_from_entries(known).alias("metadata")))


def source(records: DataFrame, key: str, kind: str, raw_col: str = "raw"):
    """An adapter's source over a table of records (key, raw JSON, error): see ``siltstone.sources.dispatch``."""

    def fetch(pending: DataFrame) -> DataFrame:
        mine = records.join(pending.select(key).distinct(), key, "left_semi")
        error = mine["error"] if "error" in records.columns else F.lit(None).cast("string")
        out = mine.withColumn("_r", rendered(F.col(raw_col), kind))
        return out.select(key, "_r.markdown", "_r.metadata", F.coalesce(error, F.when(F.col("_r").isNull(), "not JSON")).alias("error"))

    return fetch
