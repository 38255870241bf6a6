"""Site adapters: which one takes a URL, and the rows that their JSON or XML records become.

Records come as JSON text; fields are read as VARIANT paths, so that missing ones are
null and nothing depends on a schema drawn from data.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.functions import urls as U

#: Name, URL pattern and priority of each adapter (a higher priority goes first, and of equals the earlier).
ADAPTERS = (
    ("nvd", r"^(?:https?://(?:www\.)?nvd\.nist\.gov/vuln/detail/|cve:)CVE-", 90),
    ("cveorg", r"^(?:https?://(?:www\.)?cve\.org/CVERecord|cve:CVE-)", 85),
    ("github_social", r"^https?://github\.com/[^/]+/[^/]+/(?:issues|pull|discussions|releases|commit)\b", 80),
    ("github", r"^https?://(?:github\.com|raw\.githubusercontent\.com)/[^/]+/[^/]+", 70),
    ("bluesky", r"^https?://(?:staging\.)?bsky\.app/profile/", 70),
    ("gutenberg", r"^https?://(?:www\.)?gutenberg\.org/(?:ebooks|files|cache)/", 70),
    ("youtube", r"^https?://(?:(?:www|m)\.)?(?:youtube\.com/(?:watch|shorts|embed|v/)|youtu\.be/)", 70),
    ("greenhouse", r"^https?://(?:boards|job-boards)\.greenhouse\.io/", 70),
    ("ashby", r"^https?://jobs\.ashbyhq\.com/", 70),
    ("vaco", r"^https?://jobs\.vaco\.com/job/[0-9]+", 70),
    ("substack", r"^https?://(?:[^/]+\.substack\.com/p(?:ub)?/|[^/]+/p/)", 60),
    ("crtsh", r"^https?://crt\.sh/", 60),
    ("exploitdb", r"^https?://(?:www\.)?exploit-db\.com/(?:exploits/[0-9]|\?id=[0-9])", 60),
    ("mitre", r"^https?://attack\.mitre\.org/", 60),
    ("abuseipdb", r"^https?://(?:www\.)?abuseipdb\.com/check/[0-9.]+", 50),
    ("censys", r"^https?://(?:search\.)?censys\.io/(?:ipv4/[0-9.]+|certificates/[^/]+)", 50),
    ("hibp", r"^https?://(?:www\.)?haveibeenpwned\.com/account/[^/]+", 50),
    ("otx", r"^https?://otx\.alienvault\.com/indicator/[^/]+/[^/]+", 50),
    ("shodan", r"^https?://(?:www\.)?shodan\.io/(?:host/|search\?query=)", 50),
    ("virustotal", r"^https?://(?:www\.)?virustotal\.com/gui/", 50),
    ("vulncheck", r"^https?://(?:www\.)?vulncheck\.com/(?:advisories|cve)/[^/]+", 50),
    ("shopify", r"^https?://[^/]+/(?:blogs/[^/]+/|products/|collections/|pages/)", 40),
)
MAX_ROWS = 20
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
SHA256 = r"\b[a-fA-F0-9]{64}\b"
CVE = r"\bCVE-[0-9]{4}-[0-9]{4,7}\b"


def adapter_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join("('{}', '{}', {})".format(n, p.replace("\\", "\\\\"), w) for n, p, w in ADAPTERS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(adapter, pattern, priority)")


def dispatched(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with adapter: the one of highest priority whose pattern matches; null if none does.

    The fixed list becomes one CASE in order of priority: no join, no shuffle.
    """
    out = F.when(F.lit(False), "")
    for name, pattern, _ in sorted(ADAPTERS, key=lambda a: -a[2]):
        out = out.when(F.col(url_col).rlike(pattern), name)
    return pages.withColumn("adapter", out)


def matching(url: Column) -> Column:
    """Names of all adapters whose pattern matches, best first."""
    return F.array_compact(F.array(*[F.when(url.rlike(pattern), F.lit(name)) for name, pattern, _ in sorted(ADAPTERS, key=lambda a: -a[2])]))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def cve_records(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Scores, weaknesses and references of NVD records: v3.1 before v3.0; exploited if a reference is tagged so."""
    v = F.try_parse_json(json_col)
    three = F.coalesce(_get(v, "$.metrics.cvssMetricV31[0]", "variant"), _get(v, "$.metrics.cvssMetricV30[0]", "variant"))
    four = _get(v, "$.metrics.cvssMetricV40[0]", "variant")
    texts = F.coalesce(_get(v, "$.descriptions", "array<struct<lang:string,value:string>>"), F.array().cast("array<struct<lang:string,value:string>>"))
    english = F.get(F.filter(texts, lambda d: d["lang"] == "en"), 0)["value"]
    weak = F.flatten(F.transform(_get(v, "$.weaknesses", "array<struct<description:array<struct<value:string>>>>"), lambda w: F.transform(w["description"], lambda d: d["value"])))
    refs = _get(v, "$.references", "array<struct<url:string,tags:array<string>>>")
    none = F.array().cast("array<string>")
    return raw.select(
        _get(v, "$.id").alias("cve"), F.coalesce(english, F.get(texts, 0)["value"]).alias("description"), _get(three, "$.cvssData.baseScore", "double").alias("cvss_v3"), _get(three, "$.cvssData.baseSeverity").alias("severity"), _get(three, "$.cvssData.vectorString").alias("vector_v3"),
        _get(three, "$.exploitabilityScore", "double").alias("exploitability_v3"), _get(four, "$.cvssData.baseScore", "double").alias("cvss_v4"), _get(four, "$.cvssData.vectorString").alias("vector_v4"), F.filter(F.coalesce(weak, none), lambda x: x.startswith("CWE-")).alias("cwes"),
        F.coalesce(F.exists(refs, lambda r: F.array_contains(F.coalesce(r["tags"], none), "Exploit")), F.lit(False)).alias("exploited"), F.slice(F.transform(F.coalesce(refs, F.array().cast("array<struct<url:string,tags:array<string>>>")), lambda r: r["url"]), 1, MAX_ROWS).alias("urls"),
    )


def cpe_matches(raw: DataFrame, json_col: str = "raw", depth: int = 4) -> DataFrame:
    """(cve, criteria, vulnerable, versions): products named anywhere in the configuration tree, once each, ``depth`` levels deep."""
    v = F.try_parse_json(json_col)
    nodes = raw.select(_get(v, "$.id").alias("cve"), F.explode(_get(v, "$.configurations", "array<variant>")).alias("node"))
    shape = "array<struct<criteria:string,vulnerable:boolean,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>"
    found = None
    for level in range(depth):
        here = nodes.select("cve", F.lit(level).alias("level"), F.posexplode(_get(F.col("node"), "$.cpeMatch", shape)).alias("pos", "m"))
        found = here if found is None else found.unionByName(here)
        below = nodes.select("cve", F.explode(_get(F.col("node"), "$.nodes", "array<variant>")).alias("node"))
        nodes = nodes.select("cve", F.explode(_get(F.col("node"), "$.children", "array<variant>")).alias("node")).unionByName(below)
    start = F.coalesce("m.versionStartIncluding", F.concat(F.lit(">"), "m.versionStartExcluding"))
    end = F.coalesce("m.versionEndIncluding", F.concat(F.lit("<"), "m.versionEndExcluding"))
    versions = F.when(start.isNotNull() & end.isNotNull(), F.concat(start, F.lit(" - "), end)).otherwise(F.coalesce(start, end, F.lit("any")))
    rows = found.select("cve", "level", "pos", "m.criteria", F.coalesce("m.vulnerable", F.lit(True)).alias("vulnerable"), versions.alias("versions"))
    return rows.groupBy("cve", "criteria").agg(F.min_by(F.struct("vulnerable", "versions"), F.struct("level", "pos")).alias("x")).select("cve", "criteria", "x.*")


def cve_affected(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """(cve, vendor, product, version, status) of CVE list records."""
    v = F.try_parse_json(json_col)
    items = _get(v, "$.containers.cna.affected", "array<struct<vendor:string,product:string,versions:array<struct<version:string,status:string,lessThan:string>>>>")
    rows = raw.select(_get(v, "$.cveMetadata.cveId").alias("cve"), F.explode(items).alias("a"))
    rows = rows.select("cve", "a.vendor", "a.product", F.explode_outer("a.versions").alias("v"))
    version = F.when(F.col("v.lessThan").isNotNull(), F.concat("v.version", F.lit(" < "), "v.lessThan")).otherwise(F.col("v.version"))
    return rows.select("cve", "vendor", "product", version.alias("version"), F.col("v.status").alias("status"))


def faceted_text(text: Column, facets: Column) -> Column:
    """Rich text in Markdown; facets are (start, end, kind, target) in UTF-8 bytes.

    Bytes are cut natively; facets are taken in order, overlapping ones are skipped.
    """
    raw = F.encode(text, "UTF-8")
    part = lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "UTF-8")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, f):
        own = part(f["start"], f["end"])
        shown = F.when(f["kind"] == "link", F.concat(F.lit("["), own, F.lit("]("), f["target"], F.lit(")"))).when(f["kind"] == "mention", F.concat(F.lit("["), own, F.lit("](at://"), f["target"], F.lit(")"))).when(f["kind"] == "tag", F.concat(F.lit("#"), f["target"])).otherwise(own)
        taken = F.struct(F.concat(acc["out"], part(acc["at"], f["start"]), shown).alias("out"), f["end"].cast("long").alias("at"))
        return F.when(f["start"] >= acc["at"], taken).otherwise(acc)

    size = F.octet_length(text)
    return F.aggregate(F.array_sort(facets), zero, step, lambda acc: F.concat(acc["out"], part(acc["at"], size)))


def replies(posts: DataFrame, max_depth: int = 6) -> DataFrame:
    """Threads by level, (root, id, depth), from a table (id, parent): one join a level."""
    level = posts.where("parent is null").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    out = level
    for d in range(1, max_depth + 1):
        level = level.select("root", F.col("id").alias("parent")).join(posts.select("id", "parent"), "parent").select("root", "id", F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out


def book_text(text: Column) -> Column:
    """A public-domain book without the library's header and footer."""
    body = F.regexp_replace(text, r"(?is)^.*?\*\*\* ?START OF (?:THE|THIS) PROJECT [^*]*\*\*\*", "")
    return F.regexp_replace(F.regexp_replace(body, r"(?is)\*\*\* ?END OF (?:THE|THIS) PROJECT .*$", ""), r"^\s+|\s+$", "")


def chapters(books: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chapter, title, content): chapters by their headings; a book without any is one chapter."""
    heading = r"(?im)^[ \t]*(?:chapter|part|book)[ \t]+(?:[0-9]+|[ivxlc]+)\b[^\n]*$"
    marked = F.regexp_replace(text_col, heading, "\u0001$0\u0002")
    parts = books.select(id_col, F.posexplode(F.split(marked, "\u0001")).alias("n", "part"), F.col(text_col).rlike(heading).alias("has"))
    parts = parts.where("n > 0 or not has")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    title = F.when(F.col("has"), trimmed(F.substring_index("part", "\u0002", 1))).otherwise("")
    content = F.when(F.col("has"), trimmed(F.regexp_replace("part", "(?s)^.*?\u0002", ""))).otherwise(trimmed(F.col("part")))
    return parts.select(id_col, F.when(F.col("has"), F.col("n")).otherwise(1).alias("chapter"), title.alias("title"), content.alias("content"))


def repository_parts(url: Column) -> Column:
    """Struct of kind (repo, tree, blob, raw, issue, pull, discussion, release, commit), owner, repo and rest."""
    path = U.path(url)
    part = lambda n: F.regexp_extract(path, r"^/([^/]+)/([^/]+)(?:/([^/]+))?(?:/(.*))?$", n)
    names = {"tree": "tree", "blob": "blob", "issues": "issue", "pull": "pull", "discussions": "discussion", "releases": "release", "commit": "commit"}
    kind = F.when(U.hostname(url) == "raw.githubusercontent.com", "raw")
    for word, name in names.items():
        kind = kind.when(part(3) == word, name)
    return F.struct(kind.when(part(2) != "", "repo").alias("kind"), part(1).alias("owner"), part(2).alias("repo"), part(4).alias("rest"))


def video_id(url: Column) -> Column:
    short = F.regexp_extract(url, r"(?:youtu\.be/|/(?:shorts|embed|live)/)([A-Za-z0-9_-]{11})", 1)
    return F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]v=([A-Za-z0-9_-]{11})", 1), F.lit("")), F.nullif(short, F.lit("")))


def indicators(text: Column) -> Column:
    """Struct of the IPv4 addresses, SHA-256 sums and CVE ids in a text, once each."""
    all_of = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.struct(all_of(IPV4).alias("ipv4"), all_of(SHA256).alias("sha256"), all_of(CVE).alias("cve"))


def certificates(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """(count, names) of a certificate search: how many, and the first 20 common names."""
    items = F.from_json(json_col, "array<struct<id:bigint,common_name:string,not_after:string>>")
    return raw.select(F.size(items).alias("count"), F.transform(F.slice(items, 1, MAX_ROWS), lambda c: c["common_name"]).alias("names"))


def job_postings(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Title, company, location, date and text of JSON-LD or board postings."""
    v = F.try_parse_json(json_col)
    first = lambda *paths: F.coalesce(*[_get(v, p) for p in paths])
    return raw.select(
        first("$.title", "$.name").alias("title"), first("$.hiringOrganization.name", "$.company.name", "$.company_name").alias("company"), first("$.jobLocation.address.addressLocality", "$.location.name", "$.location").alias("location"), first("$.datePosted", "$.updated_at").alias("posted"), first("$.description", "$.content").alias("text")
    )


def feed_items(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(title, link, published, content) of RSS items; malformed feeds give none."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("title", "link", "published", "content")]))

    def items(text: str | None) -> list[dict]:
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            return []
        local = lambda e: e.tag.rpartition("}")[2]
        out = []
        for item in (e for e in root.iter() if local(e) == "item"):
            fields = {local(c): (c.text or "").strip() for c in item}
            out.append({"title": fields.get("title", ""), "link": fields.get("link", ""), "published": fields.get("pubDate", ""), "content": fields.get("encoded") or fields.get("description", "")})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([items(x) for x in batch.column("xml").to_pylist()], kind)], ["items"])

    rows = feeds.select(F.col(xml_col).alias("xml")).mapInArrow(run, "items array<struct<title:string,link:string,published:string,content:string>>")
    return rows.select(F.explode("items").alias("i")).select("i.*")


def with_front_matter(markdown: Column, metadata: Column) -> Column:
    """Markdown after a block of name: value lines, if there is any metadata (a map of texts)."""
    lines = F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    head = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"))
    return F.when(F.coalesce(F.size(metadata), F.lit(0)) > 0, F.concat(head, markdown)).otherwise(markdown)
