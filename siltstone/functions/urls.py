"""URL algebra as column expressions.

URLs are taken apart by the RFC 3986 (appendix B) pattern rather than by
``parse_url``, which returns null for hosts with underscores and fails on malformed
input.  Two normal forms exist on purpose: one identifies a page in a crawl, the
other is the key of a cache.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RFC3986 = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Lists that the results must equal.
SKIP_PATHS = ("/login", "/signup", "/cart", "/checkout", "/terms", "/privacy", "/tag/")
HIGH_QUALITY = (
    "provenwinners.com", "logees.com", "almanac.com", "nhs.uk", "mayoclinic.org", "webmd.com", "sciencedirect.com", "scholar.google.com", "acm.org", "ieee.org", "arstechnica.com", "reuters.com", "apnews.com", "npr.org",
)
KNOWN_BLOGS = ("medium.com", "dev.to", "smashingmagazine.com")
LOW_QUALITY = ("reddit.com", "pinterest.com", "facebook.com", "twitter.com", "x.com", "linkedin.com", "tumblr.com", "quora.com", "stackexchange.com")
VIDEO_HOSTS = ("youtube.com", "youtu.be", "m.youtube.com", "tiktok.com", "www.tiktok.com", "vm.tiktok.com", "instagram.com", "www.instagram.com")
DOMAIN_CATEGORIES = (
    ("docs", ("readthedocs.io", "readthedocs.org")),
    ("reference", ("wikipedia.org", "stackoverflow.com", "stackexchange.com", "github.com", "gitlab.com")),
    (
        "news",
        (
            "reuters.com", "nytimes.com", "cnn.com", "bbc.com", "bbc.co.uk", "bloomberg.com", "apnews.com", "npr.org", "theguardian.com", "wsj.com", "washingtonpost.com", "economist.com", "cnbc.com", "abcnews.go.com", "cbsnews.com", "nbcnews.com", "usatoday.com",
            "politico.com", "axios.com", "thehill.com",
        ),
    ),
    ("social", ("reddit.com", "twitter.com", "x.com", "youtube.com", "instagram.com", "tiktok.com", "threads.net", "bluesky", "bsky.app")),
    ("blog", ("medium.com", "substack.com", "ghost.io", "wordpress.com", "blogger.com", "blogspot.com")),
)
CATEGORY_PREFIXES = (("docs", ("docs.", "learn.", "help.")), ("api", ("api.", "developer.")), ("blog", ("blog.",)))
LOW_VALUE_PATHS = r"(?i)/tags?/|/categories?/|/authors?/|/page/[0-9]+|/search/?$"
PRIVATE_V4 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "100.64.0.0/10", "198.18.0.0/15", "240.0.0.0/4")
PRIVATE_V6 = ("::1/128", "fc00::/7", "fe80::/10")
METADATA_IPS = ("169.254.169.254", "100.100.100.200", "fd00:ec2::254")
INTERNAL_SUFFIX = ".docker.internal"


def _col(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def _any(text: Column, parts: tuple[str, ...], start: bool = False) -> Column:
    """Whether text holds (or starts with) one of several parts, by one pattern."""
    import re

    return text.rlike(("^" if start else "") + "(?:" + "|".join(re.sub("[.^$]", r"\\\g<0>", p) for p in parts) + ")")


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), RFC3986, 1))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), RFC3986, 2)


def path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), RFC3986, 3)


def query(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), RFC3986, 4)


def fragment(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), RFC3986, 5)


def hostname(url: Column | str) -> Column:
    """Lower-cased host without user info, port and brackets; empty if there is none."""
    at = F.regexp_replace(netloc(url), "^.*@", "")
    return F.lower(F.when(at.startswith("["), F.regexp_extract(at, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(at, ":", 1)))


def port(url: Column | str) -> Column:
    """Port as an integer; null if absent or no number."""
    at = F.regexp_replace(netloc(url), "^.*@", "")
    return F.regexp_extract(at, r"^(?:\[[^\]]*\]|[^:\[]*):([0-9]{1,5})$", 1).try_cast("int")


def _sorted_query(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "&")), "&")


def clean_path(text: Column) -> Column:
    """Dot segments, repeated and trailing slashes removed; '' is '/'; exactly two leading slashes stay, as POSIX has it."""
    rooted = text.startswith("/") | (text == "")
    parts = F.filter(F.split(text, "/"), lambda s: (s != "") & (s != "."))
    none = F.array().cast("array<string>")
    up = lambda acc: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).when(rooted, acc).otherwise(F.concat(acc, F.array(F.lit(".."))))
    kept = F.aggregate(parts, none, lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, up(acc)).when(rooted, acc).otherwise(F.array(F.lit("..")))).otherwise(F.concat(acc, F.array(s))))
    lead = F.when(text.startswith("//") & ~text.startswith("///"), "//").when(rooted, "/").otherwise("")
    joined = F.concat(lead, F.array_join(kept, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def normalize_crawl(url: Column | str, ignore_query: bool = False) -> Column:
    """A page's identity in a crawl: no fragment, user info or default port; host lower case, path case kept; clean path; sorted query."""
    s, host, p = scheme(url), hostname(url), port(url)
    default = ((s == "http") & (p == 80)) | ((s == "https") & (p == 443))
    at = F.when(p.isNull() | default, host).otherwise(F.concat(host, F.lit(":"), p.cast("string")))
    whole = path(url)
    params = F.regexp_extract(whole, r";([^/]*)$", 1)
    cleaned = clean_path(F.regexp_replace(whole, r";[^/]*$", ""))
    q = F.lit("") if ignore_query else query(url)
    return F.concat(
        F.when(s != "", F.concat(s, F.lit(":"))).otherwise(F.lit("")), F.when(at != "", F.concat(F.lit("//"), at)).otherwise(F.lit("")), F.when((at != "") & ~cleaned.startswith("/"), F.concat(F.lit("/"), cleaned)).otherwise(cleaned),
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(F.lit("")), F.when(q != "", F.concat(F.lit("?"), _sorted_query(q))).otherwise(F.lit("")),
    )


def normalize_cache(url: Column | str) -> Column:
    """A cache's key: scheme, host, path and query lower case; trailing slashes dropped (a root stays); sorted query; fragment kept as it is."""
    p, q, f = F.lower(path(url)), F.lower(query(url)), fragment(url)
    cut = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    return F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), cut, F.when(q != "", F.concat(F.lit("?"), _sorted_query(q))).otherwise(F.lit("")), F.when(f != "", F.concat(F.lit("#"), f)).otherwise(F.lit("")))


def domain(url: Column | str, include_scheme: bool = False) -> Column:
    """Host name; with include_scheme scheme://host[:port], a v6 literal in brackets; empty if there is no host."""
    host, p = hostname(url), port(url)
    if not include_scheme:
        return host
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.when(host == "", "").otherwise(F.concat(scheme(url), F.lit("://"), shown, F.when(p.isNotNull(), F.concat(F.lit(":"), p.cast("string"))).otherwise(F.lit(""))))


def same_origin(a: Column | str, b: Column | str) -> Column:
    return (scheme(a) == scheme(b)) & (F.lower(netloc(a)) == F.lower(netloc(b)))


def strip_fragment(url: Column | str) -> Column:
    return F.substring_index(_col(url), "#", 1)


def ipv4_number(host: Column) -> Column:
    """The address of a dotted-quad host as a number; null for any other host."""
    parts = F.split(host, r"\.")
    whole = host.rlike(r"^(?:(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + F.coalesce(x.try_cast("long"), F.lit(0)))
    return F.when(whole, number)


def v4_ranges() -> list[tuple[int, int]]:
    from ipaddress import ip_network

    return [(int(n.network_address), int(n.broadcast_address)) for n in map(ip_network, PRIVATE_V4)]


def is_private(url: Column | str) -> Column:
    """Whether a URL must not be fetched: no host, an internal suffix, or an address in a private or metadata range.

    Null for other host names, as names aren't resolved here.
    """
    from ipaddress import ip_address

    host = hostname(url)
    number = ipv4_number(host)
    inside = F.lit(False)
    for low, high in v4_ranges():
        inside = inside | number.between(low, high)
    for ip in METADATA_IPS[:2]:
        inside = inside | (number == int(ip_address(ip)))
    six = host.contains(":")
    own = host.rlike("^(0*:)*:?0*1$") | host.rlike("^f[cd][0-9a-f]{2}:") | host.rlike("^fe[89ab][0-9a-f]:")
    return F.when(host == "", True).when(host.endswith(INTERNAL_SUFFIX), True).when(number.isNotNull(), inside).when(six, own)


def glob_to_regex(pattern: str) -> str:
    """An anchored pattern for a glob in which * stays within a path segment, ** does not and ? is one character."""
    import re

    names = {"**": ".*", "*": "[^/]*", "?": "."}
    return "^" + "".join(names.get(part) or re.sub(r"[.^$+{}\[\]\\|()]", r"\\\g<0>", part) for part in re.split(r"(\*\*|\*|\?)", pattern)) + "$"


def _valid(patterns: list[str] | None, full: bool) -> list[str]:
    import re

    out = []
    for p in patterns or []:
        try:
            re.compile(p if full else glob_to_regex(p))
        except re.error:
            continue  # a pattern that is no pattern matches nothing
        out.append(p if full else glob_to_regex(p))
    return out


def path_allowed(url: Column | str, include: list[str] | None = None, exclude: list[str] | None = None, regex_on_full_url: bool = False) -> Column:
    """Include and exclude filters on the path (globs) or on the whole URL (patterns); exclusion wins."""
    target = _col(url) if regex_on_full_url else path(url)
    hit = lambda ps: target.rlike("|".join(f"(?:{p})" for p in ps)) if ps else F.lit(False)
    wanted = hit(_valid(include, regex_on_full_url)) if include else F.lit(True)
    return ~hit(_valid(exclude, regex_on_full_url)) & wanted


def filter_reason(url: Column | str, include: list[str] | None = None, exclude: list[str] | None = None, regex_on_full_url: bool = False) -> Column:
    """Struct of reason and pattern for a URL that is filtered out; null for others."""
    target = _col(url) if regex_on_full_url else path(url)
    shape = "struct<reason:string,pattern:string>"
    out = F.lit(None).cast(shape)
    if include:
        out = F.when(~path_allowed(url, include, None, regex_on_full_url), F.struct(F.lit("include_paths").alias("reason"), F.lit(None).cast("string").alias("pattern")).cast(shape))
    for p in reversed(exclude or []):
        for compiled in _valid([p], regex_on_full_url):
            out = F.when(target.rlike(compiled), F.struct(F.lit("exclude_paths").alias("reason"), F.lit(p).alias("pattern")).cast(shape)).otherwise(out)
    return out


def is_low_value(url: Column | str) -> Column:
    """Index pages of a sitemap: tags, categories, authors, numbered pages, search."""
    return path(url).rlike(LOW_VALUE_PATHS)


def extractability(url: Column | str) -> Column:
    """How likely a URL is to yield text; -9999 and -5000 rule it out.  Lists match parts of host names."""
    host, p = hostname(url), F.lower(path(url))
    one = lambda test, n: F.when(test, n).otherwise(0)
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    score = (
        one(host.endswith(".edu"), 2) + one(host.contains("wikipedia.org"), 2) + one(host.contains("github.com"), 2) + one(host.contains("youtube.com") | host.contains("youtu.be"), 2) + one(_any(host, HIGH_QUALITY), 2)
        + one(host.endswith(".gov") | host.endswith(".org"), 1) + one(_any(host, KNOWN_BLOGS), 1) + one(_any(host, LOW_QUALITY), -1) + F.when(slashes >= 2, 1).when(p.isin("", "/"), -1).otherwise(0)
    )
    return F.when(_any(p, SKIP_PATHS), -9999).when(query(url).contains("utm_"), -5000).otherwise(score)


def is_video(url: Column | str) -> Column:
    host = hostname(url)
    return host.isin(*VIDEO_HOSTS) | F.regexp_replace(host, r"^www\.", "").isin(*VIDEO_HOSTS)


def category(url: Column | str) -> Column:
    """Retention category of a URL's host: by prefix, else by the first list with a part of it, else unknown."""
    host = F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")
    out = F.when(host == "", "unknown")
    for name, starts in CATEGORY_PREFIXES:
        out = out.when(_any(host, starts, start=True), name)
    for name, parts in DOMAIN_CATEGORIES:
        out = out.when(_any(host, parts), name)
    return out.otherwise("unknown")


def link_class(link: Column | str, base_domain: Column) -> Column:
    """internal, subdomain or external, of the host of a base."""
    host, base = hostname(link), F.lower(base_domain)
    return F.when(host == base, "internal").when(host.endswith(F.concat(F.lit("."), base)), "subdomain").otherwise("external")


def in_scope(link: Column | str, base_domain: Column, allow_subdomains: bool = False, allow_external: bool = False) -> Column:
    kind = link_class(link, base_domain)
    return (kind == "internal") | (F.lit(allow_subdomains) & (kind == "subdomain")) | (F.lit(allow_external) & (kind == "external"))


def below(link: Column | str, page: Column | str) -> Column:
    """Links of the page's own host must lie strictly below its path; other hosts pass."""
    own = F.regexp_replace(path(page), "/+$", "")
    return (hostname(link) != hostname(page)) | path(link).startswith(F.concat(own, F.lit("/"))) & (F.regexp_replace(path(link), "/+$", "") != own)
