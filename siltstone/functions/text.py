"""Text quality, barrier and clean-up rules as column expressions (no Python at run time)."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# Thresholds, weights, patterns and lists that the results must equal.
MIN_CONTENT, MIN_TITLE, MAX_LINK_RATIO, MIN_QUALITY = 200, 10, 0.7, 0.3
BLOCK_PATTERNS = (
    "please enable javascript", "enable javascript to continue", "javascript is required", "please turn javascript on", "please verify you are (?:a )?human", "we need to make sure you(?:'re| are) not a robot", "checking your browser", "we are checking your browser",
    "access denied", "you have been blocked", "your (?:IP|access) has been blocked", "too many requests", "rate limit", "your session has expired", "session timed? ?out", "cloudflare", "attention required", "just a moment", "cookies are required",
    "please accept cookies", "cookie consent", "this site uses cookies", "not available in your country", "not available in your region", "geo.?restriction", "content (?:is )?not available", "subscribe to continue", "sign up to read more", "members.?only",
    "this content is for (?:members|subscribers)", "404 not found", "403 forbidden", "500 error", "internal server error", "page not found", "something went wrong", "hcaptcha", "recaptcha", "captcha", "under maintenance", "temporarily unavailable",
)
ERROR_WORDS = ("error", "not found", "forbidden", "unauthorized", "timeout", "failed", "unavailable", "exception")
CLOUDFLARE = ("Just a moment", "Checking your browser", "DDoS protection by", "cf-browser-verification", "challenge-platform", "Verification successful", "Enable JavaScript and cookies to continue", "security verification")
DDOS_GUARD = ("DDoS-Guard", "DDOS-GUARD", "ddos-guard", "Checking your browser before accessing", ".well-known/ddos-guard")
FRAME_REDIRECTS = ("substack.com/session-attribution-frame", "substack.com/channel-frame", "substack.com/iframe", "googletagmanager.com/ns.html")
CAPTCHAS = (
    ("turnstile", ("challenges.cloudflare.com/turnstile", "cf-turnstile", "cf-turnstile-response")),
    ("recaptcha", ("google.com/recaptcha", "g-recaptcha", "g-recaptcha-response")),
    ("hcaptcha", ("hcaptcha.com", "h-captcha", "h-captcha-response")),
)
EMBED_ENDINGS = (".pdf", ".epub", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz")
EMBED_HOSTS = ("sci-hub", "sci.bban", "docdrop", "academia", "researchgate", "arxiv.org", "cdn.")
BOILERPLATE = (
    "cookie", "cookies", "accept all", "accept cookies", "skip to", "skip navigation", "skip nav", "navigation", "nav bar", "main navigation", "footer", "copyright", "all rights reserved", "privacy policy", "terms of service", "terms and conditions",
    "this website uses", "we use cookies", "sign in", "sign up", "log in", "subscribe", "advertisement", "sponsored",
)
ERROR_CODES = {"TIMEOUT": "timeout", "UPSTREAM_ERROR": "http_error", "INVALID_REQUEST": "scrape_error", "AUTH_ERROR": "http_error", "CAPTCHA_UNRESOLVED": "captcha_unresolved"}
ERROR_KINDS = (
    ("dns_error", ("name resolution", "getaddrinfo", "dns", "no address found", "nodename nor servname provided", "temporary name error", "name or service not known")),
    ("connection_error", ("connection refused", "connection reset", "connection closed", "connection aborted", "connect call failed", "no route to host", "network is unreachable", "connection timed out")),
    ("http_error", ("http 4", "http 5", "status code 4", "status code 5", "400 bad request", "401 unauthorized", "403 forbidden", "404 not found", "500 internal", "502 bad gateway", "503 service unavailable")),
    ("timeout", ("timed out", "timeout")),
)
REDACTIONS = (
    (r"(?i)\b(api[_-]key\s*=\s*)\S+", "$1[REDACTED]"),
    (r"(?i)\b(password\s*[=:]\s*)\S+", "$1[REDACTED]"),
    (r"(?i)([?&](?:password|token|api[_-]key|secret)=)[^&\s]+", "$1[REDACTED]"),
    (r"(?i)\b(X-API-Key:\s*)\S+", "$1[REDACTED]"),
    (r"(?i)\b(Bearer\s+)[A-Za-z0-9._-]{6,}\b", "$1[REDACTED]"),
    (r"(?i)\b(sk-[A-Za-z0-9_-]{6,})\b", "sk-[REDACTED]"),
    (r"(?i)\b(pk-[A-Za-z0-9_-]{6,})\b", "pk-[REDACTED]"),
)
#: For each of REDACTIONS, parts of which every match has one.
_REDACTION_SIGNS = (("api",), ("password",), ("password", "token", "api", "secret"), ("api",), ("bearer",), ("sk-",), ("pk-",))
_LINK = r"\[.*?\]\(.*?\)"
_BLANK = " \t\n\x0b\f\r"
#: Characters of a text whose lines are held at once.
BLOCK = 1 << 20


def literal(text: str) -> str:
    """A pattern that matches text itself."""
    return re.sub(r"[.^$*+?{}\[\]\\|()-]", r"\\\g<0>", text)


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether text holds one of several parts; plain searches are much faster than one pattern of all."""
    return let(text, lambda t: reduce(or_, (t.contains(p) for p in parts)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def _sure_part(pattern: str) -> str:
    """The longest plain run that every match of a simple pattern holds."""
    return max(re.split(r"\(\?:.*?\)\??|.\?|\.", pattern), key=len)


def _matches(text: Column, pattern: str) -> Column:
    """text.rlike(pattern), tried only where a plain part of the pattern is found."""
    part = _sure_part(pattern)
    return text.contains(part) if part == pattern else text.contains(part) & text.rlike(pattern)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda x: x != "")


def _line_counts(text: Column) -> Column:
    """Struct of a text's lines (n), those with links and the solid ones.

    Summed over blocks of BLOCK characters, each up to the end of its last line, as lines of a very long text take many times its memory.
    """

    def counted(lines: Column) -> Column:
        solid = lambda x: (F.length(x) > 60) & ~x.rlike(_LINK)
        return F.struct(F.size(lines).alias("n"), F.size(F.filter(lines, lambda x: x.rlike(_LINK))).alias("links"), F.size(F.filter(lines, solid)).alias("solid"))

    def added(md: Column, acc: Column, i: Column) -> Column:
        end = F.call_function("locate", F.lit("\n"), md, (i + 1) * BLOCK)
        step = lambda end: let(counted(_lines(F.substr(md, acc["at"], end - acc["at"]))), lambda v: F.struct(end.alias("at"), *[(acc[c] + v[c]).alias(c) for c in ("n", "links", "solid")]))
        return let(F.when(end > 0, end).otherwise(F.length(md)) + 1, step)

    start = F.struct(F.lit(1).alias("at"), *[F.lit(0).alias(c) for c in ("n", "links", "solid")])
    return let(text, lambda md: F.aggregate(F.sequence(F.lit(0), F.floor(F.length(md) / BLOCK).cast("int")), start, lambda acc, i: added(md, acc, i)))


def boilerplate(md: Column) -> Column:
    """Struct of hundredths and status: how much of a text is links rather than paragraphs."""
    return let(_line_counts(md), lambda v: _boilerplate_verdict(md, v["links"] / F.greatest(v["n"], F.lit(1)), v["solid"]))


def _boilerplate_verdict(md: Column, ratio: Column, solid: Column) -> Column:
    return (
        F.when(F.coalesce(strip(md), F.lit("")) == "", _verdict(0, "fail")).when((ratio > MAX_LINK_RATIO) & (solid < 2), _verdict(20, "fail")).when((ratio > 0.5) & (solid < 2), _verdict(40, "warn")).when(solid >= 5, _verdict(100, "pass"))
        .when(solid >= 3, _verdict(85, "pass")).when(solid >= 1, _verdict(60, "warn")).otherwise(_verdict(30, "fail"))
    )


def _verdict(hundredths: int, status: str) -> Column:
    return F.struct(F.lit(hundredths).alias("hundredths"), F.lit(status).alias("status"))


def completeness(md: Column, title: Column | None = None) -> Column:
    """Struct of hundredths and status: length, paragraphs and title."""
    return let(strip(md), lambda whole: _completeness(whole, title))


def _completeness(whole: Column, title: Column | None) -> Column:
    n = F.length(whole)
    paragraphs = whole.contains("\n\n")  # a stripped text begins and ends with paragraphs that aren't blank
    titled = n >= MIN_CONTENT
    if title is not None:
        titled = F.when(F.coalesce(title, F.lit("")) != "", F.length(strip(title)) >= MIN_TITLE).otherwise(titled)
    return (
        F.when(F.coalesce(whole, F.lit("")) == "", _verdict(0, "fail")).when((n < MIN_CONTENT) & ~paragraphs, _verdict(10, "fail")).when(n < MIN_CONTENT, _verdict(30, "warn")).when(~paragraphs, _verdict(40, "warn"))
        .when((n >= 1000) & titled, _verdict(100, "pass")).when(n >= 500, _verdict(85, "pass")).otherwise(_verdict(60, "warn"))
    )


def _block_hits(low: Column) -> Column:
    return reduce(lambda n, p: n + _matches(low, p).cast("int"), BLOCK_PATTERNS, F.lit(0))


def block_matches(md: Column) -> Column:
    return let(F.lower(md), _block_hits)


def block_page(md: Column) -> Column:
    """Struct of hundredths and status: signs of a block or error page."""
    errors = lambda low: reduce(lambda n, w: n + low.contains(w).cast("int"), ERROR_WORDS, F.lit(0))
    # lower case is taken once, and the errors are counted only for short pages
    return let(F.lower(md), lambda low: let(_block_hits(low), lambda n: _block_verdict(md, n, errors(low))))


def _block_verdict(md: Column, n: Column, errors: Column) -> Column:
    return (
        F.when(F.coalesce(strip(md), F.lit("")) == "", _verdict(0, "fail")).when(n >= 3, _verdict(5, "fail")).when(n == 2, _verdict(15, "fail")).when(n == 1, _verdict(30, "warn"))
        .when((F.length(strip(md)) < MIN_CONTENT) & (errors >= 2), _verdict(20, "fail")).otherwise(_verdict(100, "pass"))
    )


def quality(md: Column, title: Column | None = None) -> Column:
    """Struct of score (0.3, 0.3 and 0.4 of the three checks, in whole hundredths, halves up), checks and detail."""
    return let(F.struct(boilerplate(md).alias("b"), completeness(md, title).alias("c"), block_page(md).alias("k")), lambda v: _composite(v["b"], v["c"], v["k"]))


def _composite(b: Column, c: Column, k: Column) -> Column:
    score = F.floor((b["hundredths"] * 30 + c["hundredths"] * 30 + k["hundredths"] * 40 + 50) / 100) / 100
    said = [F.when(x["status"] != "pass", F.concat(F.lit(f"{name}:"), x["status"])) for name, x in (("boilerplate", b), ("completeness", c), ("block", k))]
    joined = F.concat_ws(", ", *said)
    checks = F.struct(b["status"].alias("boilerplate"), c["status"].alias("completeness"), k["status"].alias("block_detected"))
    return F.struct(score.alias("score"), checks.alias("checks"), F.when(joined == "", "all checks passed").otherwise(joined).alias("detail"))


def barrier(title: Column, url: Column, content: Column, html: Column) -> Column:
    """Struct of detected, barrier_type, confidence, detail and provider: whether a fetched page is a challenge or empty page."""
    low_html, low = F.lower(F.coalesce(html, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    low_title, low_url = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    lower = lambda xs: tuple(x.lower() for x in xs)
    sign = lambda test, name: F.when(test, F.lit(name))
    signals = F.array_compact(
        F.array(
            sign(F.length(F.coalesce(content, F.lit(""))) < 100, "empty"), sign(any_of(low_title, lower(CLOUDFLARE)) | any_of(low_title, ("attention required", "403 forbidden")), "cloudflare-title"), sign(any_of(low_url, ("cf_chl", "challenge-platform")), "cloudflare-url"),
            sign(any_of(low_title, lower(DDOS_GUARD)), "ddos-guard-title"), sign(low_url.contains("ddos-guard"), "ddos-guard-url"), sign(any_of(low, ("rate limit", "too many requests")), "rate-limit"), sign(any_of(low_url, FRAME_REDIRECTS) | any_of(low_html, FRAME_REDIRECTS), "substack-redirect"),
        )
    )
    fallback = F.when((F.size(signals) == 0) & any_of(low, lower(CLOUDFLARE + DDOS_GUARD + FRAME_REDIRECTS)), F.array(F.lit("content-match"))).otherwise(signals)
    n = F.size(fallback)
    has = lambda word: F.exists(fallback, lambda s: s.contains(word))
    kind = F.when(has("cloudflare"), "cloudflare").when(has("ddos-guard"), "ddos-guard").when(has("rate-limit"), "rate-limit").when(has("substack-redirect"), "substack-redirect").when(has("empty"), "empty").when(has("content-match"), "suspicious")

    def out(detected: bool, type_: Column | str | None, confidence: Column | float, detail: Column | str, provider: str | None = None) -> Column:
        c = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
        return F.struct(F.lit(detected).alias("detected"), c(type_, "string").alias("barrier_type"), c(confidence, "double").alias("confidence"), c(detail, "string").alias("detail"), c(provider, "string").alias("provider"))

    verdict = F.when(F.lit(False), out(False, None, 0.0, ""))
    for provider, signs in CAPTCHAS:
        verdict = verdict.when(any_of(low_html, signs), out(True, "captcha", 0.95, f"Definitive {provider} widget", provider))
    widget = low_html.contains("<iframe") & low_html.contains("sitekey") & any_of(low_html, ("captcha", "challenge"))
    verdict = verdict.when(widget, out(True, "captcha", 0.85, "Definitive generic CAPTCHA widget", "generic"))
    nothing = (F.coalesce(content, F.lit("")) == "") & (F.coalesce(html, F.lit("")) == "")
    verdict = verdict.when(nothing, out(True, "empty", 0.95, "No content returned"))
    tenths = F.least(F.lit(50) + n * 20, F.lit(95)) / 100
    found = out(True, kind, tenths, F.concat(F.lit("Matched signals: "), F.array_join(F.array_sort(fallback), ", ")))
    return verdict.when(n == 0, out(False, None, 0.0, "No barrier signals detected")).otherwise(found)


def is_bot_challenge(title: Column, url: Column) -> Column:
    low_title, low_url = F.lower(title), F.lower(url)
    return any_of(low_title, tuple(x.lower() for x in CLOUDFLARE + DDOS_GUARD)) | any_of(low_url, ("cf_chl", "challenge-platform", "ddos-guard"))


def is_frame_redirect(url: Column) -> Column:
    return any_of(F.lower(url), FRAME_REDIRECTS)


def looks_like_markdown(text: Column) -> Column:
    """Three signs or more (headings, lists, fences, links) in the first 2,000 characters."""
    lines = F.transform(F.split(F.substring(strip(text), 1, 2000), "\n"), strip)
    signs = lambda x: F.size(F.filter(lines, lambda line: x(line)))
    n = signs(lambda x: x.rlike("^#{1,3} ")) + signs(lambda x: x.rlike("^[-*] ")) + signs(lambda x: x.startswith("```")) + signs(lambda x: x.rlike(r"^\[.+\]\(.+\)"))
    return F.coalesce(n >= 3, F.lit(False))


def has_embedded_document(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    return any_of(low, ("<iframe", "<embed", "<object")) & any_of(low, EMBED_ENDINGS + EMBED_HOSTS + ("/pdf/", "/download/"))


def is_boilerplate_line(line: Column) -> Column:
    low = strip(F.lower(line))
    return (F.length(low) < 30) | any_of(low, BOILERPLATE)


def error_type(message: Column, code: Column | None = None) -> Column:
    """Class of a fetch error: by its code where that is known, else by the first list with a part of the message."""
    out = F.when(F.lit(False), "")
    if code is not None:
        for name, kind in ERROR_CODES.items():
            out = out.when(code == name, kind)
    low = F.lower(F.coalesce(message, F.lit("")))
    for kind, parts in ERROR_KINDS:
        out = out.when(any_of(low, parts), kind)
    return out.otherwise("scrape_error")


def redact(text: Column) -> Column:
    """Sensitive values replaced, by patterns in a fixed order."""
    low = F.lower(text)
    for (pattern, to), signs in zip(REDACTIONS, _REDACTION_SIGNS, strict=True):
        # tried only where the original holds a part that every match has; marks bring no such part in
        text = F.when(reduce(or_, (low.contains(x) for x in signs)), F.regexp_replace(text, pattern, to)).otherwise(text)
    return text


def slugify(text: Column, max_len: int = 60) -> Column:
    kept = F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9\s-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"[\s-]+", "-"), "^-|-$", "")
    return F.regexp_replace(F.substring(dashed, 1, max_len), "-+$", "")


def description(md: Column, max_chars: int = 300) -> Column:
    """The first real lines of a text, up to the first sentence's end past 100 characters; cut with an ellipsis if there is none."""
    lines = F.filter(F.transform(F.split(md, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^[#!\[>]") & ~is_boilerplate_line(x))
    second = F.filter(F.transform(F.split(md, "\n"), strip), lambda x: (F.length(x) >= 30) & ~x.rlike("^[#!]"))
    chosen = F.when(F.size(lines) > 0, lines).otherwise(F.slice(second, 1, 1))

    def joined(acc, x):
        short = (F.length(acc["text"]) < 100) | (F.length(acc["text"]) == 100) & (acc["n"] == 1)
        text = F.when(acc["n"] == 0, x).when(short, F.concat(acc["text"], F.lit(" "), x)).otherwise(acc["text"])
        return F.struct(text.alias("text"), (acc["n"] + 1).alias("n"))

    grown = F.aggregate(chosen, F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), joined, lambda acc: acc["text"])
    end = F.regexp_extract(F.substring(grown, 101, 1 << 30), r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    cut = F.when(end != "", F.concat(F.substring(grown, 1, 100), end)).when(F.length(grown) > max_chars, F.concat(F.regexp_replace(F.substring(grown, 1, max_chars), r"\s+$", ""), F.lit("..."))).otherwise(grown)
    return F.when(F.coalesce(md, F.lit("")) == "", "").when(grown == "", strip(F.substring(md, 1, max_chars))).otherwise(strip(cut))


def keyword_query(title: Column, md: Column) -> Column:
    """A search query for pages like this one: its title and first paragraph, or 500 characters if it has no paragraphs."""
    first = F.when(md.contains("\n\n"), F.substring_index(md, "\n\n", 1)).otherwise(F.substring(md, 1, 500))
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), first)
