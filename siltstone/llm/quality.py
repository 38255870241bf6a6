"""Quality rules: robust multivariate outliers of text statistics, in DataFrame functions only.

Counts of each whole text are taken inside its row.  Four averages that vary among ordinary
texts make its vector: the log of the mean word length, square roots of the shares of punctuation and of
capitals (which evens out the noise of counts), and the share of distinct words in runs of ``RUN`` words.  Each
is taken as the distance from its group's median, times sqrt(n / (n + ``DAMP``)) for n words, as averages over
few words scatter more; then rounded to 1/``UNIT`` and kept within +-``LIMIT``.

For each (language, source) a minimum-covariance-determinant estimate is found.
Three deterministic starts (medians with quartile ranges and no correlation, with that of tanh scores, with that of
spatial signs) are each improved by concentration steps: the ``SHARE`` of observations with the least Mahalanobis distance
gives the next mean and covariance.  After ``FIRST`` steps the start with the least determinant goes on until the determinant
stops falling.  A row is rejected when its squared distance is above ``CUTOFF``.

Small groups: mean and covariance are mixed with a target, the robust start of the language (which is mixed with that of all
rows in the same way), as if it were ``PRIOR`` more observations.  So a group of any size, one row included, is judged, and
a large one by its own rows.  Equal vectors of a group count once in estimates: copies of a text, however
many, are one observation.  A ridge of ``RIDGE`` (about a tenth of an ordinary deviation) keeps covariances regular.

A step is one aggregation: integer moments in cells of (group, start, distance bin), which are then cumulated by bin up to the
share.  Cells are pre-aggregated in the reading tasks, so a group with a third of all
rows costs no more than others, and integer sums make the result the same for any partitioning.  Observations of one bin
(1/64 of a natural log of 1 + distance) are kept or left together.

Defined results: null text has no words and fails the base rule; a null
language or source counts as the empty string; rows that fail the base rule have no distance and enter no estimate; every other row has one;
ties share a bin; repeated rows are judged alike; null ids pass through; an empty table gives no rows;
``judge`` doesn't read extra columns, ``keep_good`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.shared import counted_small, saved, unestimated

UNIT, LIMIT = 4096, 8191
RUN, DAMP = 50, 1000
SHARE = 0.75
PRIOR = 50
FIRST, MOST_STEPS, FALL = 2, 20, 0.005
#: Chi-squared quantile at 0.9999 for four statistics, and the factor that makes the
#: covariance of the central 75 % consistent at the normal distribution.
CUTOFF, CONSISTENT = 23.51, 1.486
STATS = ("word_length", "punctuation", "capitals", "variety")
RIDGE = 0.0007 * UNIT
_RAW = tuple(f"raw_{s}" for s in STATS)
_SCORE = 1024  # tanh scores and signs are rounded to 1/_SCORE
_BINS = 64
_WORD = r"[^\x20\x09-\x0D]+"
_N = len(STATS)
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]
_AT = {p: k for k, p in enumerate(_PAIRS)}
_GROUP = ["g_lang", "g_source"]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(hashes: Column, width: int) -> Column:
    """Words covered by windows whose hash is not the only one of its kind; hashes are in order of place."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        before = lambda j: (j > 0) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"])
        return F.filter(s, lambda _, j: F.coalesce(before(j) | before(j + 1), F.lit(False)))

    starts = F.sort_array(F.transform(_let(placed, twice), lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i + width - a["end"])).alias("n"), (i + width).alias("end"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def text_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source"), window: int = 8) -> DataFrame:
    """keep, the counts of whole texts, and base_failed."""
    text = F.coalesce(docs[text_col], F.lit(""))
    out = docs.select(*[docs[c] for c in keep], text.alias("_t"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD)).alias("_l"))
    hashes = F.when(F.size("_w") >= window, F.transform(F.sequence(F.lit(1), F.size("_w") - (window - 1)), lambda i: F.xxhash64(F.slice("_w", i, window))))
    left = lambda kept: F.length(F.regexp_replace("_t", kept, "")).cast("long")  # noqa: E731  characters that a pattern doesn't take
    # whole runs only, or the one run that there is
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - (RUN - 1), F.lit(1)), F.lit(RUN)), lambda i: F.size(F.array_distinct(F.slice("_w", i, RUN))))
    out = out.select(
        *keep, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), left(r"[^#*$%&|<>]+").alias("n_symbols"), left(r"[\p{L}\p{M}\p{N}\s]+").alias("n_punctuation"), left(r"\P{Lu}+").alias("n_capitals"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.aggregate(runs, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_varied"), F.coalesce(hashes, F.array().cast("array<bigint>")).alias("_h"),
    )
    # most texts repeat nothing, and for them the sort is skipped
    repeats = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(_repeated_words(F.col("_h"), window))
    out = out.withColumn("n_repeat_words", repeats.cast("long")).drop("_h")
    return out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def _raw() -> list[Column]:
    c = F.col
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    in_runs = F.when(n < RUN, n).otherwise(F.floor(n / RUN) * RUN)
    share = lambda k: F.sqrt((c(k) + 0.375) / (chars + 0.75))
    return [F.round(r * UNIT).cast("long").alias(x) for r, x in zip((F.log(chars / n), share("n_punctuation"), share("n_capitals"), c("n_varied") / in_runs), _RAW, strict=True)]


def _mixed(own: Column, target: Column, n: Column) -> Column:
    """Arrays of an estimate from n observations and of its target, which counts as PRIOR more."""
    share = n / (n + float(PRIOR)) if PRIOR else F.lit(1.0)
    return F.zip_with(own, target, lambda x, y: share * x + (1 - share) * y)


def _constant(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _by_level(cells: DataFrame, summary: Callable[[DataFrame, list[str]], DataFrame], mixed: list[str], cast: Callable) -> DataFrame:
    """A summary of cells for each group (n and arrays), with those of its language and of all rows mixed in; the language's as l_*."""
    whole = summary(cells, []).first()
    if whole is None or whole["n"] is None:
        return summary(cells, _GROUP).select(*_GROUP, "n", *mixed, *[F.col(c).alias(f"l_{c}") for c in mixed])
    langs = summary(cells, _GROUP[:1])
    langs = langs.select(_GROUP[0], *[_mixed(F.col(c), _constant(whole[c]), F.col("n")).alias(f"l_{c}") for c in mixed])
    groups = summary(cells, _GROUP).join(cast(langs), _GROUP[0])
    return groups.select(*_GROUP, "n", *[_mixed(F.col(c), F.col(f"l_{c}"), F.col("n")).alias(c) for c in mixed], *[f"l_{c}" for c in mixed])


def _quartiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Exact medians and scaled quartile ranges of each statistic from counts of its values."""
    each = cells.groupBy(*keys, "stat", "value").agg(F.sum("count").alias("count"))
    by = Window.partitionBy(*keys, "stat")  # as many rows as a statistic has rounded values, at most
    ranked = each.withColumn("upto", F.sum("count").over(by.orderBy("value"))).withColumn("n", F.sum("count").over(by))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("value"))).cast("double")
    spread = ranked.groupBy(*keys, "stat").agg(F.max("n").alias("n"), at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("scale"))
    picked = lambda c: F.array(*[F.max(F.when(F.col("stat") == i, F.col(c))) for i in range(_N)]).alias(c)
    return spread.groupBy(*keys).agg(F.max("n").cast("double").alias("n"), picked("mid"), picked("scale"))


def _cells(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return saved(rows.select(*_GROUP, F.posexplode(F.array(*columns)).alias("stat", "value")).groupBy(*_GROUP, "stat", "value").count())


def _vector(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """rows with their vectors; those of groups that have no centre, as all fail the base rule, are null."""
    damp = F.sqrt(F.col("n_words") / (F.col("n_words") + float(DAMP)))
    near = rows.join(centers.select(*_GROUP, F.col("mid").alias("_mid")), _GROUP, "left")
    moved = [F.least(F.greatest(F.round((F.col(r) - F.get("_mid", F.lit(i))) * damp), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long").alias(s) for i, (r, s) in enumerate(zip(_RAW, STATS, strict=True))]
    return near.select(*rows.columns, *moved)


def _factored(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep with l, the Cholesky factor of the covariance c, and half the log of the determinant.

    Each entry names those before it, in one select.
    """
    entries = []
    for i, j in _PAIRS:
        rest = " - ".join([f"c[{_AT[i, j]}]", *(f"l{i}{k} * l{j}{k}" for k in range(j))])
        entries.append(f"sqrt({rest}) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    logs = " + ".join(f"ln(l{i}{i})" for i in range(_N))
    return df.selectExpr(*keep, "c", *entries).selectExpr(*keep, f"array({', '.join(f'l{i}{j}' for i, j in _PAIRS)}) AS l", f"{logs} AS logdet")


def _ridged(c: Column) -> Column:
    return F.zip_with(c, _constant([RIDGE**2 if i == j else 0.0 for i, j in _PAIRS]), lambda x, r: x + r)


def _scores(rows: DataFrame, scales: DataFrame, cast: Callable) -> DataFrame:
    """Integer moments of tanh scores and of spatial signs by group."""
    near = rows.join(cast(scales.select(*_GROUP, "mid", "scale")), _GROUP)
    z = [(F.col(s) - F.get("mid", F.lit(i))) / (F.get("scale", F.lit(i)) + RIDGE) for i, s in enumerate(STATS)]
    near = near.select(*_GROUP, *[x.alias(f"z{i}") for i, x in enumerate(z)])
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, _N)), F.col("z0") * F.col("z0")))
    near = near.withColumn("size", F.greatest(size, F.lit(1e-9)))
    y = [F.round(F.tanh(F.col(f"z{i}")) * _SCORE).cast("long").alias(f"y{i}") for i in range(_N)]
    u = [F.round(F.col(f"z{i}") / F.col("size") * _SCORE).cast("long").alias(f"u{i}") for i in range(_N)]
    near = near.select(*_GROUP, *y, *u)
    sums = [F.sum(f"y{i}").alias(f"sy{i}") for i in range(_N)] + [F.sum(F.col(f"{v}{i}") * F.col(f"{v}{j}")).alias(f"q{v}{i}{j}") for v in "yu" for i, j in _PAIRS]
    return saved(near.groupBy(*_GROUP).agg(F.count("*").alias("count"), *sums))


def _correlations(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Correlations of tanh scores and of spatial signs, each as an array, from their moments."""
    names = [c for c in cells.columns if c not in _GROUP]
    total = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    n = F.col("count").cast("double")
    cov = {"y": {(i, j): F.col(f"qy{i}{j}") / n - F.col(f"sy{i}") / n * (F.col(f"sy{j}") / n) for i, j in _PAIRS}, "u": {(i, j): F.col(f"qu{i}{j}") / n for i, j in _PAIRS}}
    arrays = [F.array(*[F.lit(1.0) if i == j else cov[v][i, j] / F.sqrt((cov[v][i, i] + 1.0) * (cov[v][j, j] + 1.0)) for i, j in _PAIRS]).alias(f"r_{v}") for v in "yu"]
    return total.select(*keys, n.alias("n"), *arrays)


def _starts(rows: DataFrame, cast: Callable) -> DataFrame:
    """(group, start, n, m, c, t_m, t_c): three starts of each group, and its target."""
    scales = saved(_by_level(_cells(rows, STATS), _quartiles, ["mid", "scale"], cast))
    related = _by_level(_scores(rows, scales, cast), _correlations, ["r_y", "r_u"], cast)
    both = scales.join(related.drop("n"), _GROUP)

    def covariance(scale: str, r: str | None) -> Column:
        """From scales and correlations, of which a tenth is taken off so that they are regular."""
        at = lambda i: F.get(scale, F.lit(i))
        rho = lambda i, j: F.lit(float(i == j)) if i == j or r is None else 0.9 * F.get(r, F.lit(_AT[i, j]))
        return F.array(*[at(i) * at(j) * rho(i, j) for i, j in _PAIRS])

    out = both.select(*_GROUP, "n", F.col("mid").alias("m"), F.col("l_mid").alias("t_m"), covariance("l_scale", "l_r_y").alias("t_c"), F.posexplode(F.array(covariance("scale", None), covariance("scale", "r_y"), covariance("scale", "r_u"))).alias("start", "c"))
    return _factored(out.withColumn("c", _ridged(F.col("c"))), [*_GROUP, "start", "n", "m", "t_m", "t_c"])


def _measured(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep with the squared Mahalanobis distance from the centre m, by forward substitution in the factor l."""
    z = []
    for i in range(_N):
        rest = " - ".join([f"{STATS[i]} - m[{i}]", *(f"l[{_AT[i, j]}] * z{j}" for j in range(i))])
        z.append(f"({rest}) / l[{_AT[i, i]}] AS z{i}")
    names = [f"`{c}`" for c in keep]
    return df.selectExpr(*names, *STATS, "m", "l", *z).selectExpr(*names, *STATS, " + ".join(f"z{i} * z{i}" for i in range(_N)) + " AS distance")


def _concentrated(rows: DataFrame, estimate: DataFrame, cast: Callable) -> DataFrame:
    """One step: the estimate from the share of each group that is nearest to an estimate."""
    key = [*_GROUP, "start"]
    near = _measured(rows.join(cast(estimate.select(*key, "m", "l")), _GROUP), key)
    bin_ = f"CAST(least(floor(ln(1 + distance) * {_BINS}), 10000) AS INT) AS bin"
    names = ["h", *[f"s{i}" for i in range(_N)], *[f"q{i}{j}" for i, j in _PAIRS]]
    sums = ["count(*)", *[f"sum({x})" for x in STATS], *[f"sum({STATS[i]} * {STATS[j]})" for i, j in _PAIRS]]
    cells = near.selectExpr(*key, bin_, *STATS).groupBy(*key, "bin").agg(*[F.expr(x).alias(n) for x, n in zip(sums, names, strict=True)])
    by = Window.partitionBy(*key)  # as many rows as there are bins, at most
    cells = cells.withColumn("before", F.sum("h").over(by.orderBy("bin")) - F.col("h")).withColumn("all", F.sum("h").over(by))
    inner = cells.where(F.col("before") < F.ceil(F.col("all") * SHARE)).groupBy(*key).agg(*[F.sum(n).cast("double").alias(n) for n in names])
    own = [f"{CONSISTENT} * (q{i}{j} / h - s{i} / h * (s{j} / h))" for i, j in _PAIRS]
    inner = inner.selectExpr(*key, f"array({', '.join(f's{i} / h' for i in range(_N))}) AS own_m", f"array({', '.join(own)}) AS own_c")
    out = estimate.select(*key, "n", "t_m", "t_c", F.col("logdet").alias("before")).join(inner, key)
    out = out.select(*key, "n", _mixed(F.col("own_m"), F.col("t_m"), F.col("n")).alias("m"), _ridged(_mixed(F.col("own_c"), F.col("t_c"), F.col("n"))).alias("c"), "t_m", "t_c", "before")
    return unestimated(saved(_factored(out, [*key, "n", "m", "t_m", "t_c", "before"])))


def _raws(stats: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    return stats.select("*", F.coalesce(lang_col, F.lit("")).alias("g_lang"), F.coalesce(source_col, F.lit("")).alias("g_source"), *_raw())


def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(centres, estimates) of each group from saved rows with raw statistics; estimates: group, m and l."""
    seen = saved(rows.where("not base_failed").select(*_GROUP, "n_words", *_RAW).distinct())
    groups = saved(seen.select(*_GROUP).distinct())
    # tables with a few rows a group are broadcast if the groups, counted, are few; else the same joins shuffle
    cast = F.broadcast if counted_small(groups, 100 * _N, 3) else lambda d: d
    centers = saved(_by_level(_cells(seen, _RAW), _quartiles, ["mid"], cast))
    vectors = saved(_vector(seen, cast(centers)).select(*_GROUP, *STATS).distinct())
    estimate = saved(_starts(vectors, cast))
    for step in range(MOST_STEPS):
        estimate = _concentrated(vectors, estimate, cast)
        if step + 1 == FIRST:
            first = Window.partitionBy(*_GROUP).orderBy("logdet", "start")  # three rows each
            estimate = estimate.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")
        elif step > FIRST and step % 2 and not (estimate.agg(F.max(F.col("before") - F.col("logdet"))).first()[0] or 0) > FALL:
            break
    return cast(centers), cast(estimate.select(*_GROUP, "m", "l"))


def _judged(rows: DataFrame, fitted: tuple[DataFrame, DataFrame]) -> DataFrame:
    """rows with their vectors, the distance from their group's estimate, and kept."""
    centers, estimates = fitted
    out = _measured(_vector(rows, centers).join(estimates, _GROUP, "left"), rows.columns)
    out = out.withColumn("distance", F.when(~F.col("base_failed"), F.col("distance")))
    # one expression over both sides of the join: as two conditions, a filter's first would be pushed down and every count taken again for it
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))))


def judge(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source"), lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The counts of text_statistics, the vector, distance (null where the base rule fails) and kept."""
    stats = text_statistics(docs, text_col, tuple(dict.fromkeys((*keep, lang_col, source_col))))
    rows = saved(_raws(stats, lang_col, source_col))
    return _judged(rows, fit(rows)).select(*stats.columns, *STATS, "distance", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that judge keeps, with their columns.

    Statistics are taken twice, once to fit and once to filter in place; that is cheaper
    than to send texts through a shuffle to meet their verdicts.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"), docs[lang_col].alias("lang"), docs[source_col].alias("source"))
    narrow = _raws(text_statistics(whole, "text", ("lang", "source")), "lang", "source")
    # saved first: a filter would be pushed down into the counts and take each again wherever it is used
    fitted = fit(saved(narrow.select(*_GROUP, "n_words", "base_failed", *_RAW)))
    rows = _raws(text_statistics(whole, "text", ("row", "lang", "source")), "lang", "source")
    return _judged(rows, fitted).where("kept").select("row.*")
