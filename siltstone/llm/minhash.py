"""Near-duplicate classes by one-permutation MinHash, confirmed on full sets.

A row's set holds its distinct runs of ``k`` words (of fewer words: the whole
sequence).  Rows are linked when 100 * intersection >= threshold * union.

1. One hash permutation is cut into ``BANDS * ROWS`` bins; each bin keeps its
   least hash.  Empty bins are filled by optimal densification: bin i tries
   a fixed random sequence of bins and copies the first that is not empty, and
   where the sequence runs out, the non-empty bin with the least hash of (i, j).
2. Rows with equal sets form a class (128-bit hashes); only classes go on.
3. ``ROWS`` bins make a band.  The class of a bucket that meets most others, in
   all its buckets, is its hub (the original of a family of copies, as a rule), and
   candidates are the edges from hub to members: a star, not all pairs.  At a
   similarity of 0.8 a pair meets in no bucket with a chance of 3e-7.
4. Edges are confirmed on full sets in three turns: each class with
   its most frequent hub; then the star edges between different components;
   then, so that no link is lost to a star whose hub differs from both ends,
   members of one hub that still lie in different components and whose
   differences from the hub overlap enough (see ``_between_members``).  A pair
   inside a component can't change the result and is never formed.

Defined results: null or blank text has an empty set, no links, and keeps its
id as component; rows with a null id are linked with nothing (component null,
kept); rows that share an id and a text share a component; an empty table gives no
rows; columns beside id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm import words as W
from siltstone.llm.graph import components
from siltstone.llm.shared import join_salted, lean, row_key, saved, small

ROWS, BANDS = 7, 64
BINS = ROWS * BANDS
_TRIES = 48
_EMPTY = np.iinfo(W.U).max
_DOCS = 1024  # texts whose signatures are made at once
_TOKENS = 64  # a member shows on average, at most, in choices of several elements
_PAIRS = 16  # for each member on average, up to which single elements do
_OCTAVE = 8
_CHOICE = 4  # elements of a choice, at most
_FILE_SETS = 20_000  # full sets in a saved file


def sets(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and how many each has."""
    ends = np.cumsum(counts)
    starts = ends - counts
    g = W.grams(hashes, k)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if e - s >= k:
            x = np.sort(g[s : e - k + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        elif e > s:
            x = W.grams(hashes[s:e], e - s)
        else:
            continue
        sizes[i] = len(x)
        out.append(x)
    return (np.concatenate(out) if out else np.zeros(0, W.U)), sizes


_TRY = (W.mix(np.arange(BINS * _TRIES, dtype=W.U) + W.U(77)) % W.U(BINS)).astype(np.int64).reshape(BINS, _TRIES)
_ORDER = W.mix(np.arange(BINS * BINS, dtype=W.U) + W.U(1 << 40)).reshape(BINS, BINS)


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One-permutation sketches of non-empty sets, densified: a row of BINS hashes for each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = owner * BINS + ((shingles >> W.U(32)) * W.U(BINS) >> W.U(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    sig = np.full(len(sizes) * BINS, _EMPTY, W.U)
    sig[cell[first]] = shingles[first]
    full = np.zeros(len(sig), bool)
    full[cell[first]] = True
    todo = np.flatnonzero(~full)
    for t in range(_TRIES):
        if not len(todo):
            break
        source = todo - todo % BINS + _TRY[todo % BINS, t]
        ok = full[source]
        sig[todo[ok]] = sig[source[ok]]
        todo = todo[~ok]
    if len(todo):
        grid = full.reshape(-1, BINS)
        row, bins = todo // BINS, todo % BINS
        cuts = np.append(np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            there = np.flatnonzero(grid[row[a]])
            sig[todo[a:b]] = sig[row[a] * BINS + there[np.argmin(_ORDER[bins[a:b]][:, there], axis=1)]]
    return sig.reshape(-1, BINS)


def bands(sig: np.ndarray) -> np.ndarray:
    key = np.repeat(np.arange(BANDS, dtype=W.U)[None, :], len(sig), 0)
    for r in range(ROWS):
        key = W.mix(key * W.U(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
    return key


def _sums(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for salt in (0x1234567, 0x89ABCDEF0):
        total = np.concatenate((np.zeros(1, W.U), np.cumsum(W.mix(shingles ^ W.U(salt)))))
        out.append(total[at[1:]] - total[at[:-1]])
    return out[0], out[1]


def _each(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = W.texts_of(batch.column("text"))
    for i, j in W.slabs(offsets):
        for a in range(i, j, _DOCS):
            b = min(a + _DOCS, j)
            _, _, hashes, counts = W.split(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
            yield a, b, *sets(hashes, counts, k)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shingles, sizes in _each(batch, k):
                has = sizes > 0
                keys = bands(signatures(shingles, sizes[has])).view(np.int64) if has.any() else np.zeros((0, BANDS), np.int64)
                sa, sb = (x.view(np.int64) for x in _sums(shingles, sizes))
                at = np.concatenate(([0], np.cumsum(np.where(has, BANDS, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("rid"), pa.array(sizes), pa.array(sa), pa.array(sb), lists], ["id", "rid", "n", "sa", "sb", "bands"])

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shingles, sizes in _each(batch, k):
                sa, sb = (x.view(np.int64) for x in _sums(shingles, sizes))
                part = batch.slice(a, b - a)
                same = (sa == part.column("sa").to_numpy()) & (sb == part.column("sb").to_numpy())
                at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                out = pa.RecordBatch.from_arrays([part.column("cid"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(at), pa.array(shingles.view(np.int64)))], ["cid", "n", "shingles"])
                yield out if same.all() else out.filter(pa.array(same))

    return run


def _linked(pairs: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""
    x, y = (full.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    # sizes alone rule out most false candidates before sets meet
    fits = (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    sized = saved(pairs.join(x.select("a", "na"), "a").join(y.select("b", "nb"), "b").where(fits).select("a", "b"))
    return sized.join(x, "a").join(y, "b").withColumn("i", both).where(100 * F.col("i") >= threshold * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80, with_key: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (least id reachable), kept (id = component_id).

    with_key: also row_key (of id and text) and component_key, which are exact where rows share an id.
    """
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("rid", row_key("id", "text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = saved(read.mapInArrow(lean(_sketches(k)), f"id {kind}, rid long, n long, sa long, sb long, bands array<long>"))
    classes = saved(
        rows.where("n > 0 and id is not null").groupBy("sa", "sb").agg(F.min("id").alias("label"), F.min("rid").alias("rid"), F.first("bands").alias("bands")).withColumn("cid", F.monotonically_increasing_id())
    )
    buckets = classes.select("cid", F.explode("bands").alias("key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = saved(buckets.join(crowded, "key").select("key", "cid", "n"))
    known = met.groupBy("cid").agg(F.sum("n").alias("met"))
    met = saved(met.join(known, "cid").select("key", "cid", "met"))
    hubs = met.groupBy("key").agg(F.max_by("cid", F.struct("met", -F.col("cid"))).alias("hub"))
    members = saved(met.join(hubs, "key").select("key", "hub", "cid"))
    stars = saved(members.where("cid <> hub").groupBy("hub", "cid").agg(F.count("*").alias("shared")), members.count())
    n_stars = stars.count()
    wanted = saved(stars.select("cid").union(stars.select("hub")).distinct().join(classes.select("cid", "rid", "sa", "sb"), "cid"), 2 * n_stars)
    texts = read.where("id is not null").select("rid", "text").join(small(wanted), "rid").select("cid", "sa", "sb", "text")
    full = saved(texts.mapInArrow(lean(_full_sets(k)), "cid long, n long, shingles array<long>").dropDuplicates(["cid"]), wanted.count(), _FILE_SETS)

    best = stars.groupBy("cid").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub")).select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    links = saved(_linked(best, full, threshold), n_stars)
    roots = saved(components(links))
    for pairs in (_between_stars, _between_members):
        # tables in between keep plans, and what the driver holds of them, small
        more = saved(_linked(saved(pairs(stars, members, roots, full, threshold)), full, threshold), n_stars)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = saved(components(links))
    return _labelled(rows, classes, roots, id_col, with_key)


def _rooted(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    return df.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _between_stars(stars: DataFrame, members: DataFrame, roots: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    apart = _rooted(_rooted(stars, roots, "hub", "x"), roots, "cid", "y").where("x <> y")
    return apart.select(F.col("hub").alias("a"), F.col("cid").alias("b"))


def _between_members(stars: DataFrame, members: DataFrame, roots: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """Pairs of members of one hub, in different components, that can still be similar enough.

    A member x of hub h is h without D(x) and with I(x).  For x and y the
    threshold t asks (100 + t) * S >= w(x) + w(y) - (100 - t) * |h|, where
    w = 100 * |D| + t * |I| and S counts what D(x), D(y) and I(x), I(y) share.  A
    member with w <= (100 - t) * |h| is linked to h itself, so of two members in
    different components one, x, is not ("far", by spare = w - (100 - t) * |h|), and S must be at least
    need = (spare(x) + w(y)) / (100 + t).

    Prefix filtering: elements that members of only one component have are dropped, and the lists are put in one order, the rarest
    element under the hub first.  A pair that shares need elements has n of them in common among the first
    length - need + n of each list, for any n up to need; the tokens of a list are all n-element choices from
    these, and candidates come from an equi-join on (hub, class, token).  What y must show depends on w(y), so
    partners are taken in classes of w (``_OCTAVE`` for each power of two), and x shows each class as many elements as that class
    can need.  Of x's list a class sees only what its own members in other components have, as nothing else can be shared with
    them.  A class is left out where even its whole lists are too short for spare(x).  n is 1 where that forms at most ``_PAIRS``
    pairs a member, which is counted; elsewhere it is the largest up to ``_CHOICE`` that gives the class at most ``_TOKENS`` tokens a member.

    Bound: tokens are linear in the members of a hub, and a pair is formed only if it shares n of the rarest
    elements of both lists.  What a family has in common (a changed word, a deletion) comes last in every
    list and forms no pairs by itself.
    """
    placed = _rooted(members, roots, "cid", "root")
    # most buckets lie in one component and end here
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
    under = saved(placed.join(mixed, "key").where("cid <> hub").select("hub", "cid", "root").distinct(), members.count())
    none = under.limit(0).select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    if under.isEmpty():
        return none
    h, x = (full.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"s{c}")) for c in ("hub", "cid"))
    away = under.join(x, "cid").join(h, "hub").select("hub", "cid", "root", "nhub", F.array_except("scid", "shub").alias("more"), F.array_except("shub", "scid").alias("less"))
    w, unit = 100 * F.size("less") + threshold * F.size("more"), 100 + threshold
    listed = F.concat(F.transform("more", lambda t: F.xxhash64(t)), F.transform("less", lambda t: F.xxhash64(F.lit(1), t)))
    size = F.col("nhub") - F.size("less") + F.size("more")
    away = away.select("hub", "cid", "root", size.alias("size"), w.cast("long").alias("w"), (w - (100 - threshold) * F.col("nhub")).cast("long").alias("spare"), listed.alias("listed"))
    # only hubs with far members can have such pairs
    away = saved(away)
    if away.where("spare > 0").isEmpty():
        return none
    beyond = away.where("spare > 0").groupBy("hub").agg(F.min("spare").alias("beyond"))
    rows = away.count()
    each = saved(join_salted(away, beyond, "hub", "cid", rows).select("hub", "cid", "root", F.explode("listed").alias("element")))
    # a pair that matters lies in two components, and so does all that it shares
    often = saved(each.groupBy("hub", "element").agg(F.count("*").alias("often"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hub", "element", "often"))
    ranked = join_salted(each, often, ["hub", "element"], "cid", each.count()).groupBy("hub", "cid").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("ranked"))
    measured = join_salted(away.drop("listed"), beyond, "hub", "cid", rows).join(saved(ranked), ["hub", "cid"])
    measured = measured.withColumn("listed", F.col("ranked.element")).withColumn("class", F.floor(F.log2(F.greatest("w", F.lit(1))) * _OCTAVE).cast("int"))
    measured = saved(measured.withColumn("length", F.size("listed").cast("long")).drop("ranked"))
    least_w = F.pow(F.lit(2.0), F.col("class") / _OCTAVE) - 0.001
    columns = ["hub", "class", "cid", "root", "w", "spare", "beyond", "length", "size", "listed", "extra"]

    def extra(need: Column) -> Column:
        """Elements of a list beyond those that a pair must share; below 0 the list is too short."""
        return F.col("length") - F.greatest(F.ceil(need / unit), F.lit(1))

    y = saved(measured.withColumn("extra", extra(F.col("w") + F.col("beyond"))).where("extra >= 0").select(*columns))
    held = y.select("hub", "class", "root", F.explode("listed").alias("element")).groupBy("hub", "element", "class").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    held = saved(held.groupBy("hub", "element").agg(F.collect_list(F.struct("class", "low", "high")).alias("held")))  # a few classes for each power of two
    shown = saved(measured.where("spare > 0").select("hub", "cid", "root", F.posexplode("listed").alias("place", "element")))
    shown = join_salted(shown, held, ["hub", "element"], "cid", shown.count()).withColumn("by", F.filter("held", lambda c: (c["low"] != F.col("root")) | (c["high"] != F.col("root")))["class"])
    shown = saved(shown.where(F.size("by") > 0).groupBy("hub", "cid").agg(F.array_sort(F.collect_list(F.struct("place", "element", "by"))).alias("shown")))
    far = measured.where("spare > 0").drop("class", "listed", "length").join(shown, ["hub", "cid"]).withColumn("class", F.explode(F.array_distinct(F.flatten("shown.by"))))
    # a partner of this class has w below least_w * 2 ** (1 / _OCTAVE), and w >= threshold * its length
    far = far.where(F.col("spare") * threshold <= (least_w + 0.01) * 2 ** (1 / _OCTAVE) * (unit - threshold))
    far = far.withColumn("listed", F.filter("shown", lambda e: F.array_contains(e["by"], F.col("class")))["element"]).withColumn("length", F.size("listed").cast("long"))
    far = saved(far.withColumn("extra", extra(F.col("spare") + least_w)).where("extra >= 0").select(*columns))
    alone = F.explode(F.slice("listed", F.lit(1), (F.col("extra") + 1).cast("int"))).alias("element")
    both = y.select("hub", "class", alone, F.lit(0).alias("x")).unionByName(far.select("hub", "class", alone, F.lit(1).alias("x"))).groupBy("hub", "class", "element").agg(F.sum("x").alias("x"), F.sum(1 - F.col("x")).alias("y"))
    pairs = both.groupBy("hub", "class").agg(F.sum(F.col("x") * F.col("y")).alias("pairs"))
    most = F.ceil(F.min(F.col("beyond") + least_w) / unit)
    count = lambda n: math.prod(((F.col("extra") + F.lit(float(i))) / i for i in range(1, n + 1)), start=F.lit(1.0))  # noqa: E731  of the choices of n
    pick = F.coalesce(*[F.when((F.avg(count(n)) <= _TOKENS) & (most >= n), n) for n in range(_CHOICE, 1, -1)], F.lit(1))
    chosen = y.unionByName(far).groupBy("hub", "class").agg(pick.alias("n"), F.count("*").alias("rows")).join(pairs.where("pairs > 0"), ["hub", "class"])
    chosen = saved(chosen.select("hub", "class", F.when(F.col("pairs") <= _PAIRS * F.col("rows"), 1).otherwise(F.col("n")).alias("n")))
    y, far = (join_salted(d, chosen, ["hub", "class"], "cid", rows).withColumn("token", F.explode(_choices(F.slice("listed", F.lit(1), (F.col("extra") + F.col("n")).cast("int")), F.col("n")))).drop("listed") for d in (y, far))
    y = y.select("hub", "class", "token", F.col("cid").alias("b"), F.col("root").alias("other"), F.col("w").alias("wb"), F.col("spare").alias("spare_b"), F.col("length").alias("length_b"), F.col("size").alias("nb"))
    far = far.select("hub", "class", "token", F.col("cid").alias("a"), "root", F.col("spare").alias("spare_a"), F.col("length").alias("length_a"), F.col("size").alias("na"))
    can = (F.col("root") != F.col("other")) & (F.col("spare_a") + F.col("wb") <= unit * F.least("length_a", "length_b")) & (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & ((F.col("spare_b") <= 0) | (F.col("a") < F.col("b")))
    met = far.join(y, ["hub", "class", "token"]).where(can)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _choices(items: Column, n: Column) -> Column:
    """Hashes of all choices of n items (1 to _CHOICE), in their order."""

    def grown(size: int, rest: Column, head: list[Column]) -> Column:
        if size == 1:
            return F.transform(rest, lambda a: F.xxhash64(*head, a))
        # (a length beyond the end will do: naming rest once more would double the expression at each level)
        return F.flatten(F.transform(rest, lambda a, i: grown(size - 1, F.slice(rest, i + 2, F.lit(1 << 24)), [*head, a])))

    return F.coalesce(*[F.when(n == size, grown(size, items, [])) for size in range(1, _CHOICE + 1)])


def _labelled(rows: DataFrame, classes: DataFrame, roots: DataFrame, id_col: str, with_key: bool) -> DataFrame:
    own = classes.select("cid", "sa", "sb", "label")
    linked = own.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    least = linked.where("root is not null").groupBy("root").agg(F.min("label").alias("least"))
    named = join_salted(linked, least, "root", "cid", classes.count(), "left").select("sa", "sb", F.coalesce("root", "cid").alias("root"), F.coalesce("least", "label").alias("component_id"))
    out = rows.select("id", "rid", "n", "sa", "sb").join(named, ["sa", "sb"], "left")
    found = F.col("root").isNotNull() & (F.col("n") > 0) & F.col("id").isNotNull()
    component = F.when(found, F.col("component_id")).otherwise(F.col("id"))
    keys = [F.col("rid").alias("row_key"), F.struct(found.alias("linked"), F.when(found, F.col("root")).otherwise(F.col("rid")).alias("at")).alias("component_key")] if with_key else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *keys)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate component: the least id, and of rows that share it the least row hash.

    Rows that share an id are one document of the component only where their texts are linked; rows
    with a null id stay, and columns are returned as they are, whatever their names.
    """
    key = row_key(docs[id_col], docs[text_col])
    found = near_duplicates(docs, id_col, text_col, k, threshold, with_key=True)
    kept = found.where(F.col(id_col).isNotNull()).groupBy("component_key").agg(F.min(F.struct(F.col(id_col).alias("id"), F.col("row_key"))).alias("least"))
    kept = kept.select(F.col("least.row_key").alias("key"))
    rows = docs.select(docs[id_col].alias("id"), key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    named = rows.where("id is not null").join(kept, "key", "left_semi")
    # exact copies of a row share its key
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("n = 1")
    return named.select("row.*").unionByName(rows.where("id is null").select("row.*"))
