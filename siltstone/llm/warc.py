"""WARC archives and a Merkle audit of replicas.

Pages become WARC/1.1 resource records in archives of ``ARCHIVE`` consecutive ids, in order of
id, each at its byte offset; an archive is stored as rows of bytes, one for each record, so that no value holds more than a record, however
large an archive is.  An audit reads the stored bytes of two
replicas.  A record's leaf is the SHA-256 of the bytes at its offset; a
node covers ``FANOUT`` neighbours of the level below and hashes their digests with the
byte range they span; above the archives, nodes cover neighbouring archives, up to
one root.  Replicas are compared from the root down: a node's children are
compared only where the nodes differ, so equal branches are never looked at.  Below unequal leaves, records are aligned by id
and digest, so one that is missing is one fault, not one for each that follows.

Leaves are hashed where their bytes are read; digests and offsets go to their archive, whose tree is folded in one row, and only the roots of
archives go further.  Records travel once, to their archive.

Defined results: null html is an empty body and a null url an empty address; rows with a
null or negative id go to archives of their own (odd numbers) by the hash of their content, as many as ``lost`` says;
rows that share an id are ordered by url, then digest; rows that repeat exactly are one record
with a number of copies; an empty table has no records and no root; extra columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.shared import _shared_folder, dropped, saved

ARCHIVE = 1024
FANOUT = 16
DATE = "1970-01-01T00:00:00Z"


def record(id_: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """The text of one WARC resource record; pages have no date of capture, so it is a parameter."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def lost_archives(pages: DataFrame, id_col: str = "page_id") -> int:
    """How many archives rows without a usable id need; replicas that are compared must share the number."""
    lost = pages.where(pages[id_col].isNull() | (pages[id_col] < 0)).count()
    return max(1, 2 * lost // ARCHIVE)


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lost: int | None = None) -> DataFrame:
    """(archive, place, id, start, length, copies, content): the bytes of archives, a row for each record at its offset."""
    lost = lost_archives(pages, id_col) if lost is None else lost
    id_, url, html = pages[id_col], F.coalesce(pages[url_col], F.lit("")), F.coalesce(pages[html_col], F.lit(""))
    archive = F.when(id_ >= 0, F.floor(id_ / ARCHIVE) * 2).otherwise(F.pmod(F.xxhash64(url, html), F.lit(lost)) * 2 + 1).cast("long")
    rows = pages.select(id_.alias("id"), archive.alias("archive"), url.alias("url"), record(id_, url, html).alias("record"))
    rows = rows.withColumn("digest", F.sha2("record", 256)).withColumn("length", F.octet_length("record").cast("long"))
    key = ["id", "archive", "url", "digest", "length"]
    single = rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1").isEmpty()
    # records travel once more only where some repeat
    rows = rows.withColumn("copies", F.lit(1).cast("long")) if single else rows.groupBy(*key).agg(F.count("*").alias("copies"), F.first("record").alias("record"))
    order = Window.partitionBy("archive").orderBy("id", "url", "digest")
    start = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("archive", (F.row_number().over(order) - 1).cast("long").alias("place"), F.col("id").cast("long").alias("id"), start.alias("start"), "length", "copies", F.encode("record", "UTF-8").alias("content"))


def write_archives(stored: DataFrame, path: str) -> DataFrame:
    """A replica: archives written under path, and read back."""
    stored.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return stored.sparkSession.read.parquet(path)


def damaged(stored: DataFrame, every: int = 997) -> DataFrame:
    """Archives in which a stored byte of every so many ids' records is wrong (for drills): its middle one becomes 0xFF, which no UTF-8 has."""
    wrong = F.overlay("content", F.unhex(F.lit("FF")), (F.floor(F.col("length") / 2) + 1).cast("int"), F.lit(1))
    return stored.withColumn("content", F.when(F.coalesce(F.col("id") % every == 5, F.lit(False)), wrong).otherwise(F.col("content")))


def _height(width: int) -> int:
    n = 0
    while width > 0:
        width //= FANOUT
        n += 1
    return n


def _node(children: Column) -> Column:
    """The parent of a few neighbours (start, end, digest)."""
    text = F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["start"], x["end"], x["digest"])), "|")
    return F.struct(F.array_min(F.transform(children, lambda x: x["start"])).alias("start"), F.array_max(F.transform(children, lambda x: x["end"])).alias("end"), F.sha2(text, 256).alias("digest"))


def trees(stored: DataFrame) -> DataFrame:
    """(archive, index, levels): the tree of each archive over its stored bytes, from the leaves up to one node."""
    # the bytes are hashed row by row where they are read; digests and offsets go to their archive
    each = stored.select("archive", F.struct("place", "id", "start", "length", "copies", F.concat_ws("*", F.sha2("content", 256), "copies").alias("digest")).alias("e"))
    out = saved(each.groupBy("archive").agg(F.array_sort(F.collect_list("e")).alias("e")))
    entry = lambda e: F.struct(*[e[c].alias(c) for c in ("id", "start", "length", "copies")])
    leaf = lambda e: F.struct(e["start"].alias("start"), (e["start"] + e["length"]).alias("end"), e["digest"].alias("digest"))
    most = out.agg(F.coalesce(F.max(F.size("e")), F.lit(1))).first()[0]
    out = out.select("archive", F.transform("e", entry).alias("index"), F.transform("e", leaf).alias("l0"))
    height = max(_height(most - 1), 1)
    for k in range(height):
        below = F.col(f"l{k}")
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FANOUT).cast("int")), lambda i: F.slice(below, i * FANOUT + 1, FANOUT))  # noqa: B023
        out = out.withColumn(f"l{k + 1}", F.transform(groups, _node))
    return saved(out.select("archive", "index", F.array(*[F.col(f"l{k}") for k in range(height + 1)]).alias("levels")))


def _above(level: DataFrame) -> DataFrame:
    made = level.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "digest"))).alias("c"))
    return saved(made.select("node", _node(F.col("c")).alias("n")).select("node", "n.*"))


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Numbers of the nodes of one level that are not equal."""
    x, y = a.select("node", F.col("digest").alias("x")), b.select("node", F.col("digest").alias("y"))
    return x.join(y, "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")


def audit(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[int]]:
    """Records that differ between two tables of trees, (archive, place, fault), and the number of unequal nodes by level, from the root down."""
    top = max(x.agg(F.coalesce(F.max("archive"), F.lit(0))).first()[0] for x in (a, b))
    # an archive's root covers its bytes; from there on start and end are archives
    root = F.concat_ws(":", F.element_at(F.element_at("levels", -1), 1)["start"], F.element_at(F.element_at("levels", -1), 1)["end"], F.element_at(F.element_at("levels", -1), 1)["digest"])
    sides = [[x.select(F.col("archive").alias("node"), F.col("archive").alias("start"), F.col("archive").alias("end"), F.concat_ws(":", F.size("levels"), root).alias("digest"))] for x in (a, b)]
    for levels in sides:
        for _ in range(_height(top)):
            levels.append(_above(levels[-1]))
    left, right = sides
    suspect = saved(_differ(left[-1], right[-1]))
    unequal = [suspect.count()]
    for k in range(len(left) - 2, -1, -1):
        if not unequal[-1]:
            break
        below = lambda side: side.withColumn("up", F.floor(F.col("node") / FANOUT)).join(suspect.select(F.col("node").alias("up")), "up", "left_semi")  # noqa: B023, E731
        suspect = saved(_differ(below(left[k]), below(right[k])))
        unequal.append(suspect.count())
    # within an archive: its levels lie in two rows, and the children of unequal nodes are looked at there
    named = suspect.select(F.col("node").alias("archive"))
    x, y = (t.join(named, "archive", "left_semi").select("archive", F.col("levels").alias(c), F.col("index").alias(f"{c}_index")) for t, c in ((a, "x"), (b, "y")))
    pair = x.join(y, "archive", "full_outer")
    height = F.greatest(F.coalesce(F.size("x"), F.lit(0)), F.coalesce(F.size("y"), F.lit(0)))
    most = pair.agg(F.max(height)).first()[0] or 0
    at = lambda side, k, i: F.get(F.get(side, F.lit(k)), i)["digest"]
    unlike = lambda k, nodes: F.filter(nodes, lambda i: ~at("x", k, i).eqNullSafe(at("y", k, i)))
    pair = pair.withColumn("nodes", F.array(F.lit(0)))
    for k in range(most - 2, -1, -1):
        children = F.flatten(F.transform("nodes", lambda n: F.sequence(n * FANOUT, n * FANOUT + (FANOUT - 1))))
        pair = pair.withColumn("nodes", unlike(k, children)).withColumn(f"n{k}", F.size("nodes"))
    pair = saved(pair)
    if most > 1:
        counts = pair.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(most - 2, -1, -1)]).first()
        unequal += [int(c) for c in counts]
    return _aligned(pair), unequal


def _aligned(pair: DataFrame) -> DataFrame:
    """(archive, place, fault) of the records below unequal leaves.

    Records are paired by id and digest, as one that is missing shifts the places of all that follow; what is left is
    paired by id, and then corrupt.  Places are those of the first replica; of records that it doesn't have (extra), of the second.
    """
    leaves = pair.select("archive", "x", "x_index", "y", "y_index", F.explode("nodes").alias("place"))
    sides = []
    for c in ("x", "y"):
        digest = F.get(F.get(c, F.lit(0)), F.col("place"))["digest"]
        own = leaves.where(digest.isNotNull()).select("archive", F.col("place").cast("long").alias("place"), F.coalesce(F.get(f"{c}_index", F.col("place"))["id"].cast("string"), F.lit("")).alias("key"), digest.alias("digest"))
        sides.append(own.withColumn("n", F.row_number().over(Window.partitionBy("archive", "key", "digest").orderBy("place"))))
    left, right = ((own.join(other, ["archive", "key", "digest", "n"], "left_anti")) for own, other in (sides, sides[::-1]))
    left, right = (t.select("archive", "key", F.row_number().over(Window.partitionBy("archive", "key").orderBy("place")).alias("n"), F.col("place").alias(c)) for t, c in ((left, "here"), (right, "there")))
    both = left.join(right, ["archive", "key", "n"], "full_outer")
    fault = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").otherwise("corrupt")
    return both.select("archive", F.coalesce("here", "there").alias("place"), fault.alias("fault"))


def _records(t: DataFrame) -> DataFrame:
    each = t.select("archive", F.posexplode(F.arrays_zip("index", F.get("levels", F.lit(0)).alias("leaf"))).alias("place", "r"))
    return each.select(F.col("r.index.id").alias("id"), "archive", F.col("place").cast("long").alias("place"), F.col("r.index.start").alias("start"), F.col("r.index.length").alias("length"), F.col("r.index.copies").alias("copies"), F.substring_index("r.leaf.digest", "*", 1).alias("digest"))


def report(first: DataFrame, second: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per record of either replica, read from stored archives: id, archive, place, start, length, copies, digest, fault (null: intact)."""
    a, b = trees(first), trees(second)
    faults, _ = audit(a, b)
    faults = saved(faults)
    found = _records(a).join(faults.where("fault <> 'extra'"), ["archive", "place"], "left")
    extra = _records(b).join(faults.where("fault = 'extra'"), ["archive", "place"])
    return found.unionByName(extra).select(F.col("id").alias(id_col), "archive", "place", "start", "length", "copies", "digest", "fault")


def drill(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes two replicas of pages to the shared folder, the second with wrong bytes, and reports what an audit of the stored bytes finds."""
    folder = f"{_shared_folder(pages.sparkSession)}/replicas-{uuid.uuid4().hex}"
    one = write_archives(archives(pages, **columns), f"{folder}/a")
    two = write_archives(damaged(one), f"{folder}/b")
    out = report(one, two, columns.get("id_col", "page_id"))
    dropped(pages.sparkSession, folder)  # what was read from it is saved
    return out


#: DuckDB SQL for the registered query (ids there are not null and not negative, and don't repeat).
ORACLE = f"""
WITH pages_ AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS eol FROM pages),
whole AS (SELECT page_id, page_id // 1024 * 2 AS archive, 'WARC/1.1' || eol || 'WARC-Type: resource' || eol || 'WARC-Record-ID: <urn:page:' || page_id || '>' || eol || 'WARC-Date: {DATE}' || eol || 'WARC-Target-URI: ' || url || eol
  || 'Content-Type: text/html' || eol || 'Content-Length: ' || strlen(html) || eol || eol || html || eol || eol AS a FROM pages_),
placed AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY page_id) - 1 AS place, sum(strlen(a)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(a) AS start FROM whole)
SELECT page_id, CAST(archive AS BIGINT) AS archive, CAST(place AS BIGINT) AS place, CAST(start AS BIGINT) AS start, CAST(strlen(a) AS BIGINT) AS length, CAST(1 AS BIGINT) AS copies, sha256(a) AS digest, CASE WHEN page_id % 997 = 5 THEN 'corrupt' END AS fault FROM placed
"""
