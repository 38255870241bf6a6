"""Merkle manifest of a dataset: a tree for each language and one above them, with a proof for every row.

H is the lowercase hex SHA-256 of its inputs, end to end.  A leaf is H of a row's fields, each ``-`` if null and
else its bytes' count, ``:`` and its value.  Per tree, leaves ascend by doc_id, and every ``FANOUT`` consecutive nodes
become their H until one is left; the roots of the languages, in bytewise order with null first, are the leaves of
the tree above.

Superblock reduction: nodes are numbered within their tree without gathering it (rows are dealt by ranges, and the
counts of ranges give each its first number), number div FANOUT**LEVELS is a bucket, and each bucket folds LEVELS
levels by itself; the buckets' roots are the nodes of the next round, until each tree has one.  On the way down
each bucket meets the proof of its own root, and a node's proof is its siblings inside the bucket followed by
that.  A task holds one bucket of FANOUT**LEVELS nodes at a time; a round shuffles digests, never texts.

A proof is the siblings' digests from leaf to root, in one string, with the node's place and its run's width at every level;
``folded`` computes the root from a leaf and a proof, so rows are verified without the tree.

Defined results: null fields as above (null and empty differ); rows with a null doc_id come before others of their
language; rows with equal ids follow the order of their leaves, equal rows have neighbouring places and proofs of
their own; a single row is its own root with an empty proof; empty tables give no rows; columns beside the five are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.shared import fresh, saved, small

#: Nodes of a run, and levels that a bucket folds.
FANOUT, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "proof string, places array<int>, widths array<int>, subroot string, root string"


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def lowered(text: Column) -> Column:
    """text with A-Z lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _height(n: Column) -> Column:
    """Levels above n nodes."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda i: n > F.pow(F.lit(FANOUT), i)))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with their number idx within the tree by order, which is unique there, and the tree's count n."""
    ranged = saved(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order))
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())  # partition and place, as saved
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(part.alias("_part"), "tree").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole, earlier = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", "tree", "_first", F.sum("_n").over(whole).alias("n"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", part).join(small(runs), ["_part", "tree"])
    return out.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _runs(nodes: list[str]) -> list[str]:
    return ["".join(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]


def _above(runs: list[str]) -> list[str]:
    return [sha256(run.encode()).hexdigest() for run in runs]


def _bucketed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("idx") / FANOUT**LEVELS)).withColumn("levels", F.least(_height(F.col("n")), F.lit(LEVELS)))


def _folded_up(nodes: DataFrame) -> DataFrame:
    """The next round's nodes: the root of each bucket."""

    def up(frame: pd.DataFrame) -> pd.DataFrame:
        digests = [x.hex() for x in frame.sort_values("idx")["digest"]]
        for _ in range(frame["levels"].iloc[0]):
            digests = _above(_runs(digests))
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "idx": frame["bucket"].iloc[:1], "n": -(-frame["n"].iloc[:1] // FANOUT**LEVELS), "digest": [bytes.fromhex(digests[0])]})

    return _bucketed(nodes).select("tree", "idx", "n", "digest", "bucket", "levels").groupBy("tree", "bucket").applyInPandas(up, "tree string, idx long, n long, digest binary")


def _proved(nodes: DataFrame, paths: DataFrame, *more: str) -> DataFrame:
    """nodes with their paths, from the paths (tree, idx, ...) of their buckets; more: string columns that go along."""

    def down(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        top = above.iloc[0]
        digests, count = [x.hex() for x in frame["digest"]], len(frame)
        proofs, places, widths = [[] for _ in range(count)], [[] for _ in range(count)], [[] for _ in range(count)]
        for level in range(frame["levels"].iloc[0]):
            runs = _runs(digests)
            for i in range(count):
                node = i // FANOUT**level
                run, place = runs[node // FANOUT], node % FANOUT
                proofs[i].append(run[: 64 * place] + run[64 * (place + 1) :])
                places[i].append(place)
                widths[i].append(len(run) // 64)
            digests = _above(runs)
        high, rest = list(top["places"]), list(top["widths"])
        out = frame[["tree", "idx", "digest", *more]].copy()
        out["proof"] = ["".join(x) + top["proof"] for x in proofs]
        out["places"], out["widths"] = [x + high for x in places], [x + rest for x in widths]
        out["subroot"], out["root"] = top["subroot"], top["root"]
        return out

    schema = "tree string, idx long, digest binary, " + "".join(f"{c} string, " for c in more) + _PATH
    own = _bucketed(nodes).select("tree", "idx", "digest", *more, "bucket", "levels")
    above = paths.select("tree", F.col("idx").alias("bucket"), "proof", "places", "widths", "subroot", "root")
    return own.groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket")).applyInPandas(down, schema)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes, and the nodes of each further round; the last has one for each tree."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(saved(_folded_up(rounds[-1]), -(-most // FANOUT**LEVELS)))
        most = -(-most // FANOUT**LEVELS)
    return rounds


def _descended(rounds: list[DataFrame], paths: DataFrame, *more: str) -> DataFrame:
    for k, nodes in reversed(list(enumerate(rounds[:-1]))):
        paths = _proved(nodes, paths, *(more if k == 0 else ()))
        if k:
            paths = saved(paths)
    return paths


def manifest(df: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, places, widths, claimed) of every row.

    claimed: a leaf (hex) that a copy of the row shows, computed where the row is read; null where none is.
    """
    docs = fresh(df, *FIELDS)
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("+"), "lang"))  # null first, then bytewise
    claim = F.lit(None).cast("string") if claimed is None else claimed
    leaves = docs.select(tree.alias("tree"), "doc_id", F.unhex(leaf(*[F.col(c) for c in FIELDS])).alias("digest"), F.unhex(claim).alias("claimed"))
    # equal rows are counted, then numbered: a key that differs for every row, so that ranges can part them
    leaves = leaves.groupBy("tree", "doc_id", "digest", "claimed").agg(F.count("*").alias("copies"))
    leaves = leaves.select("tree", "doc_id", "digest", "claimed", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    leaves = _numbered(leaves, "doc_id", "digest", "copy").drop("copy")
    # pandas has no whole numbers with nulls: ids and claims go along as strings
    carried = leaves.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("claimed", F.lower(F.hex("claimed")))
    rounds = _rounds(carried)

    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = _rounds(_numbered(subroots, "name"))
    hexed = F.lower(F.hex("digest"))
    none = F.array().cast("array<int>")
    paths = tops[-1].withColumn("proof", F.lit("")).withColumn("places", none).withColumn("widths", none).withColumn("subroot", hexed).withColumn("root", hexed)
    paths = saved(_descended(tops, paths, "name"))
    paths = paths.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "proof", "places", "widths", hexed.alias("subroot"), "root")
    if len(rounds) == 1:  # no tree has more than one row
        out = carried.join(paths.drop("idx"), "tree")
    else:
        out = _descended(rounds, paths, "doc_id", "claimed")
    kind = df.schema["doc_id"].dataType
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), hexed.alias("leaf"), "subroot", "root", "proof", "places", "widths", "claimed")


def folded(start: Column, proof: str, places: str, widths: str) -> Column:
    """The root that a leaf and a proof give."""

    def step(acc: Column, x: Column) -> Column:
        left, right = 64 * x["places"], 64 * (x["widths"] - 1 - x["places"])
        run = F.concat(F.col(proof).substr(acc["at"], left), acc["digest"], F.col(proof).substr(acc["at"] + left, right))
        return F.struct(F.sha2(run, 256).alias("digest"), (acc["at"] + left + right).alias("at"))

    return F.aggregate(F.arrays_zip(F.col(places).alias("places"), F.col(widths).alias("widths")), F.struct(start.alias("digest"), F.lit(1).alias("at")), step)["digest"]


def audited(df: DataFrame) -> DataFrame:
    """The contract's columns: rows whose id's CRC-32 is a multiple of 3 show a text with A-Z lower-cased, and are held against their proofs."""
    changed = leaf(*[lowered(df[c]) if c == "text" else df[c] for c in FIELDS])
    chosen = F.crc32(df["doc_id"].cast("string")) % 3 == 0
    docs = df.select(*[df[c] for c in FIELDS])
    out = manifest(docs, F.when(chosen, changed))
    out = out.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), "proof", "places", "widths"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def oracle(levels: int = 8, top_levels: int = 3) -> str:
    """DuckDB SQL, a table a level: up to FANOUT**levels rows a language and FANOUT**top_levels languages."""
    as_field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    own = " || ".join(as_field(c) for c in FIELDS)
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    other = " || ".join(as_field(low if c == "text" else c) for c in FIELDS)
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])), 4294967295)"
    parts = [
        f"crc AS (SELECT {_crc_table()}::BIGINT[] AS crc_table)",
        f"rows AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, sha256({own}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({other}) END AS claimed FROM documents, crc)",
        "l0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest, doc_id, leaf, claimed FROM rows)",
    ]

    def climb(prefix: str, steps: int) -> None:
        run = f"PARTITION BY tree, idx // {FANOUT} ORDER BY idx ROWS BETWEEN"
        for k in range(steps):
            sides = [f"CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER ({run} {frame}), '') ELSE '' END AS {name}" for name, frame in (("low", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("high", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))]
            parts.append(f"{prefix}s{k} AS (SELECT tree, idx, n, {', '.join(sides)} FROM {prefix}{k})")
            parts.append(f"{prefix}{k + 1} AS (SELECT tree, idx // {FANOUT} AS idx, (max(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE max(digest) END AS digest FROM {prefix}{k} GROUP BY tree, idx // {FANOUT})")

    climb("l", levels)
    parts.append(f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest, tree AS name FROM l{levels})")
    climb("t", top_levels)
    parts.append(f"f0 AS (SELECT doc_id, leaf, l0.tree AS tree, l0.idx AS idx, t0.idx AS top, t0.digest AS subroot, t{top_levels}.digest AS root, coalesce(claimed, leaf) AS digest, '' AS proof FROM l0 JOIN t0 ON t0.name = l0.tree, t{top_levels})")
    steps = [("l", k, f"f.tree = s.tree AND f.idx // {FANOUT**k} = s.idx") for k in range(levels)] + [("t", k, f"f.top // {FANOUT**k} = s.idx") for k in range(top_levels)]
    for i, (prefix, k, on) in enumerate(steps):
        parts.append(f"f{i + 1} AS (SELECT doc_id, leaf, f.tree AS tree, f.idx AS idx, top, subroot, root, CASE WHEN s.n > 1 THEN sha256(low || digest || high) ELSE digest END AS digest, proof || low || high AS proof FROM f{i} f JOIN {prefix}s{k} s ON {on})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM f{len(steps)}"
