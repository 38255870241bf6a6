"""Temperature mixing of sources, in DataFrame functions only.

Source i with a share p(i) of all tokens gets weight p(i)**a / sum of p**a.  The
exponent a in 0..1 is bisected (``FAN`` ways at once, from one aggregate of the
source table a round) to the flattest mix whose most repeated source stays within
a repetition limit, or to the least flat one that reaches a target entropy.

The budget is given in tokens, or is the least that uses every row at
least once.  A source's budget is met by whole passes and a last part of one, each
in its own pseudo-random order; sources advance in step, so that each block of
``block_tokens`` holds them at their weights; within a block, rows are permuted.

Running token sums, which a pass needs, come in two levels: sums of ``CELLS``
ranges of the order, cumulated for each (source, pass), then sums within a range.
No source is ordered in one task, however large it is.  Rows that repeat
exactly are one unit with a number of copies before that.

Defined results: null source counts as the empty string; rows without words cost
nothing and go where their order puts them; a source without any tokens is used once;
ties in order are broken by id and row hash; an exact copy of a row is used like any row; null ids
pass through; an empty table gives no rows; ``plan`` doesn't read extra columns, and
``mixed`` returns them as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from siltstone.llm.shared import row_key, saved, small

CELLS_LOG2 = 12
CELLS = 1 << CELLS_LOG2
FAN = 32
_WORD = r"[^\x20\x09-\x0D]+"


def units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, key, source, tokens, copies): exact copies of a row are one unit."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), row_key(docs[id_col], docs[source_col], docs[text_col]).alias("key"), F.coalesce(docs[source_col], F.lit("")).alias("source"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("tokens"))
    return rows.groupBy("id", "key", "source", "tokens").agg(F.count("*").alias("copies"))


def exponent(totals: DataFrame, target: str, value: float, budget: int | None, rounds: int = 6) -> float:
    """The exponent that meets the target; totals: (source, share), shares above 0."""
    lo, hi = 0.0, 1.0
    whole = totals.agg(F.sum("total")).first()[0] or 0
    if not whole:
        return 1.0
    for _ in range(rounds):
        grid = F.array(*[F.lit(lo + (hi - lo) * k / FAN) for k in range(FAN + 1)])
        at = totals.where("share > 0").select("share", F.posexplode(grid).alias("k", "a")).groupBy("k", "a").agg(
            F.sum(F.pow("share", "a")).alias("norm"), F.sum(F.pow("share", "a") * F.log("share")).alias("logs"), F.max(F.pow("share", F.col("a") - 1)).alias("most"), F.min(F.pow("share", F.col("a") - 1)).alias("least")
        )
        entropy = F.log("norm") - F.col("a") * F.col("logs") / F.col("norm")
        repeats = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("norm") * (budget / whole)
        seen = [(r["a"], r["x"]) for r in at.select("k", "a", (entropy if target == "entropy" else repeats).alias("x")).orderBy("k").collect()]
        fits = [x >= value if target == "entropy" else x <= value for _, x in seen]
        if target == "entropy":  # falls with a: the largest that fits
            k = max((i for i, ok in enumerate(fits) if ok), default=0)
            lo, hi = seen[k][0], seen[min(k + 1, FAN)][0]
        else:  # falls with a as well: the least that fits
            k = min((i for i, ok in enumerate(fits) if ok), default=FAN)
            lo, hi = seen[max(k - 1, 0)][0], seen[k][0]
        if lo == hi:
            break
    return lo if target == "entropy" else hi


def weights(rows: DataFrame, target: str = "repetition", value: float = 2.0, budget: int | None = None) -> DataFrame:
    """(source, total, share, weight, tokens_budget, passes): what each source gets.

    target "repetition": no source is passed more than value times;
    "entropy": the weights have at least value times the entropy of equal ones.
    """
    if target not in ("repetition", "entropy"):
        raise ValueError(f"no such target: {target}")
    totals = saved(rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("total")))
    whole = float(totals.agg(F.sum("total")).first()[0] or 0)
    totals = totals.withColumn("share", F.col("total") / F.lit(whole) if whole else F.lit(0.0))
    if target == "entropy":
        value *= math.log(max(totals.where("share > 0").count(), 1))
    a = exponent(totals, target, value, budget)
    powered = totals.withColumn("power", F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(F.lit(0.0)))
    # sums over all sources are one row each
    norm = float(powered.agg(F.sum("power")).first()[0] or 0)
    out = powered.withColumn("weight", F.col("power") / F.lit(norm) if norm else F.lit(0.0))
    all_of = F.lit(float(budget if budget is not None else out.agg(F.max(F.when(F.col("weight") > 0, F.col("total") / F.col("weight")))).first()[0] or 0))
    granted = F.when(F.col("total") > 0, F.round(F.col("weight") * all_of).cast("long")).otherwise(F.lit(0))
    out = out.withColumn("tokens_budget", granted)
    return out.withColumn("exponent", F.lit(a)).withColumn("passes", F.when(F.col("total") > 0, F.col("tokens_budget") / F.col("total")).otherwise(F.lit(1.0))).drop("power")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target: str = "repetition", value: float = 2.0, budget: int | None = None, block_tokens: int = 1 << 18, seed: int = 7) -> DataFrame:
    """One row for each use of a row of docs: id, key, source, tokens, pass, copy, block, position, weight.

    The mix is read in order of (block, position); position counts from 0 in each block.
    """
    rows = saved(units(docs, id_col, text_col, source_col))
    table = saved(weights(rows, target, value, budget))
    blocks = table.agg(F.greatest(F.lit(1), F.ceil(F.sum("tokens_budget") / block_tokens))).first()[0] or 1

    whole = F.when(F.col("total") > 0, F.floor(F.col("tokens_budget") / F.col("total"))).otherwise(F.lit(1))
    dealt = table.withColumn("whole", whole).withColumn("rest", F.col("tokens_budget") - F.col("whole") * F.col("total"))
    dealt = dealt.select("source", "total", "tokens_budget", "weight", "whole", "rest")
    turns = F.sequence(F.lit(0), (F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1)).cast("int"))
    used = rows.join(small(dealt), "source").where("whole > 0 or rest > 0").withColumn("pass", F.explode(turns))
    used = used.withColumn("order", F.xxhash64(F.lit(seed), "pass", "key")).withColumn("cell", F.shiftrightunsigned("order", 64 - CELLS_LOG2).cast("int")).withColumn("cost", F.col("tokens") * F.col("copies"))

    cells = used.groupBy("source", "pass", "cell").agg(F.sum("cost").alias("cost"))
    cells = cells.select("source", "pass", "cell", (F.sum("cost").over(Window.partitionBy("source", "pass").orderBy("cell")) - F.col("cost")).alias("earlier"))
    used = used.join(small(saved(cells)), ["source", "pass", "cell"])
    inside = Window.partitionBy("source", "pass", "cell").orderBy("order", "id", "key").rowsBetween(Window.unboundedPreceding, -1)
    used = used.withColumn("before", F.col("earlier") + F.coalesce(F.sum("cost").over(inside), F.lit(0)))

    last = F.col("pass") == F.col("whole")
    fit = F.when(F.col("tokens") > 0, F.least(F.col("copies"), F.floor((F.col("rest") - F.col("before")) / F.col("tokens")))).otherwise(F.when(F.col("before") < F.col("rest"), F.col("copies")).otherwise(F.lit(0)))
    used = used.withColumn("taken", F.when(last, fit).otherwise(F.col("copies"))).where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("taken"))))

    middle = F.col("pass") * F.col("total") + F.col("before") + (F.col("copy") - 0.5) * F.col("tokens")
    # rows of sources without tokens are spread by their order alone
    way = F.when(F.col("tokens_budget") > 0, middle / F.col("tokens_budget")).otherwise(F.col("cell") / F.lit(float(CELLS)))
    used = used.withColumn("block", F.least(F.floor(way * blocks), F.lit(blocks - 1)))
    shuffled = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "pass", "copy", "key"), "pass", "copy", "id", "key")
    return used.withColumn("position", F.row_number().over(shuffled) - 1).select("id", "key", "source", "tokens", "pass", "copy", "block", "position", "weight")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as the plan uses them, each block's rows together and in order; the columns of docs."""
    uses = plan(docs, id_col, text_col, source_col, **options)
    uses = uses.groupBy("key").agg(F.collect_list(F.struct("copy", "block", "position")).alias("uses"))
    # the row travels as one value, so that no name in it can clash
    rows = docs.select(row_key(docs[id_col], docs[source_col], docs[text_col]).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    numbered = rows.join(uses, "key").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    used = numbered.select("row", F.explode(F.filter("uses", lambda u: u["copy"] == F.col("n"))).alias("use"))
    placed = used.select("row", F.col("use.block").alias("block"), F.col("use.position").alias("position"))
    return placed.repartition("block").sortWithinPartitions("block", "position").select("row.*")
