"""Ranked lexical search of a stated query set over all documents, by sort-based accumulation.

A term is a maximal run of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased.  Integer weights:

    w(term)      = floor(1000 ln((2 N + 2) / (2 df + 1)))
    m(document)  = 10 + (90 n N) div L
    impact       = w * ((10^9 tf) div (1000 tf + 8 m))

1. The query set is taken in blocks of up to ``BLOCK`` bytes of text, each a table of terms and the items that
   hold them; a task gets one block.
2. A first pass over the documents counts N, L and, for the block's terms alone, df: a few sums a task.
3. In a second pass each task accumulates its own range of documents, slab by slab: matched words become
   (document, term) keys and their runs tf; impacts are repeated for every item that holds the term; the arrays of
   (item, document) keys and impacts are sorted together (radix sort, 16 bits a turn) and summed by ``reduceat``.
   Heaps keep the best documents of each item, and only those leave the task.
4. Heaps of all tasks are merged for each item in salted groups, then as a whole.

A document is one row, so all its impacts meet in one task and nothing but heaps is shuffled.  Memory is bounded
by a slab of a megabyte (or one text) times the items a term is in.

Defined results: null or blank text has no terms (neither N nor L counts it, and as an item it returns no rows);
every row is a document or an item of its own, repeated ids included; a null doc_id ranks after all others of the
same score; fewer than ``k`` documents with a score above 0: all of them; empty tables give no rows; columns beside
ids and texts are not read.  Words are told apart by 64-bit hashes and their lengths.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siltstone.llm import words as W
from siltstone.llm.shared import fresh, lean, saved

#: Bytes of query text in a block, and groups in which an item's heaps are merged first.
BLOCK, SALTS = 8 << 20, 64
_N, _L = -1, -2


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts non-negative keys: stable, least significant 16 bits first."""
    order = None
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = (keys >> shift).astype(np.uint16)  # the low 16 bits are left
        if order is None:
            order = np.argsort(digit, kind="stable")
        else:
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


class Block:
    """The terms of a block of items: their hashes (sorted) and lengths, and the items that hold each, end to end."""

    def __init__(self, texts: list[str | None]):
        raw, offsets = W.texts_of(pa.array(texts, pa.large_string()))
        starts, ends, hashes, counts = W.split(raw, offsets, True, W.NOT_ALPHANUMERIC)
        self.items = len(texts)
        self.hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.sizes = (ends - starts)[first]
        pairs = np.unique(inverse.reshape(-1).astype(np.int64) * max(self.items, 1) + np.repeat(np.arange(self.items), counts))
        self.item = pairs % max(self.items, 1)
        self.at = np.searchsorted(pairs // max(self.items, 1), np.arange(len(self.hashes) + 1))

    def postings(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and occurrences of all the block's terms in these texts, and how many terms each text has."""
        starts, ends, hashes, counts = W.split(raw, offsets, True, W.NOT_ALPHANUMERIC)
        if not len(self.hashes):
            none = np.zeros(0, np.int64)
            return none, none, none, counts
        term = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[term] == hashes) & (self.sizes[term] == ends - starts))
        doc = np.searchsorted(np.cumsum(counts), hit, "right")
        keys, tf = _summed(doc * len(self.hashes) + term[hit], np.ones(len(hit), np.int64))
        return keys // len(self.hashes), keys % len(self.hashes), tf, counts


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, offsets = W.texts_of(batch.column("text"))
        for i, j in W.slabs(offsets):
            yield batch.column("doc_id").slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _counted(block: Block):
    """Rows (term, documents that hold it) of a task, with documents and terms as a whole under _N and _L."""

    @lean
    def run(batches):
        held, documents, length = np.zeros(len(block.hashes), np.int64), 0, 0
        for _, raw, offsets in _slabs(batches):
            _, term, _, counts = block.postings(raw, offsets)
            held += np.bincount(term, minlength=len(held))
            documents, length = documents + int((counts > 0).sum()), length + int(counts.sum())
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array([_N, _L, *some.tolist()], pa.int64()), pa.array([documents, length, *held[some].tolist()], pa.int64())], ["term", "n"])

    return run


def norms(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of documents with n terms; products beyond 64 bits are taken in Python's integers."""
    if not len(n) or 90 * int(n.max()) * documents < 1 << 63:
        return 10 + 90 * n * documents // max(length, 1)
    sizes, inverse = np.unique(n, return_inverse=True)
    return np.array([10 + 90 * int(x) * documents // length for x in sizes], np.int64)[inverse]


def _heaps(block: Block, weights: np.ndarray, documents: int, length: int, k: int, kind: pa.DataType):
    """The k best documents of each item among a task's."""

    @lean
    def run(batches):
        heaps: list[list[tuple]] = [[] for _ in range(block.items)]
        least, later = np.ones(block.items, np.int64), 0
        for ids, raw, offsets in _slabs(batches):
            doc, term, tf, counts = block.postings(raw, offsets)
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norms(counts, documents, length)[doc]))
            times = np.diff(block.at)[term]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item = block.item[np.repeat(block.at[term], times) + within]
            keys, scores = _summed(item * len(counts) + np.repeat(doc, times), np.repeat(impact, times))
            item, doc = keys // len(counts), keys % len(counts)
            for x in np.flatnonzero(scores >= least[item]).tolist():
                i, name, later = int(item[x]), ids[int(doc[x])].as_py(), later + 1
                entry = (int(scores[x]), name is not None, -(name or 0), -later)
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], entry)
                else:
                    heapq.heappushpop(heaps[i], entry)
                if len(heaps[i]) == k:
                    least[i] = max(heaps[i][0][0], 1)
        rows = [(i, e[0], -e[2] if e[1] else None) for i, heap in enumerate(heaps) for e in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), kind), strict=True)], ["item", "score", "doc_id"])

    return run


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    docs, items = fresh(docs, "doc_id", "text"), fresh(items, "item_id", "text")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, outs = max(1, -(-size // BLOCK)), []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK bytes
        block = Block([r.text for r in rows])
        sums = docs.mapInArrow(_counted(block), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        known = {r.term: r.n for r in sums.collect()}  # of the block's terms alone
        documents, length = known.pop(_N, 0), known.pop(_L, 0)
        weights = np.zeros(max(len(block.hashes), 1), np.int64)
        for term, df in known.items():
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        found = docs.mapInArrow(_heaps(block, weights, documents, length, k, pa.int64()), "item int, score long, doc_id long")
        parts = _best(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "item", "salt").drop("rank", "salt")
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        out = _best(parts, k, "item").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        outs.append(out if blocks == 1 else saved(out))
    whole = outs[0]
    for out in outs[1:]:
        whole = whole.unionByName(out)
    return whole


#: DuckDB: letters are lowered by translate, as lower() would change letters beyond ASCII.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
wanted AS (SELECT DISTINCT item, unnest(terms) AS term FROM i),
posting AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY row, term),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, total GROUP BY term),
score AS (SELECT item, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM posting JOIN weight USING (term) JOIN wanted USING (term), total GROUP BY item, row),
ranked AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= 10
"""
