"""Search, decontamination and the manifest against plain versions, on odd rows and on the whole smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, manifest, ranked_search
from tests.conftest import SF
from tests.llm import helpers as H

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"passage{i % 17}" for i in range(40))
ITEMS = [
    (0, "one two"), (1, PASSAGE), (2, None), (3, " ,. \n"), (4, "ONE"), (4, "one two"), (None, PASSAGE + " " + H.SHARED), (5, H.SHARED), (6, "Shared0! shared1? shared2; shared3, shared4. shared5 shared6 shared7 shared8"),
    (7, "a b a b a b a b a b a b a"), (8, "don’t we’ll cödé TEXT"), (9, "日本語 🙂"), (10, H.LONG[:3000]), (11, PASSAGE), (11, PASSAGE), (12, "token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
]
DOCS = [*H.ODD, (30, "x. " + PASSAGE.upper() + " y", "en", "a"), (31, (PASSAGE + "\n") * 3, "en", "a"), (32, " ".join(PASSAGE.split()[:12]), "en", "a"), (33, " ".join(PASSAGE.split()[:9]), "en", "a"), (34, "one, two one", None, "b"), (35, "A B", "en", "a")]


def tables(spark, which):
    """Rows of documents and of items, and their tables with columns whose names clash."""
    if which == "table":
        docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
        return [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], docs, items
    rows, asked = ([] if which == "no documents" else DOCS), ([] if which == "no items" else ITEMS)
    docs = spark.createDataFrame([(*r, 0, "x", 1, 2, "y") for r in rows], H.SCHEMA + ", item_id string, `rank` int, score int, tree string")
    items = spark.createDataFrame([(*r, 7, "z") for r in asked], "item_id long, text string, doc_id int, win string")
    return [r[:2] for r in rows], asked, docs.repartition(3), items


WHICH = pytest.mark.parametrize("which", ["odd", "no documents", "no items", "table"])


# search


def searched(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(i, Counter(x), len(x)) for i, t in rows if (x := terms(t))]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, held, _ in docs for t in held)
    out = []
    for item, text in items:
        scored = []
        for i, held, n in docs:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * held[t] // (1000 * held[t] + 8 * m)) for t in set(terms(text)) if t in held)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@WHICH
def test_search(spark, which):
    rows, asked, docs, items = tables(spark, which)
    out = ranked_search.search(docs, items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    H.same(out.collect(), searched(rows, asked))


def test_search_in_blocks_of_items_and_with_a_large_group_of_equal_documents(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 40)
    monkeypatch.setattr(ranked_search, "SALTS", 3)
    rows = [(i, "Common words here" if i % 3 else f"rare{i} words") for i in range(300)]
    asked = [(i, f"common rare{3 * i} here") for i in range(8)] + [(None, "words"), (9, "")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "item_id long, text string")
    H.same(ranked_search.search(docs, items).collect(), searched(rows, asked))
    H.same(ranked_search.search(docs, items, k=3).collect(), searched(rows, asked, 3))


def test_radix_order_is_stable_and_wide():
    rng = np.random.default_rng(4)
    for top in (1, 1 << 10, 1 << 16, 1 << 40, (1 << 62)):
        keys = rng.integers(0, top, 3000)
        assert np.array_equal(ranked_search.radix_order(keys), np.argsort(keys, kind="stable"))
    assert len(ranked_search.radix_order(np.zeros(0, np.int64))) in (0,)


def test_norms_beyond_64_bits():
    n = np.array([1, 10**7, 3, 10**7])
    assert ranked_search.norms(n, 10**12, 10**15).tolist() == [10 + 90 * int(x) * 10**12 // 10**15 for x in n]


# decontamination


def found(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    runs = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(len(w), window) + 1 if w else 0):
            runs[tuple(w[i : i + window])].add(item)
    out = []
    for i, text in rows:
        w, hit, met = words(text), set(), set()
        for size in {len(r) for r in runs}:
            for s in range(len(w) - size + 1):
                if (run := tuple(w[s : s + size])) in runs:
                    hit.update(range(s, s + size))
                    met |= runs[run]
        names = sorted(str(x) for x in met if x is not None)
        out.append((i, len(w), len(hit), len(names), H.sha(",".join(names)), bool(hit)))
    return out


@WHICH
def test_decontamination(spark, which):
    rows, asked, docs, items = tables(spark, which)
    H.same(decontaminate.digest(decontaminate.contamination(docs, items)).collect(), found(rows, asked))


@pytest.mark.parametrize("window", [1, 2, 4, 13])
def test_decontamination_with_other_windows(spark, window):
    rows, asked, docs, items = tables(spark, "odd")
    H.same(decontaminate.digest(decontaminate.contamination(docs, items, window=window)).collect(), found(rows, asked, window))


def test_decontamination_without_broadcasts_and_with_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    rows = [(i, f"own{i} {PASSAGE} end{i}" if i % 3 == 0 else f"passage0 passage1 passage2 own{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    H.same(decontaminate.digest(decontaminate.contamination(docs, items)).collect(), found(rows, ITEMS))


def test_a_window_is_not_met_by_its_shingles_in_other_places(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f x e f g h i j"), (3, "z a b c d e f g h i j"), (4, "b c d e f g h i j a"), (5, "a b c d e f g h i")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "A,b c-d e f g h i j")], "item_id long, text string")
    H.same(decontaminate.digest(decontaminate.contamination(docs, items)).collect(), found(rows, [(1, "A,b c-d e f g h i j")]))


def test_decontamination_runs_no_python(spark):
    _, _, docs, items = tables(spark, "odd")
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# manifest


def node(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes, fanout=8):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([node(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def manifested(rows):
    """The contract's columns of rows (doc_id, text, lang, source, n_chars)."""
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda i, t, lang, s, n: node(map(one, (i, s, lang, n, t)))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang in langs:
        order[lang] = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[lang] = levels_of([leaf_of(*r) for r in order[lang]])
    top, out = levels_of([trees[lang][-1][0] for lang in langs]), []
    for place, lang in enumerate(langs):
        for idx, r in enumerate(order[lang]):
            at = leaf_of(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                at = leaf_of(r[0], r[1] and r[1].translate(LOWER), *r[2:])
            proof = ""
            for tree, i in ((trees[lang], idx), (top, place)):
                for level in tree[:-1]:
                    run = level[i // 8 * 8 : i // 8 * 8 + 8]
                    proof += "".join(run[: i % 8] + run[i % 8 + 1 :])
                    at = node([*run[: i % 8], at, *run[i % 8 + 1 :]])
                    i //= 8
            out.append((r[0], leaf_of(*r), trees[lang][-1][0], top[-1][0], node([proof]), at, at == top[-1][0]))
    return out


CASES = {
    "odd": [(i, t, lang, s, len(t or "") if i != 3 else None) for i, t, lang, s in DOCS], "empty": [], "one row": [(5, "One", None, None, 3)], "null and empty languages": [(1, "A", None, "s", 1), (2, None, "", "s", None), (2, "", "", "s", 0)],
    "eight": [(i, f"T{i}", "en", "s", 2) for i in range(8)], "nine": [(i, f"T{i}", "en", "s", 2) for i in range(9)], "powers": [(i, f"Text {i}", "ü" if i < 513 else "z" if i < 577 else f"l{i}", "s", i) for i in range(700)], "equal rows": [(7, "Same", "en", "s", 4)] * 70 + [(8, "Other", "en", "s", 5)] * 3 + [(None, "X", "de", "s", 1)] * 2,
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(spark, case, levels, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = CASES[case]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], H.SCHEMA + ", tree string, idx int, digest string").repartition(3)
    H.same(manifest.audited(docs).collect(), manifested(rows))


def test_manifest_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    out = manifest.audited(docs).collect()
    H.same(out, manifested(rows))
    assert any(r.verified for r in out) and not all(r.verified for r in out)


def test_proofs_hold_for_their_own_rows_alone(spark):
    rows = [(i, f"Text {i}", f"l{i % 3}", "s", i) for i in range(200)]
    docs = spark.createDataFrame(rows, H.SCHEMA)
    out = manifest.manifest(docs).withColumn("again", manifest.folded(F.col("leaf"), "proof", "places", "widths"))
    assert out.where("again <> root").count() == 0 and out.select("root").distinct().count() == 1
    wrong = manifest.manifest(docs).withColumn("again", manifest.folded(F.sha2("leaf", 256), "proof", "places", "widths"))
    assert wrong.where("again = root").count() == 0
    other = manifest.manifest(docs.where("doc_id <> 77")).select("root").first().root
    assert other != out.select("root").first().root
