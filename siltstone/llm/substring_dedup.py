"""Removal of word passages that repeat anywhere in the corpus (exact).

A window is ``window`` consecutive words of one row.  Every word covered by a
window whose words also start at another place (another row or the same one)
is removed; windows are judged on the input.

Method: prefix-partitioned suffix trees over anchored suffixes.

1. Anchors.  In each window the ``PREFIX``-word run with the least hash (the leftmost of equals) is its anchor.  Equal
   windows have equal anchors at equal offsets, so only the suffixes around anchors, about one word in 14, are needed.
2. Prefixes are counted, with pre-aggregation.  A suffix whose prefix is the only one of its kind repeats nothing and goes no further.
3. Variable length.  Suffixes that share a prefix are a group; where more than ``GROUP`` do, the
   prefix is lengthened to the whole window, at each offset, so that a group has a size that fits in memory.
4. Trees.  A group's suffixes travel with their words.  The levels of its tree at depths 1, 2, 4, ... up to the window are
   built by naming (Karp, Miller and Rosenberg): the name of a node at depth 2d is the rank of its pair of names at depth d.
   Words are compared as they are, not by hash.  A node at the window's depth with two leaves or more is a deep internal node:
   the part of a maximal repeat that this anchor sees.  Where the prefix is a whole window, the
   group is the node itself: it is counted and never gathered (such windows are compared by 128 bits).
5. Repeats return to their rows as runs of window starts, and a last pass over the texts drops the covered words.  The texts are
   shuffled once, for both visits.

Copies inside one slab (about a megabyte of texts) are combined before they travel, by two 64-bit hashes, so a passage held by a
third of all rows sends one record a slab, not one a row.  A task holds whole groups of up to ``GROUP`` suffixes, ``_HELD`` of them at once.

Defined results: null text has no words; a row with fewer words than
the window loses nothing; repeated rows repeat all of their windows, also when
they share the id; null ids are ids like others; an empty table gives no rows;
columns beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm import words as W
from siltstone.llm.shared import lean, row_key, saved

PREFIX = 8
GROUP = 4096
_HELD = 16_384
_BITS = 24
_PIECE = 1 << 20  # words of a very long text taken at once

SUFFIXES = "prefix long, kind byte, rid long, rid2 int, start int, width int, words binary"
RUNS = "rid long, rid2 int, start int, run int"
#: Kinds of records: a suffix that is new in its slab, one with copies there (a repeat, known already, and a witness
#: for other slabs), and such a copy, which only takes its verdict home.
_NEW, _KNOWN, _COPY = 0, 1, 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has width values."""
    step = 1
    out = x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchored(hashes: np.ndarray, counts: np.ndarray, window: int, prefix: int):
    """For the texts of a slab: anchor prefix, text, first window (counted in the slab and in its text), its distance to the anchor, and how many windows there are."""
    n = len(hashes)
    if n < window:
        return None
    first_word = np.concatenate(([0], np.cumsum(counts)))
    text_of = np.repeat(np.arange(len(counts)), counts)
    valid = np.arange(n) <= first_word[1:][text_of] - window
    valid = valid[: n - window + 1]
    if not valid.any():
        return None
    g = W.grams(hashes, prefix)
    packed = (g & ~W.U((1 << _BITS) - 1)) | np.arange(len(g), dtype=W.U)
    anchor = (_sliding_min(packed, window - prefix + 1) & W.U((1 << _BITS) - 1)).astype(np.int64)
    at = np.flatnonzero(valid)
    anchor, texts = anchor[at], text_of[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (texts[1:] != texts[:-1])
    rows = np.flatnonzero(new)
    return g[anchor[rows]], texts[rows], at[rows], at[rows] - first_word[texts[rows]], anchor[rows] - at[rows], np.diff(np.append(rows, len(at)))


def _scanned(batch: pa.RecordBatch, window: int, prefix: int):
    """Slabs of a batch with their anchors: bytes, word starts and ends, hashes, and (prefix, text, word, start, delta, width) of each anchor."""
    raw, offsets = W.texts_of(batch.column("text"))
    for i, j in W.slabs(offsets):
        part = raw[offsets[i] : offsets[j]]
        # a text of its own may have any number of words: pieces that overlap by a window less a word
        begins, ends, hashes, counts = W.split(part, offsets[i : j + 1] - offsets[i])
        for lo in range(0, max(len(hashes), 1), _PIECE - window + 1):
            alone = j - i == 1
            piece = hashes[lo : lo + _PIECE] if alone else hashes
            found = _anchored(piece, np.array([len(piece)]) if alone else counts, window, prefix)
            if found:
                g, texts, word, start, delta, width = found
                shift = lo if alone else 0
                yield part, begins, ends, hashes, (g, texts + i, word + shift, start + shift, delta, width)
            if not alone:
                break


def _counts(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, found in _scanned(batch, window, prefix):
                g, n = np.unique(found[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["prefix", "n"])

    return run


def _places(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, rid2 = batch.column("rid").to_numpy(), batch.column("rid2").to_numpy()
            for *_, (g, texts, _, start, _, _) in _scanned(batch, window, prefix):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(rid[texts]), pa.array(rid2[texts]), pa.array(start.astype(np.int32))], ["prefix", "rid", "rid2", "start"])

    return run


def _suffixes(window: int, prefix: int, heavy: bool):
    """Records of the suffixes named in the column starts: those of light groups with their words, or the windows of heavy ones as prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, rid2 = batch.column("rid").to_numpy(), batch.column("rid2").to_numpy()
            wanted = batch.column("starts")
            owner = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            values = wanted.values.slice(wanted.offsets[0].as_py(), len(owner))
            # (text, start) of the wanted anchors as one sorted number
            named = np.sort((owner[np.asarray(values.field(1)) == heavy] << 32) + np.asarray(values.field(0))[np.asarray(values.field(1)) == heavy])
            for part, begins, ends, hashes, (g, texts, word, start, delta, width) in _scanned(batch, window, prefix):
                at = np.searchsorted(named, (texts << 32) + start)
                use = np.flatnonzero((at < len(named)) & (named[np.minimum(at, len(named) - 1)] == (texts << 32) + start)) if len(named) else []
                if not len(use):
                    continue
                g, texts, word, start, delta, width = (x[use] for x in (g, texts, word, start, delta, width))
                last = word + width + window - 1
                # copies within the slab: equal in anchor, offset, width and both hashes of their words
                both = np.empty(len(g), "V32")
                both_view = both.view(W.U).reshape(-1, 4)
                both_view[:, 0], both_view[:, 1] = g, (delta * 64 + width).astype(W.U)
                both_view[:, 2], both_view[:, 3] = W.spans(hashes, word, last), W.spans(hashes, word, last, second=True)
                _, first, back, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
                kind = np.where(n[back] > 1, np.where(first[back] == np.arange(len(g)), _KNOWN, _COPY), _NEW).astype(np.int8)
                own = kind != _COPY
                if heavy:
                    # each window is a prefix of its own
                    k = np.repeat(np.flatnonzero(own), width[own])
                    step = np.arange(len(k)) - np.repeat(np.cumsum(width[own]) - width[own], width[own])
                    place = word[k] + step
                    one, two = W.spans(hashes, place, place + window), W.spans(hashes, place, place + window, second=True)
                    words = [x.tobytes() for x in two]
                    out = (one, kind[k], texts[k], (start[k] + step), np.ones(len(k), np.int64), words)
                    yield _records(*out, rid, rid2)
                else:
                    data = part.tobytes()
                    a, b = begins[word[own]].tolist(), ends[last[own] - 1].tolist()
                    yield _records(g[own], kind[own], texts[own], start[own], width[own], [data[x:y] for x, y in zip(a, b, strict=True)], rid, rid2)
                if not own.all():
                    c = np.flatnonzero(~own)
                    yield _records(W.mix(g[c] + W.mix(start[c].astype(W.U) ^ rid[texts[c]].view(W.U))), kind[c], texts[c], start[c], width[c], [None] * len(c), rid, rid2)

    return run


def _records(key, kind, texts, start, width, words, rid, rid2) -> pa.RecordBatch:
    full = [key.view(np.int64), kind, rid[texts], rid2[texts], start.astype(np.int32), width.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*[pa.array(x) for x in full], pa.array(words, pa.binary())], ["prefix", "kind", "rid", "rid2", "start", "width", "words"])


def _named(codes: np.ndarray, depth: int) -> np.ndarray:
    """Names of the runs of depth codes that start at each place: equal names, equal runs."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    names, d = codes.astype(np.int64), 1
    while 2 * d <= depth:
        names, d = pair(names[:-d], names[d:]), 2 * d
    rest = depth - d
    return pair(names[:-rest], names[rest:]) if rest else names


def _runs(rid, rid2, start, hit, width):
    """Runs of flagged windows; hit holds a flag for each window of each record."""
    at = np.flatnonzero(hit)
    if not len(at):
        return None
    record = np.repeat(np.arange(len(width)), width)[at]
    begin = np.concatenate(([0], np.cumsum(width)))[:-1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (record[1:] != record[:-1])
    first = np.flatnonzero(new)
    r = record[first]
    length = np.diff(np.append(first, len(at)))
    return pa.RecordBatch.from_arrays([pa.array(rid[r]), pa.array(rid2[r]), pa.array((start[r] + at[first] - begin[r]).astype(np.int32)), pa.array(length.astype(np.int32))], ["rid", "rid2", "start", "run"])


def _subtrees(window: int):
    """Whole groups, sorted by prefix, to the runs of windows below their deep internal nodes."""

    def judge(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        kind, rid, rid2, start = (t.column(c).to_numpy() for c in ("kind", "rid", "rid2", "start"))
        width = t.column("width").to_numpy().astype(np.int64)
        own = kind != _COPY
        hit = np.ones(int(width.sum()), bool)
        if own.any():
            raw, offsets = W.texts_of(t.column("words").filter(pa.array(own)).cast(pa.string()))
            begins, ends, _, counts = W.split(raw, offsets)
            word_offsets = np.concatenate(([0], np.cumsum(ends - begins)))
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(word_offsets), pa.py_buffer(W.without_spaces(raw))])
            names = _named(words.dictionary_encode().indices.to_numpy(), window)
            # the windows of a record are its first places, one less than its words less the window
            place = np.repeat(np.cumsum(counts) - counts, width[own]) + np.arange(int(width[own].sum())) - np.repeat(np.cumsum(width[own]) - width[own], width[own])
            leaves = names[place]
            deep = np.bincount(leaves, minlength=1)[leaves] > 1
            hit[np.repeat(own, width)] = deep | np.repeat(kind[own] == _KNOWN, width[own])
        out = _runs(rid, rid2, start, hit, width)
        if out is not None:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column("prefix").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
            if held and keys[0] != held[-1].column("prefix")[-1].as_py() and sum(map(len, held)) >= _HELD:
                yield from judge(held)
                held = []
            if cut and sum(map(len, held)) + cut >= _HELD:
                yield from judge([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from judge(held)

    return run


def _whole_windows(records: DataFrame) -> DataFrame:
    """Runs of heavy groups, where a prefix is a whole window: a node with two leaves or more is found by counting."""
    nodes = records.where(F.col("kind") != _COPY)
    deep = nodes.groupBy("prefix", "words").agg(F.count("*").alias("leaves"), F.max("kind").alias("known")).where(f"leaves > 1 or known = {_KNOWN}").select("prefix", "words")
    hits = nodes.join(deep, ["prefix", "words"]).select("rid", "rid2", "start", F.lit(1).alias("run"))
    return hits.unionByName(records.where(F.col("kind") == _COPY).select("rid", "rid2", "start", F.col("width").cast("int").alias("run")))


def repeated_runs(read: DataFrame, window: int = 35) -> DataFrame:
    """(rid, rid2, start, run): runs of window starts, counted in words from 0, whose windows repeat; read: (id, text, rid, rid2)."""
    prefix = min(PREFIX, window)
    counted = read.select("text").mapInArrow(lean(_counts(window, prefix)), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    common = saved(counted.where("n > 1").select("prefix", (F.col("n") > GROUP).alias("heavy")))
    places = read.select("text", "rid", "rid2").mapInArrow(lean(_places(window, prefix)), "prefix long, rid long, rid2 int, start int")
    # rows that repeat exactly name the same places, once
    starts = places.join(common, "prefix").groupBy("rid", "rid2").agg(F.collect_set(F.struct("start", "heavy")).alias("starts"))
    joined = read.join(starts, ["rid", "rid2"]).select("id", "text", "rid", "rid2", "starts")
    light = joined.mapInArrow(lean(_suffixes(window, prefix, False)), SUFFIXES)
    runs = light.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(lean(_subtrees(window)), RUNS)
    if common.where("heavy").isEmpty():
        return runs
    return runs.unionByName(_whole_windows(joined.mapInArrow(lean(_suffixes(window, prefix, True)), SUFFIXES)))


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.texts_of(batch.column("text"))
            runs = batch.column("runs")
            bounds = runs.offsets.to_numpy()
            starts, lengths = (runs.values.field(i).to_numpy() for i in (0, 1))
            null = np.asarray(runs.is_null())
            n_words, n_removed, kept = [], [], []
            for i in range(len(batch)):
                found = raw[offsets[i] : offsets[i + 1]].tobytes().split()
                total = len(found)
                if not null[i] and bounds[i + 1] > bounds[i]:
                    s = starts[bounds[i] : bounds[i + 1]]
                    e = s + lengths[bounds[i] : bounds[i + 1]] + (window - 1)
                    change = np.zeros(total + 1, np.int64)
                    np.add.at(change, s, 1)
                    np.add.at(change, e, -1)
                    found = list(compress(found, (np.cumsum(change)[:-1] == 0).tolist()))
                n_words.append(total)
                n_removed.append(total - len(found))
                kept.append(b" ".join(found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed and kept_text, the kept words joined by one space."""
    id_, text = docs[id_col], F.coalesce(docs[text_col], F.lit(""))
    read = docs.select(id_.alias("id"), text.alias("text"), row_key(id_, text).alias("rid"), F.hash(text).alias("rid2"))
    runs = repeated_runs(read, window).groupBy("rid", "rid2").agg(F.collect_set(F.struct("start", "run")).alias("runs"))
    joined = read.join(runs, ["rid", "rid2"], "left").select("id", "text", "runs")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(lean(_removed(window)), f"id {kind}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)
