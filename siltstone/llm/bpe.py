"""Byte-level BPE encoding and decoding through a table of distinct words.

1. Texts are split into words (pre-tokens), and each partition's rows, in the order of their hash, are cut into chunks of
   about ``CHUNK`` characters.  A chunk keeps, for each row, the places of its words in the chunk's own list of distinct
   words; that list is rows of (chunk, place, word), so a word that is in every text costs one row a chunk, not one an occurrence.
2. The lists are dealt by word and sorted: the table of distinct words with, beside each, the places that want it.  Each
   distinct word is encoded once, as the rows stream through.
3. Its ids join the vocabulary (a fixed table: 50,257 pieces, under 1 MB, with a dense key), once for each distinct word.
4. Ids and pieces return to the chunks in packed blocks and are joined back by position.  (``decode`` joins any table of ids with
   the vocabulary as a Spark table.)

A task holds one chunk.  Chunks are made twice, for the lists and for the places.  Both times they are the same, as a partition's
rows are sorted first; should the input itself change between the two, checksums of the words differ and the task fails.

The vocabulary file's path is a parameter and each worker opens it; the file must
be at that path on every machine.

Defined results: null text is the empty text, with no ids; the special token's
string in a text becomes its id, as the tokenizers library does; repeated rows
give equal results; null ids pass through; an empty table gives no rows; columns beside
id and text are not read.
"""

from __future__ import annotations

import os
import pickle
import re
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import count
from unicodedata import category
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm.shared import lean, row_key, saved

CHUNK = 32_000_000
_RUN = 1000  # ids of one list that are put together at once
_SOME = 200_000  # words that are put together at once
_PLACE = 28  # bits of a place in a chunk's list; the chunk's number lies above them
#: The splitting rule of this family of vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


@cache
def pieces(path: str) -> tuple[bytes, ...]:
    """The bytes of every id."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return tuple(out)


@cache
def _unassigned():
    """Finds characters that were unassigned in this Python's Unicode: libraries with newer or older tables may differ on them."""
    edges = [0, *(i for i in range(1, sys.maxunicode + 1) if (category(chr(i)) == "Cn") != (category(chr(i - 1)) == "Cn")), sys.maxunicode + 1]
    runs = [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False) if category(chr(a)) == "Cn"]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]").search


def _latin_pattern() -> re.Pattern:
    """PATTERN with classes cut down to the first 256 characters, which all tables agree on."""
    kind = lambda k: "".join(f"\\x{i:02x}" for i in range(256) if category(chr(i)).startswith(k))
    space = r"\t-\r\x20\x85\xa0"
    return re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kind('L')}{kind('N')}]").replace(r"\p{L}", f"[{kind('L')}]").replace(r"\p{N}", f"[{kind('N')}]").replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]"))


@cache
def _splitter(path: str):
    import regex

    rule, fast, latin, odd = tokenizer(path).pre_tokenizer, regex.compile(PATTERN).findall, _latin_pattern().findall, _unassigned()
    special = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)

    def words(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if odd(text):  # the library's own, slower splitting
                return [text[a:b] for _, (a, b) in rule.pre_tokenize_str(text)]
            return fast(text)
        return latin(text)

    if not special:
        return words
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return words(text)
        out: list[str] = []
        for i, part in enumerate(cut.split(text)):
            out += [part] if i % 2 else words(part)
        return out

    return split


def split(text: str, path: str) -> list[str]:
    """The words of a text; a special token's string is a word of its own."""
    return _splitter(path)(text)


def _pack(values: np.ndarray) -> bytes:
    """Integers with their first, second, ... bytes together, compressed."""
    planes = values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return pickle.dumps((len(planes), pa.Codec("zstd", 9).compress(planes, asbytes=True)))


def _unpack(packed: bytes) -> np.ndarray:
    size, planes = pickle.loads(packed)
    if not size:
        return np.zeros(0, np.uint32)
    return np.ascontiguousarray(np.frombuffer(pa.Codec("zstd").decompress(planes, size), np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


def _chunked(batches: Iterator[pa.RecordBatch], path: str):
    """(chunk, words, ids of rows, places of each row's words) of a partition's rows; frequent words have low places, which pack better."""
    fresh = lambda: defaultdict(count().__next__)  # noqa: E731  a new word gets the next place
    seen, ids, rows, size, number, part = fresh(), [], [], 0, 0, 0
    splitter = _splitter(path)

    def finished():
        counts, places = [len(r) for r in rows], np.concatenate(rows)
        rows.clear()
        common = np.argsort(-np.bincount(places, minlength=len(seen)), kind="stable")
        rank = np.empty(len(common), np.uint32)
        rank[common] = np.arange(len(common), dtype=np.uint32)
        words = list(seen)
        seen.clear()
        return (part << 12) + number, [words[i] for i in common.tolist()], ids, rank[places], counts

    for batch in batches:
        if not len(batch):
            continue
        part = batch.column("part")[0].as_py()
        begin = 0
        for i, text in enumerate(batch.column("text")):  # one text at once
            text = text.as_py() or ""
            found = splitter(text)
            rows.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
            size += len(text)
            if size >= CHUNK:
                ids.append(batch.column("id").slice(begin, i + 1 - begin))
                yield finished()
                seen, ids, rows, size, number, begin = fresh(), [], [], 0, number + 1, i + 1
        if begin < len(batch):
            ids.append(batch.column("id").slice(begin))
    if rows:
        yield finished()


def _lists(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, words, *rest in _chunked(batches, path):
            rest.clear()
            for a in range(0, len(words), 50_000):
                some = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array((number << _PLACE) + np.arange(a, a + len(some))), pa.array(some, pa.string())], ["at", "word"])

    return run


def _crc(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, n)


def _checksum(crc: np.ndarray) -> int:
    """Of a chunk's words in order of place."""
    return int((crc.astype(np.uint64) * (np.arange(len(crc), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum())


def _places(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, words, ids, places, counts in _chunked(batches, path):
            table = pa.table({"id": pa.chunked_array(ids), "n": pa.array(counts, pa.int64())}).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            check = _checksum(_crc(map(str.encode, words), len(words)))
            payload = pickle.dumps((check, sink.getvalue().to_pybytes(), _pack(places)))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([payload], pa.binary())], ["chunk", "payload"])

    return run


def _coded(path: str):
    """Rows (at, word), sorted by word, to (at, ids, piece): each distinct word is encoded once, and its ids are joined with the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary_ = tokenizer(path), pa.array(pieces(path), pa.large_binary())
        last: dict[str, list[int]] = {}  # a word may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            named = batch.column("word").dictionary_encode()
            words = named.dictionary.to_pylist()
            new = [w for w in words if w not in last]
            found = last | dict(zip(new, (e.ids for e in model.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            ids = pa.array([found[w] for w in words], pa.large_list(pa.int32()))
            last = {words[-1]: found[words[-1]]}
            # the vocabulary's key is dense, so that a join by id is a lookup by place; the bytes of a word lie together
            spelled_ = vocabulary_.take(ids.values)
            _, offsets, data = spelled_.buffers()
            edges = np.frombuffer(offsets, np.int64, len(spelled_) + 1)[ids.offsets.to_numpy()]
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.ascontiguousarray(edges)), data])
            yield pa.RecordBatch.from_arrays([batch.column("at"), ids.cast(pa.list_(pa.int32())).take(named.indices), whole.cast(pa.binary()).take(named.indices)], ["at", "ids", "piece"])

    return run


def _strings(values: list[bytes]) -> bytes:
    data = b"".join(values)
    return pickle.dumps((_pack(np.fromiter(map(len, values), np.uint32, len(values))), len(data), pa.Codec("zstd", 9).compress(data, asbytes=True)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, ids, piece), sorted by at, to one packed row for each chunk and task."""

    def packed(chunk: int, held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks()
        ids = t.column("ids").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        flat = ids.flatten().to_numpy().astype(np.uint32)
        lens = np.diff(ids.offsets.to_numpy()).astype(np.uint32)
        place = (t.column("at").to_numpy() & ((1 << _PLACE) - 1)).astype(np.uint32)
        payload = pickle.dumps((_pack(np.diff(place, prepend=np.uint32(0))), _pack(lens), _pack(flat), _strings(t.column("piece").to_pylist())))
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([payload], pa.binary())], ["chunk", "payload"])

    chunk, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        of = batch.column("at").to_numpy() >> _PLACE
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if int(of[a]) != chunk and held:
                yield packed(chunk, held)
                held = []
            chunk = int(of[a])
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield packed(chunk, held)


def _joined_back(kind: pa.DataType):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's rows from the ids and pieces of its words, by position; some rows at once, so that a task holds no chunk's result."""
        mine, parts = [], []
        for batch in batches:
            for own, payload in zip(batch.column("own").to_pylist(), batch.column("payload"), strict=True):
                (mine if own else parts).append(pickle.loads(payload.as_buffer()))
        check, table, packed = mine.pop() if mine else (None, None, None)
        none = np.zeros(0, np.uint32)
        place = np.concatenate([none, *(np.cumsum(_unpack(p[0]), dtype=np.uint32) for p in parts)]).astype(np.int64)
        lens = np.concatenate([none, *(_unpack(p[1]) for p in parts)]).astype(np.int64)
        flat = np.concatenate([none, *(_unpack(p[2]) for p in parts)]).astype(np.int32)
        spelled_ = [pickle.loads(p[3]) for p in parts]
        size = np.concatenate([none, *(_unpack(sizes) for sizes, *_ in spelled_)]).astype(np.int64)
        data = b"".join(pa.Codec("zstd").decompress(data, length, asbytes=True) for _, length, data in spelled_ if length)
        del parts, spelled_
        order = np.argsort(place, kind="stable")
        pieces_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(data)]).take(pa.array(order))
        del data
        # byte-level pieces spell a word's own bytes
        crc = [_crc(some, len(some)) for some in (pieces_.slice(a, _SOME).to_pylist() for a in range(0, len(pieces_), _SOME))]
        if not np.array_equal(place[order], np.arange(len(place))) or _checksum(np.concatenate([none, *crc])) != check:
            raise RuntimeError("the words of a chunk are not those that were encoded: its input has changed in between")
        begin = (np.cumsum(lens) - lens)[order]
        lens, size = lens[order], size[order]
        del place, order, crc
        table, places = pa.ipc.open_stream(table).read_all().combine_chunks(), _unpack(packed)
        del packed
        counts = table.column("n").to_numpy()
        bounds = np.concatenate(([0], np.cumsum(counts)))
        step = 0
        while step < len(counts):
            stop = max(step + 1, int(np.searchsorted(bounds, bounds[step] + _SOME)) - 1)
            here, rows = places[bounds[step] : bounds[stop]], bounds[step : stop + 1] - bounds[step]
            n = lens[here]
            ends = np.concatenate(([0], np.cumsum(n)))
            found = flat[np.arange(int(ends[-1])) + np.repeat(begin[here] - ends[:-1], n)]
            chars = np.concatenate(([0], np.cumsum(size[here])))
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - step, [None, pa.py_buffer(chars[rows]), pieces_.take(pa.array(here)).buffers()[2] or pa.py_buffer(b"")])
            yield from pa.table({"id": table.column("id").slice(step, stop - step).cast(kind), "ids": pa.ListArray.from_arrays(pa.array(ends[rows].astype(np.int32)), pa.array(found)), "decoded": texts.cast(pa.string())}).to_batches()
            step = stop

    return assemble


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids (array of int) and decoded, the text that these ids spell."""
    kind = docs.schema[id_col].dataType
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.spark_partition_id().cast("long").alias("part"), row_key(docs[id_col], docs[text_col]).alias("order"))
    read = read.sortWithinPartitions("order").select("id", "text", "part")
    lists = read.mapInArrow(lean(_lists(path)), "at long, word string")
    coded = lists.repartition("word").sortWithinPartitions("word").mapInArrow(lean(_coded(path)), "at long, ids array<int>, piece binary")
    back = coded.sortWithinPartitions("at").mapInArrow(lean(_blocks), "chunk long, payload binary")
    own = read.mapInArrow(lean(_places(path)), "chunk long, payload binary")
    both = back.withColumn("own", F.lit(False)).unionByName(own.withColumn("own", F.lit(True)))
    out = both.groupBy("chunk").applyInArrow(lean(_joined_back(to_arrow_type(kind))), f"id {kind.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, piece): the bytes that each id spells."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(pieces(path))], "token_id int, piece binary")


def spelled(lists: DataFrame, path: str) -> DataFrame:
    """(row, piece) of lists (row, ids) that aren't empty: the bytes that ids spell, through a join of ids with the vocabulary.

    Ids are cut into runs, so that a very long list is never one group.
    """
    each = lists.select("row", F.posexplode("ids").alias("at", "token_id"))
    named = each.join(F.broadcast(vocabulary(lists.sparkSession, path)), "token_id")
    runs = named.groupBy("row", F.floor(F.col("at") / _RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    runs = runs.select("row", "run", F.concat_ws("", F.transform("p", lambda x: F.hex(x["piece"]))).alias("hex"))
    whole = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("run", "hex"))).alias("r"))
    return whole.select("row", F.unhex(F.concat_ws("", F.col("r.hex"))).alias("piece"))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of any table of ids, whoever encoded it.

    Null or empty lists give the empty text; an id that the vocabulary lacks spells nothing.  Bytes that
    are no UTF-8 become U+FFFD.
    """
    rows = saved(encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).withColumn("row", F.monotonically_increasing_id()))  # row numbers must be the same in both branches
    return rows.join(spelled(rows, path), "row", "left").select(F.col("id").alias(id_col), F.coalesce(F.decode("piece", "UTF-8"), F.lit("")).alias("decoded"))
