"""Every contract against its plain version, on odd rows and on the whole smallest table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bpe, media_audio, minhash, quality, queries, secrets, substring_dedup
from tests.conftest import SF
from tests.llm import helpers as H


def docs(spark, which):
    """Rows of (id, text, language, source), and their table."""
    if which == "odd":
        return H.ODD, H.frame(spark, H.ODD)
    if which == "empty":
        return [], H.frame(spark, H.ODD).limit(0)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    return [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()], table


WHICH = pytest.mark.parametrize("which", ["odd", "empty", "table"])


@WHICH
def test_media(spark, which):
    rows, table = docs(spark, which)
    out = media_audio.digest(media_audio.audio_features(table)).collect()
    H.same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out], [(i, *H.media(t)) for i, t, *_ in rows])
    assert all(r.media_bytes == r.payload_bytes + 44 for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


@WHICH
def test_bpe(spark, which):
    from tokenizers import Tokenizer

    rows, table = docs(spark, which)
    path = queries.vocabulary_path()
    model = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, model.decode(ids, skip_special_tokens=False)))
    encoded = bpe.encode_decode(table, path)
    H.same([(r.doc_id, str(r.ids), r.decoded) for r in encoded.collect()], [(i, str(ids), t) for i, ids, t in want])
    H.same([(r.doc_id, r.decoded) for r in bpe.decode(encoded, path).collect()], [(i, t) for i, _, t in want])


def test_bpe_puts_a_chunk_together_some_rows_at_once(monkeypatch):
    path = queries.vocabulary_path()
    texts = ["", *(f"row {i} \u00e9\u4e16 {'word ' * (i % 40)}<|endoftext|>" for i in range(300)), None, "x" * 3000, ""]
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts)), pa.int64()), "text": texts, "part": pa.array([0] * len(texts), pa.int64())})
    coded = pa.Table.from_batches(bpe._coded(path)(iter(pa.Table.from_batches(bpe._lists(path)(iter([rows]))).sort_by("word").to_batches()))).sort_by("at")
    sides = [(False, x) for x in bpe._blocks(iter(coded.to_batches(max_chunksize=64)))] + [(True, x) for x in bpe._places(path)(iter([rows]))]
    sides = [pa.RecordBatch.from_arrays([*x.columns, pa.array([own] * len(x))], ["chunk", "payload", "own"]) for own, x in sides]
    monkeypatch.setattr(bpe, "_SOME", 500)
    read, out = [], []
    for batch in bpe._joined_back(pa.int32())(iter(sides)):
        read.append(len(batch))
        out += batch.to_pylist()
    assert len(read) > 10 and max(read) < 100  # no batch has the whole chunk
    model = bpe.tokenizer(path)
    want = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [(r["id"], r["ids"], r["decoded"]) for r in out] == [(i, ids, t or "") for i, (ids, t) in enumerate(zip(want, texts, strict=True))]
    with pytest.raises(RuntimeError):
        list(bpe._joined_back(pa.int32())(iter(sides[:-1])))


def test_bpe_splits_every_character_like_the_library():
    path = queries.vocabulary_path()
    rule = bpe.tokenizer(path).pre_tokenizer
    for c in map(chr, range(0, 0x110000, 7)):
        if not 0xD800 <= ord(c) < 0xE000:
            part = f"a{c}1 {c} {c}{c}\n"
            assert bpe.split(part, path) == [part[s:e] for _, (s, e) in rule.pre_tokenize_str(part)]


@WHICH
def test_quality_base(spark, which):
    rows, table = docs(spark, which)
    out = quality.judge(table).collect()
    H.same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out], [(i, *H.base_quality(t)) for i, t, *_ in rows])
    assert not any(r.kept and r.base_failed for r in out)


@WHICH
def test_secrets_base(spark, which):
    rows, table = docs(spark, which)
    out = secrets.digest(secrets.find_secrets(table)).collect()
    H.same([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out], [(i, *H.base_secrets(t)) for i, t, *_ in rows])


@WHICH
def test_substring_dedup(spark, which):
    rows, table = docs(spark, which)
    out = substring_dedup.remove_repeats(table).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    H.same(out.collect(), [(r[0], *x) for r, x in zip(rows, H.removed([r[1] for r in rows]), strict=True)])


def test_substring_dedup_with_lengthened_prefixes(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 2)
    monkeypatch.setattr(substring_dedup, "_HELD", 8)
    line = " ".join(f"menu{i}" for i in range(20))
    rows = list(H.ODD)
    for i in range(60):  # a line of 20 words between different neighbours, which repeats nothing, and longer ones that do
        own = [f"n{i}x{j}" for j in range(40)]
        rows.append((100 + i, " ".join(own) + "\n" + line + "\n" + " ".join(reversed(own)), "en", "s"))
        if i % 3 == 0:
            rows.append((200 + i, f"q{i} " + " ".join(own[20:]) + " " + line + f" r{i}", "en", "s"))
    out = substring_dedup.remove_repeats(H.frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    H.same(out.collect(), [(r[0], *x) for r, x in zip(rows, H.removed([r[1] for r in rows]), strict=True)])


@pytest.mark.parametrize("window", [9, 100, 200, 300])
def test_substring_dedup_with_other_windows(spark, window):
    own = lambda i, n: " ".join(f"o{i}x{j}" for j in range(n))
    line = " ".join(f"m{j}" for j in range(260))
    rows = [*H.ODD, *((100 + i, f"{own(i, 40)}\n{line} {own(-i, 30)}", "en", "s") for i in range(5)), (200, f"{line} {line}", "en", "s"), (201, line[:800], "en", "s")]
    out = substring_dedup.remove_repeats(H.frame(spark, rows), window=window).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    H.same(out.collect(), [(r[0], *x) for r, x in zip(rows, H.removed([r[1] for r in rows], window), strict=True)])


def test_names_of_runs():
    codes = np.random.default_rng(2).integers(0, 3, 500)
    for depth in (1, 2, 3, 8, 35):
        names = substring_dedup._named(codes, depth)
        runs = [tuple(codes[i : i + depth]) for i in range(len(codes) - depth + 1)]
        assert len(names) == len(runs) and len(set(names.tolist())) == len(set(runs)) == len(set(zip(names.tolist(), runs)))


@WHICH
@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, which, k):
    rows, table = docs(spark, which)
    H.same(minhash.near_duplicates(table, k=k).collect(), H.near([r[:2] for r in rows], k))
