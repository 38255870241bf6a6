"""The pipeline's stages against plain versions of their operators."""

import corpus_pipeline
from tests.conftest import SF
from tests.llm import helpers as H

from siltstone.llm import mixing, quality, queries, secrets


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    good = stages["quality_rules"](spark, docs, SF)
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in rows if verdict[r.doc_id]}
    single = stages["near_dedup"](spark, good, SF)
    want = {i for i, _, _, kept in H.near([(r.doc_id, r.text) for r in good.collect()], 5) if kept}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want
    clean = stages["secret_scan"](spark, single, SF)
    text = {r.doc_id: r.text for r in single.collect()}
    assert clean.columns == columns and {r.doc_id: r.text for r in clean.collect()} == {i: secrets.redacted(t, secrets.scan(t), "[SECRET]") for i, t in text.items()}
    assert all(H.base_secrets(r.text)[:3] == (0, 0, 0) for r in clean.collect())
    mix = stages["source_mixing"](spark, clean, SF)
    uses = {}
    for r in mixing.plan(clean).collect():
        uses[r.id] = uses.get(r.id, 0) + 1
    got = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert mix.columns == columns and got == uses and set(got) == want and max(got.values()) <= 2
    out = stages["bpe_encoding"](spark, mix, SF).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.vocabulary_path())
    redacted = {r.doc_id: r.text for r in clean.collect()}
    assert len(out) == sum(got.values())
    for r in out:
        assert list(r.ids) == model.encode(redacted[r.doc_id], add_special_tokens=False).ids and r.text == redacted[r.doc_id]


def test_near_dedup_keeps_rows_without_an_id_and_one_of_a_repeated_id(spark):
    stages = dict(corpus_pipeline.STAGES)
    out = [r.doc_id for r in stages["near_dedup"](spark, H.frame(spark, H.ODD), SF).collect()]
    assert out.count(None) == 1 and out.count(8) <= 1 and 0 in out and 17 not in out


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"] and out.count() > 100
