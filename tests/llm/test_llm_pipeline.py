"""Each stage of the pipeline, on what the one before kept, against a plain version of it."""

import struct
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from conftest_rows import rows_of

import corpus_pipeline as pipeline
from palimpsest.llm import lang_id, line_chunks, mixing, registry


@pytest.fixture(scope="module")
def steps(spark, docs, tmp_path_factory):
    """The input and output rows of every stage, and the tables."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    now = docs
    for name, step in pipeline.STAGES:
        path = str(folder / name)
        step(spark, now, str(folder)).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, now, after))
        now = after
    return {name: (a, b) for name, a, b in out}


def by_id(df):
    return {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in pipeline.STAGES] == list(steps)
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == pipeline.COLUMNS


def test_language_stage(steps):
    before, after = steps["language_id"]
    model = lang_id.fit(before, "text", "lang", before["doc_id"])
    labeller = lang_id.Labeller(model)
    want = set()
    for r in before.select("doc_id", "text").collect():
        [path] = labeller.label([labeller.words(r.text or "")])
        real = [x for x in path.tolist() if x >= 0]
        if real:
            want.add((r.doc_id, r.text))
    assert by_id(after) == want and len(want) >= 0.9 * len(by_id(before)) - 20


def test_line_stage(steps, duck):
    before, after = steps["line_dedup"]
    one = before.filter("doc_id is not null and doc_id <> 900008").select("doc_id", "text")
    duck.register("staged_lines", one.toArrow())
    sha = {(r[0], r[1]) for r in duck.execute(f"SELECT doc_id, text_sha256 FROM ({line_chunks.ORACLE.replace('FROM documents', 'FROM staged_lines')})").fetchall()}
    import hashlib

    assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in by_id(after) if i is not None and i != 900_008} == sha
    assert after.count() == before.count()


def test_near_stage(steps):
    before, after = steps["near_dedup"]
    pairs = list(by_id(before))
    groups = brute.near_groups(pairs, 5)
    stay = {i for (i, _), (_, c) in groups.items() if i is None or i == c}
    assert {i for i, _ in by_id(after)} == stay


def test_mix_stage(steps):
    before, after = steps["mix_sources"]
    copies = {}
    for r in mixing.mix(before).select("doc_id", "copies").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v}


def test_token_stage(steps):
    import sentencepiece

    before, after = steps["sentencepiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path())
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        ids = sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.round_trip == (sp.decode(ids) == texts[r.doc_id])


def test_pipeline_runs_on_nothing(spark, none):
    now = none
    for _, step in pipeline.STAGES:
        now = step(spark, now, "")
    assert rows_of(now) == []


def test_run_equals_the_stages_one_by_one(spark, steps, tmp_path):
    first, last = steps["language_id"][0], steps["sentencepiece"][1]
    first.write.parquet(str(tmp_path / "documents.parquet"))
    counted = lambda df: sorted((repr((r.doc_id, r.lang, r.source, r.n_tokens, bytes(r.ids))) for r in df.collect()))
    assert counted(pipeline.run(spark, str(tmp_path))) == counted(last)


def test_run_on_an_empty_table(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_keeps_texts_in_many_languages_and_all_without_labels(spark, docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language_id(spark, unlabelled, "").count() == docs.count()
    words = {"a": "aba abba baba", "b": "xyx xyyx yxyx", "c": "mnm mnnm nmnm"}
    rows = [(i, f"{w} " * 20, lang, "s", 1) for i, (lang, w) in enumerate(words.items())] + [(9, " ".join(f"{w} {w}" for w in words.values()), None, "s", 1), (10, "123 456 !", None, "s", 1)]
    kept = pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {r.doc_id: r.lang for r in kept.collect()}.keys() == {0, 1, 2, 9}
