"""Personal data, secrets, language, quality, mixing and tokens against brute force, oracles and held-out accuracy."""

import hashlib
import random
import struct
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from conftest_rows import LONG, rows_of

from palimpsest.llm import lang_id, mixing, pii, piece_codec, quality, registry, secrets


def keyed(rows):
    return sorted(rows, key=lambda r: repr(r.doc_id))


@pytest.mark.parametrize("operator, patterns, fails", [(pii, brute.PRIVATE, brute.private_fails), (secrets, brute.SECRET, brute.secret_fails)], ids=["private", "secrets"])
def test_base_spans_equal_the_patterns(docs, rows, none, operator, patterns, fails):
    got, want = keyed(operator.digests(docs).collect()), sorted(rows, key=lambda r: repr(r[0]))
    assert len(got) == len(want)
    for r, (i, text, *_) in zip(got, want, strict=True):
        found = brute.spans(text, patterns, fails)
        assert r.doc_id == i and r.base_sha256 == brute.digest(found), i
        assert [r[f"n_{k}"] for k in patterns] == [sum(s[3] == k for s in found) for k in patterns]
        assert set(filter(None, brute.joined(found).split(","))) <= set(r.spans.split(","))
    assert operator.digests(none).count() == 0


@pytest.mark.parametrize(
    "text, kind, hit",
    [
        ("please call (212) 555-0199 today", "phone", "(212) 555-0199"),
        ("write to bob [at] corp [dot] com please", "email", "bob [at] corp [dot] com"),
        ("the host 10[.]20[.]30[.]40 answered", "ip", "10[.]20[.]30[.]40"),
        ("paid with 4111.1111.1111.1111 then", "card", "4111.1111.1111.1111"),
        ("ring 01 23 45 67 89 before noon", "phone", "01 23 45 67 89"),
        ("the host 10 . 0 . 0 . 1 answered", "ip", "10 . 0 . 0 . 1"),
        ("write to ann at example dot org please", "email", "ann at example dot org"),
    ],
)
def test_crf_adds_what_patterns_miss(text, kind, hit):
    base, added = pii.Finder(pii.trained()).find(text)
    assert not base
    assert added == [(text.index(hit), text.index(hit) + len(hit), kind)]


def test_crf_on_held_out_windows():
    model = pii.SegmentModel()
    model.weights = pii.trained()
    right = found = gold_n = 0
    for text, gold in pii.training_windows(150, seed=99):
        got = set(model.decode(text, [m.span() for m in pii._TOKEN.finditer(text)]))
        right, found, gold_n = right + len(got & set(gold)), found + len(got), gold_n + len(gold)
    assert right >= 0.9 * found and right >= 0.9 * gold_n


def test_crf_leaves_look_alikes():
    finder = pii.Finder(pii.trained())
    for text in ("born 1987-05-23 in a small town", "version 3.2.1 of the tool", "at 12:34:56 sharp", "the sum of 123,456,789 units", "12 34 56 were drawn", "we meet at noon and dot the page", "page 10. 11. 12. of it"):
        assert finder.find(text) == ([], []), text


def test_crf_decodes_the_best_segmentation():
    model = pii.SegmentModel()
    model.weights = pii.trained()
    rng = random.Random(3)
    for _ in range(25):
        text = " ".join(rng.choice(["555", "0199", "(212)", "ann", "[at]", "x", "[dot]", "com", "-"]) for _ in range(6))
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        cands = [(i, j, s) for i, j, s in model.candidates(text, tokens)]

        def best(at):
            if at >= len(tokens):
                return 0.0
            return max([best(at + 1), *(s.max() + best(j) for i, j, s in cands if i == at)])

        value = {(i, j): s for i, j, s in cands}
        starts = {t[0]: k for k, t in enumerate(tokens)}
        ends = {t[1]: k + 1 for k, t in enumerate(tokens)}
        got = sum(value[starts[a], ends[b]][pii.KINDS.index(k)] for a, b, k in model.decode(text, tokens))
        assert got == pytest.approx(best(0))


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(30)]
    rows = [(i, f"value {k} end") for i, k in enumerate(keys)]
    rows += [(100 + i, t) for i, t in enumerate(["someVeryLongIdentifierNameHere here", "A" * 40, "ab" * 20, "well_known_snake_case_name_of_code", "http-like-slug-with-many-small-words"])]
    got = {r.doc_id: r.spans for r in secrets.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(got[i] == "random:6:46" for i in range(30))
    assert hits >= 27 and not any("random" in got[i] for i in range(100, 105))


def test_random_values_after_a_name_are_found(spark):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(30)]
    # the same keys, once apart from the name and once joined to it
    rows = [(i, f"AWS_KEY {k} end") for i, k in enumerate(keys)] + [(100 + i, f"AWS_KEY={k} end") for i, k in enumerate(keys)]
    # padding still counts towards a token's length
    rows += [(200 + i, f"AWS_KEY={k[:18]}== end") for i, k in enumerate(keys)]
    got = {r.doc_id: r.spans for r in secrets.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i] for i in range(30)] == [got[i] for i in range(30)]
    assert sum(got[100 + i] == "random:8:48" for i in range(30)) >= 20
    assert any(got[200 + i] == "random:8:28" for i in range(30))


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    got = lang_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(docs, rows, none):
    got = keyed(lang_id.predict(docs).collect())
    assert len(got) == len(rows)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {i for i, t, *_ in rows if not any(map(str.isalpha, t or ""))}
    assert lang_id.predict(none).count() == 0
    assert {r.lang_pred for r in lang_id.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_spans_of_mixed_text(spark):
    texts = [("a", "the house is on the hill and the water runs down"), ("b", "дом стоит на горе и вода течёт вниз"), ("c", "das haus steht auf dem berg und wasser fliesst")]
    train = spark.createDataFrame([(t * 3, k) for k, t in texts], "text string, lang string")
    model = lang_id.fit(train, "text", "lang", F.lit(1))
    mixed = f"{texts[0][1]}. {texts[1][1]}"
    spans = lang_id.identify(spark.createDataFrame([(mixed,)], "text string"), model, {}, spans=True).first()["spans"]
    assert [(s["lang"], mixed[s["start"] : s["end"]]) for s in spans] == [("a", texts[0][1]), ("b", texts[1][1])]


def test_viterbi_equals_exhaustive_search():
    from itertools import product

    rng = np.random.default_rng(2)
    scores = rng.standard_normal((6, 3)) * 3
    for n in (1, 2, 5):
        words = rng.integers(0, 6, n)
        value = lambda path: sum(scores[w, k] for w, k in zip(words, path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        [(_, path)] = lang_id.viterbi([(0, words)], scores, 2.0)
        assert value(path.tolist()) == pytest.approx(max(map(value, product(range(3), repeat=n))))


def test_quality_held_out(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").filter("held_out and quality is not null").toPandas()
    good, bad = got["score"][got["quality"] == 1].to_numpy(), got["score"][got["quality"] == 0].to_numpy()
    auc = ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean())
    assert auc >= 0.85
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def test_quality_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(60)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = quality.grow(x, y, trees=20, depth=3)

    def walk(row):
        out = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            out += leaf[at - len(f)]
        return out

    assert forest.margin(x) == pytest.approx([walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_mix_equals_the_oracle(docs, duck):
    plain = docs.filter("doc_id <> 900008")  # of repeated rows the oracle may cut either
    duck.register("hard_mix", plain.select("doc_id", "text", "source").toArrow())
    cur = duck.execute(mixing.ORACLE.replace("FROM documents", "FROM hard_mix"))
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=repr)
    got = rows_of(mixing.contract(plain))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_mix_meets_targets(docs, rows, none):
    got = mixing.mix(docs, carry={"s": docs["source"]}).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.s, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for part in by.values():
        assert sum(r["size"] for r in part) == part[0].source_size
        assert abs(sum(r.taken for r in part) - part[0].target) <= 1 and part[0].target <= 3 * part[0].source_size
    total = sum(r["size"] for r in got)
    assert sum(p[0].target for p in by.values()) == pytest.approx(min(total, 3 * total))
    assert mixing.contract(none).count() == 0


def test_mix_prefers_quality(spark):
    rows = [(i, "plain words of prose " * 5 if i % 2 else "#$% @@ {} <> 123 " * 6, "s" if i < 400 else "t") for i in range(2400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source_size < 20000 or taken > 0").collect()
    part = [r for r in got if r.doc_id >= 400 and r.taken % r["size"] == 0]
    assert sum(r.doc_id % 2 for r in part) > 0.5 * len(part)


def test_tokens_equal_the_library(docs, rows, none):
    import sentencepiece

    model = registry.tokenizer_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = keyed(piece_codec.digests(docs, model).collect())
    for r, (i, text, *_) in zip(got, sorted(rows, key=lambda r: repr(r[0])), strict=True):
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()), i
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest(), i
    assert piece_codec.digests(none, model).count() == 0


def test_tokens_of_odd_strings():
    import sentencepiece

    model = registry.tokenizer_path()
    tool, sp = piece_codec.codec(model), sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(8)
    pool = "aaab  ▁▁\n\t.…é漢字🙂𝒳‍﻿0123"
    texts = ["", " ", "▁", "  a  ", "a" * 5000, " " * 300, LONG[:2000], *("".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    for text, ids in zip(texts, tool.encode_batch(texts), strict=True):
        want = sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text
        assert tool.decode(ids) == sp.decode(want), text


def test_tokens_of_long_words_equal_the_library():
    import sentencepiece

    model = registry.tokenizer_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    tool = piece_codec.PieceCodec(model)
    rng = random.Random(8)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (399, 400, 401, 5_000)]
    texts += ["".join(rng.choice("the in ABab01é中🙂-=_".replace(" ", "")) for _ in range(4_000)), "-" * 3_000, "=" * 2_999 + "x", "ab" * 2_000, "aab" * 1_500, "   " * 1_000, "▁" * 999]
    texts += ["theinandof" * 300 + " short words " + "-=" * 700]
    for t, ids in zip(texts, tool.encode_batch(texts), strict=True):
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert list(np.frombuffer(ids, dtype="<u4")) == want, t[:40]
        assert tool.decode(ids) == sp.decode(want)
    assert not any(len(w) > piece_codec.LONG_WORD for w in tool.cache)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ABab01-=é中", "-", "ab"])
def test_a_megabyte_without_a_space_is_encoded_in_seconds(letters):
    import time

    rng = random.Random(1)
    text = "".join(rng.choices(letters, k=1_000_000))
    tool, began = piece_codec.codec(registry.tokenizer_path()), time.perf_counter()
    [ids] = tool.encode_batch([text])
    assert tool.decode(ids) == text
    assert time.perf_counter() - began < 60


def test_random_tokens_equal_the_plain_version(spark):
    rng = random.Random(12)
    full, hexed, b32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    word = lambda: rng.choice(["config", "Value", "user", "Name", "request", "Handler", "v2", "2024", "item", "Index"])
    texts = []
    for i in range(400):
        n = rng.choice([16, 20, 22, 24, 30, 32, 40, 50, 64, 90])
        made = rng.choice([
            lambda: "".join(rng.choice(full) for _ in range(n)), lambda: "".join(rng.choice(hexed) for _ in range(n)), lambda: "".join(rng.choice(b32) for _ in range(n)) + "==",
            lambda: "".join(word() for _ in range(n // 4)), lambda: "_".join(word() for _ in range(n // 5)), lambda: "Ab1" * (n // 3), lambda: "A" * n, lambda: "x" * n + "Y" * 4 + "0" * 4,
        ])()
        texts.append(f"start {made} middle token={made} end {made[:18]}== {made}" if i % 3 else f"{made}")
    texts += [None, "", "=" * 40, "-" * 40]
    got = {r.doc_id: r.spans for r in secrets.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute.random_spans(texts)
    assert sum(map(len, want)) > 40
    for i, spans in enumerate(want):
        assert [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("random")] == spans, texts[i]


def test_too_few_random_tokens_among_words_are_left(spark):
    # the step-up rule counts all candidates: the same short token passes alone and not among thousands of names
    key = "q7Xb2LmR9dKf4TzW8vN1"
    names = [(i, f"some_long_identifier_{i}_of_code_{'abcdefghij'[i % 10]}") for i in range(1, 3000)]
    alone = secrets.digests(spark.createDataFrame([(0, key)], "doc_id long, text string")).first().spans
    short = [(i, f"aLongNameOfCode{i:05d}") for i in range(1, 3000)]
    among = {r.doc_id: r.spans for r in secrets.digests(spark.createDataFrame([(0, key), *short, *[(i + 5000, t) for i, t in names]], "doc_id long, text string")).filter("doc_id = 0").collect()}
    assert alone == "random:0:20" and among[0] == ""


def test_crf_spans_never_overlap_on_unspaced_text():
    finder, rng = pii.Finder(pii.trained()), random.Random(21)
    parts = ["555", "0199", "(212)", "ann", "[at]", "at", "[dot]", "com", "-", ".", "@", "+1", "4111", "10", "x" * 150, "7" * 130]
    for _ in range(300):
        text = rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 60)))
        base, more = finder.find(text)
        assert base == pii.base_spans(text)
        both = sorted(more)
        assert all(x[1] <= y[0] for x, y in zip(both, both[1:]))
        assert all(b <= x or y <= a for a, b, _ in more for x, y, _ in base)


def test_a_megabyte_without_a_space_is_scanned_in_seconds():
    import time

    rng, finder = random.Random(2), pii.Finder(pii.trained())
    text = "".join("".join(rng.choices("abcdefghij", k=300)) + str(rng.randint(100, 99_999)) for _ in range(3_300))
    began = time.perf_counter()
    finder.find(text)
    assert time.perf_counter() - began < 20


def test_language_query_equals_the_plain_version(docs, rows):
    import zlib

    train = [(t, lang) for i, t, lang, _ in rows if t is not None and lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)]
    plain = brute.Languages(train, lang_id.script_of)
    assert len(plain.every) < lang_id.MODEL_GRAMS  # none is left out of the model
    want = {(i, t): plain.predict(t) for i, t, *_ in rows}
    got = keyed(lang_id.predict(docs).collect())
    order = sorted(rows, key=lambda r: repr(r[0]))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r, (i, t, *_) in zip(got, order, strict=True):
        assert r.lang_pred == want[i, t][0] and r.score == pytest.approx(want[i, t][1]), i


def test_language_words_keep_their_marks():
    text = "नमस्ते दुनिया สวัสดี வணக்கம் x́y 12²a _b_ İz"
    assert lang_id._LETTERS.findall(text.lower()) == brute.letters_and_marks(text)
    assert lang_id._LETTERS.findall("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"]


def test_skipped_viterbi_equals_viterbi():
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    names = sorted({g for w in words for g in lang_id.grams(w)})
    model = lang_id.pack(["a", "b", "c"], names, rng.integers(0, 50, (len(names), 3)).astype(float), {}, 6.0)
    tool, mixed = lang_id.Labeller(model), 0
    texts = [[words[int(k)] for k in rng.integers(0, 300, int(n))] for n in rng.integers(0, 40, 400)]
    for text, path in zip(texts, tool.label(texts), strict=True):
        ids = np.array([tool.known[w] for w in text], dtype=int)
        if ids.size:
            [(_, want)] = lang_id.viterbi([(0, ids)], tool.scores, 6.0)
            assert path.tolist() == want.tolist()
            mixed += len(set(path.tolist())) > 1
    assert 20 < mixed < 380


def test_quality_query_equals_the_plain_version(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], int(k % 3 > 0)) for k, r in enumerate(rows) if r[0] is not None and r[0] != 900_008], "doc_id long, quality int")
    forest = quality.fit(docs, labels.filter(~lang_id.held_out(5, 0)), "quality")
    got, order = keyed(quality.classify(docs, labels).collect()), sorted(rows, key=lambda r: repr(r[0]))
    assert len(forest.feature) > 10
    for r, (i, t, *_) in zip(got, order, strict=True):
        x, margin = brute.text_statistics(t or ""), forest.base
        assert quality.statistics(t or "") == pytest.approx(x, rel=1e-9, abs=1e-12), i
        x = quality.statistics(t or "")
        for f, cut, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if x[f[at]] > cut[at] else 1)
            margin += leaf[at - len(f)]
        assert r.doc_id == i and r.score == pytest.approx(1 / (1 + np.exp(-margin))) and r.predicted == int(r.score >= 0.3)
