"""Near-dedup of documents and embeddings, lines and fingerprints against brute force."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from conftest_rows import frame, rows_of

from palimpsest.llm import graph, itq, line_chunks, minhash, winnow


def test_minhash_equals_brute_force(docs, rows):
    want = brute.near_groups([r[:2] for r in rows], 4)
    got = minhash.cluster(docs, words=4).collect()
    assert len(got) == len(rows)
    expected = sorted(((i, *want[i, t]) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_minhash_finds_a_chained_family(spark):
    rng = np.random.default_rng(5)
    text = [f"w{i}" for i in range(120)]
    family = []
    for i in range(60):
        text[int(rng.integers(120))] = f"v{i}"
        family.append((i, " ".join(text)))
    want = brute.near_groups(family, 5)
    got = {r.doc_id: r.component_id for r in minhash.cluster(spark.createDataFrame(family, "doc_id long, text string")).collect()}
    assert got == {k: c for (k, _), (_, c) in want.items()}


def test_minhash_links_pairs_in_a_crowded_prefix(spark, monkeypatch):
    # All texts share a template (similarity 0.7); only the planted pairs are above 0.8.
    monkeypatch.setattr(minhash, "BLOCK", 30)
    template = " ".join(f"t{i}" for i in range(70))
    crowd = [(i, f"{template} " + " ".join(f"u{i}x{j}" for j in range(15))) for i in range(160)]
    crowd += [(1000 + i, f"{template} " + " ".join(f"u{i}x{j}" if j < 8 else f"v{i}x{j}" for j in range(15))) for i in range(0, 160, 2)]
    want = brute.near_groups(crowd, 1)
    got = {r.doc_id: r.component_id for r in minhash.cluster(spark.createDataFrame(crowd, "doc_id long, text string"), words=1).collect()}
    assert got == {k: c for (k, _), (_, c) in want.items()}
    assert sum(k != c for k, c in got.items()) == 80


def test_minhash_empty_table(none):
    df = minhash.cluster(none, words=4)
    assert df.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"] and df.count() == 0


def test_components_extended_by_new_links(spark):
    first = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    more = spark.createDataFrame([(3, 7), (20, 21)], "a long, b long")
    found = graph.extend(graph.extend(None, first), more)
    assert {r.node: r.component for r in found.collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 20: 20, 21: 20}


def _vectors():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 32))
    near = base[:20] + 0.08 * rng.standard_normal((20, 32))
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(np.r_[base, near])]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [2 * x for x in rows[1][1]])]
    rows += [(200, None), (201, []), (202, [0.0] * 32), (203, [float("nan")] * 32), (204, [float("inf")] + [1.0] * 31), (205, [None] + [1.0] * 31), (206, [1.0, 2.0]), (None, rows[0][1])]
    return rows


def test_embeddings_against_brute_force(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as id", "1 as v", "2 as h", "3 as m")
    got = {r.vec_id: r for r in itq.similar(df).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 200]
    links = {(a, b) for a, x in good for b, y in good if a != b and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9}
    for i, _ in good:
        partners = {b for a, b in links if a == i}
        assert got[i].n_links == len(partners)
        assert got[i].component_id == min({i, *partners})
    for i, _ in rows:
        if i is None or i >= 200:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embeddings_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = table.orderBy("vec_id").toPandas()
    m = np.stack([np.asarray(v, dtype=float) for v in x["embedding"]])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    true = (m @ m.T >= 0.9).sum(axis=1) - 1
    got = itq.similar(table).orderBy("vec_id").toPandas()["n_links"].to_numpy()
    assert (got <= true).all() and got.sum() >= 0.9 * true.sum()


def test_embeddings_empty_table(spark):
    assert itq.similar(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lines_equal_the_oracle(docs, duck):
    # the oracle names documents by id, so rows of a repeated id or none are left to the next test
    plain = docs.filter("doc_id is not null and doc_id <> 900008").select("doc_id", "text")
    duck.register("hard", plain.toArrow())
    cur = duck.execute(line_chunks.ORACLE.replace("FROM documents", "FROM hard"))
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert rows_of(line_chunks.contract(plain)) == want


def test_lines_edges(spark, docs, none):
    done = {(r.doc_id, r.text): r for r in line_chunks.dedup(docs).collect()}
    assert (900_001, None) in done and (900_002, "") in done and (None, "no id here at all") in done
    assert done[900_002, ""].removed_chunks == 0
    assert done[900_002, ""]._key == "clash _key" and done[900_002, ""].removed_lines == 0
    assert any(k[0] == 900_011 and r.removed_lines > 0 for k, r in done.items())
    same = line_chunks.dedup(frame(spark, [(1, "a b\nc d\ne f\ng h\ni j\nk l", None, None)] * 2)).collect()
    assert [r.text for r in same] == ["a b\nc d\ne f\ng h\ni j\nk l"] * 2
    assert line_chunks.contract(none).count() == 0


def test_lines_long_passage_goes_once(spark):
    passage = " ".join(f"word{i}" for i in range(55))
    df = spark.createDataFrame([(i, f"start {i}\n{passage}\nend {i}") for i in range(5)], "doc_id long, text string")
    done = {r.doc_id: r for r in line_chunks.dedup(df).collect()}
    assert passage in done[0].text and all(passage not in done[i].text and f"start {i}" in done[i].text for i in range(1, 5))


def test_winnowing_equals_the_definition(docs, rows):
    got = {(r.doc_id, r.n_chars): r for r in winnow.compare_edited(docs).collect()}
    order = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    printed = lambda t: ",".join(f"{h:x}@{p}" for h, p in brute.winnowed(t))

    def likeness(s, t):
        x, y = ({h for h, _ in brute.winnowed(z)} for z in (s, t))
        return len(x & y) / len(x | y) if x | y else 1.0

    import hashlib

    for at, (i, t) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        if i == 900_008:  # its next is its own repetition
            continue
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[i, len(t)]
        assert r.fingerprint == printed(t) and r.edited_fingerprint == printed(edited), i
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(t, edited)) and r.near_next == pytest.approx(likeness(t, after))


def test_winnowing_guarantee_and_empty(spark, none):
    shared = " ".join(f"s{i}" for i in range(winnow.WINDOW + winnow.GRAM - 1))
    df = spark.createDataFrame([(i, " ".join(f"{i}x{j}" for j in range(20)) + " " + shared + f" tail{i}") for i in range(8)], "doc_id long, text string")
    found = [{e.hash for e in r.fingerprint} for r in winnow.fingerprints(df).collect()]
    assert set.intersection(*found)
    assert winnow.compare_edited(none).count() == 0


def planted_vectors(dims, base, pairs, seed=3):
    """Random vectors, and partners at cosines from 0.90 to 0.95 of some."""
    rng = np.random.default_rng([seed, dims])
    x = rng.standard_normal((base, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[rng.permutation(base)[:pairs]]
    side = rng.standard_normal(y.shape)
    side -= (side * y).sum(axis=1, keepdims=True) * y
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.95, (pairs, 1))
    return np.r_[x, cos * y + np.sqrt(1 - cos**2) * side]


def links_by_brute_force(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (x @ x.T >= 0.9).sum(axis=1) - 1


@pytest.mark.parametrize("dims", [16, 64, 200])
def test_embeddings_recall_on_planted_pairs(spark, dims):
    x = planted_vectors(dims, 4000, 1500)
    true = links_by_brute_force(x)
    assert true.sum() >= 2 * 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in itq.similar(df).orderBy("vec_id").collect()])
    print(f"recall at {dims} dimensions: {got.sum() / true.sum():.4f} of {true.sum() // 2} links")
    assert (got <= true).all() and got.sum() >= 0.95 * true.sum()


def test_embeddings_of_every_length_and_scale(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1.0, 1.0]), (4, [1e-310, 1e-310]), (5, [1.0, -1.0]), (6, [1.0, 1.0, 1.0]), (7, [2.0, 2.0, 2.1]), (8, [3.0]), (9, [-3.0]), (10, [7.0])]
    rows += [(100 + i, np.eye(40)[i % 40].tolist()) for i in range(80)]  # the common length
    rows += [(5, [1.0, -1.001]), (5, [1.0, -1.001])]  # an id that repeats
    got = {}
    for r in itq.similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert {i: got[i] for i in (1, 2, 3, 4)} == {i: [(3, 1)] for i in (1, 2, 3, 4)}
    assert got[5] == [(2, 5)] * 3
    assert got[6] == [(1, 6)] and got[7] == [(1, 6)]
    assert got[8] == [(1, 8)] and got[9] == [(0, 9)] and got[10] == [(1, 8)]
    assert all(got[100 + i] == [(1, 100 + i % 40)] for i in range(80))


def test_minhash_recall_on_a_larger_table(spark, sf):
    """Against all pairs of sf0.01: nothing wrong, and 0.9 of the members of components found."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {i: c for (i, _), (_, c) in brute.near_groups(rows, 4).items()}
    got = {r.doc_id: r.component_id for r in minhash.cluster(docs, words=4).collect()}
    copies = [i for i, c in want.items() if i != c]
    found = sum(got[i] == want[i] for i in copies)
    print(f"recall of copies: {found} of {len(copies)}")
    assert len(copies) > 30 and found >= 0.9 * len(copies)
    assert all(got[i] == i or want[i] == want[got[i]] for i in got)


def test_minhash_large_classes_look_up_their_component(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_CLASS", 5)
    texts = ["one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta", "single text of its own kind here"]
    rows = [(i, texts[0]) for i in range(40)] + [(100 + i, texts[1]) for i in range(3)] + [(200, texts[2]), (300, None), (None, texts[0])]
    got = {r.doc_id: r.component_id for r in minhash.cluster(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{100 + i: 100 for i in range(3)}, 200: 200, 300: 300, None: None}


def test_common_prefix_counts_values():
    a = [np.array([7, 7, 7, 8]), np.array([5 << 48, 5 << 48, (5 << 48) + (3 << 32), 5 << 48]), np.array([1, 1 << 20, 1, 1])]
    b = [np.array([7, 7, 7, 7]), np.array([5 << 48, 5 << 48, 5 << 48, 5 << 48]), np.array([1, 1, 1, 1])]
    assert minhash.common_prefix(a, b).tolist() == [12, 10, 5, 0]
