"""Version tables, batches, filters and the store, against a dict of versions and goldens."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.errors import Corruption, InvalidArgument, NotFound, StoreIOError
from palimpsest.functions.codec import fixed, sized
from palimpsest.operators import batch as wb
from palimpsest.operators import bloom, versions
from palimpsest.operators.batch import WriteBatch
from palimpsest.operators.store import Store
from palimpsest.operators.versions import VersionTable, checked
from palimpsest.sources.fsenv import Env, set_current
from palimpsest.sources.record_log import RecordWriter, encode
from palimpsest.streaming import live

SCHEMA = "user_key string, seq bigint, type int, value string"


def table(spark, rows):
    return VersionTable(spark.createDataFrame(rows, SCHEMA))


A = [("a", 10, 1, "x"), ("a", 20, 1, "y"), ("a", 30, 0, None), ("b", 5, 1, ""), ("c", 7, 1, "z"), ("c", 7, 0, None), ("", 1, 1, "e")]
LOOKUPS = [("a", 9, "ABSENT", None), ("a", 10, "FOUND", "x"), ("a", 19, "FOUND", "x"), ("a", 20, "FOUND", "y"), ("a", 29, "FOUND", "y"), ("a", 30, "DELETED", None), ("a", 99, "DELETED", None), ("ab", 99, "ABSENT", None), ("b", 5, "FOUND", ""), ("c", 7, "FOUND", "z"), ("", 1, "FOUND", "e"), ("a", 99, "DELETED", None)]


def test_contains_deals_rows_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(versions, "JOINED", 50)
    rows = [(f"k{i % 7}", i, i % 2, "v") for i in range(200)]
    asked = [(k, q + shift, t) for k, q, t, _ in rows for shift in (0, 1)] * 2
    found = table(spark, rows).contains(spark.createDataFrame(asked, "user_key string, seq bigint, type int"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((k, q, t) for k, q, t, _ in rows for _ in range(2))
    # 1,000 rows of both sides, 50 for each task
    assert found._jdf.queryExecution().executedPlan().toString().count(", 21), REPARTITION_BY_NUM") == 2


def test_batches_are_coded_and_decoded_in_small_parts(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(wb, "CHUNK_OPS", 7)
    monkeypatch.setattr(wb, "CHUNK_BYTES", 100)
    rows = [(b, i, i % 3 != 0, f"key {i}", f"value {b} {i}" if i % 3 else None) for b in range(5) for i in range(10)]
    ops = spark.createDataFrame([(b, 10 * b + i, int(put), k, v) for b, i, put, k, v in rows], "batch_id bigint, op_index bigint, type int, user_key string, value string")
    coded = wb.encode(ops.coalesce(1).withColumn("base", F.col("op_index")), "batch_id", "base")
    want = {b: WriteBatch([(k.encode(), v.encode() if v else None) for c, _, _, k, v in rows if c == b], 10 * b).contents() for b in range(5)}
    assert {r["batch_id"]: bytes(r["contents"]) for r in coded.collect()} == want

    class Frame:  # hands out the function that Spark would run
        schema, sparkSession = coded.schema, spark
        select = lambda self, *columns: self
        mapInPandas = lambda self, run, schema: run

    parts = list(wb.decode(Frame(), ["batch_id"])([pd.DataFrame({"batch_id": list(want), "contents": list(want.values())})]))
    assert max(map(len, parts)) <= 7
    got = [(r.batch_id, r.op_index, bool(r.type), r.user_key.decode(), r.value and r.value.decode()) for r in pd.concat(parts).itertuples()]
    assert got == rows


@pytest.mark.parametrize("span", [1, 8, 1 << 12])
def test_multi_get(spark, span):
    asked = spark.createDataFrame([x[:2] for x in LOOKUPS], "user_key string, snap bigint")
    got = table(spark, A).multi_get(asked, span).select("user_key", "snap", "status", "value").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(LOOKUPS, key=repr)


def test_point_get(spark):
    t = table(spark, A)
    for key, snap, status, value in LOOKUPS[:6]:
        row = t.get(key, snap).first()
        assert (row["status"], row["value"]) == (status, value)


def test_against_model(spark):
    rng = random.Random(11)
    rows = [(rng.choice("abcdefgh"), i, rng.choice([0, 1, 1]), None) for i in range(1, 200)]
    rows = [(k, s, t, f"v{s}" if t else None) for k, s, t, _ in rows]
    t = table(spark, rows)
    for snap in (0, 50, 199):
        live_rows = {}
        for k, s, kind, v in rows:
            if s <= snap:
                live_rows[k] = (s, kind, v)
        want = {(k, s, v) for k, (s, kind, v) in live_rows.items() if kind}
        assert {tuple(r) for r in t.snapshot(snap).collect()} == want
    order = sorted(rows, key=lambda r: (r[0], -r[1], -r[2]))
    assert [tuple(r) for r in t.history().collect()] == order
    assert tuple(t.first().first()) == order[0] and tuple(t.last().first()) == order[-1]
    for i in (0, 1, 57, 198):
        k, s, kind, _ = order[i]
        assert tuple(t.seek(k, s, kind).first()) == order[i]
        assert [tuple(r) for r in t.next(k, s, kind).collect()] == order[i + 1 : i + 2]
        assert [tuple(r) for r in t.prev(k, s, kind).collect()] == (order[i - 1 : i] if i else [])
    near = {(r["user_key"], r["seq"]): (r["prev_key"], r["prev_seq"], r["next_key"], r["next_seq"]) for r in t.neighbours().collect()}
    for i, (k, s, *_) in enumerate(order):
        p = order[i - 1][:2] if i else (None, None)
        n = order[i + 1][:2] if i + 1 < len(order) else (None, None)
        assert near[k, s] == (*p, *n)
    back = [tuple(r) for r in t.scan("b", "e", forward=False).collect()]
    assert back == [r for r in order[::-1] if "b" <= r[0] < "e"]


def test_empty_table_and_bad_rows(spark):
    t = VersionTable.empty(spark)
    assert t.first().count() == t.snapshot().count() == 0 and t.get(b"k").first()["status"] == "ABSENT"
    assert t.memory_usage().first()["bytes"] == 0
    with pytest.raises(Exception, match="Corruption"):
        checked(spark.createDataFrame([("k", 1, 7, "v")], SCHEMA)).collect()
    assert checked(spark.createDataFrame(A, SCHEMA)).count() == len(A)


def test_repeats_need_ingest_id(spark):
    df = spark.createDataFrame([("k", 1, 1, "old", 1), ("k", 1, 1, "new", 2)], SCHEMA + ", ingest_id bigint")
    t = VersionTable(df)
    assert t.snapshot().first()["value"] == t.get("k", 1).first()["value"] == "new"
    assert t.multi_get(spark.createDataFrame([("k", 5)], "user_key string, snap bigint")).first()["value"] == "new"


OPS = st.lists(st.tuples(st.binary(max_size=6), st.none() | st.binary(max_size=200)), max_size=12)


@given(OPS, st.integers(0, 2**56 - 1))
def test_batch_round_trip(ops, base):
    made = WriteBatch(sequence=base)
    for key, value in ops:
        made.delete(key) if value is None else made.put(key, value)
    back = WriteBatch.from_contents(made.contents())
    assert (back.ops, back.sequence, back.count) == (ops, base, len(ops))
    assert made.byte_size() == len(made.contents()) == 12 + sum(1 + len(sized(k)) + (0 if v is None else len(sized(v))) for k, v in ops)
    assert back.rows() == [(k, base + i, int(v is not None), v) for i, (k, v) in enumerate(ops)]
    made.clear()
    assert made.ops == [] and made.contents() == bytes(12)


@given(OPS.filter(bool), st.data())
def test_cut_batches_keep_what_is_whole(ops, data):
    contents, ends = WriteBatch(ops).contents(), [12]
    for k, v in ops:
        ends.append(ends[-1] + 1 + len(sized(k)) + (0 if v is None else len(sized(v))))
    cut = data.draw(st.integers(12, len(contents) - 1))
    whole = sum(e <= cut for e in ends) - 1
    assert WriteBatch.from_contents(contents[:cut], lenient=True).ops == ops[:whole]
    why = "wrong count" if cut in ends else "bad WriteBatch " + ("Delete" if ops[whole][1] is None else "Put")
    with pytest.raises(Corruption, match=why):
        WriteBatch.from_contents(contents[:cut])


@pytest.mark.parametrize("bad, why", [(b"eleven byte", "too small"), (bytes(8) + fixed(1, 4) + b"\x09", "unknown")])
def test_bad_batches(bad, why):
    with pytest.raises(Corruption, match=why):
        WriteBatch.from_contents(bad)


@given(OPS, OPS)
def test_batch_append(first, second):
    one, two = WriteBatch(first, 40), WriteBatch(second, 90)
    one.append(two)
    assert (one.ops, one.sequence, two.ops, two.sequence) == (first + second, 40, second, 90)


def test_batch_visitor():
    seen = []

    class H:
        def put(self, k, v):
            seen.append((k, v))

        def delete(self, k):
            seen.append((k,))

    WriteBatch().put(b"a", b"1").delete(b"b").iterate(H())
    assert seen == [(b"a", b"1"), (b"b",)]


def test_batches_in_spark(spark):
    ops = spark.createDataFrame([(0, 1, b"k", b"v"), (1, 0, b"d", None), (2, 1, b"e", b"")], wb.OPS)
    want = WriteBatch([(b"k", b"v"), (b"d", None), (b"e", b"")], 7)
    coded = wb.encode(ops.withColumns({"g": F.lit(1), "base": F.lit(7)}), "g", "base")
    assert bytes(coded.first()["contents"]) == want.contents()
    assert wb.encoded_size(ops).first()["byte_size"] == want.byte_size()
    back = wb.decode(coded, ["g"]).orderBy("op_index").collect()
    assert [(r["base"], r["type"], bytes(r["user_key"]), r["value"] and bytes(r["value"])) for r in back][:2] == [(7, 1, b"k", b"v"), (7, 0, b"d", None)]
    assert back[2]["value"] is not None
    assert [r["seq"] for r in wb.apply(ops, 5).orderBy("seq").collect()] == [5, 6, 7]
    assert sorted(r["op_index"] for r in wb.append(ops, ops).collect()) == list(range(6))
    broken = coded.withColumn("contents", F.expr("substring(contents, 1, length(contents) - 1)"))
    assert wb.decode(broken, [], lenient=True).count() == 2


def test_bloom_in_spark(spark):
    policy = bloom.BloomPolicy()
    keys = spark.createDataFrame([(1, b"hello"), (1, b"world"), (2, b"solo")], "filter_id int, key binary")
    whole = {r["filter_id"]: bytes(r["filter"]) for r in bloom.filters(keys, policy).collect()}
    assert whole[1].hex() == "114000414410401006"
    bits = bloom.build_bits(keys, policy)
    for f, raw in whole.items():
        assert {r["byte"]: r["mask"] for r in bits.filter(F.col("filter_id") == f).collect()} == {i: x for i, x in enumerate(raw[:-1]) if x}
    sizes = spark.createDataFrame([(1, 64), (2, 64)], "filter_id int, bits bigint")
    asked = spark.createDataFrame([(1, b"hello"), (1, b"x"), (2, b"foo"), (2, b"solo")], "filter_id int, key binary")
    got = {(r["filter_id"], bytes(r["key"])): r["may_match"] for r in bloom.may_match(asked, bits, sizes, policy).collect()}
    assert got == {(f, k): policy.may_match(k, whole[f]) for f, k in got} and got[1, b"hello"] and not got[1, b"x"]


def test_store(spark, tmp_path):
    path = str(tmp_path / "db")
    store = Store.open(spark, path)
    with pytest.raises(StoreIOError):
        Store.open(spark, path)
    store.put(b"a", b"1")
    first = store.last
    store.write(WriteBatch().put(b"a", b"2").put(b"", b"").delete(b"x"))
    assert store.get(b"a") == b"2" and store.get(b"a", first) == b"1" and store.get(b"") == b""
    store.delete(b"a")
    for key in (b"a", b"nothing"):
        with pytest.raises(NotFound):
            store.get(key)
    assert store.last == 5
    RecordWriter(store._log, store.env.size(store.log_path)).add(WriteBatch([(b"late", b"v")], 6).contents())
    store._log.write(encode([b"cut short"])[:-3])
    store.abandon()
    with Store.open(spark, path) as store:
        assert store.get(b"late") == b"v" and store.last == 6


def test_store_buffers_and_cuts_its_log(spark, tmp_path, monkeypatch):
    from palimpsest.operators import store as module

    monkeypatch.setattr(module, "FLUSH_OPS", 5)
    path = tmp_path / "db"
    with Store.open(spark, str(path)) as store:
        for i in range(12):
            store.put(f"k{i}".encode(), b"v")
        # two files for ten operations, the last two only in the buffer and the new log
        assert len(list((path / "versions").glob("*.parquet"))) == 2 and store.versions().df.count() == 12
        assert [p.name for p in path.glob("*.log")] == ["000003.log"] and (path / "CURRENT").read_text() == "MANIFEST-3\n"
        store.ingest(spark.createDataFrame([(0, 1, b"big", b"load")], "op_index long, type int, user_key binary, value binary"))
        store.put(b"late", b"x")
        store.flush = lambda: None  # a crash: the buffer isn't moved
    again = Store.open(spark, str(path))
    assert again.last == 14 and again.get(b"late") == b"x" and again.get(b"big") == b"load" and again.versions().df.count() == 14
    again.close()


def test_store_frees_its_lock_when_opening_fails(spark, tmp_path):
    path = tmp_path / "db"
    Store.open(spark, str(path)).close()
    (path / "CURRENT").write_text("nonsense")
    with pytest.raises(Corruption):
        Store.open(spark, str(path))
    (path / "CURRENT").write_text("MANIFEST-1\n")
    Store.open(spark, str(path)).close()


def test_other_schemes_are_refused(spark):
    with pytest.raises(InvalidArgument):
        Store(spark, "hdfs://host/db")


def test_files(tmp_path):
    env, db = Env(), str(tmp_path)
    set_current(env, db, 3)
    assert env.open_sequential(f"{db}/CURRENT").read() == b"MANIFEST-3\n" and env.children(db) == ["CURRENT"]
    with pytest.raises(NotFound):
        env.open_sequential(f"{db}/missing")
    with pytest.raises(NotFound):
        set_current(env, f"{db}/nowhere", 1)
    env.write_file(f"{db}/f", b"abcdef", sync=True)
    assert env.size(f"{db}/f") == 6 and env.read_at(env.open_random(f"{db}/f"), 2, 3) == b"cde"
    with env.open_appendable(f"{db}/f") as out:
        out.write(b"g")
    env.rename(f"{db}/f", f"{db}/g")
    assert env.size(f"{db}/g") == 7 and not env.exists(f"{db}/f")
    env.remove(f"{db}/g")
    log = env.logger(f"{db}/LOG")
    log.log("hello")
    log.close()
    assert open(f"{db}/LOG").read().endswith("hello\n")
    lock = env.lock(f"{db}/LOCK")
    with pytest.raises(StoreIOError):
        env.lock(f"{db}/LOCK")
    env.unlock(lock)


def test_stream(spark, tmp_path):
    path = tmp_path / "logs"
    path.mkdir()
    log = path / "000001.log"
    data = encode([WriteBatch([(b"a", b"1"), (b"b", b"2")], 1).contents()])
    more = encode([WriteBatch([(b"a", None)], 3).contents()], len(data))
    log.write_bytes(data + more[:5])
    stream = live.tail(spark, str(path))
    query = stream.writeStream.format("memory").queryName("tail").start()
    try:
        query.processAllAvailable()
        assert spark.table("tail").count() == 2
        log.write_bytes(data + more)
        query.processAllAvailable()
        got = {(bytes(r["user_key"]), r["seq"], r["type"]) for r in spark.table("tail").collect()}
        assert got == {(b"a", 1, 1), (b"b", 2, 1), (b"a", 3, 0)}
    finally:
        query.stop()
    newest = live.newest(spark.table("tail")).collect()
    assert {(bytes(r["user_key"]), r["seq"]) for r in newest} == {(b"a", 3), (b"b", 2)}
