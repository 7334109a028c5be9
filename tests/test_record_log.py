"""The log: framing, reassembly, fault injection, offsets, splits and the Spark source."""

import io
import os
import random

import pytest

from palimpsest.functions.checksum import crc32c, mask
from palimpsest.functions.codec import fixed
from palimpsest.functions.hashing import Random
from palimpsest.sources import record_log as rl

B, H = rl.BLOCK, rl.HEADER


def big(text: str, n: int) -> bytes:
    return (text * (n // len(text) + 1))[:n].encode()


def read(data, start=0, checksum=True):
    dropped = []
    got = list(rl.RecordReader(io.BytesIO(data), start, checksum, lambda n, why: dropped.append((n, why))))
    return [p for _, p in got], dropped


def fix_crc(data: bytearray, at: int, size: int) -> None:
    data[at : at + 4] = fixed(mask(crc32c(bytes(data[at + 6 : at + 7 + size]))), 4)


@pytest.mark.parametrize(
    "records",
    [
        [],
        [b"foo", b"bar", b"", b"xxxx"],
        [b"small", big("medium", 50_000), big("large", 100_000)],
        [big("foo", B - 2 * H), b"", b"bar"],
        [big("foo", B - 2 * H), b"bar"],
        [big("foo", B - 2 * H + 4), b"", b"bar"],
        [big("foo", B - 2 * H + 4)],
        [f"{i}.".encode() for i in range(20_000)],
    ],
)
def test_round_trip(records):
    assert read(rl.encode(records)) == (records, [])


def test_frame_golden():
    assert rl.encode([b"foo"]).hex() == "dd5fb37a030001666f6f"
    assert len(rl.encode([big("foo", B - 2 * H)])) == B - H


def test_open_for_append():
    data = rl.encode([b"hello"])
    assert read(data + rl.encode([b"world"], len(data))) == ([b"hello", b"world"], [])


def test_random_records():
    rng = Random(301)
    records = [big(f"{i}.", rng.skewed(17)) for i in range(200)]
    assert read(rl.encode(records))[0] == records


def test_read_error():
    class Broken(io.BytesIO):
        def read(self, n=-1):
            raise OSError("disk")

    dropped = []
    assert list(rl.RecordReader(Broken(), on_drop=lambda n, why: dropped.append((n, why)))) == []
    assert dropped[0][0] == B and "read error" in dropped[0][1]


@pytest.mark.parametrize(
    ("records", "kind", "want", "lost", "reason"),
    [
        ([b"foo"], 101, [], 3, "unknown record type"),
        ([b"foo"], 3, [], 3, "missing start"),
        ([b"foo"], 4, [], 3, "missing start"),
        ([b"foo", b"bar"], 2, [b"bar"], 3, "partial record without end"),
        ([b"foo", big("bar", 100_000)], 2, [big("bar", 100_000)], 3, "partial record without end"),
    ],
)
def test_changed_type(records, kind, want, lost, reason):
    data = bytearray(rl.encode(records))
    data[6] = kind
    fix_crc(data, 0, 3)
    got, dropped = read(bytes(data))
    assert got == want and [n for n, _ in dropped] == [lost] and reason in dropped[0][1]


def test_truncated_tail_is_silent():
    assert read(rl.encode([b"foo"])[:-4]) == ([], [])
    assert read(rl.encode([big("bar", B)])[:-14]) == ([], [])
    assert read(rl.encode([big("bar", B)])[:-1]) == ([], [])
    assert read(rl.encode([b"foo"])[:-1]) == ([], [])


def test_bad_length():
    data = bytearray(rl.encode([big("bar", B - H), b"foo"]))
    data[4] = (data[4] + 1) & 255
    got, dropped = read(bytes(data))
    assert got == [b"foo"] and dropped == [(B, "bad record length")]


def test_checksum_mismatch():
    data = bytearray(rl.encode([b"foo"]))
    data[0] = (data[0] + 10) & 255
    assert read(bytes(data)) == ([], [(10, "checksum mismatch")])
    assert read(bytes(data), checksum=False) == ([b"foo"], [])


def test_skip_into_multi_record():
    assert read(rl.encode([big("foo", 3 * B), b"correct"]), B) == ([b"correct"], [])


def test_error_joins_records():
    data = bytearray(rl.encode([big("foo", B), big("bar", B), b"correct"]))
    data[B : 2 * B] = b"x" * B
    got, dropped = read(bytes(data))
    assert got == [b"correct"] and 2 * B <= sum(n for n, _ in dropped) <= 2 * B + 100


OFFSETS = [0, 10007, 20014, 84571, 84579, 98304]


@pytest.mark.parametrize(
    ("start", "first"),
    [(0, 0), (1, 1), (10000, 1), (10007, 1), (10008, 2), (20014, 2), (20015, 3), (B - 4, 3), (B + 1, 3), (2 * B + 1, 3), (66571, 3), (3 * B - 3, 5), (None, 6), (5, 1)],
)
def test_initial_offset(start, first):
    records = [big(c, n) for c, n in zip("abcdef", (10000, 10000, 64536, 1, 13716, 32761), strict=True)]
    data = rl.encode(records)
    got = list(rl.RecordReader(io.BytesIO(data), len(data) if start is None else start))
    assert got == list(zip(OFFSETS, records, strict=True))[first:]


def test_splits_give_every_record_once(tmp_path):
    rng = random.Random(5)
    for trial in range(20):
        records = [bytes([trial]) * rng.choice([0, 1, 100, 5000, 40_000, 90_000]) for _ in range(30)]
        data = bytearray(rl.encode(records))
        for _ in range(trial % 4):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        path = tmp_path / f"{trial}.log"
        path.write_bytes(data)
        reader = rl._Reader({"path": str(path), "splitBlocks": str(1 + trial % 3)})
        got = [(o, p) for split in reader.partitions() for _, o, p in reader.read(split)]
        assert got == list(rl.RecordReader(io.BytesIO(bytes(data))))


def test_many_files_and_splits_take_few_tasks(tmp_path):
    for i in range(300):
        with open(tmp_path / f"{i:03d}.log", "wb") as f:
            f.truncate(5 * B + i if i < 290 else 0)
    for faults, options in ((False, {"splitBlocks": "2"}), (False, {"splitBlocks": "2", "initialOffset": str(B + 7)}), (True, {"mode": "corruptions"})):
        reader = rl._Reader({"path": str(tmp_path), **options})
        tasks = reader.partitions()
        assert 32 <= len(tasks) <= rl.MOST_TASKS
        # each file from the first byte asked for to its end, without a gap; reports don't part a file
        seen = {}
        for split in (x for t in tasks for x in t.splits):
            assert split.start == seen.get(split.path, reader.initial)
            seen[split.path] = split.end
        assert len(seen) == 300 and set(seen.values()) == {None}
        assert not faults or sum(len(t.splits) for t in tasks) == 300
        held = [sum(max(0, (x.end or os.path.getsize(x.path)) - x.start) for x in t.splits) for t in tasks]
        assert max(held) < 2 * sum(held) / len(held)


def test_packed_splits_give_every_record_once(spark, tmp_path):
    rng, want, lost = random.Random(7), [], []
    for i in range(40):
        records = [bytes([i]) * rng.choice([0, 1, 100, 5000, 40_000, 90_000]) for _ in range(12)]
        data = bytearray(rl.encode(records))
        for _ in range(i % 3):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        path = str(tmp_path / f"{i:03d}.log")
        (tmp_path / f"{i:03d}.log").write_bytes(data)
        want += [(path, o, p) for o, p in rl.RecordReader(io.BytesIO(bytes(data)), on_drop=lambda n, why, path=path: lost.append((path, n, why)))]
    reader = rl._Reader({"path": str(tmp_path), "splitBlocks": "1"})
    tasks = reader.partitions()
    assert len(tasks) <= rl.MOST_TASKS < sum(-(-os.path.getsize(f) // B) for f in rl.files(str(tmp_path)))
    assert [r for t in tasks for r in reader.read(t)] == want
    rl.register(spark)
    read_ = lambda **o: sorted(tuple(r) for r in spark.read.format("record_log").options(**o).load(str(tmp_path)).collect())
    assert [(f, o, bytes(p)) for f, o, p in read_(splitBlocks="1")] == sorted(want)
    assert lost and read_(mode="corruptions") == sorted(lost)


def test_blocks_beyond_the_end_are_read_one_by_one():
    class Counting(io.BytesIO):
        count = 0

        def read(self, n=-1):
            self.count += 1
            return super().read(n)

    source = Counting(rl.encode([b"x" * 1000] * 3000))
    for offset, _ in rl.RecordReader(source, until=3 * B):
        if offset >= 3 * B:
            break
    assert source.count == 4


def test_spark_source(spark, tmp_path):
    rl.register(spark)
    path = str(tmp_path / "logs")
    rows = [(big(str(i), 20_000 * (i % 4)),) for i in range(40)]
    df = spark.createDataFrame(rows, "payload binary").repartition(3)
    df.write.format("record_log").mode("append").save(path)
    assert len(rl.files(path)) == 3 and not [f for f in os.listdir(path) if f.startswith("_")]
    read_ = lambda **o: spark.read.format("record_log").options(**o).load(path)
    got = sorted(bytes(r["payload"]) for r in read_(splitBlocks="1").collect())
    assert got == sorted(r[0] for r in rows)
    assert read_(mode="corruptions").count() == 0
    broken = rl.files(path)[0]
    data = bytearray(open(broken, "rb").read())
    data[0] ^= 1
    open(broken, "wb").write(data)
    report = read_(mode="corruptions").collect()
    assert [r["reason"] for r in report][0] == "checksum mismatch" and {r["path"] for r in report} == {broken}
    df.limit(1).write.format("record_log").mode("overwrite").save(path)
    assert read_().count() == 1


def test_tail_reads_from_the_block_of_an_unfinished_record(tmp_path):
    import random

    rng = random.Random(5)
    records = [bytes([i % 251]) * rng.choice([0, 3, 500, 32_755, 32_761, 40_000, 100_000]) for i in range(120)]
    data, path = rl.encode(records), tmp_path / "a.log"
    tail, seen, at = rl._Tail({"path": str(tmp_path)}), [], 0
    while at < len(data):
        stop = min(len(data), at + rng.choice([1, 6, 7, 700, 33_000, 120_000]))
        path.write_bytes(data[:stop])
        for split in tail.partitions({str(path): at}, tail.latestOffset()):
            seen += [payload for _, _, payload in tail.read(split)]
        at = stop
    assert seen == records


def test_tail_reads_only_what_is_new(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(rl.encode([b"x" * 1000] * 2000))
    size = path.stat().st_size

    class Counting:
        def __init__(self, source):
            self.source, self.read_bytes = source, 0

        def seek(self, place):
            self.source.seek(place)

        def tell(self):
            return self.source.tell()

        def read(self, n):
            got = self.source.read(n)
            self.read_bytes += len(got)
            return got

    with open(path, "rb") as f:
        counting = Counting(f)
        begin = rl._begin(counting, size - 5000)
        list(rl.RecordReader(rl._Window(counting, size), begin))
        assert counting.read_bytes < 4 * rl.BLOCK
