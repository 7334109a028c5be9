"""The record log: records framed in 32 KiB blocks, as a Spark data source.

A frame is a masked CRC (4 bytes), a length (2), a type (1) and the payload. A record that
doesn't fit its block is cut into First, Middle and Last frames; the last bytes of a block that
can't hold a header are zeros.

``spark.read.format("record_log").load(path)`` gives ``path, record_offset, payload``. Options:
``initialOffset`` (0), ``checksum`` (true), ``mode`` (``records``, or ``corruptions`` for
``path, bytes, reason``), ``splitBlocks`` (2048: blocks between two places where tasks may part). A
split starts at a block, skips the rest of a record that began before it, and reads past its end to
finish its last record, so a large file is read by many tasks. Reports don't part a file. A task
takes splits in a row, of the same file in one pass, so that there are 64 tasks at most, or one for
each 64 MB if that is more, however many the files and splits.

Writing: each task writes one file of its rows' ``payload`` in order; files appear when the job
commits. With the option ``fileColumn``, a task begins a new file, ``<value>.log``, wherever that
column (a whole number) changes; rows must be sorted by it. Paths are on a file system that all
machines mount; those of other schemes are refused.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from palimpsest.errors import InvalidArgument
from palimpsest.functions.checksum import crc32c, crc32c_many, mask

BLOCK = 32768
HEADER = 7
ZERO, FULL, FIRST, MIDDLE, LAST = range(5)
_BAD = -1
RECORDS = "path string, record_offset bigint, payload binary"
CORRUPTIONS = "path string, bytes bigint, reason string"
_TYPE_CRC = [crc32c(bytes([t])) for t in range(5)]
#: Checksum, length, type.
_FRAME_HEAD = struct.Struct("<IHB")
#: Blocks whose checksums are reckoned together.
AHEAD = 32


class RecordWriter:
    """Appends framed records to a binary file; ``length`` is what the file already holds."""

    def __init__(self, out, length: int = 0):
        self.out, self.at = out, length % BLOCK

    def add(self, record: bytes) -> None:
        self.add_many([record])

    def add_many(self, records: list[bytes]) -> None:
        """Records in a row; their checksums are reckoned together."""
        kinds, parts, gaps = [], [], []
        for record in records:
            view, begun = memoryview(record), False
            while True:
                room, gap = BLOCK - self.at, 0
                if room < HEADER:
                    self.at, room, gap = 0, BLOCK, room
                part = view[: room - HEADER]
                view = view[len(part) :]
                kinds.append((LAST if begun else FULL) if not view else (MIDDLE if begun else FIRST))
                parts.append(part)
                gaps.append(gap)
                self.at += HEADER + len(part)
                begun = True
                if not view:
                    break
        sums = crc32c_many(parts, np.array([_TYPE_CRC[k] for k in kinds], dtype=np.int64)).tolist()
        for kind, part, gap, crc in zip(kinds, parts, gaps, sums, strict=True):
            self.out.write(bytes(gap) + _FRAME_HEAD.pack(mask(crc), len(part), kind))
            self.out.write(part)


class RecordReader:
    """Iterates over ``(record_offset, payload)`` of one file; ``on_drop(bytes, reason)`` hears of what is lost.

    Blocks are read some at a time, and one by one from the offset ``until`` on.
    """

    def __init__(self, source, initial_offset: int = 0, checksum: bool = True, on_drop: Callable[[int, str], None] | None = None, until: int | None = None):
        self.source, self.start, self.checksum, self.on_drop, self.until = source, initial_offset, checksum, on_drop, until
        self.block_end = 0  # file offset where the buffered block ends
        self.rest = 0  # bytes of the block not yet used

    def _drop(self, count: int, reason: str) -> None:
        place = self.block_end - self.rest - count
        # a place before the file's start counts as far beyond it
        if self.on_drop and (place < 0 or place >= self.start):
            self.on_drop(count, reason)

    def _blocks(self, place: int) -> Iterator[tuple[bytes | OSError, list[tuple[int, int, int, bool]]]]:
        """Each block, or the fault in reading it, with its frames up to the first that can't be placed: start, stop, type, and whether the checksum fits."""
        ended = False
        while not ended:
            blocks: list[bytes | OSError] = []
            wanted = AHEAD if self.until is None else min(AHEAD, max(1, -(-(self.until - place) // BLOCK)))
            while len(blocks) < wanted and not ended:
                try:
                    blocks.append(self.source.read(BLOCK))
                    ended = len(blocks[-1]) < BLOCK
                except OSError as error:
                    blocks.append(error)
                    ended = True
            place += BLOCK * len(blocks)
            placed = [[] if isinstance(block, OSError) else self._placed(block) for block in blocks]
            if self.checksum:
                data = [block[at + 6 : stop] for block, found in zip(blocks, placed, strict=True) for at, stop, _, _ in found]
                sums = iter(crc32c_many(data, np.zeros(len(data), dtype=np.int64)).tolist())
                placed = [[(at, stop, kind, said == mask(next(sums))) for at, stop, kind, said in found] for found in placed]
            yield from zip(blocks, placed, strict=True)

    @staticmethod
    def _placed(block: bytes) -> list[tuple[int, int, int, int]]:
        """Start, stop, type and stated checksum of a block's frames, as far as their lengths lead."""
        found, at = [], 0
        while len(block) - at >= HEADER:
            said, size, kind = _FRAME_HEAD.unpack_from(block, at)
            stop = at + HEADER + size
            if stop > len(block) or kind == ZERO and not size:
                break
            found.append((at, stop, kind, said))
            at = stop
        return found

    def _frames(self) -> Iterator[tuple[int, int, bytes]]:
        """``(type, offset, payload)`` of each frame, type _BAD for what can't be used; ends at the end of the file."""
        within = self.start % BLOCK
        skip = self.start - within + (BLOCK if within > BLOCK - 6 else 0)
        self.block_end = skip
        if skip:
            try:
                self.source.seek(skip)
            except OSError as error:
                self._drop(skip, str(error))
                return
        for block, placed in self._blocks(skip):
            if isinstance(block, OSError):
                self.rest = 0
                self._drop(BLOCK, f"read error: {block}")
                return
            begin, self.block_end = self.block_end, self.block_end + len(block)
            at, fault = 0, None
            for at, stop, kind, fits in placed:
                if self.checksum and not fits:
                    fault = "checksum mismatch"
                    break
                self.rest = len(block) - stop
                yield (kind, begin + at, block[at + HEADER : stop]) if begin + at >= self.start else (_BAD, 0, b"")
                at = stop
            if fault is None and len(block) - at >= HEADER:
                if at + HEADER + _FRAME_HEAD.unpack_from(block, at)[1] <= len(block):
                    fault = ""  # preallocated space
                elif len(block) < BLOCK:
                    return  # the writer died inside the record
                else:
                    fault = "bad record length"
            self.rest = 0
            if fault is not None:
                if fault:
                    self._drop(len(block) - at, fault)
                yield _BAD, 0, b""

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        resync = self.start > 0
        parts: list[bytes] | None = None
        begin = 0
        for kind, offset, payload in self._frames():
            if resync and kind != _BAD:
                if kind in (MIDDLE, LAST):
                    resync = kind == MIDDLE
                    continue
                resync = False
            pending = sum(map(len, parts or ()))
            if kind in (FULL, FIRST):
                if pending:
                    self._drop(pending, f"partial record without end({1 if kind == FULL else 2})")
                if kind == FULL:
                    parts = None
                    yield offset, payload
                else:
                    parts, begin = [payload], offset
            elif kind in (MIDDLE, LAST):
                if parts is None:
                    self._drop(len(payload), f"missing start of fragmented record({1 if kind == MIDDLE else 2})")
                    continue
                parts.append(payload)
                if kind == LAST:
                    whole, parts = b"".join(parts), None
                    yield begin, whole
            elif kind == _BAD:
                if parts is not None:
                    self._drop(pending, "error in middle of record")
                parts = None
            else:
                self._drop(len(payload) + pending, f"unknown record type {kind}")
                parts = None


def encode(records: Iterable[bytes], length: int = 0) -> bytes:
    out = io.BytesIO()
    RecordWriter(out, length).add_many(list(records))
    return out.getvalue()


def local(path: str) -> str:
    """A path of the mounted file system; other schemes can't be opened here."""
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in path:
        raise InvalidArgument(f"{path}: logs and stores need a mounted file system")
    return path


def files(path: str) -> list[str]:
    path = local(path)
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".log"))


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int | None


@dataclass
class Splits(InputPartition):
    """What one task reads, one after the other."""

    splits: list[Split]


#: Tasks at most, unless the logs hold more than so many times as many bytes.
MOST_TASKS, TASK_BYTES = 64, 64 << 20


class _Packer:
    """Deals splits, as they come, to tasks of about the same number of bytes; a file's neighbouring splits become one."""

    def __init__(self, total: int):
        self.most = max(MOST_TASKS, -(-total // TASK_BYTES))
        self.each, self.taken, self.tasks = max(1, total / self.most), 0, []

    def add(self, split: Split, count: int) -> None:
        task = min(int(self.taken / self.each), self.most - 1)
        self.taken += count
        if not self.tasks or task != self.tasks[-1][0]:
            self.tasks.append((task, [split]))
            return
        here = self.tasks[-1][1]
        if here[-1].path == split.path and here[-1].end == split.start:
            here[-1].end = split.end
        else:
            here.append(split)

    def partitions(self) -> list[Splits]:
        return [Splits(splits) for _, splits in self.tasks]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.initial = int(options.get("initialoffset", options.get("initialOffset", 0)))
        self.checksum = str(options.get("checksum", "true")).lower() == "true"
        self.faults = options.get("mode", "records") == "corruptions"
        self.span = BLOCK * int(options.get("splitblocks", options.get("splitBlocks", 2048)))

    def partitions(self) -> list[Splits]:
        sizes = [(f, os.path.getsize(f)) for f in files(self.path)]
        packer = _Packer(sum(max(0, size - self.initial) for _, size in sizes))
        for f, size in sizes:
            start = self.initial
            while not self.faults:
                end = (start // self.span + 1) * self.span
                if end >= size:
                    break
                packer.add(Split(f, start, end), end - start)
                start = end
            packer.add(Split(f, start, None), max(0, size - start))
        return packer.partitions()

    def read(self, part: Splits):
        for split in part.splits:
            yield from self.read_split(split)

    def read_split(self, split: Split):
        dropped: list[tuple[str, int, str]] = []
        with open(split.path, "rb") as source:
            found = RecordReader(source, split.start, self.checksum, (lambda n, why: dropped.append((split.path, n, why))) if self.faults else None, split.end)
            for offset, payload in found:
                if split.end is not None and offset >= split.end:
                    break
                if not self.faults:
                    yield split.path, offset, payload
        yield from dropped


#: Rows and bytes of one Arrow batch of what is read.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


class _ArrowReader(_Reader):
    """The reader that Spark gets: the same rows, in Arrow batches."""

    def read(self, part: Splits):
        import pyarrow as pa

        names = ["path", "bytes", "reason"] if self.faults else ["path", "record_offset", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string() if self.faults else pa.binary()]
        rows, held = [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for row in super().read(part):
            rows.append(row)
            held += len(row[2])
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield make()
                rows, held = [], 0
        if rows:
            yield make()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # staged, final


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = local(options["path"]), overwrite
        self.column = options.get("filecolumn", options.get("fileColumn"))

    def write(self, batches) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        number, done = task.partitionId() if task else 0, []
        out, last = None, None

        def begin(value):
            unique = uuid.uuid4().hex
            final = os.path.join(self.path, f"{number:06d}-{unique}.log" if value is None else f"{int(value):06d}.log")
            staged = os.path.join(self.path, f"_{unique}.tmp")
            done.append((staged, final))
            return open(staged, "wb")

        def end(out) -> None:
            if out is not None:
                out.flush()
                os.fsync(out.fileno())
                out.close()

        for batch in batches:
            column = lambda name: batch.column(batch.schema.names.index(name)).to_pylist()  # noqa: B023, E731
            rows = zip(column(self.column) if self.column else [None] * batch.num_rows, column("payload"), strict=True)
            for value, part in groupby(rows, key=itemgetter(0)):
                if out is None or value != last:
                    end(out)
                    out, last = begin(value), value
                    writer = RecordWriter(out)
                writer.add_many([payload for _, payload in part])
        if out is None and not self.column:
            out = begin(None)  # a task without rows has a file as well
        end(out)
        return Written(done)

    def commit(self, messages) -> None:
        made = [f for m in messages if m is not None for f in m.files]
        old = files(self.path) if self.overwrite else []
        for staged, final in made:
            os.replace(staged, final)
        for f in set(old) - {final for _, final in made}:
            os.remove(f)

    def abort(self, messages) -> None:
        for m in messages:
            for staged, _ in m.files if m is not None else ():
                if os.path.exists(staged):
                    os.remove(staged)


class _Window:
    """A file that ends at ``end``."""

    def __init__(self, source, end: int):
        self.source, self.end = source, end

    def seek(self, place: int) -> None:
        self.source.seek(place)

    def read(self, count: int) -> bytes:
        return self.source.read(max(0, min(count, self.end - self.source.tell())))


def _begin(source, place: int) -> int:
    """Start of the nearest block at or before ``place`` that doesn't begin inside a record."""
    block = place // BLOCK * BLOCK
    while block:
        source.seek(block)
        head = source.read(HEADER)
        if len(head) == HEADER and head[6] not in (MIDDLE, LAST):
            break
        block -= BLOCK
    return block


class _Tail(DataSourceStreamReader):
    """Follows growing files: a record is delivered once its last byte is there."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: os.path.getsize(f) for f in files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return [Split(f, start.get(f, 0), size) for f, size in end.items() if size > start.get(f, 0)]

    def read(self, split: Split):
        # A record belongs to the batch in which its last byte arrived. Reading starts at the block
        # where the record that was unfinished then began, and stops at the batch's end.
        with open(split.path, "rb") as source:
            found = RecordReader(_Window(source, split.end), _begin(source, split.start))
            for offset, payload in found:
                if found.block_end - found.rest > split.start:
                    yield split.path, offset, payload

    def commit(self, end: dict) -> None:
        pass


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return CORRUPTIONS if self.options.get("mode") == "corruptions" else RECORDS

    def reader(self, schema) -> _ArrowReader:
        return _ArrowReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)

    def streamReader(self, schema) -> _Tail:
        return _Tail(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(RecordLog)
