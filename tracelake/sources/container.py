"""Chunked log containers (the public MCAP format) as a Spark data source.

    spark.dataSource.register(LogContainer)
    spark.read.format("log_container").load(folder).where("topic = 'click'")
    events.write.format("log_container").mode("append").save(folder)

Reading: a file's summary names its chunks with their times, sizes and topics. Chunks
become partitions of about ``partitionBytes`` each, so a long recording is read by many
tasks and many short ones by few. Filters on episode, topic and ts_ns (Spark's own, where
the option ``pushdown`` and ``spark.sql.python.filterPushdown.enabled`` are true, or the options ``topics``, a JSON
list, ``startNs`` and ``endNs``) drop files and chunks before a task starts and, through a chunk's message
index, all messages of other topics within it. Each chunk has a checksum. Option
``table`` picks what is read: messages, chunks (the index itself), attachments, metadata.

Writing: rows come sorted by episode and time (``arranged``). A task writes a file for
each of its episodes, or part of one; files get their names when all tasks have ended,
so a failed job or a task that ran twice leaves nothing. An episode that has two message
types for a topic is an error, found while writing. The episode is kept in the file's
metadata; it defaults to the file's name for files of other writers.

Defined cases: a folder without containers is an error; a file without messages gives
no rows; a chunk or file that does not fit its checksum or ends early is an error that
names it. Sequence numbers must fit 32 bits, times must not be negative.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tracelake.schema import ENVELOPE

#: Magic bytes and record numbers, fixed values of the format.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX = range(1, 9)
ATTACHMENT, ATTACHMENT_INDEX, STATISTICS, METADATA, METADATA_INDEX, SUMMARY_OFFSET, DATA_END = range(9, 16)
SUFFIX, EPISODE = ".mcap", "episode"
CHUNK_BYTES, PARTITION_BYTES = 1 << 20, 32 << 20
TABLES = {
    "messages": ENVELOPE,
    "chunks": "file string, episode string, start bigint, length bigint, start_ns bigint, end_ns bigint, topics array<string>, messages bigint, bytes bigint",
    "attachments": "file string, episode string, name string, media_type string, log_ns bigint, create_ns bigint, data binary",
    "metadata": "file string, episode string, name string, values map<string,string>",
}


class Cursor:
    """Little-endian fields of a record, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def number(self, form: str) -> int:
        (value,) = struct.unpack_from(f"<{form}", self.data, self.at)
        self.at += struct.calcsize(f"<{form}")
        return value

    def bytes(self, size: int) -> bytes:
        self.at += size
        if self.at > len(self.data):
            raise ValueError("a record ends early")
        return bytes(self.data[self.at - size : self.at])

    def text(self) -> str:
        return self.bytes(self.number("I")).decode()

    def pairs(self, key: str | None = None, value: str | None = None) -> list[tuple]:
        end = self.number("I") + self.at
        out = []
        while self.at < end:
            out.append((self.number(key) if key else self.text(), self.number(value) if value else self.text()))
        return out


def text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


def texts(values: dict[str, str]) -> bytes:
    raw = b"".join(text(k) + text(v) for k, v in values.items())
    return struct.pack("<I", len(raw)) + raw


def record(kind: int, content: bytes) -> bytes:
    return struct.pack("<BQ", kind, len(content)) + content


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(kind, offset, content) of the records of a section."""
    at = 0
    while at < len(data):
        kind, size = struct.unpack_from("<BQ", data, at)
        if at + 9 + size > len(data):
            raise ValueError("a record ends early")
        yield kind, at, data[at + 9 : at + 9 + size]
        at += 9 + size


def compress(data: bytes, how: str) -> bytes:
    if how == "zstd":
        import zstandard

        return zstandard.compress(data, 3)
    return data


def decompress(data: bytes, how: str, size: int) -> bytes:
    if how == "zstd":
        import zstandard

        return zstandard.decompress(data, max_output_size=size)
    if how == "lz4":
        return pa.decompress(data, size, "lz4", asbytes=True)
    if how:
        raise ValueError(f"chunks are compressed by {how!r}")
    return data


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    scheme, sep, _ = path.partition("://")
    if sep or scheme.startswith("file:"):
        return fs.FileSystem.from_uri(path if sep else f"file://{path[5:]}")
    return fs.LocalFileSystem(), path


class ChunkRef(NamedTuple):
    start: int
    length: int
    index_length: int
    start_ns: int
    end_ns: int
    bytes: int
    channels: tuple[int, ...]


@dataclass
class Summary:
    """What the end of a file says of it."""

    channels: dict[int, tuple[str, str]] = field(default_factory=dict)  # topic, message type
    chunks: list[ChunkRef] = field(default_factory=list)
    attachments: list[tuple[int, int]] = field(default_factory=list)
    metadata: list[tuple[int, int]] = field(default_factory=list)
    episode: str = ""


def read_summary(files: fs.FileSystem, path: str, name: str) -> Summary:
    """Channels and indexes of a file, from its end; its episode, from its metadata."""
    with files.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(37, max(0, size - 37))  # a footer and the magic bytes
        if size < 45 or tail[-8:] != MAGIC or tail[0] != FOOTER:
            raise ValueError(f"{path} is no container or ends early")
        start, _, crc = struct.unpack_from("<QQI", tail, 9)
        section = f.read_at(size - 37 - start, start) if start else b""
        if crc and zlib.crc32(section + tail[:25]) != crc:
            raise ValueError(f"the summary of {path} does not fit its checksum")
        out, kinds = Summary(episode=name), {}
        for kind, _, content in records(section):
            c = Cursor(content)
            if kind == SCHEMA:
                number = c.number("H")
                kinds[number] = c.text()
            elif kind == CHANNEL:
                number, schema = c.number("H"), c.number("H")
                out.channels[number] = (c.text(), kinds.get(schema, ""))
            elif kind == CHUNK_INDEX:
                first, last, at, length = (c.number("Q") for _ in range(4))
                offsets = c.pairs("H", "Q")
                index_length = c.number("Q")
                c.text()
                c.number("Q")
                out.chunks.append(ChunkRef(at, length, index_length, first, last, c.number("Q"), tuple(k for k, _ in offsets)))
            elif kind == ATTACHMENT_INDEX:
                out.attachments.append((c.number("Q"), c.number("Q")))
            elif kind == METADATA_INDEX:
                at, length = c.number("Q"), c.number("Q")
                out.metadata.append((at, length))
                if c.text() == EPISODE:
                    out.episode = dict(metadata_of(f.read_at(length, at))[1]).get(EPISODE, name)
        return out


def metadata_of(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    c = Cursor(data, 9)
    return c.text(), c.pairs()


def attachment_of(data: bytes, path: str) -> tuple[int, int, str, str, bytes]:
    """(log time, creation time, name, media type, data)."""
    c = Cursor(data, 9)
    out = c.number("Q"), c.number("Q"), c.text(), c.text(), c.bytes(c.number("Q"))
    crc = c.number("I")
    if crc and zlib.crc32(data[9 : c.at - 4]) != crc:
        raise ValueError(f"attachment {out[2]} of {path} does not fit its checksum")
    return out


@dataclass(frozen=True)
class Wanted:
    """What a scan asks for; None is everything."""

    topics: frozenset[str] | None = None
    episodes: frozenset[str] | None = None
    start_ns: int | None = None
    end_ns: int | None = None

    def narrowed(self, topics=None, episodes=None, start_ns=None, end_ns=None) -> Wanted:
        both = lambda a, b: b if a is None else a if b is None else a & b
        most = lambda f, *x: f([v for v in x if v is not None], default=None)
        return Wanted(both(self.topics, topics), both(self.episodes, episodes), most(max, self.start_ns, start_ns), most(min, self.end_ns, end_ns))

    def channels(self, summary: Summary) -> set[int]:
        return {k for k, (topic, _) in summary.channels.items() if self.topics is None or topic in self.topics}

    def chunks(self, summary: Summary) -> list[ChunkRef]:
        if self.episodes is not None and summary.episode not in self.episodes:
            return []
        channels = self.channels(summary)
        inside = lambda c: (self.start_ns is None or c.end_ns >= self.start_ns) and (self.end_ns is None or c.start_ns <= self.end_ns)
        return [c for c in summary.chunks if inside(c) and not channels.isdisjoint(c.channels)]


def wanted_by(filters: list[Filter], wanted: Wanted) -> Wanted:
    """Narrowed by the filters that are known; the others are Spark's alone."""
    for f in filters:
        column = f.attribute[0] if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
        if column in ("topic", "episode") and isinstance(f, EqualTo | In):
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            wanted = wanted.narrowed(**{f"{column}s": values})
        elif column == "ts_ns" and not isinstance(f, In):
            low = isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual)
            high = isinstance(f, EqualTo | LessThan | LessThanOrEqual)
            wanted = wanted.narrowed(start_ns=f.value + isinstance(f, GreaterThan) if low else None, end_ns=f.value - isinstance(f, LessThan) if high else None)
    return wanted


@dataclass
class Part(InputPartition):
    """Places in files: path, episode, channels (number -> topic and type), and offsets of chunks or records."""

    places: list[tuple[str, str, dict[int, tuple[str, str]], list]]


def messages_of(data: bytes, ref: ChunkRef, channels: dict[int, tuple[str, str]], wanted: Wanted, path: str) -> Iterator[tuple]:
    """(sequence, time, topic, type, payload) of a chunk's wanted messages; ``data``: the chunk's record and its message indexes."""
    c = Cursor(data, 9)
    c.at += 16
    size, crc, how = c.number("Q"), c.number("I"), c.text()
    body = decompress(c.bytes(c.number("Q")), how, size)
    if len(body) != size or (crc and zlib.crc32(body) != crc):
        raise ValueError(f"the chunk at {ref.start} of {path} does not fit its checksum")
    found = []
    for kind, _, content in records(data[ref.length :]):
        (channel,) = struct.unpack_from("<H", content)
        if kind == MESSAGE_INDEX and channel in channels:
            found.append(np.frombuffer(content, "<u8", -1 if len(content) > 6 else 0, 6).reshape(-1, 2))
    index = np.concatenate(found) if found else np.empty((0, 2), "<u8")
    low, high = wanted.start_ns, wanted.end_ns
    kept = index[(index[:, 0] >= max(0, low or 0)) & (index[:, 0] <= (2**64 - 1 if high is None else max(0, high)))] if high is None or high >= 0 else index[:0]
    for offset in np.sort(kept[:, 1]).tolist():
        kind, length, channel, sequence, log_ns = struct.unpack_from("<BQHIQ", body, offset)
        if kind != MESSAGE or offset + 9 + length > size:
            raise ValueError(f"the message index of the chunk at {ref.start} of {path} is wrong")
        yield sequence, log_ns, *channels[channel], body[offset + 31 : offset + 9 + length]


class ContainerReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.path, self.table = options["path"], options.get("table", "messages")
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        topics = options.get("topics")
        start, end = (options.get(k.lower(), options.get(k)) for k in ("startNs", "endNs"))
        self.wanted = Wanted(frozenset(json.loads(topics)) if topics else None, None, int(start) if start else None, int(end) if end else None)

    def _files(self) -> list[tuple[str, str]]:
        """(path, name) of the containers in the folder and below, in order."""
        files, root = store(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        paths = sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(SUFFIX) and not any(p[:1] in "._" for p in i.path[len(root) :].split("/") if p))
        if not paths:
            raise FileNotFoundError(f"no {SUFFIX} files in {self.path}")
        return [(p, p.rpartition("/")[2].removesuffix(SUFFIX)) for p in paths]

    def partitions(self) -> list[Part]:
        files = store(self.path)[0]
        paths = self._files()
        with ThreadPoolExecutor(16) as pool:  # a few kB of each file
            summaries = list(pool.map(lambda x: read_summary(files, *x), paths))
        parts, room = [], 0
        for (path, _), s in zip(paths, summaries, strict=True):
            if self.table == "messages":
                refs, channels = self.wanted.chunks(s), self.wanted.channels(s)
            else:
                refs, channels = getattr(s, self.table), set(s.channels)
            for ref in refs:
                size = ref.bytes if isinstance(ref, ChunkRef) and self.table == "messages" else 4096 if self.table == "chunks" else ref[1]
                if room < size or not parts:
                    parts.append(Part([]))
                    room = self.partition_bytes
                room -= size
                places = parts[-1].places
                if not places or places[-1][0] != path:
                    places.append((path, s.episode, {k: v for k, v in s.channels.items() if k in channels}, []))
                places[-1][3].append(ref)
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in TABLES[self.table].split(", ")]
        types = SCHEMAS[self.table]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        files = store(self.path)[0]
        for path, episode, channels, refs in partition.places:
            with files.open_input_file(path) as f:
                for ref in refs:
                    if self.table == "messages":
                        data = f.read_at(ref.length + ref.index_length, ref.start)
                        rows += [(episode, sequence, t, topic, kind, payload.decode()) for sequence, t, topic, kind, payload in messages_of(data, ref, channels, self.wanted, path)]
                    elif self.table == "chunks":
                        index = f.read_at(ref.index_length, ref.start + ref.length)
                        messages = sum((len(c) - 6) // 16 for _, _, c in records(index))
                        rows.append((path, episode, ref.start, ref.length, ref.start_ns, ref.end_ns, sorted({channels[c][0] for c in ref.channels}), messages, ref.bytes))
                    elif self.table == "metadata":
                        name, values = metadata_of(f.read_at(ref[1], ref[0]))
                        rows.append((path, episode, name, values))
                    else:
                        log_ns, create_ns, name, media, content = attachment_of(f.read_at(ref[1], ref[0]), path)
                        rows.append((path, episode, name, media, log_ns, create_ns, content))
                    if len(rows) >= 20_000:
                        yield batch()
                        rows.clear()
        yield batch()


class PushingReader(ContainerReader):
    """A reader that Spark hands its filters to."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows what is opened; Spark applies every filter again."""
        self.wanted = wanted_by(filters, self.wanted) if self.table == "messages" else self.wanted
        yield from filters


_TEXT, _LONG = pa.string(), pa.int64()
SCHEMAS = {
    "messages": [_TEXT, _LONG, _LONG, _TEXT, _TEXT, _TEXT],
    "chunks": [_TEXT, _TEXT, _LONG, _LONG, _LONG, _LONG, pa.list_(_TEXT), _LONG, _LONG],
    "attachments": [_TEXT, _TEXT, _TEXT, _TEXT, _LONG, _LONG, pa.binary()],
    "metadata": [_TEXT, _TEXT, _TEXT, pa.map_(_TEXT, _TEXT)],
}


class ContainerFile:
    """One file being written: chunks as they fill, then the summary."""

    def __init__(self, sink, episode: str, *, compression: str = "zstd", chunk_bytes: int = CHUNK_BYTES, metadata: dict[str, dict[str, str]] | None = None):
        self.sink, self.at, self.how, self.chunk_bytes = sink, 0, compression, chunk_bytes
        self.channels: dict[str, tuple[int, str]] = {}
        self.kinds: dict[str, int] = {}
        self.described: list[bytes] = []
        self.indexes: list[bytes] = []
        self.n_chunks, self.n_attachments, self.counts, self.first, self.last = 0, 0, defaultdict(int), None, 0
        self._put(MAGIC + record(HEADER, text("") + text("tracelake")))
        named = {EPISODE: {EPISODE: episode}} | (metadata or {})
        self.n_metadata = len(named)
        for name, values in named.items():
            raw = record(METADATA, text(name) + texts(values))
            self.indexes.append(record(METADATA_INDEX, struct.pack("<QQ", self.at, len(raw)) + text(name)))
            self._put(raw)
        self._fresh()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _fresh(self) -> None:
        self.body, self.size, self.places, self.low, self.high = [], 0, defaultdict(list), None, 0

    def _into_chunk(self, data: bytes) -> int:
        self.body.append(data)
        self.size += len(data)
        return self.size - len(data)

    def message(self, sequence: int | None, ts_ns: int, topic: str, kind: str, payload: str | None) -> None:
        if not 0 <= (sequence or 0) < 2**32 or ts_ns is None or ts_ns < 0:
            raise ValueError(f"sequence {sequence} or time {ts_ns} can't be stored")
        topic, kind = topic or "", kind or ""
        if topic not in self.channels:
            self.channels[topic] = len(self.channels) + 1, kind
            if kind not in self.kinds:
                self.kinds[kind] = len(self.kinds) + 1
                self.described.append(record(SCHEMA, struct.pack("<H", self.kinds[kind]) + text(kind) + text("jsonschema") + struct.pack("<I", 0)))
                self._into_chunk(self.described[-1])
            self.described.append(record(CHANNEL, struct.pack("<HH", self.channels[topic][0], self.kinds[kind]) + text(topic) + text("json") + texts({})))
            self._into_chunk(self.described[-1])
        channel, known = self.channels[topic]
        if known != kind:
            raise ValueError(f"topic {topic!r} has the message types {known!r} and {kind!r}")
        place = self._into_chunk(record(MESSAGE, struct.pack("<HIQQ", channel, sequence or 0, ts_ns, ts_ns) + (payload or "").encode()))
        self.places[channel].append((ts_ns, place))
        self.counts[channel] += 1
        self.low, self.high = ts_ns if self.low is None else min(self.low, ts_ns), max(self.high, ts_ns)
        if self.size >= self.chunk_bytes:
            self._end_chunk()

    def _end_chunk(self) -> None:
        if not self.places:
            return
        body = b"".join(self.body)
        small = compress(body, self.how)
        raw = record(CHUNK, struct.pack("<QQQI", self.low, self.high, len(body), zlib.crc32(body)) + text(self.how) + struct.pack("<Q", len(small)) + small)
        start, offsets, index = self.at, [], b""
        for channel, places in sorted(self.places.items()):
            offsets.append(struct.pack("<HQ", channel, start + len(raw) + len(index)))
            index += record(MESSAGE_INDEX, struct.pack("<HI", channel, 16 * len(places)) + np.array(places, "<u8").tobytes())
        self._put(raw + index)
        table = b"".join(offsets)
        self.indexes.append(record(CHUNK_INDEX, struct.pack("<QQQQI", self.low, self.high, start, len(raw), len(table)) + table + struct.pack("<Q", len(index)) + text(self.how) + struct.pack("<QQ", len(small), len(body))))
        self.n_chunks += 1
        self.first = self.low if self.first is None else min(self.first, self.low)
        self.last = max(self.last, self.high)
        self._fresh()

    def attach(self, name: str, media_type: str, data: bytes, log_ns: int = 0, create_ns: int = 0) -> None:
        self._end_chunk()
        content = struct.pack("<QQ", log_ns, create_ns) + text(name) + text(media_type) + struct.pack("<Q", len(data)) + data
        raw = record(ATTACHMENT, content + struct.pack("<I", zlib.crc32(content)))
        self.indexes.append(record(ATTACHMENT_INDEX, struct.pack("<QQQQQ", self.at, len(raw), log_ns, create_ns, len(data)) + text(name) + text(media_type)))
        self.n_attachments += 1
        self._put(raw)

    def close(self) -> None:
        self._end_chunk()
        self._put(record(DATA_END, struct.pack("<I", 0)))
        counts = b"".join(struct.pack("<HQ", k, n) for k, n in sorted(self.counts.items()))
        totals = struct.pack("<QHIIIIQQI", sum(self.counts.values()), len(self.kinds), len(self.channels), self.n_attachments, self.n_metadata, self.n_chunks, self.first or 0, self.last, len(counts))
        section = b"".join([*self.described, *self.indexes, record(STATISTICS, totals + counts)])
        head = struct.pack("<BQ", FOOTER, 20) + struct.pack("<QQ", self.at, 0)
        self._put(section + head + struct.pack("<I", zlib.crc32(section + head)) + MAGIC)
        self.sink.close()


@dataclass
class Written(WriterCommitMessage):
    """A task's files as (temporary name, episode), and the message types of its episodes' topics."""

    files: list[tuple[str, str]]
    kinds: dict[tuple[str, str], str]


class ContainerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.compression = options.get("compression", "zstd")
        self.chunk_bytes = int(options.get("chunkbytes", options.get("chunkBytes", CHUNK_BYTES)))
        self.job = uuid.uuid4().hex

    def _folder(self) -> str:
        return f"{store(self.path)[1]}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = store(self.path)[0]
        files.create_dir(self._folder(), recursive=True)
        out, done, kinds = None, [], {}
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("episode", "seq", "ts_ns", "topic", "message_type", "payload")]
            for episode, *row in zip(*columns, strict=True):
                episode = episode or ""
                if out is None or done[-1][1] != episode:
                    if out:
                        out.close()
                    done.append((uuid.uuid4().hex, episode))
                    out = ContainerFile(files.open_output_stream(f"{self._folder()}/{done[-1][0]}"), episode, compression=self.compression, chunk_bytes=self.chunk_bytes)
                out.message(*row)
                kinds[episode, row[2] or ""] = row[3] or ""
        if out:
            out.close()
        return Written(done, kinds if len(done) < 2 else {k: v for k, v in kinds.items() if k[0] in (done[0][1], done[-1][1])})

    def commit(self, messages: list[Written | None]) -> None:
        """Files get their names; of episodes that several tasks wrote, all must agree on the message types."""
        files, root = store(self.path)
        written = [m for m in messages if m]
        seen: dict[tuple[str, str], str] = {}
        for m in written:
            for key, kind in m.kinds.items():
                if seen.setdefault(key, kind) != kind:
                    self.abort(messages)
                    raise ValueError(f"topic {key[1]!r} of {key[0]!r} has the message types {seen[key]!r} and {kind!r}")
        if self.overwrite:
            old = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
            for info in old:
                if info.path.endswith(SUFFIX):
                    files.delete_file(info.path)
        for m in written:
            for name, _ in m.files:
                files.move(f"{self._folder()}/{name}", f"{root}/{name}{SUFFIX}")
        if written:
            files.delete_dir(self._folder())

    def abort(self, messages: list[Written | None]) -> None:
        files = store(self.path)[0]
        if files.get_file_info(self._folder()).type == fs.FileType.Directory:
            files.delete_dir(self._folder())


class LogContainer(DataSource):
    """Registered by ``spark.dataSource.register(LogContainer)``."""

    @classmethod
    def name(cls) -> str:
        return "log_container"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "messages")]

    def reader(self, schema) -> ContainerReader:
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else ContainerReader
        return kind(schema, dict(self.options))

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        missing = {"episode", "seq", "ts_ns", "topic", "message_type", "payload"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return ContainerWriter(dict(self.options), overwrite)


def arranged(events: DataFrame) -> DataFrame:
    """Envelopes in the order in which they are written: a long episode is split among tasks, many short ones share one."""
    order = ["episode", "ts_ns", "seq"]
    return events.select("episode", "seq", "ts_ns", "topic", "message_type", "payload").repartitionByRange(*order).sortWithinPartitions(*order)


def write_containers(events: DataFrame, path: str, *, mode: str = "append", **options: object) -> None:
    """Write envelopes to a folder of containers."""
    spark = events.sparkSession
    spark.dataSource.register(LogContainer)
    arranged(events).write.format("log_container").options(**{k: str(v) for k, v in options.items()}).mode(mode).save(path)


def read_containers(spark, path: str, *, table: str = "messages", topics: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Messages of a folder of containers, both ends of the range included; or its chunks, attachments or metadata."""
    spark.dataSource.register(LogContainer)
    reader = spark.read.format("log_container").option("table", table).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    given = {"topics": None if topics is None else json.dumps(topics), "startNs": start_ns, "endNs": end_ns}
    for key, value in given.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(path)
