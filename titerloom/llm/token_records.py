"""Token ids in length-delimited binary records: a data source that writes and reads them.

A folder of the format holds, for each task that wrote, a shard and its index, and ``index.json``,
which names them in order. The manifest is written last and at once: without it nothing is there,
and files that it doesn't name (of lost or repeated attempts) are never read.

Shard ``part-<n>-<attempt>.rec``, all numbers little-endian, record after record::

    u64 length | u32 masked checksum of the length's 8 bytes | payload | u32 masked checksum of the payload
    payload: u8 bytes of an id (2 or 4) | u8 1 if a doc_id follows that is not null | i64 doc_id | ids

Index ``part-<n>-<attempt>.idx``: u64 n, then n + 1 byte offsets and n + 1 counts of ids before each
record, u64 each, so that any record is read by one seek: readers take byte ranges, in stored or in
shuffled order. The checksum is CRC-32, masked by a rotation and a constant, as a sum of data that
holds sums would otherwise be weak.

Rows: nulls in doc_id come first, in the order of (doc_id, hash of the text); a null text is empty;
repeated rows are each a record; other columns take no part. An empty table gives a manifest
without shards, which reads as no row. A text of any length is encoded whole, in pieces of bounded size.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from titerloom.llm.common import give_back, kept_by_worker, let_go, text_hash

FORMAT = "token_records"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
LENGTH, SUM, HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BBq")
FRAME = LENGTH.size + 2 * SUM.size
#: Bytes of records that a reading task takes, and that it hands to Spark at once.
PER_TASK, PER_BATCH = 32 << 20, 4 << 20
#: Characters that are encoded at once; chunks of text whose ids a worker remembers, in each of two
#: generations; characters beyond which a chunk isn't remembered.
AT_ONCE, MEMO, LONG = 1 << 16, 600_000, 256
#: Marks that stand apart from the letter before them, if it is below LATIN.
MARKS, LATIN = ".,;:!?", "\u0250"
WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Byte-level models write a byte as the character of its number, or, if that isn't printable, as one from 256 on, by their order.
BYTES = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: A chunk: white space and what follows it up to the next; the tokenizer never joins what stands
#: on both sides of the place where white space begins. 1C to 1F are white space in Python alone.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, SUM.pack(masked(length)), payload, SUM.pack(masked(payload))))


def unframe(data: memoryview, where: str) -> memoryview:
    """The payload of a whole record; ValueError if its length or a checksum is wrong."""
    if len(data) < FRAME or SUM.unpack_from(data, LENGTH.size)[0] != masked(data[: LENGTH.size]) or LENGTH.unpack_from(data)[0] != len(data) - FRAME:
        raise ValueError(f"{where}: the record's length is damaged")
    payload = data[LENGTH.size + SUM.size : -SUM.size]
    if SUM.unpack_from(data, len(data) - SUM.size)[0] != masked(payload):
        raise ValueError(f"{where}: the record is damaged")
    return payload


class Encoder:
    """Ids of whole texts by the tokenizers library; chunks met before are looked up."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        config = json.loads(self.library.to_str())
        split = config["pre_tokenizer"] or {}
        # Chunks are independent for byte-level splitting without a normalizer; any other tokenizer gets whole texts.
        self.by_chunk = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not config["normalizer"] and not config["post_processor"] and not config["model"].get("dropout")
        self.model = self.library.model
        # Strings of added tokens may hold white space or swallow what stands around them.
        self.added = [t["content"] for t in config["added_tokens"]]
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = next(c for c in "HIL" if array(c).itemsize == self.type.itemsize)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pack(self, ids: Sequence[int]) -> bytes:
        numbers = array(self.code, ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return numbers.tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Bring chunks into the memo: from its older generation, or from the library. A mark after a
        letter of a chunk is a piece of its own, so that a word is looked up once, with and without."""
        marked = {c for c in chunks if c[-1] in MARKS and c[-2:-1].isalpha() and c[-2] < LATIN and c not in self.old}
        others = []
        new, old = self.new, self.old
        for c in chunks - marked | {c[:-1] for c in marked} | {c[-1] for c in marked}:
            if c not in new:
                if c in old:
                    new[c] = old[c]
                elif WORD.fullmatch(c):
                    # One piece, which needn't be looked for: the library's model takes it as it is.
                    if c.isascii():  # of its bytes a space alone has another character
                        letters = BYTES[32] + c[1:] if c[0] == " " else c
                    else:
                        letters = c.encode().decode("latin-1").translate(BYTES)
                    self.new[c] = self.pack([t.id for t in self.model.tokenize(letters)])
                else:
                    others.append(c)
        for c, found in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.new[c] = self.pack(found.ids)
        for c in marked:
            self.new[c] = self.new[c[:-1]] + self.new[c[-1]]

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or any(a in text for a in self.added):
            return self.pack(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(self.pieces(text))

    def pieces(self, text: str) -> Iterator[bytes]:
        lo = 0
        while lo < len(text):
            hi = min(len(text), lo + AT_ONCE)
            chunks = CHUNK.findall(text, lo, hi)
            if hi < len(text) and len(chunks) > 1:
                hi -= len(chunks.pop())  # it may go on
            elif hi < len(text):
                end = CHUNK.match(text, lo)
                chunks, hi = [end[0]], end.end()
            if len(self.new) > MEMO:
                self.new, self.old = {}, self.new
            ids = list(map(self.new.get, chunks))
            unknown = {c for c, i in zip(chunks, ids, strict=True) if i is None} if None in ids else set()
            if unknown:
                self.learn(unknown)
                ids = [self.new[c] if i is None else i for c, i in zip(chunks, ids, strict=True)]
            yield b"".join(ids)
            for c in unknown:
                if len(c) > LONG:
                    del self.new[c]
            lo = hi


@kept_by_worker
def encoder(path: str) -> Encoder:
    return Encoder(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class Shard(WriterCommitMessage):
    """What a task wrote."""

    place: int
    name: str
    rows: int
    tokens: int
    bytes: int


class Writer(DataSourceArrowWriter):
    """Of rows with doc_id and text, which are encoded here: a worker then has one memo for both."""

    def __init__(self, path: str, tokenizer: str, end: int | None, overwrite: bool) -> None:
        self.path, self.tokenizer, self.end, self.overwrite = path, tokenizer, end, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        """A shard and its index, under names no other attempt has."""
        let_go(encoder)
        enc = encoder(self.tokenizer)
        width, tail = enc.type.itemsize, b"" if self.end is None else enc.pack([self.end])
        task = TaskContext.get()
        place = task.partitionId() if task else 0
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{place:05d}-{uuid.uuid4().hex}"
        at, tokens, offsets, counts = 0, 0, [0], [0]
        with files.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as out:
            for batch in iterator:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    ids = enc.encode(text.as_py() or "") + tail
                    record = frame(HEAD.pack(width, doc_id is not None, doc_id or 0) + ids)
                    out.write(record)
                    at += len(record)
                    tokens += len(ids) // width
                    offsets.append(at)
                    counts.append(tokens)
        with files.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.array([len(offsets) - 1, *offsets, *counts], dtype="<u8").tobytes())
        give_back()
        return Shard(place, name, len(offsets) - 1, tokens, at)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        shards, start = [], 0
        for s in sorted((m for m in messages if isinstance(m, Shard)), key=lambda s: s.place):
            if s.rows:
                shards.append({"name": s.name, "rows": s.rows, "tokens": s.tokens, "bytes": s.bytes, "start": start})
                start += s.tokens
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        if not self.overwrite and files.get_file_info(f"{root}/index.json").type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds records already")
        with files.open_output_stream(f"{root}/index.json.new") as out:
            out.write(json.dumps({"format": 1, "shards": shards}).encode())
        files.move(f"{root}/index.json.new", f"{root}/index.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.path)
        for s in messages:
            if isinstance(s, Shard):
                for kind in ("rec", "idx"):
                    files.delete_file(f"{root}/{s.name}.{kind}")


@dataclass
class Range(InputPartition):
    """Records lo to hi of a shard; start: ids of all shards before it."""

    name: str
    lo: int
    hi: int
    start: int
    seed: int | None


class Reader(DataSourceReader):
    def __init__(self, path: str, seed: int | None) -> None:
        self.path, self.seed = path, seed

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of about PER_TASK bytes; shuffled, they come in another order too."""
        files, root = opened(self.path)
        with files.open_input_stream(f"{root}/index.json") as f:
            shards = json.loads(f.read())["shards"]
        out = []
        for s in shards:
            cuts = np.linspace(0, s["rows"], min(s["rows"], s["bytes"] // PER_TASK + 1) + 1).astype(int).tolist()
            out += [Range(s["name"], lo, hi, s["start"], self.seed) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        if self.seed is not None:
            np.random.default_rng(self.seed).shuffle(out)
        return out or [Range("", 0, 0, 0, None)]

    def read(self, partition: Any) -> Iterator[pa.RecordBatch]:
        """Every record is checked; stored order reads runs of records, shuffled order seeks each."""
        if partition.lo == partition.hi:
            return
        files, root = opened(self.path)
        offsets, counts = self.index(files, f"{root}/{partition.name}.idx", partition.lo, partition.hi)
        n = partition.hi - partition.lo
        order = np.arange(n)
        if partition.seed is not None:
            np.random.default_rng([partition.seed, zlib.crc32(partition.name.encode()), partition.lo]).shuffle(order)
        with files.open_input_file(f"{root}/{partition.name}.rec") as f:
            at = 0
            while at < n:
                size, to = 0, at
                while to < n and (to == at or size < PER_BATCH):
                    size += int(offsets[order[to] + 1] - offsets[order[to]])
                    to += 1
                group = order[at:to]
                if partition.seed is None:
                    block, base = memoryview(f.read_at(size, int(offsets[at]))), int(offsets[at])
                    parts = [block[int(offsets[i]) - base : int(offsets[i + 1]) - base] for i in group]
                else:
                    parts = [memoryview(f.read_at(int(offsets[i + 1] - offsets[i]), int(offsets[i]))) for i in group]
                yield self.batch(parts, [f"{partition.name} at {offsets[i]}" for i in group], partition.start + counts[group])
                at = to
        give_back()

    @staticmethod
    def index(files: fs.FileSystem, path: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        with files.open_input_file(path) as f:
            n = int(np.frombuffer(f.read_at(8, 0), dtype="<u8")[0])
            if f.size() != 8 * (2 * n + 3) or hi > n:
                raise ValueError(f"{path}: the index is damaged")
            return tuple(np.frombuffer(f.read_at(8 * (hi - lo + 1), 8 * (1 + k * (n + 1) + lo)), dtype="<u8").astype(np.int64) for k in (0, 1))

    @staticmethod
    def batch(parts: list[memoryview], where: list[str], starts: np.ndarray) -> pa.RecordBatch:
        doc_ids, lengths, ids = [], [], []
        for data, place in zip(parts, where, strict=True):
            payload = unframe(data, place)
            width, known, doc_id = HEAD.unpack_from(payload)
            if width not in (2, 4) or (len(payload) - HEAD.size) % width:
                raise ValueError(f"{place}: the record is of another format")
            row = np.frombuffer(payload, dtype=f"<u{width}", offset=HEAD.size)
            doc_ids.append(doc_id if known else None)
            lengths.append(len(row))
            ids.append(row.astype("<u4").tobytes())
        columns = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
        return pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids"])


class TokenRecords(DataSource):
    """Options: path; for a write tokenizer (a file of the tokenizers library) and end (an id to close
    each text); for a read seed (for a shuffled order). Rows read: doc_id, start (ids of all
    records before it), n_tokens, ids (unsigned, 32 bits, little-endian)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        end = self.options.get("end")
        return Writer(self.options["path"], self.options["tokenizer"], None if end is None else int(end), overwrite)

    def reader(self, schema: StructType) -> DataSourceReader:
        seed = self.options.get("seed")
        return Reader(self.options["path"], None if seed is None else int(seed))


def write_records(docs: DataFrame, path: str, tokenizer: str, end: int | None = None) -> None:
    """Encode every text, close it with the id end, and write the ids under path, in ascending order
    of doc_id. Only doc_id and text are shuffled, once; a doc_id of very many rows is dealt out by
    its texts' hashes."""
    docs.sparkSession.dataSource.register(TokenRecords)
    placed = docs.select("doc_id", "text", text_hash().alias("hash")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    out = placed.select("doc_id", "text").write.format(FORMAT).option("tokenizer", tokenizer)
    (out if end is None else out.option("end", str(end))).mode("append").save(path)


def read_records(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """The records under path, in stored order, or with a seed in a shuffled one."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format(FORMAT)
    return (reader if seed is None else reader.option("seed", str(seed))).load(path)


def ids_of(binary: str = "ids") -> F.Column:
    """The column ids of a read as an array of numbers."""
    hexed = lambda i, k: F.hex(F.substring(binary, i * 4 + k, 1))
    word = lambda i: F.conv(F.concat(*[hexed(i, k) for k in (4, 3, 2, 1)]), 16, 10).cast("long")
    n = (F.octet_length(binary) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))
