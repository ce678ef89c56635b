"""Files of token ids: each document compressed by itself with a zstandard dictionary that all documents share.

``write`` encodes whole texts and writes shards in ascending order of ids; ``spark.read.format("token_ids")`` (after ``register``)
gives the documents back, and a condition on ``doc_id`` reads only the shards and frames it needs. The dictionary, trained on
serialized id arrays, makes short documents small without making them depend on each other.

A shard is

    header    MAGIC, length (8 bytes), JSON: dictionary hash, bytes per id, vocabulary, end id
    frames    one zstandard frame per document: its ids, little-endian
    index     a zstandard frame: per document its id, whether it has one, frame offset, ids before it in the shard
    trailer   offset of the index (8 bytes), MAGIC

beside ``dictionary-<hash>.zdict`` and ``manifest.json``, which is written last, when all tasks have succeeded: the shards in order with
their documents, ids, ids before them and range of document ids. A file without its line in the manifest is the rest of a failed task and is never
read. Shards are bounded in bytes and documents, so a task's memory and the manifest's lines are, too: the manifest has a line
for every ``SHARD`` bytes of output.

Null texts count as empty; an empty document has the end id alone. Documents of equal id follow each other in the order of their
contents, null ids come first, repeated rows are written as often as they occur. A very long text is one frame. An empty table gives a manifest without
shards. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual, WriterCommitMessage

from ..storage import shared_path
from .common import materialize, small_batches
from .token_ids import BYTE_LEVEL, byte_level

MAGIC = b"TOKENID1"
END = 0
#: Documents the dictionary is trained on, ids of each, bytes of the dictionary; compression level.
SAMPLE, STRETCH, DICTIONARY, LEVEL = 4000, 1024, 65536, 3
#: Bytes and documents of a shard, at most (a longer document has a shard of its own); documents of a batch read back, and their ids.
SHARD, DOCS, ROWS, IDS = 64 << 20, 1 << 20, 1000, 1 << 22
FORMAT = "token_ids"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    system, at = place(path)
    with system.open_output_stream(at, compression=None) as f:
        f.write(data)


def get(path: str) -> bytes:
    system, at = place(path)
    with system.open_input_stream(at, compression=None) as f:
        return f.read()


def width(vocabulary_size: int) -> int:
    return 2 if vocabulary_size <= 1 << 16 else 4


@lru_cache(maxsize=2)
def dictionary(path: str, name: str) -> zstandard.ZstdCompressionDict | None:
    """A dictionary file's contents, checked against the hash it goes by; None if documents are compressed without one."""
    if not name:
        return None
    data = get(f"{path}/dictionary-{name}.zdict")
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError(f"{path}: the dictionary's contents don't have the hash {name}")
    return zstandard.ZstdCompressionDict(data)


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary; empty if there is too little to train it on."""
    if sum(map(len, samples)) < 4 * size:
        size = sum(map(len, samples)) // 4
    if size < 1024 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # the samples have nothing in common
        return b""


@dataclass
class Written(WriterCommitMessage):
    partition: int
    shards: list[dict]


class Writer(DataSourceArrowWriter):
    """Writes sorted frames; a partition's files bear a name of their own, so a task's second attempt leaves the first one's alone."""

    def __init__(self, options: dict[str, str]):
        self.path, self.header = options["path"], json.loads(options["header"])
        self.shard, self.docs = int(options.get("shardbytes", SHARD)), int(options.get("sharddocs", DOCS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        number, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        shards: list[dict] = []
        head = json.dumps(self.header).encode()
        out = None
        for batch in iterator:
            for doc_id, n, frame in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["frame"].to_pylist(), strict=True):
                if out and (at + len(frame) > self.shard or len(ids) >= self.docs):
                    shards.append(self.close(out, name, ids, offsets, starts))
                    out = None
                if not out:
                    name = f"shard-{number:06d}-{len(shards):04d}-{attempt}.ids"
                    system, at_path = place(f"{self.path}/{name}")
                    out = system.open_output_stream(at_path, compression=None)
                    out.write(MAGIC + struct.pack("<q", len(head)) + head)
                    at = len(MAGIC) + 8 + len(head)
                    ids, offsets, starts = [], [at], [0]
                out.write(frame)
                at += len(frame)
                ids.append(doc_id)
                offsets.append(at)
                starts.append(starts[-1] + n)
        if out:
            shards.append(self.close(out, name, ids, offsets, starts))
        return Written(number, shards)

    def close(self, out, name: str, ids: list, offsets: list[int], starts: list[int]) -> dict:
        known = np.array([i is not None for i in ids], np.uint8)
        numbers = np.array([i or 0 for i in ids], "<i8")
        index = zstandard.ZstdCompressor(level=LEVEL).compress(struct.pack("<q", len(ids)) + numbers.tobytes() + np.array(offsets, "<i8").tobytes() + np.array(starts, "<i8").tobytes() + known.tobytes())
        out.write(index + struct.pack("<q", offsets[-1]) + MAGIC)
        out.close()
        real = numbers[known == 1]
        return {"file": name, "documents": len(ids), "ids": starts[-1], "least": int(real.min()) if len(real) else None, "most": int(real.max()) if len(real) else None}

    def commit(self, messages: list[Written | None]) -> None:
        shards, start = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for s in m.shards:
                shards.append(s | {"start": start})
                start += s["ids"]
        put(f"{self.path}/manifest.json", json.dumps(self.header | {"shards": shards}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Without a manifest there is nothing to read; the files stay for the owner of the folder to remove."""


@dataclass
class Shard(InputPartition):
    file: str
    start: int


def index_of(f, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, whether they are known, frame offsets and ids before each document."""
    f.seek(size - 16)
    tail = f.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a whole shard of token ids")
    at = struct.unpack("<q", tail[:8])[0]
    f.seek(at)
    data = zstandard.ZstdDecompressor().decompress(f.read(size - 16 - at))
    n = struct.unpack("<q", data[:8])[0]
    ids, offsets, starts = (np.frombuffer(data, "<i8", m, o) for m, o in ((n, 8), (n + 1, 8 + 8 * n), (n + 1, 16 + 16 * n)))
    return ids, np.frombuffer(data, np.uint8, n, 24 + 24 * n), offsets, starts


class Reader(DataSourceReader):
    """One partition a shard; conditions on doc_id choose shards by the manifest and frames by the index."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.low, self.high, self.wanted, self.known = None, None, None, False

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", None)
            if column != ("doc_id",):
                yield f
            elif isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else values & self.wanted
            elif isinstance(f, IsNotNull):
                self.known = True
            elif isinstance(f, GreaterThanOrEqual):
                self.low = f.value if self.low is None else max(self.low, f.value)
            elif isinstance(f, LessThanOrEqual):
                self.high = f.value if self.high is None else min(self.high, f.value)
            else:
                yield f

    def fits(self, least: int | None, most: int | None) -> bool:
        if self.low is None and self.high is None and self.wanted is None:
            return not self.known or least is not None
        if least is None or self.low is not None and most < self.low or self.high is not None and least > self.high:
            return False
        return self.wanted is None or any(least <= x <= most for x in self.wanted)

    def partitions(self) -> list[Shard]:
        shards = json.loads(get(f"{self.path}/manifest.json"))["shards"]
        return [Shard(s["file"], s["start"]) for s in shards if self.fits(s["least"], s["most"])] or [Shard("", 0)]

    def chosen(self, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        take = known == 1 if self.known else np.ones(len(ids), bool)
        if self.wanted is not None:
            take &= np.isin(ids, np.array(sorted(self.wanted), np.int64)) & (known == 1)
        if self.low is not None:
            take &= (ids >= self.low) & (known == 1)
        if self.high is not None:
            take &= (ids <= self.high) & (known == 1)
        return np.flatnonzero(take)

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, at = place(f"{self.path}/{partition.file}")
        with system.open_input_file(at) as f:
            ids, known, offsets, starts = index_of(f, system.get_file_info(at).size)
            f.seek(len(MAGIC))
            header = json.loads(f.read(struct.unpack("<q", f.read(8))[0]))
            if header["bytes"] not in (2, 4):
                raise ValueError(f"{partition.file}: ids of {header['bytes']} bytes")
            unpack = zstandard.ZstdDecompressor(dict_data=dictionary(self.path, header["dictionary"]) or zstandard.ZstdCompressionDict(b"")).decompress
            rows, held, kind = [], 0, "<u2" if header["bytes"] == 2 else "<u4"
            take = self.chosen(ids, known)
            for i in take.tolist():
                if f.tell() != offsets[i]:
                    f.seek(offsets[i])
                data = np.frombuffer(unpack(f.read(offsets[i + 1] - offsets[i])), kind).astype("<u4").tobytes()
                rows.append((int(ids[i]) if known[i] else None, partition.start + int(starts[i]), int(starts[i + 1] - starts[i]), data))
                held += len(data) // 4
                if len(rows) >= ROWS or held >= IDS:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        doc, start, n, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


class TokenIds(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenIds)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def serialized(texts: pd.Series, vocabulary: str) -> list[np.ndarray]:
    end = struct.pack("<I", END)
    return [np.frombuffer(ids + end, "<u4") for ids in byte_level(vocabulary).many(list(texts))]


def samples(docs: DataFrame, vocabulary: str, number: int = SAMPLE, stretch: int = STRETCH) -> list[bytes]:
    """What the dictionary is trained on: about ``number`` random documents, of each a stretch of ids from a random place. The bound holds
    for the dictionary alone; every document is encoded and written whole."""
    share = number / max(number, docs.count())
    chosen = docs.where(F.rand(13) < share).select("text", (F.rand(7) * (1 << 62)).cast("long").alias("h"))

    def cut(batches):
        for b in batches:
            kind = f"<u{width(byte_level(vocabulary).encode.get_vocab_size())}"
            out = []
            for ids, at in zip(serialized(b["text"], vocabulary), b["h"], strict=True):
                a = int(at) % max(1, len(ids) - stretch)
                out.append(ids[a : a + stretch].astype(kind).tobytes())
            yield pd.DataFrame({"ids": out})

    return [bytes(r.ids) for r in chosen.mapInPandas(cut, "ids binary").collect()]


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = BYTE_LEVEL, shard_bytes: int = SHARD, shard_docs: int = DOCS) -> None:
    """Encode whole texts and write them to ``path``, a new folder that the cluster shares."""
    spark = docs.sparkSession
    register(spark)
    small_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    trained = train(samples(docs, vocabulary))
    name = hashlib.sha256(trained).hexdigest() if trained else ""
    system, at = place(path)
    system.create_dir(at, recursive=True)
    if trained:
        put(f"{path}/dictionary-{name}.zdict", trained)
    size = byte_level(vocabulary).encode.get_vocab_size()
    header = {"dictionary": name, "bytes": width(size), "vocabulary": vocabulary, "end": END}

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary(path, name), write_checksum=True)
        kind = "<u2" if header["bytes"] == 2 else "<u4"
        for b in batches:
            ids = serialized(b["text"], vocabulary)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "place": b["place"], "n_tokens": [len(x) for x in ids], "frame": [packer.compress(x.astype(kind).tobytes()) for x in ids]})

    # encoded once and stored, since cutting into ranges reads its input twice; texts are never shuffled, only their frames
    placed = docs.withColumn("place", F.monotonically_increasing_id())
    encoded = materialize(placed.mapInPandas(frames, "doc_id long, place long, n_tokens long, frame binary"))
    total = encoded.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // shard_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("frame"), F.col("place")]
    ranged = encoded.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    ranged.write.format(FORMAT).mode("append").options(path=path, header=json.dumps(header), shardbytes=shard_bytes, sharddocs=shard_docs).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, unsigned 32 bits)."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


def id_digest(docs: DataFrame) -> DataFrame:
    """One row per document, from files written and read back: doc_id, start, n_tokens, ids_crc32."""
    path = shared_path(docs.sparkSession)
    write(docs, path)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
