"""Token ids of documents in binary shards with an index of keys.

    path/ids/part-00000….txt    a shard: little-endian ids of its documents from the first byte on, then a footer
    path/index                  blocks of the table of keys: which shards have a key
    path/shards                 of each shard: documents, ids, and ids of all shards before it

Documents are range-partitioned by key, so that shards follow each other in ascending order of keys, and each shard is
written by one task through Spark's text writer: a row's bytes are a document's ids, and the writer's line separator is the
end id. Ids take two bytes each where the vocabulary allows it, else four. So a shard is committed, retried and put on any file system as Spark does it, and any reader can map it as an array.
A footer holds a minimal perfect hash function over the shard's keys; by a key's number, a fingerprint, where its ids
start, and how many there are. The index holds such functions over all keys, cut into blocks by hash, and by number a
fingerprint and the shards. So a key costs two probes, whatever the size of the table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import _words
from filigree.llm._perfect import Perfect, digests, fingerprints
from filigree.llm._scratch import arrow_map, folder, stored
from filigree.llm.packing import encoder

MAGIC = b"filigree"
#: Keys of a block of the index, about.
BLOCK = 4096
#: Bytes of ids that a task hands on at once.
AT_ONCE = 1 << 20


def named(key: object, nth: int = 0) -> bytes:
    """What the digest of a shard's n-th document of a key is made of; a null key differs from all others."""
    return b"\x00%d" % nth if key is None else b"\x01%d\x00%s" % (nth, str(key).encode())


class Shard:
    """A shard's bytes (a buffer or a memory map), by key."""

    def __init__(self, content: bytes | memoryview):
        content = memoryview(content)
        # the writer ends the footer with an end id, too
        tail = next((len(content) - w for w in (2, 4) if content[len(content) - w - 8 : len(content) - w] == MAGIC), None)
        if tail is None:
            raise ValueError("not a shard")
        (size,) = struct.unpack("<q", content[tail - 16 : tail - 8])
        with pa.ipc.open_stream(content[tail - 16 - size : tail - 16]) as footer:
            self.table = footer.read_all().combine_chunks()
        facts = self.table.schema.metadata
        self.number = int(facts[b"shard"])
        #: The shard's ids, as they are in the file.
        self.ids = np.frombuffer(content, facts[b"type"].decode(), int(facts[b"ids"]))
        self.find = Perfect([int(x) for x in facts[b"sizes"].split()], facts[b"bits"])
        self.fingerprints, self.starts, self.lengths = (self.table[c].to_numpy() for c in ("fingerprint", "start", "length"))

    def at(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of digests start, and how many there are; -1 for keys that aren't here."""
        if not len(self.starts):
            none = np.full(len(d), -1, np.int64)
            return none, none
        number = np.maximum(self.find(d), 0)
        known = self.fingerprints[number] == fingerprints(d)
        return np.where(known, self.starts[number], -1), np.where(known, self.lengths[number], -1)

    def get(self, key: object, nth: int = 0) -> np.ndarray | None:
        """The ids of the n-th document of a key here."""
        start, length = (int(x[0]) for x in self.at(digests([named(key, nth)])))
        return None if start < 0 else self.ids[start : start + length]


def _footer(shard: int, kind: str, keys: pa.Array, nth: list[int], lengths: np.ndarray) -> bytes:
    d = digests(map(named, keys.to_pylist(), nth))
    perfect = Perfect.of(d)
    order = np.argsort(perfect(d))
    starts = np.cumsum(lengths) - lengths
    table = pa.table({"key": keys, "nth": pa.array(nth, pa.int32()), "fingerprint": pa.array(fingerprints(d)[order]), "start": pa.array(starts[order]), "length": pa.array(lengths[order])})
    facts = {"shard": str(shard), "type": kind, "ids": str(int(lengths.sum())), "sizes": " ".join(map(str, perfect.sizes)), "bits": perfect.packed}
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema.with_metadata(facts)) as out:
        out.write_table(table)
    data = sink.getvalue().to_pybytes()
    return data + struct.pack("<q8s", len(data), MAGIC)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, shard_bytes: int = 16 << 20, text: str = "text", key: str = "doc_id") -> None:
    """Writes every row's ids, the end id after each, in ascending order of keys, and the index.

    shard_bytes: bytes of text in a shard, about; there are as many shards as default parallelism, at least. A shard must
    stay below 2 GB of ids, and so must a document. Keys: integers or strings; null comes first; rows of equal keys go by
    a hash of the text, and those equal in both are interchangeable, so that no key or row must fit into one shard. A null
    text is empty and has the end id only. Other columns aren't read. docs must give the same rows when read again.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes))
    tokens = max(end, *encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True).values())
    width = "<u2" if tokens < 1 << 16 else "<u4"
    last = np.array([end], width).tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, nth, lengths = encoder(tokenizer), [], [], []
        before, count, part, ready = object(), 0, [], 0
        batch = None
        for batch in batches:
            data, bounds = _words.buffers(batch.column(1))
            data = memoryview(data)
            keys.append(batch.column(0))
            for i, k in enumerate(batch.column(0).to_pylist()):
                ids = np.frombuffer(own.encode(bytes(data[bounds[i] : bounds[i + 1]])), "<u4").astype(width)
                count = count + 1 if k == before else 0
                before = k
                nth.append(count)
                lengths.append(len(ids) + 1)
                part.append(ids.tobytes())
                ready += ids.nbytes
                if ready > AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["ids"])
                    part, ready = [], 0
        if batch is not None:
            part.append(_footer(TaskContext.get().partitionId(), width, pa.concat_arrays(keys), nth, np.array(lengths, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["ids"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("salt"))
    dealt = rows.repartitionByRange(shards, "key", "tie", "salt").sortWithinPartitions("key", "tie").select("key", "text")
    # bytes pass through a string column as they are; the separator's characters are the bytes of the end id
    out = arrow_map(dealt, encoded, "ids binary").select(F.col("ids").cast("string").alias("value"))
    out.write.option("lineSep", last.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 0).text(f"{path}/ids")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            nth = shard.table["nth"].to_numpy()
            some = np.flatnonzero(nth == 0)
            d = digests(map(named, shard.table["key"].take(pa.array(some)).to_pylist()))
            first = np.full(len(some), shard.number)
            whole = [pa.array([v] + [None] * (len(some) - 1), pa.int64()) for v in (len(nth), len(shard.ids))]
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].view(np.int64)), pa.array(d[:, 1].view(np.int64)), pa.array(first, pa.int32()), *whole], names=["a", "b", "shard", "documents", "ids"])

    keys = stored(arrow_map(_contents(spark, path), listed, "a long, b long, shard int, documents long, ids long"), "keys")
    totals, table, start = keys.filter("ids IS NOT NULL").select("shard", "documents", "ids").orderBy("shard").collect(), [], 0
    for r in totals:  # a row a shard
        table.append((r["shard"], r["documents"], r["ids"], start))
        start += r["ids"]
    spark.createDataFrame(table, "shard int, documents long, ids long, start long").coalesce(1).write.parquet(f"{path}/shards")
    blocks = max(1, -(-keys.count() // BLOCK))
    block = F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int")
    # rows of a key in several shards are in one block
    arrow_map(keys.select(block.alias("block"), "a", "b", "shard").repartition("block").sortWithinPartitions("block"), _blocks(blocks), _INDEX).write.parquet(f"{path}/index")


_INDEX = "block int, blocks int, n int, sizes string, bits binary, fingerprints binary, first binary, last binary"


def _blocks(blocks: int):
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(block: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            new = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            d = rows[new, :2].view(np.uint64)
            perfect = Perfect.of(d)
            order = np.argsort(perfect(d))
            first, last = rows[new, 2][order].astype("<i4"), rows[np.append(new[1:], len(rows)) - 1, 2][order].astype("<i4")
            values = [block, blocks, len(new), " ".join(map(str, perfect.sizes)), perfect.packed, fingerprints(d)[order].tobytes(), first.tobytes(), last.tobytes()]
            kinds = [pa.int32()] * 3 + [pa.string()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["block", "blocks", "n", "sizes", "bits", "fingerprints", "first", "last"])

        held, parts = None, []
        for batch in batches:
            block = batch.column(0).to_numpy()
            rows = np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.int64)])
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if block[a] != held:
                    if parts:
                        yield row(held, parts)
                    held, parts = int(block[a]), []
                parts.append(rows[a:b])
        if parts:
            yield row(held, parts)

    return built


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/ids").filter("length > 0").select("content")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for content in batch.column(0):
            yield Shard(content.as_buffer())


def documents(spark: SparkSession, path: str, kind: str = "long", ids: bool = False, key: str = "doc_id") -> DataFrame:
    """key, start (ids before it), n_tokens and ids_crc32 of every document in the files, and its ids, if wanted.

    Each shard is read whole by a task, and each of its keys found by hash. kind: the keys' type. Checksums and ids are of
    32-bit numbers, whatever a shard holds.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            keys = shard.table["key"].combine_chunks()
            d = digests(map(named, keys.to_pylist(), shard.table["nth"].to_pylist()))
            starts, lengths = shard.at(d)
            if (starts < 0).any():
                raise ValueError(f"shard {shard.number} is damaged")
            whole = memoryview(shard.ids.astype("<u4"))
            for a in range(0, len(d), 4096):
                parts = [whole[s : s + n] for s, n in zip(starts[a : a + 4096].tolist(), lengths[a : a + 4096].tolist(), strict=True)]
                columns = [keys[a : a + 4096], pa.array(np.full(len(parts), shard.number), pa.int32()), pa.array(starts[a : a + 4096]), pa.array(lengths[a : a + 4096]), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(map(bytes, parts), pa.binary())] if ids else [])], names=["key", "shard", "at", "n_tokens", "ids_crc32", "ids"][: 5 + ids])

    rows = arrow_map(_contents(spark, path), found, f"key {kind}, shard int, at long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    shards = spark.read.parquet(f"{path}/shards").select("shard", "start")
    out = rows.join(shards, "shard").withColumn("start", F.col("start") + F.col("at"))
    return out.select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def located(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """keys with the first and last shard that have documents of each, null for unknown keys (but one of 2^32 by chance).

    A null key is looked up like others, and repeated ones are looked up again.
    """
    kind = keys.schema[key].dataType.simpleString()
    index = spark.read.parquet(f"{path}/index")
    blocks = index.select("blocks").first()  # the same in all rows
    if blocks is None:
        return keys.select(F.col(f"`{key}`"), F.lit(None).cast("int").alias("first_shard"), F.lit(None).cast("int").alias("last_shard"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = digests(map(named, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d[:, 0].view(np.int64)), pa.array(d[:, 1].view(np.int64))], names=["key", "a", "b"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = None, None
        for batch in batches:
            first, last = [], []
            block = batch.column(3).to_pylist()
            d = np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()]).view(np.uint64)
            cuts = [i for i in range(len(block)) if i == 0 or block[i] != block[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if block[a] != held:
                    held, r = block[a], {c: batch.column(c)[a].as_py() for c in ("sizes", "bits", "fingerprints", "first", "last")}
                    table = r["sizes"] and (Perfect([int(x) for x in r["sizes"].split()], r["bits"]), np.frombuffer(r["fingerprints"], np.uint32), np.frombuffer(r["first"], "<i4"), np.frombuffer(r["last"], "<i4"))
                if not table:  # no key is in this block
                    first += [None] * (b - a)
                    last += [None] * (b - a)
                    continue
                number = np.maximum(table[0](d[a:b]), 0)
                known = table[1][number] == fingerprints(d[a:b])
                for out, column in ((first, table[2]), (last, table[3])):
                    out += [x if k else None for x, k in zip(column[number].tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["key", "first_shard", "last_shard"])

    rows = arrow_map(keys.select(F.col(f"`{key}`").alias("key")), hashed, f"key {kind}, a long, b long")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks[0])).cast("int"))
    joined = rows.join(index, "block", "left").select("key", "a", "b", "block", "sizes", "bits", "fingerprints", "first", "last").sortWithinPartitions("block")
    return arrow_map(joined, probed, f"key {kind}, first_shard int, last_shard int").withColumnRenamed("key", key)


def fetched(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ids of all documents of the given keys; only shards that have some are read. Unknown keys have no row."""
    kind = keys.schema[key].dataType.simpleString()
    found = located(spark, path, keys.select(F.col(f"`{key}`")).distinct(), key).filter("first_shard IS NOT NULL")
    found = stored(found.select(F.col(f"`{key}`").alias("key"), F.explode(F.sequence("first_shard", "last_shard")).alias("shard")), "located")
    wanted = found.groupBy("shard").agg(F.collect_list(F.struct("key")).alias("keys"))  # at most a shard's documents
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    files = spark.read.format("binaryFile").load(f"{path}/ids").select("path", number.alias("shard"))
    paths = [r["path"] for r in files.join(found.select("shard").distinct(), "shard", "left_semi").collect()]  # of shards
    schema = f"key {kind}, ids binary"
    if not paths:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, some in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                shard, out = Shard(content.as_buffer()), []
                for k in (x["key"] for x in some):
                    nth = 0
                    while (ids := shard.get(k, nth)) is not None:
                        out.append((k, ids.astype("<u4").tobytes()))
                        nth += 1
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.column(1).type.value_type.field(0).type), pa.array([x for _, x in out], pa.binary())], names=["key", "ids"])

    contents = spark.read.format("binaryFile").load(paths).select(number.alias("shard"), "content")
    return arrow_map(contents.join(wanted, "shard").select("content", "keys"), cut, schema).withColumnRenamed("key", key)


def op11_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = folder(spark, "token-shards")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return documents(spark, path, docs.schema["doc_id"].dataType.simpleString())
