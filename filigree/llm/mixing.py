"""Mixing sources to target weights.

The words of a source, its documents in order, are cut into blocks of fixed length. How many blocks of a source each output
shard has is drawn as one multinomial count of the source's whole number over the shards, at any size, so that the totals
meet the targets; a source's slots, numbered through the shards, go to its blocks through a pseudorandom permutation of the block numbers,
a new one for each pass over the source; and blocks are fetched by a join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm import _words
from filigree.llm._ranks import running
from filigree.llm._scratch import arrow_map, stored
from filigree.llm._words import U

BLOCK, SHARDS, RUN, WEIGHTS, MOST = 128, 256, 1 << 14, (5, 2, 1), 3


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words in the text; null: 0) and tag, a hash of the text that settles ties of doc_id."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), docs.schema["source"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(w.offsets).astype(np.int64) for _, _, w in _words.each(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=["doc_id", "source", "tag", "size"])

    return arrow_map(docs.select("doc_id", "source", F.xxhash64("text").alias("tag"), "text"), count, f"doc_id {kinds[0]}, source {kinds[1]}, tag long, size long")


def targets(totals: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Shares of the sum of totals by repeated weights; none above `most` times its total, what is over reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(totals))]
    whole, out, free = float(sum(totals)), [0.0] * len(totals), set(range(len(totals)))
    while free:
        left, share = whole - sum(out[i] for i in range(len(out)) if i not in free), sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / share > most * totals[i]}
        if not over:
            for i in free:
                out[i] = left * w[i] / share
            break
        for i in over:
            out[i] = float(most * totals[i])
        free -= over
    return out


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK)

    @property
    def passes(self) -> int:
        """Whole passes over the source; the rest of the target is a part of one more."""
        return int(self.target // self.size) if self.size else 0

    @property
    def rest(self) -> int:
        return round(self.target - self.passes * self.size) if self.size else 0

    @property
    def lack(self) -> int:
        """Words that the last block lacks to a full one."""
        return self.blocks * BLOCK - self.size


def sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[Source]:
    """The sources by code point, null last, with their sizes and targets (one row for each reaches the driver)."""
    rows = sorted(((x[0], x[1]) for x in sized.groupBy("source").agg(F.sum("size")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    return [Source(n, s, t) for (n, s), t in zip(rows, targets([s for _, s in rows], weights, most), strict=True)]


def shares(slots: int, source: int, seed: int, shards: int = SHARDS) -> np.ndarray:
    """How many of a source's slots each shard has: multinomial counts (conditional binomials one by one), whose sum is `slots`."""
    return np.random.Generator(np.random.PCG64([seed, source])).multinomial(slots, np.full(shards, 1 / shards))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Pseudorandom permutations of range(n): a Feistel network on the next power of 4, walked until it is within range."""
    half = np.maximum((np.frexp(np.maximum(n - 1, 1).astype(np.float64))[1] + 1) // 2, 1).astype(U)
    mask = (U(1) << half) - U(1)
    out, todo = index.astype(U), np.arange(len(index))
    n, key = n.astype(U), key.astype(U)
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        left, right = x >> h, x & m
        for i in (3, 2, 1, 0) if inverse else range(4):
            other = left if inverse else right
            turned = _words.mix(other + key[todo] + U(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) & m
            left, right = (right ^ turned, left) if inverse else (right, left ^ turned)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def key_of(source: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    return _words.mix(((source << 8) + turn + (seed << 32)).astype(U))


def last_slots(found: list[Source], seed: int) -> np.ndarray:
    """Of each source, the slot of the last, shorter block in the pass that is taken in part."""
    numbers, passes, blocks = np.arange(len(found)), np.array([x.passes for x in found], np.int64), np.array([max(x.blocks, 1) for x in found], np.int64)
    return permuted(blocks - 1, blocks, key_of(numbers, passes, seed), inverse=True)


def schedule(spark, found: list[Source], seed: int) -> DataFrame:
    """The mix: a row (shard, slot, source_no, pass, block, words) for each slot; words: how many of its block it takes."""
    # one value for each source: small enough for a task's closure
    blocks, passes, rest, lack = (np.array([getattr(x, name) for x in found], np.int64) for name in ("blocks", "passes", "rest", "lack"))
    short = last_slots(found, seed)
    part = -(-rest // BLOCK)
    part = np.where(short < part, -(-(rest + lack) // BLOCK), part)
    wanted = spark.createDataFrame([(i, int(x)) for i, x in enumerate(passes * blocks + part)], "source_no int, slots long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends = np.cumsum(shares(n, source, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARDS, dtype=np.int32)), pa.array(np.full(SHARDS, source, np.int32)), pa.array(np.append(0, ends[:-1])), pa.array(ends)], names=["shard", "source_no", "low", "high"])

    runs = arrow_map(wanted, deal, "shard int, source_no int, low long, high long").filter("low < high")
    runs = runs.select("shard", "source_no", "high", F.explode(F.sequence(F.col("low"), F.col("high") - 1, F.lit(RUN))).alias("low")).repartition("shard", "source_no", "low")
    slots = runs.select("shard", "source_no", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + RUN, "high") - 1)).alias("slot"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, slot = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            turn, index = slot // blocks[source], slot % blocks[source]
            block = permuted(index, blocks[source], key_of(source, turn, seed))
            before = index * BLOCK - np.where(index > short[source], lack[source], 0)
            words = np.where(turn < passes[source], BLOCK, np.minimum(BLOCK, rest[source] - before))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(turn.astype(np.int32)), pa.array(block), pa.array(words.astype(np.int32))], names=["shard", "slot", "source_no", "pass", "block", "words"])

    return arrow_map(slots, draw, "shard int, slot long, source_no int, pass int, block long, words int")


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame, list[Source]]:
    """The documents with their place, the mix, and the sources.

    Documents: doc_id, source, tag, size, source_no, first (words of the source before it). The mix: shard, slot,
    source_no, pass, first, doc_id, tag, start, length: the words start to start + length of a document, in the order of slot.
    A null text has no words; null doc_ids come first in their source; rows equal in doc_id and text are interchangeable.
    """
    spark = docs.sparkSession
    sized = stored(sizes(docs), "sizes")
    found = sources(sized, weights, most)
    numbers = spark.createDataFrame([(x.name, i) for i, x in enumerate(found)], "source string, source_no int")
    placed = running(sized.join(numbers, sized["source"].eqNullSafe(numbers["source"])).drop(numbers["source"]), "source_no", ["doc_id", "tag", "size"], "size", "first")
    last = F.col("first") + F.col("size") - 1
    block = F.lit(BLOCK)
    parts = placed.filter("size > 0").select(
        "doc_id", "tag", "source_no", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(last / block))).alias("block")
    )
    at = F.col("block") * block
    low, high = F.greatest("first", at), F.least(F.col("first") + F.col("size"), at + F.col("words"))
    mixed = (
        parts.hint("merge").join(schedule(spark, found, seed), ["source_no", "block"])  # both grow with the input
        .select("shard", "slot", "source_no", "pass", "first", "doc_id", "tag", (low - F.col("first")).alias("start"), (high - low).alias("length"))
        .filter("length > 0")
    )
    return placed, mixed, found


def taken(docs: DataFrame, seed: int = 7) -> DataFrame:
    """For each row: doc_id, tag, size, source_size, target and taken (words that the mix takes, repeats counted)."""
    placed, mixed, found = mix(docs, seed)
    about = docs.sparkSession.createDataFrame([(i, x.size, float(x.target)) for i, x in enumerate(found)], "source_no int, source_size long, target double")
    sums = mixed.groupBy("source_no", "first").agg(F.sum("length").alias("all")).hint("merge")  # places are unique, rows may not be
    out = placed.join(sums, ["source_no", "first"], "left").join(about, "source_no")
    return out.select("doc_id", "tag", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("all", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, text: str = "text") -> DataFrame:
    """The mix as documents: a row of docs for each pass that takes some of its words, with just these as its text.

    A pass that takes all words leaves the text as it is; else the words taken are joined by one space. Rows without words,
    or of which the mix takes none, are gone. Repeated rows are rows of their own: each has its own place in its source and
    its own turns. Columns may have any names and stay as they are.
    """
    _, mixed, found = mix(docs.withColumn("text", F.col(text)) if text != "text" else docs, seed)
    turns = mixed.groupBy("source_no", "first", "pass", "doc_id", "tag").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("parts"))
    same = lambda *more: F.to_json(F.struct(F.lit(0).alias("at"), *more))  # noqa: E731, exact, also for nulls
    # rows equal in id, text and source are numbered on both sides, and the n-th of them has the turns of the n-th place
    turns = turns.select(same("source_no", "doc_id").alias("id"), "tag", F.dense_rank().over(Window.partitionBy("source_no", "doc_id", "tag").orderBy("first")).alias("nth"), "n", "parts").hint("merge")
    numbers = docs.sparkSession.createDataFrame([(x.name, i) for i, x in enumerate(found)], "source string, source_no int")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", F.xxhash64(text).alias("tag"))
    rows = rows.join(numbers, rows["source"].eqNullSafe(numbers["source"])).select("row", same("source_no", "row.doc_id").alias("id"), "tag")
    rows = rows.withColumn("mine", F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.xxhash64("row"))))
    # not an equality of columns, so that the join keeps the window's partitioning
    joined = rows.join(turns, ["id", "tag"]).filter(F.col("mine") - F.col("nth") == 0)
    # explode() of one element: words are made once, not in each use
    joined = joined.select("row", "n", "parts", F.explode(F.array(F.filter(F.split(F.col("row").getField(text), "[\\x20\\x09-\\x0D]+"), lambda x: x != ""))).alias("words"))
    some = F.array_join(F.flatten(F.transform("parts", lambda x: F.slice(F.col("words"), (x["start"] + 1).cast("int"), x["length"].cast("int")))), " ")
    taken = F.when(F.size("words") == F.col("n"), F.col("row").getField(text)).otherwise(some)
    return joined.select(*((taken if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
