"""Best-fit packing of documents into sequences of a fixed capacity.

Best-fit decreasing, bulk-synchronous. Pieces are range-sorted by length; a length is a class of interchangeable pieces,
and so is a gap of sequences that are filled alike. A round takes the longest class that is left and sweeps the gaps:
each time the smallest gap that it fits (the successor), which takes as many as fit, until the class is used up or new
sequences open. The sweep works on the counts of the classes, of which there are no more than the capacity, at any size
of the input; which piece goes where follows from its rank within its length, which is found by distributed sums. So
no two pieces want the same gap, and each round's updated gaps are those of one-by-one best-fit decreasing.
"""

from __future__ import annotations

import bisect
import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm import _words
from filigree.llm._ranks import running
from filigree.llm._scratch import arrow_map, stored

#: Entries of a worker's cache of encoded words.
KEPT = 800_000


#: Letters that lower-casing and NFC keep single letters: a run of these, with a mark or not, needs the model only.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([.,;:!?]?)")


class Encoder(dict):
    """Ids of runs of characters between white space, as packed 32-bit numbers.

    For byte-level tokenizers that lower-case, drop white space and never join across it, the ids of a text are those of
    its runs. Runs of plain letters skip the library's normalizer and pre-tokenizer, which leave them as they are; all
    other runs go through it whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in letters]
        self.letters = {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode()
        plain = PLAIN.fullmatch(text)
        if plain and plain[2]:
            out = self[plain[1].encode()] + (self.get(mark := plain[2].encode()) or self.whole(mark.decode()))
        elif plain:
            word = text.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            out = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        else:
            out = self.whole(text)
        if len(run) < 64:
            if len(self) > KEPT:
                self.clear()
            self[run] = out
        return out

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, end: int | None, capacity: int, ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32 (and the ids, if wanted) of each row's tokens, cut only where over capacity.

    end: an id put after each document. A null text is empty; without an end id, a document without tokens has no piece.
    """
    kind = docs.schema[key].dataType.simpleString()
    last = b"" if end is None else np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            data, bounds = _words.buffers(batch.column(1))
            data = memoryview(data)
            for a, b in _words.slices(bounds):
                rows, columns = [], ([], [], [], [], [])
                for i in range(a, b):
                    tokens = own.encode(bytes(data[bounds[i] : bounds[i + 1]])) + last
                    for k, at in enumerate(range(0, len(tokens), 4 * capacity)):
                        part = tokens[at : at + 4 * capacity]
                        rows.append(i)
                        for column, x in zip(columns, (k, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None), strict=True):
                            column.append(x)
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4])]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(columns[4], pa.binary())] if ids else [])], names=["key", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return arrow_map(docs.select(key, text), cut, schema).withColumnRenamed("key", key)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, first sequence, pieces to a sequence, offset of the first), and the number of sequences."""
    gaps: list[int] = []  # sorted
    alike: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    rows, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in alike:
                bisect.insort(gaps, gap)
                alike[gap] = []
            alike[gap].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = alike[gap].pop()
                if not alike[gap]:
                    del alike[gap], gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            rest = min(left - full * each, each - 1) if full < n else 0
            rows.append((length, rank, first, each, capacity - gap))
            add(gap - each * length, first, full)
            if rest:
                add(gap - rest * length, first + full, 1)
            add(gap, first + full + bool(rest), n - full - bool(rest))
            left -= full * each + rest
            rank += full * each + rest
    return rows, opened


def _ready(parts: DataFrame, order: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """parts as (row, length, o0, o1, ...): the caller's columns in one, so that their names don't matter; and these names."""
    names, keep = [f"o{i}" for i in range(len(order))], [c for c in parts.columns if c not in ("sequence_id", "offset")]
    rows = parts.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col("length").cast("long").alias("length"), *(F.col(f"`{c}`").alias(n) for c, n in zip(order, names, strict=True)))
    return rows, names, keep


def pack(parts: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """parts (any columns, with a `length` of 1 to capacity) with sequence_id and offset.

    order: columns that settle which of equally long pieces goes where; rows equal in these are interchangeable, and
    repeated rows are pieces of their own. A length that is null or out of bounds raises. Columns sequence_id and offset of
    parts give way to the results.
    """
    rows, names, keep = _ready(parts, order)
    ranked = running(rows.withColumn("one", F.lit(1).cast("long")), "length", names, "one", "rank").select("row", "length", "rank")
    counts = {x[0]: x[1] for x in ranked.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    found, _ = plan(counts, capacity)
    shared = parts.sparkSession.sparkContext.broadcast(np.array(sorted(found), np.int64).reshape(-1, 5))  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, number = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            row = table[np.searchsorted(starts, length << 48 | number, "right") - 1] if len(length) else table[:0]
            nth = number - row[:, 1]
            sequence, slot = row[:, 2] + nth // np.maximum(row[:, 3], 1), nth % np.maximum(row[:, 3], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(row[:, 4] + slot * length)], names=["row", "sequence_id", "offset"])

    out = arrow_map(ranked, place, f"row {ranked.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), "sequence_id", "offset")


def pack_in_rounds(parts: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """As pack(), by bulk-synchronous rounds over rows instead of classes.

    A round: pieces longer than every gap open sequences, as many to one as the longest of them allow; all other pieces and
    all gaps are range-sorted by size together, and each range is swept downwards: a piece takes the smallest gap at or
    above it that is left, longer pieces first, and what is left of a gap is a gap again, further down the range or in
    the next round. Until no piece is left. Nothing but counts and the greatest sizes reaches the driver.
    """
    rows, names, keep = _ready(parts, order)
    kind = rows.schema["row"].dataType.simpleString()
    own = f"row {kind}, size long, {', '.join(f'{n} {rows.schema[n].dataType.simpleString()}' for n in names)}, seq long, gap boolean"
    left = stored(rows.select("row", F.col("length").alias("size"), *names), "left")
    gaps, placed, opened = None, [], 0

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: list[tuple[int, int]] = []  # gaps at or above the place of the sweep, the smallest last
        below: list[tuple[int, int]] = []  # what is left of gaps, further down
        for batch in batches:
            sizes, seqs, taken = batch.column(1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), []
            for i, gap in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                size = sizes[i]
                while below and -below[0][0] >= size:
                    rest, seq = heapq.heappop(below)
                    free.append((-rest, seq))
                if gap:
                    free.append((size, seqs[i]))
                    taken.append(None)
                elif free:
                    rest, seq = free.pop()
                    taken.append(seq)
                    if rest > size:
                        heapq.heappush(below, (size - rest, seq))
                else:
                    taken.append(None)
            pieces = pa.array([not g for g in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(taken, pa.int64()), batch.column(batch.num_columns - 1)], schema=batch.schema).filter(pieces)
        rest = [*free, *((-r, s) for r, s in below)]
        for a in range(0, len(rest), 100_000):
            some = rest[a : a + 100_000]
            columns = [pa.nulls(len(some), t.type) for t in batch.schema]
            columns[1], columns[-2], columns[-1] = pa.array([r for r, _ in some], pa.int64()), pa.array([s for _, s in some], pa.int64()), pa.array([True] * len(some))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    while True:
        ends = left.agg(F.max("size"), F.min("size")).first()
        if ends[0] is None:
            break
        if ends[0] > capacity or ends[1] < 1:
            raise ValueError("lengths must be from 1 to the capacity")
        most = 0 if gaps is None else gaps.agg(F.max("size")).first()[0] or 0
        if ends[0] > most:  # these fit nowhere
            each = capacity // ends[0]
            alike = (F.col("size") > most) & (F.floor(F.lit(capacity) / F.col("size")) == each)
            need = running(left.filter(alike).select("*", F.lit(0).cast("long").alias("all"), F.lit(1).cast("long").alias("one"), (-F.col("size")).alias("down")), "all", ["down", *names], "one", "rank")
            need = stored(need.select("row", "size", *names, (F.lit(opened) + F.floor(F.col("rank") / each)).alias("seq")), "opened")
            placed.append(need.select("row", "size", "seq", *names))
            new = need.groupBy("seq").agg((F.lit(capacity) - F.sum("size")).alias("size")).filter("size > 0").select("seq", "size")
            opened = (need.agg(F.max("seq")).first()[0] or 0) + 1
            gaps = new if gaps is None else gaps.unionByName(new)
            left = left.filter(~alike)
        holes = gaps.select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("row",)), "size", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names), "seq", F.lit(True).alias("gap"))
        both = left.select("row", "size", *names, F.lit(None).cast("long").alias("seq"), F.lit(False).alias("gap")).unionByName(holes)
        swept = stored(arrow_map(both.repartitionByRange(F.desc("size")).sortWithinPartitions(F.desc("size"), F.desc("gap"), *names), sweep, own), "swept")
        placed.append(swept.filter("NOT gap AND seq IS NOT NULL").select("row", "size", "seq", *names))
        left = swept.filter("NOT gap AND seq IS NULL").select("row", "size", *names)
        gaps = swept.filter("gap").select("seq", "size")
    if not placed:
        placed = [left.select("row", "size", F.lit(0).cast("long").alias("seq"), *names)]
    whole = placed[0]
    for x in placed[1:]:
        whole = whole.unionByName(x)
    before = F.sum("size").over(Window.partitionBy("seq").orderBy(F.desc("size"), *names).rowsBetween(Window.unboundedPreceding, -1))
    out = whole.withColumn("offset", F.coalesce(before, F.lit(0)))  # a window holds one sequence
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("seq").alias("sequence_id"), "offset")


def best_fit(docs: DataFrame, tokenizer: str, end: int | None = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row."""
    return pack(stored(pieces(docs, tokenizer, end, capacity), "pieces"), capacity, ["doc_id", "piece", "ids_crc32"])


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
