"""Substring dedup: word passages that repeat across documents stay in the first document only.

Fixed-block anchors. Each window of 50 words holds a whole one of the non-overlapping 25-word blocks of its document. So

1. the blocks of every document are indexed, in a bit table of bounded size that any task can probe;
2. every rolling 25-word window of every document probes it; what passes meets by hash, and windows that two documents
   share are anchors (what passed in error meets nothing);
3. anchors extend: the 50-word windows around them are hashed to 128 bits, meet by hash, and those that also start in a
   smaller doc_id are removed, neighbours together, so that whole maximal repeats go.

Only positions near anchors and hashes are shuffled, and the texts of documents that have anchors. Texts of equal words are
one from the start. A passage of any number of documents doesn't gather in one task: each task settles what its own
documents share and sends one of them to meet those of other tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm import _words
from filigree.llm._members import may_have, members
from filigree.llm._scratch import arrow_map, stored
from filigree.llm._words import U

WINDOW, BLOCK = 50, 25
#: Bits of the block table: 16 for each block, at most 2**29 (64 MB); beyond, more windows pass in error, and results stay.
LEAST_BITS, MOST_BITS = 20, 29
SEGMENTS = 256
#: Windows that a task holds before it settles them.
HELD = 1 << 20
NULL = -(2**63)
#: Base of the second hash of windows. Together with the first one, 128 bits: at 10**13 windows, 64 would let strangers meet.
ALSO_BASE = 0xA0761D6478BD642F
EMPTY = hashlib.sha256(b"").hexdigest()


def _joined(text: bytes) -> bytes:
    """The words of a text, joined by one space (bytes.split knows the same white space)."""
    return b" ".join(text.split())


def _class(text: bytes) -> tuple[str, int]:
    digest = hashlib.sha256(_joined(text)).digest()
    return digest.hex(), int.from_bytes(digest[:8], "little", signed=True)


def _documents(column: pa.Array) -> Iterator[tuple[int, _words.Words, list[bytes]]]:
    data, bounds = _words.buffers(column)
    view = memoryview(data)
    for a, b in _words.slices(bounds):
        yield a, _words.words(data, bounds[a : b + 1]), [bytes(view[bounds[i] : bounds[i + 1]]) for i in range(a, b)]


SURVEY = ["key", "n_words", "sha", "cls", "segment", "blocks"]


def _survey(docs: DataFrame) -> DataFrame:
    """(key, n_words, sha, cls) of each row, and rows (segment, blocks) with hashes of blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for a, words, texts in _documents(batch.column(1)):
                n = np.diff(words.offsets).astype(np.int64)
                names = [_class(x) for x in texts]
                m = len(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array(n), pa.array([x for x, _ in names]), pa.array([x for _, x in names], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=SURVEY)
                fresh = np.zeros(m, bool)
                for i in np.flatnonzero(n >= WINDOW):
                    fresh[i] = names[i][1] not in known
                    known.add(names[i][1])
                first, offsets = words.windows(words.starts, BLOCK)
                place = np.arange(len(first)) - np.repeat(offsets[:-1], np.diff(offsets))
                first = first[(place % BLOCK == 0) & np.repeat(fresh, np.diff(offsets))]
                if len(first):
                    found = np.sort(_words.rolling(words.hashes(), _words.WORD_BASE, first, first + BLOCK))
                    cuts = np.searchsorted(found >> U(56), np.arange(SEGMENTS + 1))
                    full = np.flatnonzero(np.diff(cuts))
                    k = len(full)
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array(full, pa.int32()), pa.array([found[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())], names=SURVEY)

    return arrow_map(docs, read, "key long, n_words long, sha string, cls long, segment int, blocks binary")


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each hash, both in the segment that its first byte names."""
    within = bits - 8
    segment = (hashes >> U(56)).astype(np.int64) << within
    low = (hashes & U((1 << within) - 1)).astype(np.int64)
    high = (_words.mix(hashes) >> U(64 - within)).astype(np.int64)
    return segment + low, segment + high


def _index(survey: DataFrame):
    """The bit table of all blocks, broadcast, and its size as a power of 2."""
    blocks = survey.filter("segment IS NOT NULL").select("segment", "blocks")
    n = blocks.agg(F.sum(F.length("blocks"))).first()[0] or 0
    bits = min(max(int(np.ceil(np.log2(max(2 * n, 1)))), LEAST_BITS), MOST_BITS)  # n is 8 for each block

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        size = 1 << bits - 8
        for batch in batches:
            for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = tables.setdefault(segment, np.zeros(size, bool))
                for at in _bits(np.frombuffer(packed, U), bits):
                    table[at & (size - 1)] = True
        if tables:
            yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([np.packbits(t, bitorder="little").tobytes() for t in tables.values()], pa.binary())], names=["segment", "bits"])

    table = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << bits - 11
    for segment, packed in arrow_map(blocks.repartition("segment"), build, "segment int, bits binary").collect():
        table[segment * size : (segment + 1) * size] = np.frombuffer(packed, np.uint8)
    return survey.sparkSession.sparkContext.broadcast(table), bits


#: A row without pos has what its task settled: all positions in more. Other rows have their first position in pos.
MET = "meet long, cls long, rank long, pos int, more binary, also long"
NAMES = [x.split()[0] for x in MET.split(", ")]


class _Meeting:
    """Windows of a task, by hash: what they settle among themselves, and what must meet those of other tasks."""

    def __init__(self, ranked: bool):
        self.ranked = ranked  # a window goes if a smaller rank has it; else, if another class has it
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, hashes: np.ndarray, also: np.ndarray, cls: int, rank: int, pos: np.ndarray) -> bool:
        """also: a second hash, by which windows are told apart that share the first."""
        self.parts.append((hashes, cls, rank, pos, also))
        self.held += len(hashes)
        return self.held >= HELD

    def settle(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        sizes = [len(x[0]) for x in self.parts]
        hashes, also, pos = np.concatenate([x[0] for x in self.parts]), np.concatenate([x[4] for x in self.parts]), np.concatenate([x[3] for x in self.parts]).astype(np.int32)
        cls, rank = (np.repeat(np.array([x[i] for x in self.parts], np.int64), sizes) for i in (1, 2))
        self.parts, self.held = [], 0
        gone, meets = _resolve(hashes, also, cls, rank, self.ranked)
        yield from _packed(cls[gone], rank[gone], pos[gone])
        # a class meets with one row for each hash, whatever its positions: a text that repeats itself has many
        meets = meets[np.lexsort((pos[meets], cls[meets], also[meets], hashes[meets]))]
        first = np.flatnonzero(np.append(True, (np.diff(hashes[meets]) != 0) | (np.diff(also[meets]) != 0) | (np.diff(cls[meets]) != 0))) if len(meets) else meets
        sizes = np.diff(np.append(first, len(meets)))
        for a in range(0, len(first), 100_000):
            at, many = meets[first[a : a + 100_000]], sizes[a : a + 100_000] > 1
            more: list[bytes | None] = [None] * len(at)
            for i in np.flatnonzero(many).tolist():
                j = first[a + i]
                more[i] = pos[meets[j + 1 : j + sizes[a + i]]].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(cls[at]), pa.array(rank[at]), pa.array(pos[at]), pa.array(more, pa.binary()), pa.array(also[at].view(np.int64))], names=NAMES)


def _resolve(hashes: np.ndarray, also: np.ndarray, cls: np.ndarray, rank: np.ndarray, ranked: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of windows: those known to be shared (ranked: with a smaller rank), and those that others must still meet."""
    order = np.lexsort((also, hashes))
    first = np.flatnonzero(np.append(True, (np.diff(hashes[order]) != 0) | (np.diff(also[order]) != 0))) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(order)))
    value = (rank if ranked else cls)[order]
    least = np.repeat(np.minimum.reduceat(value, first), sizes) if len(order) else value
    if ranked:
        gone = order[value > least]
        return gone, order[value == least]
    shared = np.repeat(np.minimum.reduceat(value, first) != np.maximum.reduceat(value, first), sizes) if len(order) else value != 0
    speaks = ~shared
    speaks[first] = True
    return order[shared], order[speaks]


def _packed(cls: np.ndarray, rank: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each class, its positions packed."""
    if not len(cls):
        return
    order = np.lexsort((pos, cls))
    cls, rank, pos = cls[order], rank[order], pos[order]
    first = np.flatnonzero(np.append(True, np.diff(cls) != 0))
    ends = np.append(first[1:], len(cls))
    packs = [np.unique(pos[a:b]).astype("<i4").tobytes() for a, b in zip(first, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(cls[first]), pa.array(cls[first]), pa.array(rank[first]), pa.nulls(len(first), pa.int32()), pa.array(packs, pa.binary()), pa.nulls(len(first), pa.int64())], names=NAMES)


def _met(windows: DataFrame, ranked: bool) -> DataFrame:
    """(cls, single, packs): positions that meet in several tasks, and packed ones that tasks settled."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            done = batch.filter(batch.column(3).is_null())
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(1), done.column(3), done.column(4)], names=["cls", "pos", "pack"])
            held.append(batch.filter(batch.column(3).is_valid()))
        if not held:
            return
        rows = pa.Table.from_batches(held)
        hashes, cls, rank, also = (rows.column(i).to_numpy() for i in (0, 1, 2, 5))
        gone, _ = _resolve(hashes, also, cls, rank, ranked)
        found = rows.select(["cls", "pos", "more"]).take(pa.array(gone)).rename_columns(["cls", "pos", "pack"])
        yield from found.to_batches(100_000)

    met = arrow_map(windows.repartition("meet"), meet, "cls long, pos int, pack binary")
    return met.groupBy("cls").agg(F.collect_list("pos").alias("single"), F.collect_list("pack").alias("packs"))


def _probe(docs: DataFrame, index, bits: int) -> DataFrame:
    """Rolling windows of every class that the block table knows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, meeting = index.value, set(), _Meeting(False)
        for batch in batches:
            for _, words, texts in _documents(batch.column(0)):
                first, offsets = words.windows(words.starts, BLOCK)
                hashes = _words.rolling(words.hashes(), _words.WORD_BASE, first, first + BLOCK)
                a, b = _bits(hashes, bits)
                passed = ((table[a >> 3] >> (a & 7).astype(np.uint8)) & (table[b >> 3] >> (b & 7).astype(np.uint8)) & 1) != 0
                n = np.diff(words.offsets)
                for i in np.flatnonzero(n >= WINDOW):
                    name = _class(texts[i])[1]
                    if name in known:
                        continue
                    known.add(name)
                    pos = np.flatnonzero(passed[offsets[i] : offsets[i + 1]])
                    if len(pos) and meeting.add(hashes[offsets[i] + pos], np.zeros(len(pos), U), name, 0, pos):
                        yield from meeting.settle()
        yield from meeting.settle()

    return arrow_map(docs.select("text"), read, MET)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text) of the wanted classes, at least once each; strangers may be among them."""
    filters = members(wanted, "cls")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = filters.value, set()
        for batch in batches:
            for _, words, texts in _documents(batch.column(0)):
                n, found = np.diff(words.offsets), []
                for i in np.flatnonzero(n >= WINDOW):
                    name = _class(texts[i])[1]
                    if name not in known and may_have(table, name):
                        found.append((name, texts[i]))
                    known.add(name)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x.decode() for _, x in found], pa.string())], names=["cls", "text"])

    return arrow_map(docs.select("text"), read, "cls long, text string")


def _starts(single: list[int], packs: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([np.array(single, np.int64), *(np.frombuffer(x, "<i4") for x in packs)]))


def _covered(starts: np.ndarray, back: int, ahead: int, n: int) -> np.ndarray:
    """Which of n places lie from `back` before to `ahead` after one of the starts, both included."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(starts - back, 0, n), 1)
    np.add.at(step, np.clip(starts + ahead + 1, 0, n), -1)
    return np.cumsum(step[:-1]) > 0


def _extend(docs: DataFrame, anchors: DataFrame, ranks: DataFrame) -> DataFrame:
    """The 50-word windows around anchors, with the rank of their class (its least doc_id)."""
    anchors = stored(anchors.join(ranks, "cls"), "anchors")
    texts = _texts(docs, anchors).hint("merge").join(anchors, "cls")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = _Meeting(True)
        for batch in batches:
            names, ranked, single, packs = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
            for a, words, _ in _documents(batch.column(0)):
                hashes = words.hashes()
                for i in range(len(words.offsets) - 1):
                    at, n = words.offsets[i], words.offsets[i + 1] - words.offsets[i]
                    pos = np.flatnonzero(_covered(_starts(single[a + i], packs[a + i]), WINDOW - BLOCK, 0, n - WINDOW + 1))
                    own = _words.rolling(hashes, _words.WORD_BASE, at + pos, at + pos + WINDOW)
                    also = _words.rolling(hashes, ALSO_BASE, at + pos, at + pos + WINDOW)
                    if meeting.add(own, also, names[a + i], ranked[a + i], pos):
                        yield from meeting.settle()
        yield from meeting.settle()

    return arrow_map(texts.select("text", "cls", "rank", "single", "packs"), read, MET)


def _cut(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(cls, removed, kept): how many words of a class's text go, and the rest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept = [], []
            for text, single, packs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = text.encode().split()
                gone = _covered(_starts(single, packs), 0, WINDOW - 1, len(words))
                n.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=["cls", "removed", "kept"])

    windows = stored(windows, "windows")
    texts = _texts(docs, windows).hint("merge").join(windows, "cls").select("cls", "text", "single", "packs")
    return arrow_map(texts, read, "cls long, removed long, kept string")


def dedup_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """What to keep. Two tables: rows, and the texts that lose some words but not all.

    Rows: `key`, n_words, n_removed, sha (of all its words joined by one space), cls, and all_gone. Texts: cls, removed,
    kept. A row that is neither all_gone nor in the texts keeps its words. A null text has no words; a null key is smaller
    than all others; rows with equal keys don't remove each other's words.
    """
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL)).alias("key"), F.col(text).alias("text"))
    survey = stored(_survey(docs), "survey")
    index, bits = _index(survey)
    rows = survey.filter("segment IS NULL").select("key", "n_words", "sha", "cls")
    ranks = rows.filter(F.col("n_words") >= WINDOW).groupBy("sha", "cls").agg(F.min("key").alias("rank"))
    anchors = _met(_probe(docs, index, bits), False)
    windows = _met(_extend(docs, anchors, ranks.select("cls", "rank")), True)
    cuts = stored(_cut(docs, windows).dropDuplicates(["cls"]), "cuts")
    least = rows.join(ranks.select(F.col("sha").alias("_sha"), "rank"), F.col("sha") == F.col("_sha"), "left").drop("_sha")
    whole = F.coalesce(F.col("key") > F.col("rank"), F.lit(False))
    out = least.join(cuts.select(F.col("cls").alias("_cls"), "removed"), F.col("cls") == F.col("_cls"), "left")
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0)))
    out = out.select(F.nullif("key", F.lit(NULL)).alias(key), "n_words", removed.cast("long").alias("n_removed"), "sha", "cls", whole.alias("all_gone"))
    return out, cuts


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    rows, cuts = dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = cuts.select(F.col("cls").alias("_cls"), F.sha2("kept", 256).alias("kept_sha"))
    out = rows.join(kept, F.col("cls") == F.col("_cls"), "left")
    sha = F.when(F.col("all_gone"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha", "sha"))
    return out.select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM g) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM d),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
k AS (SELECT u.doc_id, count(c.i) AS gone, string_agg(x, ' ' ORDER BY u.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
