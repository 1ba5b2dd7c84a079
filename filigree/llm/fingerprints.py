"""Document fingerprints: MinHash signatures of word shingles.

Each signature entry is the least value of one universal hash permutation over a document's shingles, computed for all
documents of a slice at once. A fingerprint keeps the low byte of each entry; likeness is the share of equal bytes,
corrected for equality by chance. For joins, bands of whole entries meet in Spark, and Jaccard is verified on the sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm import _words
from filigree.llm._graph import components
from filigree.llm._members import may_have_each, members
from filigree.llm._scratch import arrow_map, stored
from filigree.llm._words import U, Words

SHINGLE, ENTRIES = 5, 128
_seeds = _words.mix(np.arange(1, 2 * ENTRIES + 1, dtype=U))
MULTIPLY = (_seeds[:ENTRIES] >> U(32)).astype(np.uint32) | np.uint32(1)
ADD = (_seeds[ENTRIES:] >> U(32)).astype(np.uint32)


def signatures(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """ENTRIES minima for each document (all ones without words), and how many shingles each has, repeats counted."""
    hashes, offsets = words.shingles(words.hashes(fold=True), k)
    n = np.diff(offsets)
    out = np.full((len(n), ENTRIES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        x = (hashes >> U(32)).astype(np.uint32)
        values, at = np.empty_like(x), offsets[:-1][full]
        for i in range(ENTRIES):
            np.multiply(x, MULTIPLY[i], out=values)
            values += ADD[i]
            out[full, i] = np.minimum.reduceat(values, at)
    return out, n


def prints(words: Words) -> np.ndarray:
    """A row of ENTRIES bytes for each document; the first byte tells documents without words from others."""
    entries, n = signatures(words)
    out = (entries & 0xFF).astype(np.uint8)
    out[n == 0] = 0
    return np.hstack([(n > 0).astype(np.uint8)[:, None], out])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An estimate of the Jaccard similarity for rows of fingerprints; 1 if both have no words, 0 if one has none."""
    equal = (a[:, 1:] == b[:, 1:]).mean(axis=1)
    out = np.clip((equal - 1 / 256) / (1 - 1 / 256), 0, 1)
    return np.where(a[:, 0] != b[:, 0], 0.0, np.where(a[:, 0] == 0, 1.0, out))


def of_texts(texts: list[bytes]) -> np.ndarray:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts = [prints(_words.words(data, bounds[a : b + 1])) for a, b in _words.slices(bounds)]
    return np.vstack(parts) if parts else np.zeros((0, ENTRIES + 1), np.uint8)


def edited(text: str, following: str) -> bytes:
    """The last half of the code points, rounded down, replaced by as many from the start of the following text."""
    half = len(text) // 2
    return (text[: len(text) - half] + following[:half]).encode()


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(texts: list[str], own: np.ndarray, following: list[str], after: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    new = of_texts(changed)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
        pa.array([x.tobytes().hex() for x in own], pa.string()),
        pa.array([x.tobytes().hex() for x in new], pa.string()),
        pa.array(likeness(own, new)),
        pa.array(likeness(own, after)),
    ]


def with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how like it is to that and to the next row's.

    Rows follow each other by `key`, nulls first, equal keys by a hash of the text; after the last comes the first.
    A null text is empty. One range exchange of the texts; the rows at partition borders, two from each, are joined apart.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "part", "border", "text", *(x.split()[0] for x in COLUMNS.split(", "))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, first = TaskContext.get().partitionId(), None, True

        def emit(keys: pa.Array, texts: list[str], own: np.ndarray, following: list[str], after: np.ndarray) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([keys, pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string()), *_row(texts, own, following, after)], names=names)

        def border(keys: pa.Array, text: str, own: np.ndarray, which: int) -> pa.RecordBatch:
            arrays = [keys, pa.array([part], pa.int32()), pa.array([which], pa.int32()), pa.array([text]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([own.tobytes().hex()]), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            _, bounds = _words.buffers(batch.column(1))
            for a, b in _words.slices(bounds):
                keys = batch.column(0).slice(a, b - a)
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                own = of_texts([x.encode() for x in texts])
                if first:
                    yield border(keys.slice(0, 1), texts[0], own[0], 1)
                    first = False
                if waiting is not None:
                    yield emit(waiting[0], [waiting[1]], waiting[2], [texts[0]], own[:1])
                if len(texts) > 1:
                    yield emit(keys.slice(0, len(texts) - 1), texts[:-1], own[:-1], texts[1:], own[1:])
                waiting = keys.slice(len(texts) - 1), texts[-1], own[-1:]
        if waiting is not None:
            yield border(waiting[0], waiting[1], waiting[2][0], 2)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts, mine, following, after) = (batch.column(i).to_pylist() for i in range(1, 5))
            rows = [np.frombuffer(b"".join(map(bytes.fromhex, x)), np.uint8).reshape(len(x), ENTRIES + 1) for x in (mine, after)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_row(texts, rows[0], following, rows[1])], names=["key", *names[4:]])

    # by the text's hash too: rows of one key, or without one, spread over tasks
    dealt = docs.select(key, text).repartitionByRange(F.col(key), F.xxhash64(text)).sortWithinPartitions(key, F.xxhash64(text))
    rows = stored(arrow_map(dealt, walk, f"key {kind}, part int, border int, text string, {COLUMNS}"), "fingerprints")
    heads = rows.filter("border = 1").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("after"))
    parts = sorted(x[0] for x in heads.select("part").collect())  # one number for each partition
    order = docs.sparkSession.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "tail int, part int")
    tails = rows.filter("border = 2").select(F.col("part").alias("tail"), "key", "text", "fingerprint")
    ends = tails.join(order, "tail").join(heads, "part").select("key", "text", "fingerprint", "following", "after")
    closed = arrow_map(ends, close, f"key {kind}, {COLUMNS}")
    return rows.filter("border = 0").select("key", *names[4:]).unionByName(closed).withColumnRenamed("key", key)


def near_pairs(docs: DataFrame, threshold: float = 0.8, rows_per_band: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pairs (a, b, jaccard), a < b, verified: links that connect all documents whose Jaccard is enough and that share a bucket.

    Documents with equal sets are one class: the least key stands for it, and has a pair with each other one. Equal
    signatures in a band of `rows_per_band` entries put classes in a bucket. Each member is first held against the
    bucket's least key; the pairs that pass connect documents. Then, in each bucket, the members outside its largest connected
    part are held against all members that they aren't connected with. Two documents that nothing connects yet include one
    of those, so no link is lost; within a part not all pairs are listed. A bucket of near copies gives about as many pairs
    as it has members, one of texts that are all unlike each other gives the square of it to verify. Jaccard is exact, on the
    hashed sets of five-word shingles. Rows without words or with a null key have no pairs. Of a key given with several
    texts each counts, and a pair's greatest Jaccard does.

    Only bands that two classes share, and sets of documents that are in a pair to verify, are shuffled: bit tables of bounded
    size, broadcast, keep the others back.
    """
    kind = docs.schema[key].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in _words.each(batch.column(1)):
                entries, n = signatures(words)
                full = np.flatnonzero(n)
                grouped = entries[full].astype(U).reshape(len(full), ENTRIES // rows_per_band, rows_per_band)
                keys = np.arange(grouped.shape[1], dtype=U)[None, :] + U(1)
                for i in range(rows_per_band):
                    keys = _words.mix(keys * U(_words.WORD_BASE) + grouped[:, :, i])
                hashes, offsets = words.shingles(words.hashes(fold=True), SHINGLE)
                sets = [np.unique(hashes[offsets[i] : offsets[i + 1]]) for i in full]
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full + a)), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())], names=["key", "size", "digest", "bands"])

    def every_band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(batch.num_rows, -1)
            row = np.repeat(np.arange(batch.num_rows), bands.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(bands.reshape(-1))], names=["key", "size", "band"])

    def shared_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column(2).to_pylist()), U).reshape(batch.num_rows, -1)
            row, column = np.nonzero(may_have_each(filters.value, bands))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(bands[row, column].view(np.int64))], names=["key", "size", "band"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                j.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j, pa.float64())], names=["a", "b", "jaccard"])

    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL")
    rows = stored(arrow_map(docs, features, f"key {kind}, size long, digest binary, bands binary"), "features")
    firsts = rows.groupBy("digest").agg(F.min("key").alias("a"))
    copies = rows.select("digest", F.col("key").alias("b")).join(firsts, "digest").filter("a <> b").select("a", "b", F.lit(1.0).alias("jaccard"))
    classes = stored(rows.groupBy("digest").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("bands").alias("bands")).select("key", "size", "bands"), "classes")
    banded = f"key {kind}, size long, band long"
    least = arrow_map(classes, every_band, banded).groupBy("band").agg(F.min(F.struct("key", "size")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    least = stored(least.select("band", F.col("m.key").alias("a"), F.col("m.size").alias("other")), "least")
    filters = members(least, "band")
    # what the table lets pass in error is dropped by this join
    shared = stored(arrow_map(classes, shared_bands, banded).join(least.select("band"), "band", "left_semi").distinct(), "bands")
    alike = F.least("size", "other") / F.greatest("size", "other") >= threshold  # sizes bound Jaccard

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = members(pairs.select(F.explode(F.array("a", "b")).alias("key")).select(F.xxhash64("key").alias("h")), "h")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(may_have_each(wanted.value, batch.column(2).to_numpy().view(U))))
                for a, b, words in _words.each(batch.column(1)):
                    hashes, offsets = words.shingles(words.hashes(fold=True), SHINGLE)
                    found = [np.unique(hashes[i:j]).tobytes() for i, j in zip(offsets, offsets[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], names=["key", "grams"])

        grams = arrow_map(docs.select("key", "text", F.xxhash64("key").alias("h")), sets, f"key {kind}, grams binary")
        both = pairs.join(grams.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
        found = arrow_map(both.select("a", "b", "x", "y"), verify, f"a {kind}, b {kind}, jaccard double").filter(F.col("jaccard") >= threshold)
        return found.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))

    stars = stored(shared.join(least, "band").filter("a < key").filter(alike).select("a", F.col("key").alias("b")).distinct(), "stars")
    first = stored(verified(stars), "pairs")

    parts = components(first.select("a", "b"))
    rooted = stored(shared.join(parts, shared["key"] == parts["node"], "left").select("band", "key", "size", F.coalesce("root", "key").alias("root")), "rooted")
    largest = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("m")).select("band", F.col("m.root").alias("main"))
    outside = rooted.join(largest, "band").filter("root <> main").select("band", F.col("key").alias("_key"), F.col("size").alias("other"), F.col("root").alias("_root"))
    rest = rooted.join(outside, "band").filter("root <> _root").filter(alike).select(F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b")).distinct()
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    return first.unionByName(verified(rest)).unionByName(copies).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def near_classes(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, class_id (the least key that verified links reach, the row's own included) and n_links of each row.

    n_links: its links among those that near_pairs returns, which connect a class and aren't all of its pairs. Rows without
    words, and rows with a null key, are classes of their own. Rows with equal keys are one document.
    """
    links = stored(near_pairs(docs, threshold, text=text, key=key), "links")
    roots = components(links.select("a", "b")).withColumnRenamed("node", "_node")
    counts = links.select(F.explode(F.array("a", "b")).alias("_end")).groupBy("_end").agg(F.count(F.lit(1)).alias("n_links"))
    rows = docs.select(F.col(key).alias("_key"))
    out = rows.join(roots, F.col("_key") == F.col("_node"), "left").join(counts, F.col("_key") == F.col("_end"), "left")
    return out.select(F.col("_key").alias(key), F.coalesce("root", "_key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
