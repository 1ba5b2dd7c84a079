"""Toxicity by multiple-instance learning.

Only documents are labelled, but sentences offend. A sentence scores p = sigmoid(bias + sum of its features' weights); a
document scores by noisy-or, 1 - product of (1 - p) over its sentences; weights are fitted to the documents' labels through
that formula, and so learn which sentences make a document toxic. Features are words and their beginnings, hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm import _words
from filigree.llm._scratch import arrow_map, stored
from filigree.llm._words import U, Words
from filigree.sources.workers import trim

#: Labelled rows that the fit reads at most (a third of them toxic, if there are so many), and features it keeps at most.
SAMPLE, FEATURES = 12_000, 4096
#: Bytes of the training sample's texts, at most.
BYTES = 256 << 20
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.3
STOP, MARK = np.zeros(256, bool), np.zeros(256, bool)
STOP[list(b".!?\n")] = True
MARK[list(b".,;:!?\"'()")] = True


def features(words: Words) -> np.ndarray:
    """For each word a row of hashes: the word without a mark at its end, and its first bytes; 0 where it is too short."""
    data, starts = words.data, words.starts
    ends = words.ends - MARK[data[words.ends - 1]]
    values = _words._folded[data]
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), U)
    out[:, 0] = _words.rolling(values, _words.BYTE_BASE, starts, ends)
    for i, n in enumerate(BEGINNINGS):
        long = ends - starts > n
        out[long, i + 1] = _words.mix(_words.rolling(values, _words.BYTE_BASE, starts[long], starts[long] + n) + U(n))
    return out


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word's sentence in the slice, and each sentence's document. Stops and line ends part sentences."""
    stops = np.concatenate(([0], np.cumsum(STOP[words.data])))
    doc = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.offsets))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(stops[words.starts]) > 0) | (np.diff(doc) > 0)
    return np.cumsum(new) - 1, doc[new]


@dataclass(frozen=True)
class Model:
    """hashes: sorted."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document, of each sentence, and each sentence's document. A document without words scores 0."""
        n = len(words.bounds) - 1
        if not len(words.starts):
            return np.zeros(n), np.zeros(0), np.zeros(0, np.int64)
        sentence, doc = sentences(words)
        logit = np.full(len(doc), self.bias)
        if len(self.hashes):
            found = features(words)
            table = np.zeros(1 << 16, bool)
            table[(self.hashes >> U(48)).astype(np.int64)] = True
            word, kind = np.nonzero(table[(found >> U(48)).astype(np.int64)])
            hits = found[word, kind]
            at = np.minimum(np.searchsorted(self.hashes, hits), len(self.hashes) - 1)
            same = self.hashes[at] == hits
            np.add.at(logit, sentence[word[same]], self.weights[at[same]])
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        clean = np.zeros(n)
        np.add.at(clean, doc, np.log1p(-np.minimum(p, 1 - 1e-12)))
        return -np.expm1(clean), p, doc


def _pick(texts: pa.Array, y: np.ndarray, most: int) -> np.ndarray:
    """The hashes most typical of documents with label 1, by chi-square over 15, sorted.

    Two passes. The first counts slots of hashes: a hash isn't in more documents with label 1 than its slot's count, so
    slots that couldn't reach 15 without any document with label 0 go. The second counts the other slots' hashes, a part
    of the texts at a time, and holds a row for each hash rather than for each occurrence.
    """
    count = np.zeros(1 << 22, np.int32)

    def passes() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b, words in _words.each(texts):
            found = features(words)
            doc = np.repeat(np.arange(a, b), np.diff(words.offsets))
            keep = found != 0
            yield found[keep], np.broadcast_to(doc[:, None], found.shape)[keep]

    def chi(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        n, p = len(y), max(int(y.sum()), 1)
        a, b, c, d = pos.astype(float), neg.astype(float), p - pos.astype(float), n - p - neg.astype(float)
        out = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
        return np.where((a * d > b * c) & (pos >= 3), out, 0)

    def once(found: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((found, doc))
        found, doc = found[order], doc[order]
        new = np.ones(len(found), bool)
        new[1:] = (np.diff(doc) > 0) | (found[1:] != found[:-1])
        return found[new], doc[new]

    for found, doc in passes():
        found, doc = once(found, doc)
        np.add.at(count, (found[y[doc] == 1] >> U(42)).astype(np.int64), 1)
    wanted = chi(np.minimum(np.arange(count.max() + 1), y.sum()), np.zeros(count.max() + 1))[count] > 15
    del count
    each, pos, neg = np.zeros(0, U), np.zeros(0), np.zeros(0)
    parts, held = [], 0

    def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, label = (np.concatenate(x) for x in zip(*parts, strict=True))
        both, at = np.unique(np.concatenate((each, found)), return_inverse=True)
        return both, np.bincount(at, np.concatenate((pos, label)), len(both)), np.bincount(at, np.concatenate((neg, 1 - label)), len(both))

    for found, doc in passes():
        keep = wanted[(found >> U(42)).astype(np.int64)]
        found, doc = once(found[keep], doc[keep])
        parts.append((found, y[doc]))
        held += len(found)
        if held > 1 << 19:
            each, pos, neg = added()
            parts, held = [], 0
    if parts:
        each, pos, neg = added()
    score = chi(pos, neg)
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(each[best[score[best] > 15]])


def fit(texts: pa.Array, y: np.ndarray, weight: np.ndarray, most: int = FEATURES, rounds: int = 400, ridge: float = 3e-4) -> Model:
    """Weights by Adam on the noisy-or likelihood of the documents' labels. Without both labels there is nothing to learn: all score 0."""
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, U), np.zeros(0), -30.0)
    hashes = _pick(texts, y, most)
    rows, columns, docs, total = [], [], [], 0
    for a, _, words in _words.each(texts):
        if not len(words.starts):
            continue
        sentence, doc = sentences(words)
        found = features(words)
        at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
        word, kind = np.nonzero(hashes[at] == found) if len(hashes) else (np.zeros(0, int),) * 2
        rows.append(sentence[word] + total)
        columns.append(at[word, kind])
        docs.append(doc + a)
        total += len(doc)
    rows, columns, docs = (np.concatenate(x) for x in (rows, columns, docs))
    weight = weight / weight.sum()
    theta = np.zeros(len(hashes) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        logit = theta[-1] + np.bincount(rows, theta[columns], total)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        whole = np.clip(-np.expm1(np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))), 1e-9, 1 - 1e-9)
        # d loss / d logit of a sentence: p if the document is clean, -p (1 - P) / P if it is toxic
        slope = weight * np.where(y == 1, -(1 - whole) / whole, 1.0)
        g = slope[docs] * p
        grad = np.append(np.bincount(columns, g[rows], len(hashes)), g.sum()) + ridge * np.append(theta[:-1] / max(len(hashes), 1), 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return Model(hashes, theta[:-1], float(theta[-1]))


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows whose labels aren't for learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key) % 4 == 2, F.lit(False))


def _within(rows: list, most: int) -> list:
    """Rows (id, label, bytes) in their order, without those that would take the sum of bytes beyond a bound."""
    out, held = [], 0
    for row in rows:
        if held + (row[2] or 0) <= most:
            out.append(tuple(row)[:2])
            held += row[2] or 0
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> Model:
    """Fits on at most `sample` labelled rows that aren't held out, a third of them toxic if there are so many, with texts of at
    most `most` bytes in all: a text that would go beyond that is left out of the sample, as the driver couldn't hold it.

    Which rows is settled by a hash of their ids; classes are weighted back to their shares among the documents' labels. Null ids,
    labels other than 0 and 1, and labels without a document don't count; the greatest of several labels does.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    counts = {x[0]: x[1] for x in known.groupBy("toxic").count().collect()}
    positive = min(counts.get(1, 0), sample // 3)
    order = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(positive).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(sample - positive))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # of an id's rows all texts are learned from, so their bytes count together
    bytes_ = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text")).alias("bytes"))
    rows = bytes_.orderBy(order, "doc_id").collect()  # at most `sample` rows
    ids = docs.sparkSession.createDataFrame(_within(rows, most), f"doc_id {kind}, toxic int")
    table = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "text").select("text", "toxic").toArrow()
    y = table.column("toxic").to_numpy().astype(np.int64)
    n = np.bincount(y, minlength=2)
    texts = table.column("text").combine_chunks()
    del table
    model = fit(texts, y, np.array([counts.get(k, 0) / max(n[k], 1) for k in (0, 1)])[y])
    del texts
    trim()
    return model


def scores(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and score of each row, in one pass. A text without words, or null, scores 0."""
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _words.each(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(words)[0])], names=["key", "score"])

    return arrow_map(docs.select(key, text), judge, f"key {kind}, score double").withColumnRenamed("key", key)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are; no join, no shuffle."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _words.each(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(model.score(words)[0] < threshold))

    return arrow_map(docs, keep, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def offending(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The sentences that score at least `threshold`: `key`, sentence (from 0), its words as text, score."""
    kind = docs.schema[key].dataType.simpleString()

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in _words.each(batch.column(1)):
                _, p, doc = model.score(words)
                hit = np.flatnonzero(p >= threshold)
                if not len(hit):
                    continue
                sentence, _ = sentences(words)
                first, last = np.searchsorted(sentence, hit), np.searchsorted(sentence, hit, "right") - 1
                texts = [words.data[words.starts[i] : words.ends[j]].tobytes().decode() for i, j in zip(first, last, strict=True)]
                number = hit - np.searchsorted(doc, doc[hit])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[hit] + a)), pa.array(number), pa.array(texts, pa.string()), pa.array(p[hit])], names=["key", "sentence", "span", "score"])

    return arrow_map(docs.select(key, text), locate, f"key {kind}, sentence long, span string, score double").withColumnRenamed("key", key)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
