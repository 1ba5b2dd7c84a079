"""N-gram Jaccard join: links between documents whose sets of word n-grams are alike, and what they connect.

1. Each document's distinct n-grams are hashed. Documents with equal sets are one set from here on.
2. N-grams get a global order, rare ones first: they are counted by hash, over all sets, and tables of bounded size tell
   which stand in more than one set, and which in many. (Any order gives the same links; a good one, fewer candidates.)
3. Prefix filter: two sets above the threshold share an n-gram among the first n - ceil(t n) + 1 of each. Sets that share
   one, and whose sizes permit, are connected into blocks: a set meets the first of its run only, never all others.
4. Each block's sets are stored in a trie in the global order and joined by walking it; see _trie. Blocks over a bounded
   size are cut: into chunks, then by prefix n-gram or by chunk, whichever copies less; see _block_links.
5. The links' connected components are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm import _words
from filigree.llm._graph import components
from filigree.llm._members import may_have, members
from filigree.llm._scratch import arrow_map, stored
from filigree.llm._trie import linked
from filigree.llm._words import U
from filigree.sources.workers import trim

#: Slots of the table of frequent n-grams, and of that of shared ones at most (powers of 2), and n-grams in a chunk of a block.
SLOTS, MOST_BITS, CHUNK = 22, 29, 1 << 22
#: N-grams that a task holds before it hands them on, and bytes of input for each bucket that they go to.
HELD, BUCKET = 1 << 20, 1 << 18
#: From so many sets on an n-gram is frequent; of its sets, so many go to one task.
MANY, SHARE = 16, 4096


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each row its number, its distinct n-grams, sorted by hash, and the set's 128-bit name (empty: of no n-grams)."""
    for a, _, words in _words.each(column):
        hashes, offsets = words.shingles(words.hashes(fold=True), k)
        for i, (x, y) in enumerate(zip(offsets, offsets[1:], strict=False)):
            grams = np.unique(hashes[x:y])
            yield a + i, grams, hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else b""


def _number(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def ngram_sets(docs: DataFrame, k: int, text: str, key: str) -> DataFrame:
    """A row (key, n, id) for each document: how many n-grams its set has, and the set's number."""
    kind = docs.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(grams), _number(name) if name else 0) for _, grams, name in _sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["key", "n", "id"])

    return arrow_map(docs.select(key, text), read, f"key {kind}, n long, id long")


def _bucket_bits(total: int) -> int:
    """So many that a bucket's part of all n-grams fits in a task."""
    return min(max((8 * total // BUCKET).bit_length(), 8), 20)


def _frequencies(docs: DataFrame, k: int, total: int, text: str):
    """Broadcast tables: which n-grams stand in two sets at least (bits, by hash), and weights of frequent ones (by slot)."""
    buckets, bits = _bucket_bits(total), min(max(total.bit_length(), SLOTS), MOST_BITS)
    low = 64 - buckets - 32

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, waiting = set(), [], 0

        def deal() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket, rest = (grams >> U(64 - buckets)).astype(np.int64), (grams >> U(low)).astype(np.uint32)
            edges = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
            single = counts == 1
            ones, more, often = [], [], []
            for a, b in zip(edges, np.append(edges[1:], len(grams)), strict=True):
                own = single[a:b]
                ones.append(rest[a:b][own].tobytes())
                more.append(rest[a:b][~own].tobytes())
                often.append(counts[a:b][~own].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), *(pa.array(x, pa.binary()) for x in (ones, more, often))], names=["bucket", "ones", "more", "often"])

        for batch in batches:
            for _, grams, name in _sets(batch.column(0), k):
                if name and name not in known:
                    known.add(name)
                    held.append(grams)
                    waiting += len(grams)
                    if waiting >= HELD:
                        yield deal()
                        held, waiting = [], 0
        if held:
            yield deal()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def close() -> pa.RecordBatch:
            ones, more, often = (np.frombuffer(b"".join(x), np.uint32) for x in zip(*parts, strict=True))
            grams, counts = np.concatenate((ones, more)), np.concatenate((np.ones(len(ones), np.int64), often))
            order = np.argsort(grams, kind="stable")
            grams, counts = grams[order], counts[order]
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            sums = np.add.reduceat(counts, first)
            shared = sums >= 2
            whole = U(current) << U(64 - buckets) | grams[first[shared]].astype(U) << U(low)
            at, sums = (whole >> U(64 - bits)).astype(np.int64), sums[shared]
            slots, place = np.unique((whole[sums >= MANY] >> U(64 - SLOTS)).astype(np.int64), return_inverse=True)
            top = np.zeros(len(slots), np.int64)
            np.maximum.at(top, place, sums[sums >= MANY])
            pages = np.unique(at >> 12)
            packed = []
            for x in pages:
                flags = np.zeros(4096, bool)
                flags[at[(at >> 12) == x] & 4095] = True
                packed.append(np.packbits(flags, bitorder="little").tobytes())
            m, j = len(pages), len(slots)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((pages, slots)).astype(np.int64)), pa.array([*packed, *[None] * j], pa.binary()), pa.array([*[None] * m, *top.tolist()], pa.int64())], names=["at", "bits", "sets"])

        for batch in batches:
            for bucket, *part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != current and parts:
                    yield close()
                    parts = []
                current = bucket
                parts.append(part)
        if parts:
            yield close()

    dealt = arrow_map(docs.select(text), read, "bucket int, ones binary, more binary, often binary")
    found = stored(arrow_map(dealt.repartition("bucket").sortWithinPartitions("bucket"), count, "at long, bits binary, sets long"), "frequencies")
    shared = np.zeros((1 << bits - 12, 512), np.uint8)  # in pages of 4096 bits
    for at, packed in found.filter("bits IS NOT NULL").select("at", "bits").collect():
        shared[at] |= np.frombuffer(bytes(packed), np.uint8)
    weights = np.zeros(1 << SLOTS, np.uint8)
    for at, sets in found.filter("sets IS NOT NULL").groupBy("at").agg(F.max("sets")).collect():
        weights[at] = min(2 + int(4 * np.log2(sets / MANY)), 63)
    out = docs.sparkSession.sparkContext.broadcast((shared.reshape(-1), bits, weights))
    trim()
    return out


def _order(grams: np.ndarray, tables: tuple) -> np.ndarray:
    """N-grams under the global order, sorted: unique ones, shared ones, frequent ones by weight; then by hash."""
    shared, bits, weights = tables
    at = (grams >> U(64 - bits)).astype(np.int64)
    weight = np.maximum(weights[(grams >> U(64 - SLOTS)).astype(np.int64)], 1)
    weight *= shared[at >> 3] >> (at & 7).astype(np.uint8) & 1
    return np.sort(weight.astype(U) << U(58) | grams >> U(6))


def _prefixes(docs: DataFrame, k: int, num: int, den: int, tables, text: str) -> DataFrame:
    """Rows (gram, part, id, n): of the prefix of each set the n-grams that other sets may have. part splits frequent ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, share = tables.value, set(), _share()
        for batch in batches:
            parts, ids, sizes = [], [], []
            for _, grams, name in _sets(batch.column(0), k):
                if not name or name in known:
                    continue
                known.add(name)
                n = len(grams)
                prefix = _order(grams, own)[: n - -(-num * n // den) + 1]
                parts.append(prefix[np.searchsorted(prefix, U(1 << 58)) :])
                ids.append(_number(name))
                sizes.append(n)
            if parts:
                grams, lengths = np.concatenate(parts), [len(x) for x in parts]
                number = np.repeat(np.array(ids, np.int64), lengths)
                part = (number & 0xFFFFFF) % share[(grams >> U(58)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(number), pa.array(np.repeat(sizes, lengths).astype(np.int32))], names=["gram", "part", "id", "n"])

    return arrow_map(docs.select(text), read, "gram long, part int, id long, n int")


def _candidates(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect all sets with a common prefix n-gram and sizes that permit a link."""
    run = "PARTITION BY gram, part ORDER BY n, id"
    marked = prefixes.selectExpr("gram", "part", "id", "n", f"lag(n) OVER ({run}) AS before")
    # sizes in ascending order: across a gap that forbids a link between neighbours, no two sets link
    first = f"CASE WHEN before IS NULL OR {den} * before < {num} * n THEN id END"
    led = marked.selectExpr("gram", "part", "id", "before", f"last({first}, true) OVER ({run} ROWS UNBOUNDED PRECEDING) AS head")
    within = led.filter("head <> id").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b"))
    # the parts of a frequent n-gram: their heads meet, whatever their sizes
    heads = led.filter(f"gram >= 0 AND shiftrightunsigned(gram, 58) >= {_first_cut()} AND head = id OR gram < 0 AND head = id").select("gram", "id")
    least = heads.groupBy("gram").agg(F.min("id").alias("a"))
    across = heads.join(least, "gram").filter("a < id").select("a", F.col("id").alias("b"))
    return within.unionByName(across).distinct()


def _share() -> np.ndarray:
    """Into how many parts an n-gram of each weight is split."""
    return np.maximum(MANY * 2 ** ((np.arange(64) - 1) / 4) // SHARE, 1).astype(np.int64)


def _first_cut() -> int:
    """The least weight that is split; weights from 32 on make the n-gram negative as a signed number."""
    return int(np.argmax(_share() > 1))


def classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """`key`, n_shingles and component_id of each row, and n_class, the rows in its class.

    A row's set: the distinct k-word n-grams of its lower-cased text (A-Z), the whole sequence if it has fewer words. Rows
    link if den * intersection >= num * union. A row without words links with nothing; a null key comes before all others,
    so a class with one has a null component_id. Rows equal in all columns keep their number. chunk: n-grams in a task.
    """
    spark = docs.sparkSession
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    rows = stored(ngram_sets(docs, k, text, key), "sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    weights = _frequencies(docs, k, total, text)

    prefixes = stored(_prefixes(docs, k, num, den, weights, text), "prefixes")
    edges = _candidates(prefixes, num, den)
    stars = components(edges)
    blocks = stars.select("node", F.col("root").alias("block")).unionByName(stars.select(F.col("root").alias("node"), F.col("root").alias("block")).distinct())
    joined = _block_links(docs, rows, blocks, prefixes, k, num, den, weights, text, chunk)

    sets = rows.filter("n > 0").groupBy("id").agg(F.min("key").alias("least"), F.max(F.col("key").isNull()).alias("none"), F.count(F.lit(1)).alias("rows"))
    sets = sets.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "least", "none", "rows")
    groups = sets.groupBy("root").agg(F.min("least").alias("least"), F.max("none").alias("none"), F.sum("rows").alias("n_class"))
    named = sets.select("id", "root").join(groups, "root").select(F.col("id").alias("_id"), F.when(F.col("none"), F.lit(None).cast(kind)).otherwise(F.col("least")).alias("least"), "n_class")
    out = rows.join(named, (F.col("n") > 0) & (F.col("id") == F.col("_id")), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"))


def _block_links(docs: DataFrame, rows: DataFrame, blocks: DataFrame, prefixes: DataFrame, k: int, num: int, den: int, weights, text: str, chunk: int) -> DataFrame:
    """(node, root): the components of all links within blocks.

    A block of up to `chunk` n-grams is one task. A larger one is cut: each chunk is joined by itself, and so are, in
    rounds, the heads of the chunks' largest components, which in a group of near copies makes one component of most sets. What may be
    missing are links between these components. Two ways find all of them, and each block takes the one that copies less:

    * by chunks: the sets outside the block's largest component are joined with every chunk. A link between two components
      has an end among these. Few sets, where a block is near copies and some that are nearly so.
    * by postings: two sets that link share a prefix n-gram, so the sets of each prefix n-gram that has sets of several
      components are joined: those outside its largest component with all. Few sets, where a block is held together by
      chains of n-grams and little in it links: verified components count, not those of candidates.
    """
    sizes = rows.filter("n > 0").select("id", "n").distinct()
    blocks = blocks.join(sizes, blocks["node"] == sizes["id"]).select("id", "block", "n")
    total = blocks.groupBy("block").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks"))
    dealt = stored(blocks.select("id", "block").join(total, "block"), "blocks")
    shared = members(dealt, "id")  # what it lets pass in error is dropped by the join

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, table, known = shared.value, weights.value, set()
        for batch in batches:
            ids, parts = [], []
            for _, grams, name in _sets(batch.column(0), k):
                if not name or name in known:
                    continue
                known.add(name)
                number = _number(name)
                if may_have(bits, number):
                    ids.append(number)
                    parts.append(_order(grams, table).tobytes())
                    if len(ids) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], names=["id", "grams"])
                        ids, parts = [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], names=["id", "grams"])

    grams = arrow_map(docs.select(text), read, "id long, grams binary").hint("merge").join(dealt, "id")
    cut = not dealt.filter("chunks > 1").isEmpty()
    if cut:
        grams = stored(grams.dropDuplicates(["id"]), "grams")
    whole = stored(_tasks(grams.filter("chunks = 1"), F.lit(0), F.col("id"), num, den), "links")
    stars = whole.select(F.col("b").alias("node"), F.col("a").alias("root"))
    if not cut:
        return stars

    large = grams.filter("chunks > 1").withColumn("part", F.pmod("id", "chunks")).withColumn("n", (F.length("grams") / 8).cast("long"))
    own = stored(_tasks(large, F.col("part"), F.col("id"), num, den), "links")
    light = stored(large.select("block", "chunks", "part", "id", "n"), "large")

    def marked(links: DataFrame) -> DataFrame:
        """The sets of large blocks with their components so far."""
        found = components(links).withColumnRenamed("node", "id")
        return light.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))

    def largest(labels: DataFrame, *by: str) -> DataFrame:
        counts = labels.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("c"))
        return counts.groupBy(*by).agg(F.min_by("root", F.struct(-F.col("c"), F.col("root"))).alias("main"))

    heads = largest(marked(own), "block", "part").select("block", F.col("main").alias("id"))
    met = _head_links(light.select("block", "id", "n").join(heads, ["block", "id"], "left_semi"), large, num, den, chunk)
    labels = stored(marked(own.unionByName(met)), "labels")

    sides = labels.join(largest(labels, "block"), "block")
    copied = F.when(F.col("root") != F.col("main"), F.col("n") * (F.col("chunks") - 1)).otherwise(0)
    by_chunks = sides.groupBy("block").agg(F.sum(copied).alias("chunked"))
    postings = stored(prefixes.select("gram", "id").join(labels.select("id", "block", "root", "n"), "id"), "postings")
    open_ = postings.groupBy("gram", "block").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.sum("n").alias("n")).filter("a < b")
    by_postings = open_.groupBy("block").agg(F.sum("n").alias("posted"))
    ways = stored(by_chunks.join(by_postings, "block", "left").select("block", _by_postings(F.coalesce("posted", F.lit(0)), F.col("chunked")).alias("posted")), "ways")

    both = large.join(sides.select("id", "block", "root", "main"), ["block", "id"]).join(ways.filter("NOT posted"), "block", "left_semi")
    others = both.filter("root <> main").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("to <> part").withColumn("part", F.col("to")).drop("to")
    rest = stored(_tasks(both.unionByName(others.select(*both.columns)), F.col("part"), F.col("root"), num, den), "links")

    chosen = postings.join(ways.filter("posted"), "block", "left_semi").join(open_.select("gram", "block"), ["gram", "block"], "left_semi")
    chosen = stored(chosen.join(largest(chosen, "gram", "block"), ["gram", "block"]).withColumn("probe", F.col("root") != F.col("main")), "chosen")
    # cells of at most two chunks: probes in rows, all sets in columns; each probe is in all columns of its row
    cells = chosen.groupBy("gram", "block").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("columns"), F.ceil(F.sum(F.when(F.col("probe"), F.col("n"))) / chunk).cast("int").alias("lines"))
    at = chosen.join(cells, ["gram", "block"]).select("id", "root", "probe", "columns", "lines", F.xxhash64("gram", "block").alias("unit"), F.pmod(F.xxhash64("id"), "columns").alias("c"), F.pmod(F.xxhash64(F.lit(1), "id"), "lines").alias("l"))
    across = at.select("id", "root", "unit", F.explode(F.transform(F.sequence(F.lit(0), F.col("lines") - 1), lambda x: x * F.col("columns") + F.col("c"))).alias("cell"))
    along = at.filter("probe").select("id", "root", "unit", F.explode(F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda x: F.col("l") * F.col("columns") + x)).alias("cell"))
    met_in = across.unionByName(along).distinct().join(large.select("id", "grams"), "id").withColumnRenamed("unit", "block")
    more = stored(_tasks(met_in, F.col("cell"), F.col("root"), num, den), "links")
    return stars.unionByName(components(own.unionByName(met).unionByName(rest).unionByName(more)))


def _head_links(heads: DataFrame, large: DataFrame, num: int, den: int, chunk: int) -> DataFrame:
    """Links (a, b) of the chunks' heads (block, id, n), joined in groups of about `chunk` n-grams.

    A block's heads are dealt to groups by their running sum of n-grams. Of a group, the head of its largest component goes
    on to the next round, until a block has one group. A group has at least two heads, so rounds are no more than the
    logarithm of a block's chunks. Links between other heads are found as those of all components are.
    """
    found = []
    order = Window.partitionBy("block").orderBy("id")  # a row a chunk, without its n-grams
    while True:
        # of two rising numbers the lesser rises, too: groups of about `chunk` n-grams, and no more of them than pairs
        before = F.floor((F.sum("n").over(order) - F.col("n")) / chunk)
        pair = F.floor((F.row_number().over(order) - 1) / 2)
        dealt = stored(heads.withColumn("part", F.least(before, pair).cast("int")), "heads")
        met = stored(_tasks(large.select("block", "id", "grams").join(dealt.select("block", "id", "part"), ["block", "id"]), F.col("part"), F.col("id"), num, den), "links")
        found.append(met)
        several = dealt.groupBy("block").agg(F.max("part").alias("last")).filter("last > 0").select("block")
        if several.isEmpty():
            break
        stars = met.select(F.col("b").alias("id"), F.col("a").alias("root"))
        marked = dealt.join(several, "block", "left_semi").join(stars, "id", "left").withColumn("root", F.coalesce("root", "id"))
        counts = marked.groupBy("block", "part", "root").agg(F.count(F.lit(1)).alias("c"))
        mains = counts.groupBy("block", "part").agg(F.min_by("root", F.struct(-F.col("c"), F.col("root"))).alias("id"))
        heads = dealt.select("block", "id", "n").join(mains.select("block", "id"), ["block", "id"], "left_semi")
    return reduce(DataFrame.unionByName, found)


def _by_postings(posted, chunked):
    """Whether a block goes by postings: n-grams that each way copies."""
    return posted < chunked


def _tasks(sets: DataFrame, part, label, num: int, den: int) -> DataFrame:
    """Links (a, b), stars of the components, of each (block, part) of sets (block, id, grams, ...).

    Sets with equal labels are in one component already; one link to another is enough for all of them.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; a task's sets are joined when its last one has come."""
        current, ids, held, marks = None, [], [], []

        def close() -> pa.RecordBatch | None:
            if len(ids) < 2:
                return None
            names, labels = np.array(ids, np.int64), np.array(marks, np.int64)
            if (labels == labels[0]).all():
                return None
            roots = linked(held, num, den, labels if len(np.unique(labels)) < len(labels) else None)
            other = np.flatnonzero(labels != labels[roots])
            if not len(other):
                return None
            _, first = np.unique(labels[other], return_index=True)
            other = other[first]
            return pa.RecordBatch.from_arrays([pa.array(names[roots[other]]), pa.array(names[other])], names=["a", "b"])

        for batch in batches:
            for block, place, number, mark, grams in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (block, place) != current:
                    if (out := close()) is not None:
                        yield out
                    current, ids, held, marks = (block, place), [], [], []
                if not ids or ids[-1] != number:  # equal sets from several tasks
                    ids.append(number)
                    held.append(np.frombuffer(grams, U))
                    marks.append(mark)
        if (out := close()) is not None:
            yield out

    rows = sets.select("block", part.cast("int").alias("part"), "id", label.alias("label"), "grams")
    return arrow_map(rows.repartition("block", "part").sortWithinPartitions("block", "part", "id"), join, "a long, b long")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""
