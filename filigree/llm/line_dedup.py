"""Line dedup: lines that many documents share stay in one document only.

1. One pass over the texts hashes each line's key to 128 bits. Only (hash, document, position) goes on, 28 bytes a line.
2. These rows are range-partitioned by hash and sorted by document, last one first, and position. Each range is swept in
   that order: the first occurrence of a hash is in the document that keeps it, and later ones go if enough documents have it.
3. What goes comes back as a compressed bitmap for each document that loses lines: words of 64 lines, those that are kept
   whole left out. The text is rebuilt from it where the text is.

Hot lines: one line may stand in a third of all documents, which no range could hold. A sketch of bounded size (frequent
items) names the hashes with more than 1/(0.75 * TRACKED) of all lines, which are so few that they can be broadcast. Their
rows don't enter the ranges: the number of documents and the last one are summed before any shuffle, a row for each hash
comes back, and each task tells by itself which of its rows go. Which hashes the sketch names changes where rows go, never
the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm._scratch import stored

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = -(2**63)
#: Hashes that the sketch holds at most; each with over 1/(0.75 * TRACKED) of the lines is among them.
TRACKED = 1 << 14


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, tag, pos, h, g) of each line whose key has at least min_chars code points; docs: doc, tag, text.

    The key is the line without white space at both ends, A-Z lower-cased (in the whole text at once); other letters stay.
    """
    lines = lines_of(F.translate("text", UPPER, LOWER))
    long = F.filter(F.transform(lines, lambda x, i: F.struct(F.trim(x, F.lit(SPACES)).alias("key"), i.alias("pos"))), lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h"), F.xxhash64(F.lit(1), x["key"]).alias("g")))
    return docs.select("doc", "tag", F.explode(hashed).alias("x")).select("doc", "tag", "x.pos", "x.h", "x.g")


def hot_hashes(lines: DataFrame) -> DataFrame:
    """(h): hashes with so many of the lines that they don't go to a range; fewer than TRACKED rows.

    Sketches of tasks are put together in groups first, so that none gathers those of all tasks.
    """
    parts = lines.groupBy((F.spark_partition_id() % 64).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("sketch"))
    whole = parts.groupBy(F.lit(1).alias("all")).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))  # no row of no lines
    each = whole.select("n", F.explode(F.expr(f"approx_top_k_estimate(sketch, {TRACKED})")).alias("x"))
    return each.filter(F.col("x.count") * (TRACKED * 3 // 4) > F.col("n")).select(F.col("x.item").alias("h"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc, tag, keeps) of each row of docs (doc, tag, text) that loses lines.

    keeps is an array of (word, bits): line 64 * word + i stays if bit i of bits is set; words that aren't listed stay whole.
    A key is dropped from all documents but the one with the largest doc if at least min_docs have it. Rows with equal doc
    are one document, whatever their texts: they count once and keep or lose a line together. tag tells their texts apart.
    """
    lines = stored(occurrences(docs, min_chars), "lines")
    hot = stored(hot_hashes(lines), "hot")
    # a window's rows are all in one range and in the order of the sweep: nothing moves between this exchange and the windows
    dealt = lines.join(F.broadcast(hot), "h", "left_anti").repartitionByRange("h", "g").sortWithinPartitions("h", "g", F.desc("doc"))
    sweep = Window.partitionBy("h", "g").orderBy(F.desc("doc"))
    swept = dealt.withColumn("last", F.first("doc").over(sweep)).withColumn("nth", F.dense_rank().over(sweep))
    counted = swept.withColumn("n", F.max("nth").over(sweep.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    gone = counted.filter((F.col("n") >= min_docs) & (F.col("doc") < F.col("last"))).select("doc", "tag", "pos")

    often = lines.join(F.broadcast(hot), "h")
    shared = often.groupBy("h", "g").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= min_docs).select("h", "g", "last")
    found = often.join(F.broadcast(shared), ["h", "g"]).filter(F.col("doc") < F.col("last")).select("doc", "tag", "pos")

    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64))
    words = gone.unionByName(found).groupBy("doc", "tag", F.shiftright("pos", 6).alias("word")).agg(F.bitwise_not(bits).alias("bits"))
    return words.groupBy("doc", "tag").agg(F.collect_list(F.struct("word", "bits")).alias("keeps"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Each row of docs (doc_id, text and any other columns) with `kept_text`, `n_lines` and `n_dropped`.

    A null or empty text is one empty line, which is too short to be dropped. A null doc_id is smaller than all others;
    rows with equal doc_id are one document. Repeated rows stay repeated. Other columns may have any names; those of the
    names above give way to the results.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)) if kind in ("tinyint", "smallint", "int", "bigint") else F.coalesce(F.struct("doc_id"), F.lit(None))
    rest = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), own.alias("doc"), F.xxhash64("text").alias("tag"), F.col("text").alias("text"))
    keeps = keep_bitmaps(rows.select("doc", "tag", "text"), min_docs, min_chars)
    joined = rows.join(keeps, ["doc", "tag"], "left").select("row", "text", lines_of(F.col("text")).alias("lines"), F.map_from_entries("keeps").alias("bits"))
    stays = lambda i: F.call_function("getbit", F.coalesce(F.try_element_at("bits", F.shiftright(i, 6)), F.lit(-1).cast("long")), i % 64) != 0
    kept = F.when(F.col("bits").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: stays(i)))
    out = joined.withColumn("kept", kept)
    text = F.when(F.col("bits").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("kept", "\n"))
    n = F.size("lines").cast("long")
    return out.select(*(F.col("row").getField(c).alias(c) for c in rest), text.alias("kept_text"), n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH r AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, coalesce(doc_id, -9223372036854775808) AS doc, doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM r),
k AS (
  SELECT r, doc, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (SELECT key, max(doc) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc) >= 3),
j AS (SELECT k.r, k.doc_id, k.pos, k.line, s.last IS NOT NULL AND k.doc < s.last AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""
