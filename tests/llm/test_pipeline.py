import re
from collections import Counter

import corpus_pipeline
from tests.llm.conftest import write

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, folder), "test")
        yield name, before, docs


def test_stages(spark, awkward_dir):
    folder, rows = awkward_dir
    seen = {}
    for name, before, after in stages(spark, folder):
        seen[name] = before, after
        if name != "best-fit packing":
            assert set(after.columns) == COLUMNS
            assert after.filter("n_chars <> length(text)").isEmpty()
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES]
    before, after = seen["line dedup"]
    assert before.count() == after.count()
    before, after = seen["n-gram Jaccard join"]
    ids = Counter(r[0] for r in after.select("doc_id").collect())
    assert max(ids.values()) == 1 and set(ids) <= {r[0] for r in before.select("doc_id").collect()}
    before, after = seen["mixing sources to target weights"]
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in before.select("doc_id", "text").collect()}
    taken = Counter()
    for i, text in after.select("doc_id", "text").collect():
        taken[i] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    assert all(0 < n <= 3 * size[i] for i, n in taken.items())
    before, after = seen["best-fit packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_null_ids(spark, null_dir):
    assert corpus_pipeline.run(spark, null_dir[0]).count() > 0


def test_near_copies_leave_one(spark, tmp_path):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], f"new{i}", *base[i:]]), "src0") for i in range(5)] + [(9, "quite another text of some words", "src1")]
    folder = write(tmp_path / "t", rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()) == [0, 9]


def test_near_copies_with_null_or_repeated_ids_leave_one(spark, tmp_path):
    """Copies that share the null id, and an id that stands for another row's class than its own."""
    text = lambda name, new="": " ".join([*(f"{name}{i}" for i in range(200)), new])
    rows = [(None, text("a")), (None, text("a", "x")), (4, text("a", "y")), (None, text("b")), (1, text("c")), (2, text("c", "x")), (1, text("d", "x")), (0, text("d")), (3, ""), (None, None)]
    folder = write(tmp_path / "t", [(i, t, "src0") for i, t in rows])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [(r["doc_id"], (r["text"] or "")[:1]) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    assert Counter(found) == Counter([(None, "a"), (None, "b"), (1, "c"), (0, "d"), (3, ""), (None, "")])
