"""The jobs over growing copies of the tables, against plain Python and SQL."""

import hashlib
import json
import logging
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from jobs import cohort_report, run_notes
from jobs.registered import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
NOTES = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
RULES = {"min_words": 3, "max_files_per_batch": 2, "otherwise": "NA", "conditions": [[["flow", "high"], "high_flow"], [["flow"], "flow"], [["static"], "static"]]}


def land(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    data = {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": ["a"] * len(rows), "source": [r[2] for r in rows], "n_chars": [0] * len(rows)}
    pq.write_table(pa.table({k: pa.array(v, NOTES[k]) for k, v in data.items()}).append_column("words", pa.array(["clash"] * len(rows))), folder / f"{name}.parquet")


def labelled(folder, rows):
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([r[1] for r in rows], pa.int32()), "toxic": pa.array([r[2] for r in rows], pa.int32())}), folder / "l.parquet")


def expect(rows, labels):
    """name -> (doc_id, condition, words, lines, message, status)"""
    down = {}
    for i, q, t in labels:
        down[i] = down.get(i, False) or not q or t == 1
    out = {}
    for i, text, source in rows:
        text = text or ""
        name = f"note_{hashlib.md5(text.encode()).hexdigest()}" if i is None else f"{source or 'unnamed'}_a_img{i}"
        low, n = text.lower(), len(re.findall(run_notes.WORD, text))
        condition = next((label for words, label in RULES["conditions"] if all(w in low for w in words)), "NA")
        message = "no number" if i is None else "no note" if n == 0 else "short note" if n < RULES["min_words"] else None
        status = "failed" if message else {True: "skip", False: "curated", None: "pending"}[down.get(i)]
        if name not in out:
            out[name] = (i, condition, n, text.count("\n") + 1 if text else 0, message, status)
    return out


def got(df):
    rows = df.collect()
    alike = Counter((r["condition"], r["status"]) for r in rows)
    assert all(r["alike"] == alike[r["condition"], r["status"]] for r in rows)
    assert len({r["name"] for r in rows}) == len(rows)
    return {r["name"]: tuple(r[c] for c in ("doc_id", "condition", "words", "lines", "message", "status")) for r in rows}


FIRST = [(0, "High FLOW all day\nlong", "r"), (1, "a static chip, day 7", "r"), (2, None, "r"), (3, "", None), (4, "one two", "s"), (5, "flow at valve 3", "s"), (None, "no id here at all", "s")]
SECOND = [(0, "delivered again, but static", "r"), (6, "İstanbul flow " * 2000, "r"), (7, "neither of them here", "t"), (5, "flow at valve 3", "s")]
LABELS = [(0, 1, 0), (1, 1, 1), (5, 0, 0), (5, 1, 0), (6, 1, 0), (None, 1, 0), (99, 1, 0)]


@pytest.fixture
def place(tmp_path):
    labelled(tmp_path / "labels", LABELS)
    return tmp_path


def take(spark, place, documents=None):
    return run_notes.run(spark, str(documents or place / "notes"), str(place / "labels"), str(place / "out"), str(place / "checkpoint"), RULES)


def files(place):
    return {p: p.stat().st_mtime_ns for p in (place / "out").rglob("part-*")}


def test_only_new_notes_are_taken(spark, place, caplog):
    caplog.set_level(logging.INFO, "jobs")
    land(place / "notes", "one", FIRST)
    assert got(take(spark, place)) == expect(FIRST, LABELS)
    before = files(place)
    assert got(take(spark, place)) == expect(FIRST, LABELS) and files(place) == before  # nothing new: nothing written
    land(place / "notes", "two", SECOND)
    assert got(take(spark, place)) == expect(FIRST + SECOND, LABELS)
    assert before.items() <= files(place).items()  # what was written stays as it is
    assert "read 7 notes, wrote 7 images" in caplog.text and "read 4 notes, wrote 2 images" in caplog.text
    for i, name in enumerate(("three", "four", "five")):  # more files than a batch takes
        land(place / "notes", name, [(100 + i, "static flow, and more", "x")])
    assert len(got(take(spark, place))) == 12
    folders = {p.name for p in (place / "out" / "catalogue").iterdir() if p.is_dir()}
    assert folders == {f"batch={i}" for i in range(4)}


def test_a_repeated_batch_replaces_its_own(spark, place):
    """As after a failure between the write and the checkpoint; also without a checkpoint."""
    land(place / "notes", "one", FIRST)
    land(place / "notes", "two", SECOND)
    run_notes.ready(spark, str(place / "out"))
    batch = spark.read.parquet(str(place / "notes" / "one.parquet"))
    for number in (0, 0):
        run_notes.take(batch, number, str(place / "labels"), str(place / "out"), RULES)
    assert got(run_notes.result(spark, str(place / "out"))) == expect(FIRST, LABELS)
    assert set(got(take(spark, place))) == set(expect(FIRST + SECOND, LABELS))


def test_notes_in_one_file_and_no_notes(spark, place):
    land(place / "notes", "documents", [])
    assert got(take(spark, place, place / "notes" / "documents.parquet")) == {}
    land(place / "other", "documents", FIRST)
    assert got(run_notes.run(spark, str(place / "other" / "documents.parquet"), str(place / "labels"), str(place / "o"), str(place / "c"), RULES)) == expect(FIRST, LABELS)


def test_rows_of_one_image_in_one_batch(spark, place):
    land(place / "notes", "one", [(1, "a b c d", "r"), (1, "a b c", "r"), (1, "a b c", "r")])
    assert got(take(spark, place)) == {"r_a_img1": (1, "NA", 3, 1, None, "skip")}


def test_command_lines(spark, place):
    land(place / "notes", "one", FIRST)
    (place / "rules.json").write_text(json.dumps(RULES))
    argv = [sys.executable, "-m", "jobs.run_notes", *(x for k in ("notes", "labels", "out", "checkpoint") for x in (f"--{'documents' if k == 'notes' else k}", str(place / k))), "--config", str(place / "rules.json")]
    done = subprocess.run(argv, cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0 and "wrote 7 images" in done.stderr, done.stderr[-2000:]
    assert got(run_notes.result(spark, str(place / "out"))) == expect(FIRST, LABELS)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_jobs_against_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want, settings = con.sql(ORACLE_SQL[name]), dict(spark.conf.getAll)
    out = QUERIES[name](spark, str(DATA))
    assert sorted(out.columns) == sorted(want.columns)
    assert {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"} == {k: v for k, v in settings.items() if k != "spark.checkpoint.dir"}
    plain = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda r, c: sorted((tuple(plain(dict(zip(c, x, strict=True))[k]) for k in sorted(c)) for x in r), key=str)
    assert rows(out.collect(), out.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_report_of_growing_tables(spark, tmp_path):
    """Half of the customers, then all: partitions are replaced, and the report is that of a first call over all."""
    half = spark.read.parquet(str(DATA / "customer.parquet")).filter("c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY'")
    half.write.parquet(str(tmp_path / "customer"))
    paths = [str(DATA / "lineitem.parquet"), str(DATA / "orders.parquet")]
    first = cohort_report.run(spark, *paths, str(tmp_path / "customer"), str(tmp_path / "a"))
    assert {r["experiment"] for r in first.collect()} == {"AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"}
    for out in ("a", "b"):
        cohort_report.run(spark, *paths, str(DATA / "customer.parquet"), str(tmp_path / out))
    a, b = (sorted(map(tuple, cohort_report.result(spark, str(tmp_path / out)).collect())) for out in ("a", "b"))
    assert a == b and len({r[0] for r in a}) == 5
    panel = spark.read.schema(cohort_report.PANEL).parquet(str(tmp_path / "a" / "panel"))
    assert panel.groupBy("image_id", "feature").count().filter("count > 1").count() == 0


def test_report_of_nothing_and_of_unknown_features(spark, tmp_path):
    tables = {
        "lineitem": "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double", "orders": "o_orderkey long, o_custkey long, o_orderstatus string", "customer": "c_custkey long, c_mktsegment string",
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / t) for t in tables]
    assert cohort_report.run(spark, *paths, str(tmp_path / "out")).collect() == []
    with pytest.raises(ValueError, match="nonsense"):
        cohort_report.run(spark, *paths, str(tmp_path / "out"), {"min_lines": 1, "level": 0.05, "features": ["median_branch_nonsense"]})
