import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from filigree.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "filigree").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("filigree.llm") for n in names), path


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(DATA))
    assert sorted(want.columns) == sorted(got.columns)
    plain = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).removesuffix("+00:00")
    rows = lambda r, c: sorted((tuple(plain(dict(zip(c, x, strict=True))[k]) for k in sorted(c)) for x in r), key=str)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)
