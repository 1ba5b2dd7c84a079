"""Token shards against the tokenizers library and byte by byte; centroid clustering against plain integers."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from filigree.llm import centroids, token_shards
from filigree.llm._perfect import Perfect, digests, fingerprints
from filigree.llm.queries import QUERIES
from tests.llm.conftest import vectors

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts, end=2):
    own = Tokenizer.from_file(PATH)
    return [np.array([*own.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 1000, 30_000])
def test_perfect_function(n):
    d = digests(b"%d" % i for i in range(n))
    f = Perfect.of(d)
    assert sorted(f(d)) == list(range(n))
    again = Perfect(f.sizes, f.packed)
    assert (again(d) == f(d)).all() and len(f.packed) <= 0.75 * n + 8 * len(f.sizes)
    if n > 100:
        other = digests(b"x%d" % i for i in range(n))
        assert (fingerprints(other) == fingerprints(d)[np.argsort(f(d))][np.maximum(f(other), 0)]).sum() <= 1


def test_equal_keys_raise():
    with pytest.raises(ValueError, match="equal keys"):
        Perfect.of(digests([b"a", b"b", b"a"]))


@pytest.mark.parametrize("tables", ["awkward_dir", "null_dir"])
def test_op11_against_the_library(spark, request, tables):
    """Ascending keys, null first; of a key's rows any order, with the ids of one after the other."""
    folder, rows = request.getfixturevalue(tables)
    want = defaultdict(Counter)
    for r, ids in zip(rows, ids_of([r[1] for r in rows]), strict=True):
        want[r[0]][len(ids) // 4, zlib.crc32(ids)] += 1
    out = sorted(QUERIES["op11_token_shards"](spark, folder).collect(), key=lambda r: r["start"])
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    got = defaultdict(Counter)
    for r in out:
        got[r["doc_id"]][r["n_tokens"], r["ids_crc32"]] += 1
    assert got == want


def test_shards_are_raw_ids_with_keyed_access(spark, tmp_path):
    texts = {i: " ".join(f"word{i * j % 97}" for j in range(i % 50)) for i in range(0, 900, 3)}
    rows = [(k, v) for k, v in texts.items()] + [(7, f"copy {i}") for i in range(40)] + [(7, "the same")] * 40 + [(None, None)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "shards")
    token_shards.write(docs, path, PATH, shard_bytes=2000)
    files = sorted(p for p in Path(path, "ids").glob("part-*") if p.stat().st_size)
    shards = [token_shards.Shard(np.memmap(p, np.uint8, "r")) for p in files]
    assert len(shards) > 5 and sum(any(k == 7 for k in s.table["key"].to_pylist()) for s in shards) > 1  # one key over several shards
    assert all(s.ids.dtype == np.uint16 for s in shards)
    raw = b"".join(np.fromfile(p, "<u2", len(s.ids)).astype("<u4").tobytes() for p, s in zip(files, shards, strict=True))
    ordered = token_shards.documents(spark, path, ids=True).orderBy("start").collect()
    assert raw == b"".join(r["ids"] for r in ordered)
    expected = dict(zip(texts, ids_of(texts.values()), strict=True))
    assert all(r["ids"] == expected[r["doc_id"]] for r in ordered if r["doc_id"] in texts)
    assert any((ids := s.get(300)) is not None and ids.astype("<u4").tobytes() == expected[300] for s in shards)
    assert all(s.get(1) is None and s.get("300 ") is None for s in shards)
    keys = spark.createDataFrame([(300,), (7,), (1,), (None,), (300,)], "doc_id long")
    found = {r["doc_id"]: (r["first_shard"], r["last_shard"]) for r in token_shards.located(spark, path, keys).collect()}
    assert found[1] == (None, None) and found[300][0] == found[300][1] and found[7][0] < found[7][1] and found[None][0] == 0
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in token_shards.fetched(spark, path, keys).collect())
    texts_of = [(k, t) for k, t in rows if k in (300, 7) or k is None]
    assert got == Counter(zip([k for k, _ in texts_of], ids_of([t for _, t in texts_of]), strict=True))


@pytest.mark.parametrize("end", [50256, 99_999])  # not text; of more than two bytes
def test_shards_of_nothing_and_of_strings(spark, tmp_path, end):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_shards.write(none, str(tmp_path / "a"), PATH)
    assert token_shards.documents(spark, str(tmp_path / "a")).count() == 0
    keys = spark.createDataFrame([(1,)], "doc_id long")
    assert token_shards.located(spark, str(tmp_path / "a"), keys).collect()[0]["first_shard"] is None
    assert token_shards.fetched(spark, str(tmp_path / "a"), keys).count() == 0
    docs = spark.createDataFrame([("b", "One two"), ("a\x00", ""), ("ä", None)], "name string, body string")
    token_shards.write(docs, str(tmp_path / "b"), PATH, end=end, text="body", key="name")
    out = token_shards.documents(spark, str(tmp_path / "b"), "string", ids=True, key="name").orderBy("start").collect()
    assert [(r["name"], bytes(r["ids"])) for r in out] == list(zip(["a\x00", "b", "ä"], ids_of(["", "One two", ""], end), strict=True))


def plain_clusters(rows, k=8, rounds=10):
    v = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    c = [x for _, x in sorted(v, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x: min((far(x, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in v:
            own[near(x)[1]].append(x)
        for j, xs in own.items():
            c[j] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out = [(i, *near(x)[::-1]) for i, x in v]
    each = Counter()
    for _, j, d in out:
        each[j] += d
    sha = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return Counter((i, j, d, each[j], sum(each.values()), sha(j)) for i, j, d in out)


@pytest.mark.parametrize(("tables", "seed"), [("awkward_dir", 7), ("null_dir", 8)])
def test_op12_against_plain_integers(spark, request, tables, seed):
    folder, _ = request.getfixturevalue(tables)
    got = QUERIES["op12_centroid_clustering"](spark, folder).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(vectors(seed))


def test_op12_sql_over_awkward_rows(spark, awkward_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{awkward_dir[0]}/embeddings.parquet'")
    assert Counter(con.sql(centroids.OP12_SQL).fetchall()) == plain_clusters(vectors(7))


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in centroids.clusters(df).collect()) == plain_clusters(rows)
    with pytest.raises(Exception, match="beyond"):
        centroids.clusters(spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 1 << 10, 1 << 27]), st.sampled_from([1, 3, 64]), st.integers(1, 12))
def test_nearest_is_exact(seed, width, d, k):
    """Also where float32 can't tell: components of 27 bits that differ by one, and ties."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-width, width, d, endpoint=True)
    c = np.clip(base + rng.integers(-1, 2, (k, d)), -width, width)
    x = np.clip(base + rng.integers(-2, 3, (50, d)), -width, width).astype(np.int32)
    own = centroids.Centroids(c)
    far = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    low, high = own.intervals(x)
    shared = (x.astype(object) ** 2).sum(axis=1)[:, None]
    assert ((low <= (far - shared).astype(np.float64) + 1e-6) & (high >= (far - shared).astype(np.float64) - 1e-6)).all()
    numbers, _ = own.nearest(x)
    assert numbers.tolist() == [int(np.argmin(r)) for r in far]
    assert own.distances(x, numbers).tolist() == [int(min(r)) for r in far]


def test_most_rows_are_settled_in_single_precision():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-300, 300, (5000, 64)).astype(np.int32), rng.integers(-300, 300, (200, 64))
    assert centroids.Centroids(c).nearest(x)[1] < 250
