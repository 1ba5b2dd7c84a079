import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

COLUMNS = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
#: Columns that an operator might use for itself.
CLASHES = ("key", "id", "n", "size", "tag", "first", "score", "drops", "_drops", "lines", "unit", "n_words", "length", "piece", "block", "cls", "rank", "component_id")


def vectors(seed=7):
    """(vec_id, embedding): whole ones, ties between centroids, repeated rows, null ids, and rows that don't count."""
    rng = random.Random(seed)
    out = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(60)]
    out += [(100 + i, [float(i % 3)] * 64) for i in range(30)]
    out += [out[5], out[5], (None, out[7][1]), (None, out[8][1]), (None, [0.25] * 64)]
    out += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [float("nan")] + [1.0] * 63), (206, [float("-inf")] + [1.0] * 63), (207, [-0.0, 1e-30, -1e-30] + [0.5] * 61)]
    rng.shuffle(out)
    return out


def write(folder, rows, labels=(), extra=True, files=3, embeddings=()):
    """A documents table of (doc_id, text, source) in several files, with extra columns, a labels table and an embeddings table."""
    (folder / "documents.parquet").mkdir(parents=True)
    for i in range(files):
        part = rows[i::files]
        data = {"doc_id": [r[0] for r in part], "text": [r[1] for r in part], "lang": [None] * len(part), "source": [r[2] for r in part], "n_chars": [None if r[1] is None else len(r[1]) for r in part]}
        table = pa.table({k: pa.array(v, COLUMNS[k]) for k, v in data.items()})
        if extra:
            for name in CLASHES:
                table = table.append_column(name, pa.array(["x"] * len(part), pa.string()))
        pq.write_table(table, folder / "documents.parquet" / f"part-{i}.parquet")
    table = {"vec_id": pa.array([x[0] for x in embeddings], pa.int64()), "embedding": pa.array([x[1] for x in embeddings], pa.list_(pa.float32())), "label": pa.array([0] * len(embeddings), pa.int32())}
    pq.write_table(pa.table(table | {name: pa.array(["x"] * len(embeddings), pa.string()) for name in ("v", "h", "cluster", "distance", "sums", "mean")}), folder / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([x[1] for x in labels], pa.int32())}), folder / "labels.parquet")
    return str(folder)


def prose(rng, n, width=2000):
    return [f"w{rng.randrange(width)}" for _ in range(n)]


def awkward(seed=5):
    """Rows with all that may go wrong but null ids: nulls, empty and long texts, ties, repeated rows, copies, passages."""
    rng = random.Random(seed)
    passage, line = prose(rng, 70), "A line that many of the documents share, surely."
    texts = [None, "", " \n\t ", "one", "One two", "\n\n", "a b c d", "A B C D", "naïve ŉ İ?! <|endoftext|> don't 中文　\xa0x\x1cy  z ", "word " * 300, "Eins. " * 40, "#$% " * 30, "LOUD WORDS ONLY " * 20]
    for i in range(40):
        words = prose(rng, rng.randrange(5, 400))
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage[rng.randrange(12) :]
        text = " ".join(w if k % 17 else w + ".\n" for k, w in enumerate(words))
        if i % 3 == 0:
            text += f"\n  {line.upper() if i % 2 else line} \nLicensed under the Apache License, Version 2.0.\n"
        texts.append(text)
    for i in range(20):  # near copies
        words = texts[20].split()
        words[rng.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    texts += [texts[30]] * 15
    texts.append(" ".join(prose(rng, 60_000, 50_000)))
    texts.append("x" * 100_000)
    rows = [(i, t, None if i % 7 == 0 else ("src0" if i % 3 else f"src{i % 4}")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[3], rows[3], rows[10]]


@pytest.fixture(scope="session")
def awkward_dir(tmp_path_factory):
    rows = awkward()
    return write(tmp_path_factory.mktemp("awkward") / "t", rows, [(r[0], r[0] % 2) for r in rows] + [(None, 1), (1, None)], embeddings=vectors()), rows


@pytest.fixture(scope="session")
def null_dir(tmp_path_factory):
    rows = [*awkward(6), (None, "no id here, twice over", "src1"), (None, None, None), (None, "no id here, twice over", "src1")]
    return write(tmp_path_factory.mktemp("nulls") / "t", rows, [(3, 1)], embeddings=vectors(8)), rows


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty") / "t", [])
