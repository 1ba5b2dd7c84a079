"""Parts of the operators, against brute force."""

import random
import re
import textwrap

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.llm import _words, fingerprints, licenses, line_dedup, mixing, packing, quality, substring_dedup, token_counts, toxicity
from filigree.llm._trie import linked
from filigree.operators.components import components


def test_words_and_windows():
    texts = ["Hello  World foo", "", "  a\tb ", "\x0bAÉ x y z", None, "one two three four five"]
    for _, _, w in _words.each(pa.array(texts)):
        assert np.diff(w.offsets).tolist() == [3, 0, 2, 4, 0, 5]
        assert np.diff(w.shingles(w.hashes(), 4)[1]).tolist() == [1, 0, 1, 1, 0, 2]
        assert w.hashes(fold=True)[0] == _words.words(np.frombuffer(b"hELLO", np.uint8), np.array([0, 5])).hashes(fold=True)[0]


@pytest.mark.parametrize("num,den", [(85, 100), (1, 2), (1, 1)])
def test_trie_links(num, den):
    rng = random.Random(3)
    for _ in range(40):
        base = [rng.sample(range(200), rng.randint(1, 60)) for _ in range(rng.randint(1, 6))]
        found = set()
        for _ in range(rng.randint(1, 50)):
            b = set(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                b.symmetric_difference_update({rng.randrange(220)})
            found.add(tuple(sorted(b)) or (1,))
        sets = [np.array(s, np.uint64) for s in found]
        up = list(range(len(sets)))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if den * both >= num * (len(a) + len(sets[j]) - both):
                    x, y = sorted((root(i), root(j)))
                    up[y] = x
        assert linked(sets, num, den).tolist() == [root(i) for i in range(len(sets))]
        assert linked(sets, num, den, cells=1, pairs=1).tolist() == [root(i) for i in range(len(sets))]
        known = np.array([root(i) if root(i) % 2 else -i - 1 for i in range(len(sets))])  # some components are there already
        assert linked(sets, num, den, known).tolist() == [root(i) for i in range(len(sets))]
        assert linked(sets, num, den, np.array([root(i) for i in range(len(sets))])).tolist() == [root(i) for i in range(len(sets))]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 400), (5, 5)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(1, 101)} | {300: 200, 400: 200}


def test_counter_is_exact_and_associative():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_counts.Counter(path)
    rng = random.Random(1)
    letters = "aabcdeéß ñ  \n\t'’s.,!?0123456789ABC中日　\xa0\x1c"
    for _ in range(2000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        if rng.random() < 0.3:
            s = s[:7] + "<|endoftext|>" + s[7:] + " I'll we've"
        n = len(library.encode(s, add_special_tokens=False).ids)
        assert own.count(s) == own.count(s, chunk=1) == own.count(s, chunk=5) == n
        a, b, c = (own.chunk(x) for x in (s[:3], s[3:9], s[9:]))
        assert own.compose(own.compose(a, b), c)[1] == own.compose(a, own.compose(b, c))[1] or own.compose(a, b)[1] is None


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    a = [f"w{rng.randrange(9999)}" for _ in range(2000)]
    b = a[:1500] + [f"v{rng.randrange(9999)}" for _ in range(500)]
    p = fingerprints.of_texts([" ".join(a).encode(), " ".join(b).encode(), b"", b" "])
    assert abs(fingerprints.likeness(p[:1], p[1:2])[0] - 0.6) < 0.15
    assert fingerprints.likeness(p[2:3], p[3:4])[0] == 1 and fingerprints.likeness(p[:1], p[2:3])[0] == 0


def test_near_pairs_are_verified(spark):
    rng = random.Random(4)
    a = [f"w{rng.randrange(9999)}" for _ in range(300)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:150], "x", *a[150:]])), (3, " ".join(a[:150])), (4, None), (None, " ".join(a))]
    found = fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["a"], r["b"]) for r in found] == [(1, 2)] and 0.95 < found[0]["jaccard"] < 1


def test_near_pairs_lose_no_link(spark):
    """A chain of versions, and versions of a text that many unlike ones with smaller keys share most of their buckets with."""
    rng = random.Random(12)
    stock, ids = [f"w{i}" for i in range(1500)], rng.sample(range(1000), 31)
    texts = {i: " ".join(stock[30 * k : 30 * k + 300]) for k, i in enumerate(ids)}
    texts |= {i + 2000: t + f" copy{i}" for i, t in list(texts.items())[:8]}
    base = [f"v{i}" for i in range(300)]
    for i in range(80):
        at = rng.randrange(240)
        texts[5000 + i] = " ".join([*base[:at], *(f"u{i}_{k}" for k in range(60)), *base[at + 60 :]])
    versions = [base[: 8 * i] + [f"new{k}" for k in range(8 * i)] + base[16 * i :] for i in range(6)]
    texts |= {6000 + i: " ".join(x) for i, x in enumerate(versions)}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in grams for b in grams if a < b}
    want = {k: j for k, j in want.items() if j >= 0.8}
    assert {(min(x), max(x)) for x in zip(ids, ids[1:], strict=False)} <= set(want)
    found = {(r["a"], r["b"]): r["jaccard"] for r in fingerprints.near_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found.items() <= want.items()

    def parts(links):
        up = {i: {i} for i in texts}
        for a, b in links:
            up[a] |= up[b]
            for i in up[a]:
                up[i] = up[a]
        return {i: min(x) for i, x in up.items()}

    assert parts(found) == parts(want) and len({parts(want)[i] for i in ids}) == 1 and len({parts(want)[6000 + i] for i in range(6)}) == 1


def test_targets_and_permutations():
    assert mixing.targets([10, 1000, 20, 30]) == [30.0, 880.0, 60.0, 90.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    for n in (1, 2, 3, 17, 64, 1000):
        size, key = np.full(n, n), np.full(n, 99)
        out = mixing.permuted(np.arange(n), size, key)
        assert sorted(out) == list(range(n)) and (mixing.permuted(out, size, key, inverse=True) == np.arange(n)).all()
    for n in (0, 3, 10_000, 10**13):  # one draw at all sizes
        per = mixing.shares(n, 1, 7, 16)
        assert per.sum() == n and (per >= 0).all() and (per == mixing.shares(n, 1, 7, 16)).all()
        assert abs(per / max(n, 1) - 1 / 16).max() < 4 / max(n, 1) ** 0.5
    assert (mixing.shares(10_000, 1, 7) != mixing.shares(10_000, 2, 7)).any()


def test_plan_is_best_fit_decreasing():
    rng = random.Random(0)
    for _ in range(100):
        capacity = rng.choice([5, 16, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        gaps = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, g in enumerate(gaps) if g >= n]
            if fits:
                gaps[min(fits, key=lambda i: gaps[i])] -= n
            else:
                gaps.append(capacity - n)
        assert packing.plan({n: lengths.count(n) for n in lengths}, capacity)[1] == len(gaps)


def test_cascade_order_does_not_change_verdicts():
    texts = pa.array(["good words here " * 10, "LOUD WORDS HERE " * 10, "### $$$ %%% " * 9, "x" * 300, "same line\n" * 30])
    for _, _, w in _words.each(texts):
        alive = np.ones(len(texts), bool)
        want = quality.verdicts(quality.Texts(w), quality.RULES, alive)
        assert want.tolist() == [True, False, False, False, False]
        assert (quality.verdicts(quality.Texts(w), quality.RULES[::-1], alive) == want).all()


def test_cascade_is_ordered_by_added_cost(monkeypatch):
    """A rule whose measure is paid for, or rejects much, comes before one that rejects as much for more."""
    texts = pa.array(["LOUD WORDS HERE " * 200 if i % 2 else "good words here " * 200 for i in range(64)])
    (_, _, w), = list(_words.each(texts))
    clock = iter(range(10**6))
    monkeypatch.setattr(quality.time, "perf_counter", lambda: cost[0] + next(clock) * 1e-9)
    cost = [0.0]

    def rule(name, reads, share, price):
        def rejects(t):
            if reads not in t.__dict__:
                cost[0] += price
                t.__dict__[reads] = np.arange(len(t))
            return np.arange(len(t)) < share * len(t)

        return quality.Rule(name, rejects)

    rules = [rule("dear", "a", 0.5, 9.0), rule("cheap", "b", 0.5, 1.0), rule("shares", "b", 0.1, 1.0), rule("none", "c", 0.0, 1.0)]
    assert [r.name for r in quality.ordered(quality.Texts(w), rules)] == ["cheap", "shares", "dear", "none"]
    paid = quality.Texts(w)
    paid.__dict__["a"] = np.arange(len(paid))
    assert quality.ordered(paid, rules)[0].name == "dear"
    assert len(quality.sampled(quality.Texts(w), 10)) == 10


def _plain_measures(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x.strip(" \t\n\v\f\r") for x in text.split("\n")]
    lines = [x for x in lines if x]
    return (
        sum(bool(re.search(r"[A-Za-z\x80-\U0010FFFF]", x)) for x in found),
        sum(x.startswith(("-", "*", "•")) for x in lines),
        sum(x.endswith(("...", "…")) for x in lines),
        max(map(len, found), default=0),
        max((found.count(x) for x in set(found)), default=0),
    )


MARKED = ["", " \n ", "-", "...", "…", "•", "\xe2", "..", "a..\n.b", "- a\n * b...\n\t• c … \r\nd•", "1 2 3 4 x", "12 34\n中文 56", "x" * 600 + " y", "é" * 501, "no no no yes", "..\n.", "-\n*\n•\n\n", "…\n…a", "\x0b- a\x0c\n b...\x0c"]


def test_rules_with_measures_of_their_own():
    rng = random.Random(3)
    texts = MARKED + ["".join(rng.choice("-*•….. \n\tab1é") for _ in range(rng.randrange(60))) for _ in range(400)]
    for _, _, w in _words.each(pa.array(texts), 1 << 10):
        t = quality.Texts(w)
        got = list(zip(*(x.tolist() for x in (t.n_lettered, t.n_bullets, t.n_ellipses, t.longest_word, t.n_top_word)), strict=True))
        data = bytes(w.data)
        assert got == [_plain_measures(data[a:b].decode()) for a, b in zip(w.bounds, w.bounds[1:], strict=False)]


def test_rules_alone_reject(spark):
    fine = " ".join(f"word{i} and" if i % 4 == 0 else f"word{i}" for i in range(40)) + "."
    lines = [f"line{i} is{i} of{i} some words" for i in range(12)]
    cases = {
        "fine": fine,
        "letters": " ".join(str(i * 7919) for i in range(30)) + " but few words have letters",
        "bullets": "\n".join("- " + x for x in lines),
        "ellipses": "\n".join(x + "..." * (i % 2) for i, x in enumerate(lines)),
        "long_word": fine + " " + "x" * 501,
        "one_word": " ".join(f"buy buy w{i}" for i in range(30)),
    }
    docs = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    for order in (True, False):
        out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality(docs, order=order).collect()}
        assert out == {k: (False, k == "fine") for k in cases}
    for name in set(cases) - {"fine"}:
        assert {r["doc_id"] for r in quality.passing(docs, [x for x in quality.RULES if x.name == name]).collect()} == set(cases) - {name}


def test_measures_are_made_of_what_is_left_only():
    """In its turn, a rule with a measure of its own sees fewer rows than there are."""
    seen = []

    def dear(t):
        seen.append(len(t))
        return np.zeros(len(t), bool)

    for _, _, w in _words.each(pa.array(["a b c"] * 10 + ["12 34"] * 90)):
        quality.verdicts(quality.Texts(w), [quality.Rule("letters", lambda t: t.n_lettered == 0), quality.Rule("dear", dear)], np.ones(100, bool))
    assert seen == [10]


def test_passing_rows_are_those_of_quality(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir[0]}/documents.parquet")
    kept = sorted(r["doc_id"] for r in quality.quality(docs).collect() if r["kept"])
    out = quality.passing(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == kept and kept


def test_toxicity_learns_from_documents_and_locates_sentences(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(8)) for _ in range(6)]
        if i % 4 == 0:
            sentences[3] += f" grimbo{rng.randrange(50)}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    out = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert sum((s >= 0.3) == (i % 4 == 0) for i, s in out.items()) >= 585
    found = toxicity.offending(docs, model).collect()
    assert {r["sentence"] for r in found} == {3} and all("grimbo" in r["span"] for r in found)


def test_toxicity_picks_labels_that_have_documents(spark):
    """Labels far beyond the documents leave the training sample to those of documents."""
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20)) + (" grimbo" if i % 3 == 0 else "") + ".") for i in range(120)]
    labels = [(i, int(i % 3 == 0)) for i in range(20_000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, toxicity.train(docs, marks, sample=90)).collect()}
    assert sum((s >= 0.3) == (i % 3 == 0) for i, s in out.items()) >= 115


def test_toxicity_keeps_features_of_common_slots():
    """A hash that only toxic documents have, in a slot with one that half of all documents have."""
    rng = random.Random(13)
    short = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(20_000)]
    hashes = dict(zip(short, toxicity.features(next(_words.each(pa.array([" ".join(short)])))[2])[:, 0].tolist(), strict=True))
    slots = {}
    for w, h in hashes.items():
        slots.setdefault(h >> 42, []).append(w)
    rare, common = next(x for x in slots.values() if len(x) > 1)[:2]
    y = np.array([int(i % 3 == 0) for i in range(600)])
    texts = pa.array([f"d{i} {common if i % 2 else ''} {rare if i % 3 == 0 and i % 16 == 0 else ''}" for i in range(600)])
    assert toxicity._pick(texts, y, 4096).tolist() == [hashes[rare]]


def test_licence_sizes_bound_matches(spark):
    docs = spark.createDataFrame([(1, "x\nReleased under  THE mit license!\ny"), (2, "Released under the MIT"), (3, None), (4, "")], "doc_id long, text string")
    out = licenses.scan(docs).collect()
    assert [(r["doc_id"], r["unit"], r["license"], r["dice"]) for r in out if r["doc_id"] == 1 and r["unit"] >= 0] == [(1, 1, "MIT", 1.0)]
    assert [(r["doc_id"], r["license"]) for r in out if r["doc_id"] == 2] == [(2, "MIT")]
    assert licenses.scan(docs, {}).collect() == []


def _best_windows(text, percent=80):
    """By trying all windows: the best of each template, then the best that share no word with it, and so on."""
    words, out = re.sub("[^a-z0-9]+", " ", text.lower()).split(), []
    for name, template in licenses.TEMPLATES.items():
        t = re.sub("[^a-z0-9]+", " ", template.lower()).split()
        grams, found, taken = set(zip(t, t[1:], strict=False)), [], []
        for i in range(len(words)):
            own = set()
            for j in range(i + 1, len(words)):
                own.add((words[j - 1], words[j]))
                same = len(own & grams)
                if 200 * same >= percent * (len(own) + len(grams)):
                    found.append((-2 * same / (len(own) + len(grams)), j - i + 1, i))
        for loss, n, i in sorted(found):
            if all(i + n <= a or a + m <= i for a, m in taken):
                taken.append((i, n))
                out.append((i, n, name, round(-loss, 6)))
    return sorted(out)


def test_licence_passages_wrapped_and_embedded(spark):
    """Notices over several lines of a longer document, or within a line of prose, are found by passages."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(["the", "of", "in", "under", "license", "this", "a", f"w{rng.randrange(50)}"]) for _ in range(n))
    rows, named = [], []
    for name, template in licenses.TEMPLATES.items():
        wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(template, 40))
        mangled = " ".join(w for w in template.split() if rng.random() > 0.05)
        rows += [f"{prose(30)}\n{wrapped}\n{prose(30)}", f"{prose(20)} {template} {prose(20)}", f"{prose(9)}\n{mangled} {prose(9)} {wrapped} {template}"]
        named += [name] * 3
    rows += ["Released under the MIT License. " * 9, "x x x " * 30 + "released under the the the the " + "x " * 50 + "mit license", prose(200), "", None, "license"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["passages"]] for r in licenses.passages(docs).collect()}
    assert found == {i: _best_windows(x or "") for i, x in enumerate(rows)}
    for i, name in enumerate(named):
        assert name in {x[2] for x in found[i]}
    # lines and whole texts alone miss most of the wrapped ones
    lines = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert sum((i, name) not in lines for i, name in enumerate(named) if i % 3 == 0) >= 8
    assert len(found[36]) == 9
    assert all(r["passages"] == [] for r in licenses.passages(docs, {}).collect())
    own = licenses.passages(docs.selectExpr("doc_id", "text", "'mine' AS _words", "'old' AS passages", "'r' AS _row", "'f' AS _found"))
    assert {r["doc_id"]: [tuple(x) for x in r["passages"]] for r in own.collect()} == found
    assert {tuple(r) for r in own.select("_words", "_row", "_found").collect()} == {("mine", "r", "f")}


def test_passages_in_many_tasks(spark):
    """A passage of all documents, in any alignment, over more tasks than blocks."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"a{i}_{k}" for k in range(rng.randrange(1, 40))), *passage, f"z{i}"])) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
    found, _ = substring_dedup.dedup_passages(docs)
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()} == {i: 0 if i == 0 else 60 for i in range(64)}


#: Names that operators use for columns of their own.
OWN = "row doc tag text2 lines bits keeps kept h g hot last nth n pos x word _doc _tag _drops _lines _bits _kept _words _n _parts _part _sum _rank _one _offset before key first place number turn".split()


def crowded(spark, rows):
    """docs with columns of all these names."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in OWN))


def unharmed(out, rows):
    for r in out:
        name = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[c] == f"{c} of {name}" for c in OWN)


def test_lines_keep_other_columns_and_repeated_rows(spark):
    line = "a line that is long enough to count"
    rows = [(i, f"{line}\nown line {i}", "s") for i in range(5)] + [(None, f"x\n {line.upper()}\t", "s"), (2, f"{line}\nown line 2", "s"), (None, None, None), (9, "", "s")]
    out = [r.asDict() for r in line_dedup.dedup_lines(crowded(spark, rows)).collect()]
    unharmed(out, rows)
    assert sorted((str(r["doc_id"]), r["kept_text"], r["n_lines"], r["n_dropped"]) for r in out) == sorted(
        [*((str(i), f"own line {i}", 2, 1) for i in (0, 1, 2, 2, 3)), ("4", f"{line}\nown line 4", 2, 0), ("None", "x", 2, 1), ("None", "", 1, 0), ("9", "", 1, 0)]
    )
    again = line_dedup.dedup_lines(line_dedup.dedup_lines(crowded(spark, rows)))
    assert again.columns == [c for c in crowded(spark, rows).columns] + ["kept_text", "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(crowded(spark, rows).limit(0)).collect() == []


def test_rows_of_one_document_count_once(spark):
    line = "a line that is long enough to count"
    rows = [(1, line, "s"), (1, line + "\nmore", "s"), (1, line, "s"), (2, line, "s")]
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {0}


def test_hot_lines_over_many_tasks(spark, monkeypatch):
    """Lines that the sketch names, some in every document and some many times in one, and rarer ones that it doesn't."""
    monkeypatch.setattr(line_dedup, "TRACKED", 16)
    rng = random.Random(21)
    common = [f"common line number {i} of a good length" for i in range(3)]
    rare = [f"rarer line number {i} of a good length" for i in range(40)]
    rows = []
    for i in range(400):
        lines = [f"line {k} of document {i} alone, long enough" for k in range(rng.randrange(4))] + rng.sample(rare, 2) + common[: rng.randrange(4)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows.append((500, "\n".join(["one document's line that is there again"] * 500)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    hot = line_dedup.hot_hashes(line_dedup.stored(line_dedup.occurrences(docs.select(F.col("doc_id").alias("doc"), F.lit(0).alias("tag"), "text"), 20), "lines")).count()
    assert 2 <= hot < 16
    last, n = {}, {}
    for i, text in rows:
        for x in set(text.split("\n")):
            last[x], n[x] = max(last.get(x, -1), i), n.get(x, 0) + 1
    want = {i: "\n".join(x for x in text.split("\n") if len(x) < 20 or n[x] < 3 or last[x] == i) for i, text in rows}
    assert {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs).collect()} == want


def test_mixed_documents_keep_other_columns_and_repeated_rows(spark):
    rng = random.Random(22)
    text = lambda n: "  ".join(f"w{rng.randrange(99)}" for _ in range(n))
    rows = [(i, text(rng.randrange(1, 400)), "s" if i % 3 else "t") for i in range(40)] + [(None, text(30), "s"), (None, None, None), (50, "", "u")]
    rows += [rows[1], rows[1], rows[5], rows[40], (1, rows[1][1], "t")]
    out = [r.asDict() for r in mixing.mixed_documents(crowded(spark, rows)).collect()]
    unharmed(out, rows)
    words, got, passes = lambda x: (x or "").split(), {}, {}
    for r in out:
        key = r["doc_id"], r["source"]
        got[key] = got.get(key, 0) + len(words(r["text"]))
        passes[key] = passes.get(key, 0) + 1
    want = {}
    for r in mixing.taken(crowded(spark, rows)).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    sums = {}
    for (i, _), n in got.items():
        sums[i] = sums.get(i, 0) + n
    assert {i: n for i, n in want.items() if n} == sums
    for i, t, source in rows:  # a row's turns take its own words, no more often than three times
        for r in out:
            if (r["doc_id"], r["source"]) == (i, source):
                assert set(words(r["text"])) <= set(words(t))
        assert passes.get((i, source), 0) <= 3 * sum(x[0] == i and x[2] == source for x in rows)


@pytest.mark.parametrize("way", [packing.pack, packing.pack_in_rounds])
def test_packing_keeps_other_columns_and_repeated_rows(spark, way):
    rng = random.Random(23)
    rows = [(i, "x" * rng.choice([1, 3, 30, 33, 34, 50, 51, 60, 99, 100, rng.randint(1, 100)]), "s") for i in range(300)]
    rows += [rows[0], rows[0], (None, "yyy", "s"), (None, "yyy", "s")]
    docs = crowded(spark, rows).withColumn("length", F.length("text")).withColumn("offset", F.lit("gone"))
    out = [r.asDict() for r in way(docs.repartition(5), 100, ["doc_id"]).collect()]
    unharmed(out, rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted((str(i), t) for i, t, _ in rows)
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 100
    counts = {}
    for _, t, _ in rows:
        counts[len(t)] = counts.get(len(t), 0) + 1
    best = packing.plan(counts, 100)[1]
    assert len(places) == best if way is packing.pack else len(places) <= 1.05 * best + 1
    assert way(docs.limit(0), 100, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        way(docs, 20, ["doc_id"])


def test_the_training_sample_is_bounded_in_bytes(spark):
    """A text that is too long for the sample is left out of it; the others are learned from as before."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("fine", "good", "day", "tree")) for _ in range(30)) + (" vile." if i % 3 == 0 else "."), i % 3 == 0) for i in range(120)]
    labels = spark.createDataFrame([(i, int(t)) for i, _, t in rows] + [(999, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    long = docs.unionByName(spark.createDataFrame([(999, "vile " * 100_000)], docs.schema))
    a, b = toxicity.train(docs, labels), toxicity.train(long, labels, most=100_000)
    assert np.array_equal(a.hashes, b.hashes) and np.allclose(a.weights, b.weights, rtol=0.05)  # but for the classes' shares
    assert toxicity._within([(1, 0, 60), (2, 1, 50), (3, 0, 40), (4, 0, None)], 100) == [(1, 0), (3, 0), (4, 0)]


def test_rows_without_ids_spread_over_tasks(spark):
    """All ids null: texts are dealt by their hashes; pairs of a key's texts are as they were."""
    docs = spark.range(4000).selectExpr("cast(NULL AS long) AS doc_id", "concat('some words of text number ', id) AS text")
    with_edits = fingerprints.with_edits(docs)
    assert with_edits.count() == 4000
    dealt = docs.repartitionByRange(4, F.col("doc_id"), F.xxhash64("text"))
    assert dealt.groupBy(F.spark_partition_id()).count().count() == 4
