"""Quality rules as a short-circuit cascade.

Each task measures each rule's cost and rejection rate on a sample of its own rows, spread over the first ones, and runs the
rules in the order of rejections per cost, each on the documents that all rules before it have let pass. A cost is what
a rule adds to what is measured already: measures that are returned anyway are free, and those that an earlier rule has
made as well. No pass over the table goes before, and a source whose texts differ gets an order of its own. The order changes
the time, never the verdict. Rules on letters, bullets, ellipses, long words and a word that takes over have measures of
their own, which are made only of the documents that are left when their turn comes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filigree.llm import _words
from filigree.llm._scratch import arrow_map
from filigree.llm._words import U, Words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPERCASE = np.zeros(256, bool)
UPPERCASE[65:91] = True
#: Bytes of letters, as far as that is told without a language: A-Z, a-z and all of other scripts.
LETTER = UPPERCASE.copy()
LETTER[97:123] = LETTER[128:] = True


class Texts:
    """Measures of some documents, each computed when first asked for."""

    def __init__(self, words: Words):
        self.words = words

    def __len__(self) -> int:
        return len(self.words.bounds) - 1

    def copy(self) -> Texts:
        """With the measures made so far; what is made from now on isn't shared."""
        out = Texts(self.words)
        out.__dict__.update(self.__dict__)
        return out

    def take(self, rows: np.ndarray) -> Texts:
        """Some of the documents, in this order, with the measures made so far; no word is looked for again."""
        if len(rows) == len(self):
            return self
        w = self.words
        sizes, counts = w.bounds[rows + 1] - w.bounds[rows], w.offsets[rows + 1] - w.offsets[rows]
        bounds, offsets = (np.concatenate(([0], np.cumsum(x))).astype(np.int64) for x in (sizes, counts))
        at = np.arange(offsets[-1]) + np.repeat(w.offsets[rows] - offsets[:-1], counts)
        shift = np.repeat(w.bounds[rows] - bounds[:-1], counts)
        data = np.concatenate([w.data[w.bounds[i] : w.bounds[i + 1]] for i in rows]) if len(rows) else w.data[:0]
        out = Texts(Words(data, bounds, w.starts[at] - shift, w.ends[at] - shift, offsets))
        for name, x in self.__dict__.items():
            if name == "word_hashes":
                out.word_hashes = x[at]
            elif name != "words":
                out.__dict__[name] = tuple(y[rows] for y in x) if isinstance(x, tuple) else x[rows]
        return out

    def by_document(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(sums[self.words.bounds])

    @cached_property
    def word_hashes(self) -> np.ndarray:
        """Of words, not of documents."""
        return self.words.hashes()

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.offsets).astype(np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        w = self.words
        sums = np.concatenate(([0], np.cumsum(_words.characters(w.data, w.starts, w.ends))))
        return np.diff(sums[w.offsets]).astype(np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.by_document(SYMBOL[self.words.data])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.by_document(UPPERCASE[self.words.data])

    def line_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where lines with a word start and end, and their documents."""
        w = self.words
        breaks = np.flatnonzero(w.data == 10)
        starts = np.union1d(breaks + 1, w.bounds[:-1])
        starts = starts[starts < len(w.data)]
        ends = np.append(breaks, len(w.data))[np.searchsorted(breaks, starts)]
        ends = np.minimum(ends, w.bounds[np.searchsorted(w.bounds, starts, "right")])
        full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        starts, ends = starts[full], ends[full]
        return starts, ends, np.searchsorted(w.bounds, starts, "right") - 1

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and distinct ones of these, of each document."""
        starts, ends, doc = self.line_spans()
        keys = _words.rolling(_words._table[self.words.data], _words.BYTE_BASE, starts, ends)
        _, first = np.unique(_words.mix(keys + doc.astype(U) * U(_words.WORD_BASE)), return_index=True)
        return np.bincount(doc, minlength=len(self)), np.bincount(doc[first], minlength=len(self))

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self._lines[0].astype(np.int64)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return (self._lines[0] - self._lines[1]).astype(np.int64)

    @cached_property
    def _marked_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines of each document whose first word begins with a bullet, and those whose last word ends in an ellipsis."""
        w = self.words
        starts, ends, doc = self.line_spans()
        at, last = w.starts[np.searchsorted(w.starts, starts)], w.ends[np.searchsorted(w.starts, ends) - 1]
        data = np.concatenate((np.zeros(3, np.uint8), w.data, np.zeros(3, np.uint8)))  # the three bytes around any place are there

        def reads(place: np.ndarray, mark: str) -> np.ndarray:
            found = np.ones(len(place), bool)
            for i, byte in enumerate(mark.encode()):
                found &= data[place + 3 + i] == byte
            return found

        bullet = reads(at, "-") | reads(at, "*") | (reads(at, "•") & (last >= at + 3))
        ellipsis = (reads(last - 3, "...") | reads(last - 3, "…")) & (last >= at + 3)
        return tuple(np.bincount(doc[x], minlength=len(self)).astype(np.int64) for x in (bullet, ellipsis))

    @cached_property
    def n_bullets(self) -> np.ndarray:
        return self._marked_lines[0]

    @cached_property
    def n_ellipses(self) -> np.ndarray:
        return self._marked_lines[1]

    def by_word(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's words."""
        return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[self.words.offsets])

    @cached_property
    def n_lettered(self) -> np.ndarray:
        """Words with a letter."""
        w = self.words
        sums = np.concatenate(([0], np.cumsum(LETTER[w.data], dtype=np.int64)))
        return self.by_word(sums[w.ends] > sums[w.starts])

    @cached_property
    def longest_word(self) -> np.ndarray:
        """Code points of the longest word."""
        w, out = self.words, np.zeros(len(self), np.int64)
        some = np.flatnonzero(np.diff(w.offsets))
        if len(some):
            out[some] = np.maximum.reduceat(_words.characters(w.data, w.starts, w.ends), w.offsets[some])
        return out

    @cached_property
    def n_top_word(self) -> np.ndarray:
        """How often the commonest word is there."""
        w, out = self.words, np.zeros(len(self), np.int64)
        doc = np.repeat(np.arange(len(self)), np.diff(w.offsets))
        _, first, counts = np.unique(_words.mix(self.word_hashes + doc.astype(U) * U(_words.WORD_BASE)), return_index=True, return_counts=True)
        np.maximum.at(out, doc[first], counts)
        return out

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        first, offsets = w.windows(w.starts, 5)
        if not len(first):
            return np.zeros(len(self), np.int64)
        keys = _words.rolling(self.word_hashes, _words.WORD_BASE, first, first + 5)
        keys = _words.mix(keys + np.repeat(np.arange(len(self), dtype=U), np.diff(offsets)) * U(_words.WORD_BASE))
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        step = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(step, first[twice], 1)
        np.add.at(step, first[twice] + 5, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
        return np.diff(covered[w.offsets]).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """rejects: of some texts, which go."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 12 * t.n_words)),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("shouting", lambda t: 2 * t.n_upper > t.word_chars),
    Rule("letters", lambda t: 2 * t.n_lettered < t.n_words),
    Rule("bullets", lambda t: 10 * t.n_bullets > 9 * t.n_lines),
    Rule("ellipses", lambda t: 10 * t.n_ellipses > 3 * t.n_lines),
    Rule("long_word", lambda t: t.longest_word > 500),
    Rule("one_word", lambda t: 2 * t.n_top_word > t.n_words),
)


def failed(t: Texts) -> np.ndarray:
    """The base rule: too few words, or too many in repeated windows."""
    return (t.n_words < 10) | (100 * t.n_repeat_words > 20 * t.n_words)


#: What is measured of every document before the rules, and the base rule: too few words, or too many in repeated windows.
BASE = Rule("base", failed)


def ordered(texts: Texts, rules: Sequence[Rule]) -> list[Rule]:
    """The rules by rejections per second, most first, as measured on texts (equal ones in the given order).

    Greedily: the next rule is the one that rejects most per second of what those before it let pass, its cost counted
    without measures that texts have, or that those before it have made.
    """
    left, out = list(rules), []
    while len(left) > 1 and len(texts):
        rates = []
        for rule in left:
            own = texts.copy()
            began = time.perf_counter()
            rejected = rule.rejects(own)
            rates.append((int(rejected.sum()) / max(time.perf_counter() - began, 1e-9), own, rejected))
        best = max(range(len(left)), key=lambda i: (rates[i][0], -i))
        if not rates[best][0]:
            break
        out.append(left.pop(best))
        _, texts, rejected = rates[best]
        texts = texts.take(np.flatnonzero(~rejected))
    return out + left


def sampled(texts: Texts, rows: int = 256) -> Texts:
    """At most so many of the texts, at even distances, with their measures."""
    return texts.take(np.unique(np.linspace(0, len(texts) - 1, min(rows, len(texts))).astype(np.int64))) if len(texts) else texts


def verdicts(texts: Texts, rules: Sequence[Rule], alive: np.ndarray) -> np.ndarray:
    """Which of the rows `alive` all rules let pass; each rule sees only what is left.

    A view of what is left costs a copy, so one is made when a fifth of the bytes have gone.
    """
    rows = np.flatnonzero(alive)
    left, at = texts, rows
    for rule in rules:
        if not len(rows):
            break
        sizes = np.diff(left.words.bounds)
        if sizes[at].sum() < 0.8 * sizes.sum():
            left, at = left.take(at), np.arange(len(at))
        keep = ~rule.rejects(left)[at]
        rows, at = rows[keep], at[keep]
    out = np.zeros(len(texts), bool)
    out[rows] = True
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id", sample: int = 256, order: bool = True) -> DataFrame:
    """`key`, the base measures, base_failed and kept for each row, in one pass without a shuffle.

    A null or empty text has no words, so it fails the base rule. kept: neither the base rule nor any other rejects. Repeated
    rows and rows with a null key are judged each by itself; only key and text are read, whatever else docs has. Each task
    puts the rules in order by `sample` rows of its first slice, unless order is False.
    """
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if order else list(rules)
        for batch in batches:
            for a, b, words in _words.each(batch.column(1)):
                t = Texts(words)
                measures = [pa.array(getattr(t, m)) for m in MEASURES]
                bad = failed(t)
                if own is None:  # what the base rule rejects doesn't come to the others
                    own = ordered(sampled(t.take(np.flatnonzero(~bad)), sample), rules)
                columns = [batch.column(0).slice(a, b - a), *measures, pa.array(bad), pa.array(verdicts(t, own, ~bad))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", *MEASURES, "base_failed", "kept"])

    schema = f"key {kind}, {', '.join(f'{m} long' for m in MEASURES)}, base_failed boolean, kept boolean"
    return arrow_map(docs.select(key, text), judge, schema).withColumnRenamed("key", key)


def passing(docs: DataFrame, rules: Sequence[Rule] = (BASE, *RULES), text: str = "text", sample: int = 256) -> DataFrame:
    """The rows of docs that all rules let pass, all columns as they are; no measure is made that no rule needs any more.

    Here the cascade is short-circuit throughout: the base rule is a rule as the others, and what one rejects costs nothing
    further. A null or empty text has no words.
    """
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for a, b, words in _words.each(batch.column(at)):
                t = Texts(words)
                own = ordered(sampled(t, sample), rules) if own is None else own
                yield batch.slice(a, b - a).filter(pa.array(verdicts(t, own, np.ones(b - a, bool))))

    return arrow_map(docs, keep, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
u AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM w),
g AS (SELECT r, i, x || ' ' || lead(x, 1) OVER v || ' ' || lead(x, 2) OVER v || ' ' || lead(x, 3) OVER v || ' ' || lead(x, 4) OVER v AS k FROM u WINDOW v AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g WHERE k IS NOT NULL) WHERE n > 1),
c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS j FROM t) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_lettered,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|\x{2022})'))) AS n_bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_ellipses,
         coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word, coalesce(list_max(map_values(list_histogram(w))), 0) AS n_top_word
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words) AND word_chars BETWEEN 2 * n_words AND 12 * n_words
       AND NOT (2 * n_dup_lines > n_lines) AND NOT (2 * n_upper > word_chars)
       AND NOT (2 * n_lettered < n_words) AND NOT (10 * n_bullets > 9 * n_lines) AND NOT (10 * n_ellipses > 3 * n_lines)
       AND NOT longest_word > 500 AND NOT (2 * n_top_word > n_words) AS kept
FROM b
"""
