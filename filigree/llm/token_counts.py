"""Token counts without tokenizing: a byte-level BPE vocabulary compiled, as needed, into counting transducers.

Three machines stack up:

* a chunk map cuts a text into pieces that no pre-token crosses; what a piece of a long text contributes is
  (open left fragment, count inside, open right fragment). That is a map of states: whatever state a chunk is entered in
  ends with its left fragment, and the state it is left in is its right fragment. Maps compose associatively, so that the
  chunks of a long text are dealt to all tasks, and their maps put together by a parallel prefix scan: first those of each
  run of chunks, in as many tasks as there are runs, then the runs';
* the pre-tokenizer, a regular expression over character classes;
* for the bytes of a pre-token, a deterministic transducer. BPE has the property that the encoding of a prefix is the
  encoding of a shorter prefix plus one token, and that a sequence of tokens is an encoding if each neighbouring pair is.
  So a state needs the last token at the few previous positions which a longer token could still reach back to, and a
  transition by a byte finds the one token that ends there. Each transition is annotated with the tokens it emits (the
  change of the count, which may be negative). States and transitions are made when first met and kept by the worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm import _words
from filigree.llm._scratch import arrow_map, stored

#: White space in the pre-tokenizer's pattern (Unicode White_Space), and the pattern itself: fixed values.
WHITE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Entries that a worker keeps of each kind before it starts anew.
KEPT = 300_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of a pre-token byte by byte."""

    def __init__(self, vocab: dict[str, int], merges: list):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in vocab.items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.merges = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[raw(a)], self.ids[raw(b)]] = rank, self.ids[raw(a) + raw(b)]
        self.prefixes = {b[:i] for b in self.ids for i in range(1, len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        #: of each state: the reachable suffix, and at each of its positions the last token (-1: none) and the count less the current one
        self.states: list[tuple[bytes, tuple, tuple]] = [(b"", (-1,), (0,))]
        self.numbers = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def merged(self, tokens: list[int]) -> list[int]:
        while True:
            best = min(((r[0], i) for i in range(len(tokens) - 1) if (r := self.merges.get((tokens[i], tokens[i + 1])))), default=None)
            if best is None:
                return tokens
            i = best[1]
            tokens[i : i + 2] = [self.merges[tokens[i], tokens[i + 1]][1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens."""
        out = self.pairs.get((a, b))
        if out is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            out = self.merged([self.ids[bytes([x])] for x in self.bytes[a] + self.bytes[b]]) == [a, b]
            self.pairs[a, b] = out
        return out

    def step(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, counts = self.states[state]
        suffix += bytes([byte])
        for at in range(len(suffix)):  # the longest token first
            token = self.ids.get(suffix[at:])
            if token is not None and (last[at] < 0 or self.follows(last[at], token)) and (last[at] >= 0 or self.whole(token)):
                break
        else:
            raise ValueError("the vocabulary has no token for a byte")
        emitted = counts[at] + 1
        keep = next(i for i in range(len(suffix) + 1) if i == len(suffix) or suffix[i:] in self.prefixes)
        new = suffix[keep:], (*last, token)[keep:], tuple(c - emitted for c in (*counts, emitted)[keep:])
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        self.steps[state << 8 | byte] = number, emitted
        return number, emitted

    def whole(self, token: int) -> bool:
        """Whether the encoding of the token's bytes is the token."""
        out = self.alone.get(token)
        if out is None:
            out = self.alone[token] = self.merged([self.ids[bytes([x])] for x in self.bytes[token]]) == [token]
        return out

    def count(self, word: bytes) -> int:
        if len(self.steps) > KEPT:
            self.forget()
        state, total, steps = 0, 0, self.steps
        for byte in word:
            move = steps.get(state << 8 | byte) or self.step(state, byte)
            state, total = move[0], total + move[1]
        return total


class Known(dict):
    """Counts of pieces, made when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> int:
        out = self.make(piece)
        if len(piece) < 64:
            if len(self) > 2 * KEPT:
                self.clear()
            self[piece] = out
        return out


class Counter:
    """Counts tokens of texts as a byte-level BPE file gives them; special strings count as one token, as by default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.transducer = Transducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = re.compile("|".join(re.escape(x["content"]) for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"]))) or "(?!)")
        self.pattern = regex.compile(PATTERN)
        #: a space after another character than white space: no pre-token crosses its left side
        self.cut = re.compile(rf" (?<=[^{WHITE}] )")
        self.uneven = re.compile(rf"[{WHITE}] ")
        self.after = Known(self.spaced)  # of pieces that follow such a space

    def closed(self, text: str) -> int:
        """Of a text with nothing before or after it that could change its pre-tokens."""
        total, at = 0, 0
        for found in self.special.finditer(text):
            total += 1 + self.plain(text[at : found.start()])
            at = found.end()
        return total + self.plain(text[at:])

    def plain(self, text: str) -> int:
        return sum(self.transducer.count(x.encode()) for x in self.pattern.findall(text))

    def spaced(self, piece: str) -> int:
        if piece[-1:] in ".,;:!?" and piece[:-1].isalpha():
            return self.after[piece[:-1]] + 1  # the mark is a pre-token and a token of its own
        if piece.isalpha():
            return self.transducer.count(b" " + piece.encode())
        return self.closed(" " + piece)

    def pieces(self, text: str) -> int:
        first, *rest = self.cut.split(text) if self.uneven.search(text) or text[:1] == " " else text.split(" ")
        return self.closed(first) + sum(map(self.after.__getitem__, rest))

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """What a chunk of a text contributes: its left fragment, the count inside, its right fragment; None: no cut inside."""
        first = self.cut.search(text)
        if first is None:
            return text, None, ""
        at = first.start()
        last = at
        for x in self.cut.finditer(text, max(at, len(text) - 4096)):
            last = x.start()
        if last == at and len(text) - at > 4096:
            for x in self.cut.finditer(text, at):
                last = x.start()
        return text[:at], self.pieces(text[at:last]), text[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """Associative: the contribution of two neighbouring chunks together."""
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.pieces(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """The composition of all, in a tree of logarithmic depth."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def count(self, text: str, chunk: int = 1 << 16) -> int:
        if len(text) <= chunk:
            return self.pieces(text) if text else 0
        left, inner, right = self.scan([self.chunk(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self.pieces(left) if inner is None else self.pieces(left) + inner + self.pieces(right)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


#: Code points from which on a text is cut, in a chunk, and chunks whose maps are composed at once.
LONG, CHUNK, RUN = 1 << 18, 1 << 16, 64


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", key: str = "doc_id", long: int = LONG, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """`key`, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row; a null text is empty and has no tokens.

    tokenizer: the path of a byte-level BPE file, the same on all executors. Repeated rows and rows with a null key are
    counted each by itself; only key and text are read. One pass over the text: texts of up to `long` code points are
    counted where they are, and only longer ones are shuffled, by chunk.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_bytes", "n_tokens", "tag", "at", "part"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            _, bounds = _words.buffers(batch.column(1))
            sizes, short, n, cut = np.diff(bounds), [], [], []
            for i, x in enumerate(batch.column(1)):
                x = x.as_py() or ""
                if len(x) <= long:
                    short.append(i)
                    n.append(own.count(x))
                else:
                    cut.append((i, x))
            take = pa.array(short, pa.int64())
            m = len(short)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(sizes).take(take), pa.array(n, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string())], names=names)
            for i, x in cut:
                tag = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)
                for a in range(0, len(x), 16 * chunk):
                    parts = [x[b : b + chunk] for b in range(a, min(a + 16 * chunk, len(x)), chunk)]
                    m = len(parts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * m)), pa.array([int(sizes[i])] * m), pa.nulls(m, pa.int64()), pa.array([tag] * m), pa.array(np.arange(m) + a // chunk), pa.array(parts, pa.string())], names=names)

    maps = ["key", "n_bytes", "tag", "at", "copies", "closed", "left", "inside", "right"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk at a time: fragments may be long
                left, inside, right = own.chunk(batch.column(4)[i].as_py())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:4]), pa.array([1]), pa.array([False]), pa.array([left]), pa.array([inside], pa.int64()), pa.array([right])], names=maps)

    def composed(last: bool):
        def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Maps come sorted by text and place; repeated rows have each map several times."""
            own, current, head, held, places, copies = counter(tokenizer), None, None, [], [], 0

            def close() -> Iterator[pa.RecordBatch]:
                if current is None:
                    return
                left, inside, right = own.scan(held)
                if last:
                    inside = own.pieces(left) if inside is None else own.pieces(left) + inside + own.pieces(right)
                    left = right = ""
                yield pa.RecordBatch.from_arrays([*head, pa.array([places[0] // run]), pa.array([copies]), pa.array([last]), pa.array([left]), pa.array([inside], pa.int64()), pa.array([right])], names=maps)

            for batch in batches:
                for i in range(batch.num_rows):
                    group = tuple(batch.column(j)[i].as_py() for j in (0, 2)) + (() if last else (batch.column(3)[i].as_py() // run,))
                    if current != group:
                        yield from close()
                        current, head, held, places, copies = group, [batch.column(j).slice(i, 1) for j in (0, 1, 2)], [], [], 0
                    place, many = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                    if not places or places[-1] != place:
                        places.append(place)
                        held.append(tuple(batch.column(j)[i].as_py() for j in (6, 7, 8)))
                        copies = copies if len(places) > 1 else many
                    elif len(places) == 1:
                        copies += many
            yield from close()

        return compose

    counted = stored(arrow_map(docs.select(key, text), count, f"key {kind}, n_bytes long, n_tokens long, tag long, at long, part string"), "counts")
    schema = f"key {kind}, n_bytes long, tag long, at long, copies long, closed boolean, left string, inside long, right string"
    chunks = arrow_map(counted.filter("at IS NOT NULL").select("key", "n_bytes", "tag", "at", "part").repartition("key", "tag", "at"), mapped, schema)
    runs = arrow_map(chunks.repartition("key", "tag", F.floor(F.col("at") / run)).sortWithinPartitions("key", "tag", "at"), composed(False), schema)
    whole = arrow_map(runs.repartition("key", "tag").sortWithinPartitions("key", "tag", "at"), composed(True), schema)
    found = whole.select("key", "n_bytes", F.col("inside").alias("n_tokens"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_")).drop("_")
    out = counted.filter("at IS NULL").select("key", "n_bytes", "n_tokens").unionByName(found)
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
