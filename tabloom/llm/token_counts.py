"""Token counts by a compiled finite-state transducer for byte-level BPE.

Compilation. Over the bytes of one pre-token, a deterministic transducer gives after each byte the number of tokens of the
prefix read so far; every transition is annotated with the change of that number, so the sum along the path is the count.
A prefix of a BPE encoding has a unique last token, and a token may follow another only if BPE keeps the two apart when it
encodes their joint bytes. A state is the live suffix (the longest that is a prefix of some token) with the last token and
relative count at each of its cut points: finitely many, made when first reached, and kept as integers with a transition
table; once the table is full, rarer states are passed through without being kept. A whole pre-token, after which the state is the start state again, is one macro transition, also kept.

Chunks. Text is cut into chunks of CHUNK characters, and each chunk's state map is computed on its own: between a character
that is not white space and white space, and between a letter or digit and a character of another kind, the splitter always is in its start state, whatever came before. So a map is (head, count, tail): the text before the first such point
and after the last depend on the neighbours, and between them the count is constant. A chunk without such a point is all
head. Composition joins one map's tail with the next one's head; it is associative, so maps are combined in a balanced
scan. A text of more than PART characters is a row for each of its parts, whose maps are computed by different tasks and
composed by document; what meets there is a few words for each part, and the text of runs that are one word for megabytes.

Special strings of the vocabulary file count as one token each where they occur, as the library does by default.

Defined cases: null counts as empty (0 bytes, 0 tokens); very long texts are many chunks; repeated rows give repeated
results; an empty table gives an empty result; extra columns of the documents stay out.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, map_rows, public_vocabulary, table

LIMIT = 1024
CHUNK, PART = 4096, 1 << 18
#: bounds of what a worker keeps (no macro of more than MAX_RUN characters); beyond them results are computed again, never changed
MAX_STATES, MAX_MACROS, MAX_PAIRS, MAX_RUN = 100_000, 200_000, 500_000, 64
#: white space of the split pattern (the Unicode property, unlike \\s of Python's re)
ODD_SPACE = r"\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"\n {ODD_SPACE}"


@lru_cache(4)
def char_class(kind: str) -> str:
    """The characters of a general category as the inside of a bracket expression for re."""
    out, start = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == kind
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


def split_pattern() -> str:
    letter, number = char_class("L"), char_class("N")
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """Counts the tokens of byte strings; transitions are made when first taken."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {raw(t): i for i, t in enumerate(vocab, 1)}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.apart: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((b"", 0),))
        self.ids, self.states, self.steps = {start: 0}, [start], [{}]

    def merge(self, text: bytes) -> list[bytes]:
        """Plain BPE of a few bytes: what the transitions are derived from."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, last: bytes, token: bytes) -> bool:
        key = (self.tokens[last] << 32 if last else 0) | self.tokens[token]
        found = self.apart.get(key)
        if found is None:
            found = self.apart[key] = self.merge(last + token) == ([last, token] if last else [token])
        return found

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        suffix, cuts = self.states[state]  # cuts[k]: last token and relative count k bytes before the end
        grown = suffix + bytes((byte,))
        for n in range(len(grown), 0, -1):
            token = grown[-n:]
            if token in self.tokens and self._fits(cuts[n - 1][0], token):
                delta = cuts[n - 1][1] + 1
                break
        else:
            raise ValueError(f"the vocabulary has no token that ends in byte {byte}")
        live = len(grown)
        while live and grown[-live:] not in self.prefixes:
            live -= 1
        grown = grown[len(grown) - live :]
        # a cut point counts only while a token that starts there can still be read
        new = (grown, ((token, 0), *[(cut[0], cut[1] - delta) if cut and grown[live - k :] in self.prefixes else None for k, cut in enumerate(cuts[:live], 1)]))
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
            self.steps.append({})
        self.steps[state][byte] = (to, delta)
        return to, delta

    def count(self, text: bytes) -> int:
        """Tokens of one pre-token: the annotations along its path."""
        steps, state, total = self.steps, 0, 0
        for i, byte in enumerate(text):
            step = steps[state].get(byte)
            if step is None:
                if len(self.states) >= MAX_STATES:
                    return total + self._rest(state, text, i)
                step = self._step(state, byte)
            state, delta = step
            total += delta
        return total

    def _rest(self, state: int, text: bytes, i: int) -> int:
        """The annotations from byte ``i`` on, without keeping the states that are passed: the table is full."""
        if len(self.apart) > MAX_PAIRS:
            self.apart.clear()
        suffix, cuts = self.states[state]
        first = begin = i - len(suffix)
        cuts, tokens, prefixes, apart = [*reversed(cuts)], self.tokens, self.prefixes, self.apart
        for end in range(i + 1, len(text) + 1):
            while text[begin:end] not in prefixes:
                begin += 1
            for j in range(begin, end):
                token = text[j:end]
                if n := tokens.get(token):
                    last, count = cuts[j - first]
                    fits = apart.get((tokens[last] << 32 if last else 0) | n)
                    if fits is None:
                        fits = self._fits(last, token)
                    if fits:
                        cuts.append((token, count + 1))
                        break
            else:
                raise ValueError(f"the vocabulary has no token that ends in byte {text[end - 1]}")
        return cuts[-1][1]


class Macros(dict):
    """text -> tokens; kept transitions from the start state to itself."""

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, text: str) -> int:
        n = self.count(text)
        if len(text) <= MAX_RUN:
            if len(self) >= MAX_MACROS:
                self.clear()
            self[text] = n
        return n


class Counter:
    """Counts tokens of texts, by chunk maps."""

    def __init__(self, path: str, chunk: int = CHUNK) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.transducer = Transducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.macros = Macros(lambda word: self.transducer.count(word.encode()))
        self.runs = Macros(self._run)
        self.odd = re.compile(rf"[{ODD_SPACE}]").search
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = re.compile(split_pattern()).findall
        letter, number = char_class("L"), char_class("N")
        # letters may belong to an apostrophe before them, so points lie after letters and digits; none within a special string
        within = {t[i : i + 2] for t in special for i in range(len(t) - 1)}
        no = "".join(rf"(?!(?<={re.escape(a)}){re.escape(b)})" for a, b in sorted(within))
        self.sync = re.compile(rf"(?:(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{letter}])(?=[^{letter}])|(?<=[{number}])(?=[^{number}])){no}")
        self.chunk = chunk

    def direct(self, text: str) -> int:
        """Tokens of a text that starts and ends in the start state."""
        if self.special is not None and (parts := self.special.split(text))[1:]:
            return len(parts) - 1 + sum(map(self.direct_plain, parts))
        return self.direct_plain(text)

    def direct_plain(self, text: str) -> int:
        if "  " in text or "\n " in text or self.odd(text):
            return self.by_words(text)
        first, *runs = text.split(" ")  # every space follows a character that is none: a point of known state
        return self.by_words(first) + sum(map(self.runs.__getitem__, runs))

    def _run(self, run: str) -> int:
        """Tokens of a space and what follows it up to the next one."""
        if run.isalpha():
            return self.transducer.count(b" " + run.encode())
        if run[-1:] in (".", ",") and run[:-1].isalpha():
            return self.macros[" " + run[:-1]] + self.macros[run[-1]]
        return self.by_words(" " + run)

    def by_words(self, text: str) -> int:
        return sum(map(self.macros.__getitem__, self.split(text)))

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, count, tail); count is None if the chunk has no point where the state is known."""
        first = self.sync.search(chunk)
        if first is None:
            return chunk, None, ""
        start, end = first.start(), len(chunk) - 1
        while not self.sync.match(chunk, end):
            end -= 1
        return chunk[:start], self.direct(chunk[start:end]), chunk[end:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            return self.chunk_map(a[0] + b[0])
        if a[1] is None:
            head, n, rest = self.chunk_map(a[0] + b[0])
            return (head, b[1], b[2]) if n is None else (head, n + self.direct(rest) + b[1], b[2])
        if b[1] is None:
            head, n, rest = self.chunk_map(a[2] + b[0])
            return (a[0], a[1], head) if n is None else (a[0], a[1] + self.direct(head) + n, rest)
        return a[0], a[1] + self.direct(a[2] + b[0]) + b[1], b[2]

    def text_map(self, text: str) -> tuple[str, int | None, str]:
        """The map of a text of any length, by a balanced scan of its chunks' maps."""
        return self.scan([self.chunk_map(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)] or [("", None, "")])

    def scan(self, maps: list[tuple[str, int | None, str]]) -> tuple[str, int | None, str]:
        """Neighbours are composed until one map is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, whole: tuple[str, int | None, str]) -> int:
        """Tokens of a text whose map is ``whole``: it starts and ends in the start state."""
        head, n, tail = whole
        return self.direct(head) if n is None else self.direct(head) + n + self.direct(tail)

    def count(self, text: str) -> int:
        return self.direct(text) if len(text) <= self.chunk else self.total(self.text_map(text))


@lru_cache(1)
def counter(path: str) -> Counter:
    """One for each worker process, so that its transitions serve all its tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs; ``vocabulary`` names a byte-level BPE file."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > PART, F.lit(False))

    def make():
        count = counter(public_vocabulary(vocabulary)).count

        def apply(rows: dict) -> dict:
            texts = [t or "" for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [count(t) for t in texts]}

        return apply

    short = map_rows(rows.where(~is_long), make, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    out = short.unionByName(_long_counts(rows.where(is_long), vocabulary, kind))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _long_counts(rows: DataFrame, vocabulary: str, kind: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): the parts of a text are rows, dealt out to all tasks; their maps are composed by document.
    Rows that are equal in id and text are counted once and repeated."""
    spark = rows.sparkSession
    arrow_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.select("doc_id", F.md5("text").alias("key"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.monotonically_increasing_id().alias("row"), "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PART).cast("int"))).alias("part"))
    parts = parts.select("doc_id", "key", "n_bytes", "row", "part", F.expr(f"substring(text, part * {PART} + 1, {PART})").alias("text"))
    each = parts.groupBy("doc_id", "key", "n_bytes", "part").agg(F.min("text").alias("text"), F.count("*").alias("times")).repartition(partitions, "key", "part")

    def make():
        text_map = counter(public_vocabulary(vocabulary)).text_map

        def apply(rows: dict) -> dict:
            maps = [text_map(t) for t in rows["text"]]
            return {k: rows[k] for k in ("doc_id", "key", "n_bytes", "part", "times")} | {"head": [m[0] for m in maps], "n": [m[1] for m in maps], "tail": [m[2] for m in maps]}

        return apply

    maps = map_rows(each, make, f"doc_id {kind}, key string, n_bytes bigint, part int, times bigint, head string, n bigint, tail string", rows=50)

    def compose(frame):
        import pandas as pd

        counting = counter(public_vocabulary(vocabulary))
        frame = frame.sort_values("part")
        whole = counting.scan([(h, None if pd.isna(n) else int(n), t) for h, n, t in zip(frame["head"], frame["n"], frame["tail"], strict=True)])
        first = frame.iloc[:1]
        return first[["doc_id", "n_bytes", "times"]].assign(n_tokens=counting.total(whole))

    found = maps.groupBy("doc_id", "key").applyInPandas(compose, f"doc_id {kind}, n_bytes bigint, times bigint, n_tokens bigint")
    return found.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
