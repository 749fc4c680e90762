"""Best-fit packing of token sequences after dominance reduction.

Tokens: each document's ids and a closing id are cut into pieces of at most ``capacity`` tokens. Lengths are small
integers, so the instance is the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus), and the
driver packs the histogram, not the pieces:

1. Reduction (Martello and Toth): a set with a piece that dominates every other feasible set with that piece is fixed and
   taken out. Used: a piece that fills a sequence or with which nothing fits; a pair that fills a sequence exactly; a
   piece with its largest partner where no two others fit beside it, or where at most two fit and none of these pairs is
   longer than that partner. All pieces of a length are handled at once.
2. Best fit decreasing for the rest, again with multiplicities: alike sequences are one group, and a step splits at most
   one group, so the number of groups is bounded by a few times the capacity.

The result is a table of slots (length, ranks from-to, first sequence, offset). A piece finds its slot by its rank among
the pieces of its length, which comes from counts by (length, salt) and the row number within such a cell. A length gets a
salt for each CELLS-th of all pieces that it has, so there are at most CELLS cells more than lengths, and no task holds much
more than a CELLS-th of the pieces.

Defined cases: null text is empty, so its one piece is the closing id; texts of any length are cut into as many pieces as
needed; repeated rows are packed each for itself; an empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, arrow_batches, map_rows, public_vocabulary, small, table, work_table
from .token_counts import SPACE, byte_alphabet, char_class

CAPACITY, CLOSING_ID = 2048, 0
#: a cell is a CELLS-th of all pieces, but not under MIN_CELL
CELLS, MIN_CELL = 20_000, 256
#: what a worker keeps between batches at most: so many bytes, and no word or run of more than MAX_RUN characters
MAX_KEPT, MAX_RUN = 128 << 20, 64
_CONTROL = re.compile(r"[\x1c-\x1f]").search


class WordIds:
    """Ids of a tokenizer that lower-cases, splits into words and merges within them, as little-endian unsigned 32-bit
    bytes. Words never span white space, so the ids of space-separated runs are kept, and below them those of words;
    texts for which that does not hold go to the library whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        letter, number = char_class("L"), char_class("N")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+").findall
        # the model alone, shared with the library's tokenizer: words in byte letters, one a line
        self.letters = {b: "\n" if b == 10 else c for c, b in byte_alphabet().items()}
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.kept = 0  # bytes, about: of keys, values and the objects around them
        self.long: list[tuple[dict[str, bytes], str]] = []

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, runs: set[str]) -> None:
        words, split = self.words, self.split
        parts: dict[str, list[str]] = {}
        new: set[str] = set()
        for r in runs:  # a word, a word with a mark, or whatever the pattern says
            core, last = (r[:-1], r[-1]) if r[-1] in ".," else (r, "")
            if core.isalpha():
                parts[r] = [core, last] if last else [core]
            else:
                parts[r] = split(r)
        new.update(*parts.values())
        new.difference_update(words)
        if new:
            order = list(new)
            bare = "\n".join(order).encode().decode("latin1").translate(self.letters)
            (found,) = self.bare.encode_batch_fast([bare], add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1  # every word ends in a token of its own kind
            if len(ends) != len(order):
                raise AssertionError("a word has no final token")
            raw, start = ids.tobytes(), 0
            for word, end in zip(order, (4 * ends).tolist(), strict=True):
                words[word] = raw[start:end]
                self._note(words, word, end - start)
                start = end
        known = self.runs
        for r, p in parts.items():
            known[r] = words[p[0]] if len(p) == 1 else words[p[0]] + words[p[1]] if len(p) == 2 else b"".join([words[w] for w in p])
            self._note(known, r, len(known[r]))

    def _note(self, kept: dict[str, bytes], key: str, size: int) -> None:
        if len(key) > MAX_RUN:
            self.long.append((kept, key))
        else:
            self.kept += 4 * len(key) + size + 200

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; ``texts`` together should be some megabytes at most."""
        if self.kept > MAX_KEPT:
            self._forget()
        split: list[list[str] | None] = []
        for text in texts:
            plain = text.isascii()
            x = text.lower() if plain else unicodedata.normalize("NFC", text).lower()
            # special strings stand for themselves; a final sigma and marks that combine anew depend on their neighbours;
            # four control characters are white space for str.split alone
            odd = "<|" in text or _CONTROL(text) or not plain and ("Σ" in text or not unicodedata.is_normalized("NFC", x))
            split.append(None if odd else x.split())
        if new := set().union(*(runs for runs in split if runs is not None)).difference(self.runs):
            self._learn(new)
        known = self.runs
        out = [self.whole(t) if runs is None else b"".join([known[r] for r in runs]) for t, runs in zip(texts, split, strict=True)]
        for kept, key in self.long:  # texts without spaces are one run: they are not seen again
            kept.pop(key, None)
        self.long.clear()
        return out

    def _forget(self) -> None:
        self.runs.clear()
        self.words.clear()
        self.kept = 0


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that what it learned serves all its tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with the closing id, cut at ``capacity``."""
    kind = dict(docs.dtypes)[key]

    def make():
        words, close = word_ids(public_vocabulary(vocabulary)), np.asarray([CLOSING_ID], "<u4").tobytes()

        def apply(rows: dict) -> dict:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, ids in zip(rows[key], words.encode([t or "" for t in rows["text"]]), strict=True):
                ids += close
                n = len(ids) // 4
                for i, start in enumerate(range(0, n, capacity)):
                    out["doc_id"].append(doc)
                    out["piece"].append(i)
                    out["start"].append(start)
                    out["length"].append(min(capacity, n - start))
                    out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + capacity)]))
            return out

        return apply

    return map_rows(docs.select(key, "text"), make, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", rows=500)


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """([(lengths of a sequence, times)], what remains): sets that dominate all alternatives, fixed for good."""
    left = {w: n for w, n in counts.items() if n}
    fixed = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for w in lengths:
            left[w] -= times
            if not left[w]:
                del left[w]

    for w in sorted(left, reverse=True):
        if w not in left:
            continue
        if w == capacity:
            fix((w,), left[w])
        elif w * 2 == capacity:
            if left[w] >= 2:
                fix((w, w), left[w] // 2)
        elif w * 2 > capacity and capacity - w in left:
            fix((w, capacity - w), min(left[w], left[capacity - w]))
    for w in sorted(left, reverse=True):
        while left.get(w):
            room = capacity - w
            others = sorted(x for x in left if x <= room and (x != w or left[w] > 1))
            times = {x: left[x] - (x == w) for x in others}
            if not others:
                fix((w,), left[w])
                continue
            least = [x for x in others[:3] for _ in range(min(3, times[x]))][:3]
            largest = others[-1]
            if len(least) > 1 and least[0] + least[1] <= room:
                if len(least) > 2 and sum(least) <= room or _best_pair(others, times, room) > largest:
                    break  # no set is known to dominate; shorter pieces leave more room, but may still be fixed
            n = left[w] // 2 if largest == w else min(left[w], left[largest])
            fix((w, largest), n)
    return fixed, left


def _best_pair(others: list[int], times: dict[int, int], room: int) -> int:
    best, i, j = 0, 0, len(others) - 1
    while i <= j:
        total = others[i] + others[j]
        if total > room or (i == j and times[others[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times in a sequence), ...), sequences)] of best fit decreasing over a histogram."""
    by_room: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []  # sorted; those with groups

    def put(content: tuple, times: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((content, times))

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            at = bisect.bisect_left(rooms, w)
            if at == len(rooms):
                content, times, room = (), -(-n // (capacity // w)), capacity
            else:
                room = rooms[at]
                content, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            each = room // w
            full = min(times, n // each)
            if full:
                put((*content, (w, each)), full, room - each * w)
            n, times = n - full * each, times - full
            if n and times:
                put((*content, (w, n)), 1, room - n * w)
                n, times = 0, times - 1
            if times and content:
                put(content, times, room)
    return [group for groups in by_room.values() for group in groups]


def solve(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(slots, sequences): a slot is (length, first rank, end rank, pieces of it in a sequence, first sequence, offset)."""
    fixed, left = reduce_instance(counts, capacity)
    groups = [(_runs(lengths), times) for lengths, times in fixed] + best_fit(left, capacity)
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for content, times in groups:
        offset = 0
        for w, each in content:
            slots.append((w, used[w], used[w] + each * times, each, sequence, offset))
            used[w] += each * times
            offset += w * each
        sequence += times
    if used != {w: counts[w] for w in used}:
        raise AssertionError("packing lost or repeated pieces")
    return slots, sequence


def _runs(lengths: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    return tuple((w, lengths.count(w)) for w in sorted(set(lengths), reverse=True))


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = work_table(pieces(docs, vocabulary, capacity, key), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count("*")).collect()}  # capacity rows at most
    cell = max(MIN_CELL, -(-sum(counts.values()) // CELLS))
    salts = F.element_at(F.array(*[F.lit(max(1, -(-counts.get(w, 0) // cell))) for w in range(1, capacity + 1)]), F.col("length").cast("int"))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts).cast("int"))
    cells = work_table(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "cells")
    slots, _ = solve(counts, capacity)
    in_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = small(work_table(cells.select("length", "salt", F.coalesce(F.sum("n").over(in_length), F.lit(0)).alias("before")), "before"))
    in_cell = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("row", F.row_number().over(in_cell) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row")).alias("rank"))
    return _place(spark, ranked, slots)


def _place(spark: SparkSession, ranked: DataFrame, slots: list[tuple]) -> DataFrame:
    by_length: dict[int, np.ndarray] = {}
    table_ = np.asarray(sorted(slots), np.int64).reshape(-1, 6)
    for w in np.unique(table_[:, 0]):
        by_length[int(w)] = table_[table_[:, 0] == w]
    doc = dict(ranked.dtypes)["doc_id"]
    schema = f"doc_id {doc}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    out_schema = _arrow_schema(spark, schema)
    arrow_batches(spark)

    def run(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for w in np.unique(length):
                at, s = length == w, by_length[int(w)]
                slot = s[np.searchsorted(s[:, 1], rank[at], side="right") - 1]
                nth = rank[at] - slot[:, 1]
                sequence[at] = slot[:, 4] + nth // slot[:, 3]
                offset[at] = slot[:, 5] + nth % slot[:, 3] * w
            kept = [b.column(b.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=out_schema)

    return ranked.mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
