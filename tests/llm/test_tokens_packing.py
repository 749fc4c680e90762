"""Operators 3 and 6 against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabloom.llm import packing, token_counts
from tabloom.llm.common import public_vocabulary

LETTERS = [*"ab'sdltrevm  \n\t é漢字١2!?.-_<|>ΣσİK", " ", "　", "\x1c", "\x85", "🙂", "é", "<|endoftext|>", "'ll", "'re", " the", "ing"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_bpe():
    return token_counts.Counter(public_vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk", [1, 2, 5, 17, 1 << 16])
def test_counts_equal_the_library_for_any_chunks(byte_bpe, chunk):
    counter, library = byte_bpe
    counter.chunk = chunk
    cases = texts(3000, chunk)
    assert [counter.count(t) for t in cases] == [len(e.ids) for e in library.encode_batch(cases, add_special_tokens=False)]


def long_texts():
    r = random.Random(7)
    letters = [chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(300)]
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return {
        1: "".join(r.choice(letters) for _ in range(300_000)), 2: "".join(r.choice([*letters, *"。，"]) for _ in range(300_000)), 3: "".join(r.choice(base64) for _ in range(400_000)),
        4: " ".join(r.choice(["word", "token", "don't", "1234", "<|endoftext|>", "x"]) for _ in range(200_000)), 5: "a" * 280_000, 6: " " * 270_000 + "x", 7: "".join(r.choice(LETTERS) for _ in range(300_000)),
    }


def test_long_texts_are_composed_from_parts(spark, documents, byte_bpe):
    _, library = byte_bpe
    cases = [*long_texts().items(), (4, long_texts()[4]), (None, long_texts()[2]), (9, "short"), (9, None)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(documents(cases)).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in cases]
    assert got == sorted(want, key=str)


def test_most_counts_of_chunked_texts_come_from_their_chunks(byte_bpe):
    """What is left to composition is a word or two for each chunk."""
    counter, _ = byte_bpe
    counter.chunk = 4096
    prose = "The quick brown fox, they say, jumps over 13 lazy dogs. " * 500
    maps = [counter.chunk_map(prose[i : i + 4096]) for i in range(0, len(prose), 4096)]
    assert all(n is not None and len(h) < 10 and len(t) < 10 for h, n, t in maps)
    assert counter.count(prose) == sum(n for _, n, _ in maps) + sum(counter.direct(a[2] + b[0]) for a, b in zip(maps, maps[1:])) + counter.direct(maps[0][0]) + counter.direct(maps[-1][2])


def test_what_workers_keep_is_bounded_in_bytes(byte_bpe, monkeypatch):
    counter, _ = byte_bpe
    cjk = long_texts()[1]
    for i in range(20):
        counter.count(cjk[i * 12_000 : (i + 1) * 12_000])
    assert all(len(k) <= 64 for kept in (counter.macros, counter.runs) for k in kept)
    ids = packing.WordIds(public_vocabulary("word_bpe_49k.json"))
    whole = [cjk[i * 12_000 : (i + 1) * 12_000] + " and words" for i in range(20)]
    want = [ids.whole(t) for t in whole]
    assert ids.encode(whole) == want and all(len(k) <= 64 for kept in (ids.runs, ids.words) for k in kept) and ids.kept < 10_000
    monkeypatch.setattr(packing, "MAX_KEPT", 100)
    assert ids.encode(["some other words"]) == [ids.whole("some other words")] and ids.encode(["more"]) == [ids.whole("more")] and len(ids.words) == 1


def test_full_state_table_changes_nothing(byte_bpe, monkeypatch):
    _, library = byte_bpe
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_MACROS", 5)
    small = token_counts.Counter(public_vocabulary("byte_bpe_50k.json"))
    cases = texts(500, 3) + ["supercalifragilistic expialidocious antidisestablishmentarianism " * 3]
    assert [small.count(t) for t in cases] == [len(e.ids) for e in library.encode_batch(cases, add_special_tokens=False)]


def test_composition_is_associative(byte_bpe):
    counter, _ = byte_bpe
    counter.chunk = 1 << 16
    r = random.Random(5)
    for t in texts(300, 9):
        cuts = sorted(r.randint(0, len(t)) for _ in range(3))
        a, b, c, d = (counter.chunk_map(t[i:j]) for i, j in zip([0, *cuts], [*cuts, len(t)], strict=True))
        left = counter.compose(counter.compose(counter.compose(a, b), c), d)
        right = counter.compose(a, counter.compose(b, counter.compose(c, d)))
        assert left == right


def test_token_counts_of_odd_rows(spark, documents, odd, byte_bpe):
    _, library = byte_bpe
    got = sorted(map(tuple, token_counts.count_tokens(documents(odd)).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in odd]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(documents([])).count() == 0


def test_word_ids_equal_the_library():
    ids = packing.WordIds(public_vocabulary("word_bpe_49k.json"))
    cases = texts(5000, 4) + ["Ein Satz, der. endet's", "ΟΔΟΣ ΟΔΟΣ."]
    want = [e.ids for e in ids.library.encode_batch(cases, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(cases)] == want
    ids.encode(["new words only zzyzx"])
    assert np.frombuffer(ids.encode([cases[-1]])[0], "<u4").tolist() == want[-1]


def optimal(lengths, capacity):
    """The fewest sequences, by search."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        seen = set()
        for k, room in enumerate(bins):
            if room >= lengths[i] and room not in seen:
                seen.add(room)
                bins[k] -= lengths[i]
                go(i + 1, bins)
                bins[k] += lengths[i]
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    r = random.Random(1)
    for _ in range(250):
        capacity = r.choice([8, 10, 13, 20])
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 9))), reverse=True)
        counts = {w: lengths.count(w) for w in lengths}
        fixed, left = packing.reduce_instance(counts, capacity)
        assert all(sum(s) <= capacity for s, _ in fixed)
        rest = sorted((w for w, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + optimal(rest, capacity) == optimal(lengths, capacity)


def test_packing_is_whole_gapless_and_tight(spark, documents, odd, monkeypatch):
    r = random.Random(2)
    cases = [*odd, *[(100 + i, "word " * r.choice([1, 3, 50, 200, 511, 700, 1023, 1024, 1500])) for i in range(150)]]
    got = packing.pack(documents(cases)).collect()
    library = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    want = []
    for i, t in cases:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((i, k, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted(((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got), key=str) == sorted(want, key=str)
    sequences = {}
    for g in got:
        sequences.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(w[3] for w in want) // 2048)
    assert len(sequences) <= least * 1.1 + 1
    monkeypatch.setattr(packing, "MIN_CELL", 2)
    monkeypatch.setattr(packing, "CELLS", 10)
    salted = packing.pack(documents(cases)).collect()
    assert len({(g.sequence_id, g.offset) for g in salted}) == len(got) and len({g.sequence_id for g in salted}) == len(sequences)
    assert packing.pack(documents([])).count() == 0
