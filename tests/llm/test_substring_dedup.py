import hashlib
import random

import numpy as np
import pytest

from axiomill.llm import substring_dedup as s

from .helpers import docs, none, odd


def brute(texts, length):
    seen, out = set(), {}
    for d, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def passages(seed, count):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    pool = [fresh(rng.choice([40, 90, 99, 100, 101, 150, 260])) for _ in range(12)] + ["=" * 130, "ab" * 120, "x" * 1500]
    return ["".join(rng.choice([fresh(rng.randrange(0, 150)), rng.choice(pool), rng.choice(pool)[3:-2]]) for _ in range(rng.randrange(0, 6))) for _ in range(count)]


@pytest.mark.parametrize("hot, held, slice_, bucket", [(2000, 60_000, 1 << 20, 8 << 20), (3, 60_000, 1 << 20, 8 << 20), (2000, 50, 700, 2000)])
def test_removed_bytes_are_those_of_comparing_all_strings(spark, monkeypatch, hot, held, slice_, bucket):
    monkeypatch.setattr(s, "HOT_LEAST", hot)
    monkeypatch.setattr(s, "BUCKET_BYTES", bucket)
    texts = dict(enumerate(passages(hot + held, 90)))
    df = docs(spark, list(texts.values()), list(texts)).repartition(3)
    got = {r.doc_id: tuple(r)[1:5] for r in s.deduplicate_substrings(df).collect()}
    want = brute(texts, 100)
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_pieces_of_a_text_have_the_triggers_of_the_whole(monkeypatch):
    texts = [t.encode() for t in passages(5, 30)]

    def strings():
        found = set()
        for who, offset, raw, starts in s._chunks(texts, 100):
            piece, at, lo, hi, h = s.triggers(raw, starts, 100, 32)
            for p, a, x, y in zip(piece.tolist(), at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                pos = a - int(starts[p]) + offset[p]
                found |= {(who[p], pos, k) for k in range(x, y + 1)}
        return found

    whole = strings()
    assert {(i, p - k) for i, p, k in whole} == {(i, x) for i, t in enumerate(texts) for x in range(len(t) - 99)}
    monkeypatch.setattr(s, "SLICE", 400)
    assert strings() == whole


def test_odd_tables(spark):
    got = s.deduplicate_substrings(odd(spark)).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    # a text of one sentence 4,000 times: its first 50 strings are new, all later ones repeat them
    assert by[5][0].n_bytes - by[5][0].n_removed == 50 and by[6][0].n_removed == 200_000
    assert by[8][0] == by[8][1] and by[None][0].n_removed == 0
    assert s.deduplicate_substrings(none(spark)).collect() == []


def test_the_dictionary_is_sorted_with_its_common_prefixes():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 2, (300, 9)).astype(np.uint8)
    number, common = s.dictionary(rows)
    words = sorted({r.tobytes() for r in rows})
    assert [words[i] for i in number] == [r.tobytes() for r in rows]
    prefix = lambda a, b: next((i for i in range(9) if a[i] != b[i]), 9)
    assert common.tolist() == [0, *(prefix(a, b) for a, b in zip(words, words[1:], strict=False))]


def test_settling_tells_all_but_the_first_of_equal_strings():
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(0, 40))) for _ in range(30)] + [b"abababababababab" * 3]
    length, gram = 12, 4
    kind = s.phrase_type(length, gram)
    raw, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    piece, at, lo, hi, h = s.triggers(raw, starts, length, gram)
    rows = np.zeros(len(piece), kind)
    rows["key"], rows["id"], rows["pos"] = h, piece, at - starts[piece]
    rows["mask"] = s._bits(lo, hi, length - gram + 1)
    near = at[:, None] + np.arange(gram - length, length)
    inside = (near >= starts[piece][:, None]) & (near < starts[piece + 1][:, None])
    rows["bytes"] = np.where(inside, raw[np.clip(near, 0, len(raw) - 1)], 0)
    removed, first = s.settle(rows, length, gram)
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            want |= {(i, k)} if t[k : k + length] in seen else set()
            seen.add(t[k : k + length])
    strings = lambda mask: {(int(rows["id"][r]), int(rows["pos"][r]) - k) for r, k in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True)}
    assert strings(removed) == want and len(strings(first)) == len(seen)


def test_windows_hold_the_bytes_around_a_place_within_its_text():
    rng = np.random.default_rng(3)
    raw = rng.integers(1, 255, 600).astype(np.uint8)
    bounds = np.array([0, 3, 200, 201, 520, 600])
    at = rng.integers(0, 600, 80)
    text = np.searchsorted(bounds, at, "right") - 1
    got = s._windows(raw, at, bounds[text], bounds[text + 1], 68, 100)
    for i, p in enumerate(at):
        assert got[i].tolist() == [int(raw[q]) if bounds[text[i]] <= q < bounds[text[i] + 1] else 0 for q in range(p - 68, p + 100)]
