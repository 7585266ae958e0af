import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from axiomill.llm import ctph

from .helpers import docs, none, odd


def expect(texts):
    order = sorted(texts.items(), reverse=True)
    out = {}
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), ctph.fingerprint(t.encode()), ctph.fingerprint(edited.encode()))
    return out


@pytest.mark.parametrize("per_bucket", [20_000, 3])
def test_every_document_meets_the_next_one(spark, per_bucket):
    rng = random.Random(2)
    texts = {i * i - 40: "".join(rng.choices("abc deé😀\n", k=rng.choice([0, 1, 5, 300, 3000]))) for i in range(60)}
    texts[5] = None
    df = docs(spark, list(texts.values()), list(texts))
    got = {r.doc_id: tuple(r)[1:5] for r in ctph.fingerprint_documents(df, rows_per_bucket=per_bucket).collect()}
    assert got == expect(texts)


def test_slices_do_not_matter(monkeypatch):
    rng = random.Random(4)
    raw = bytes(rng.choices(range(97, 123), k=50_000))
    whole = ctph.fingerprint(raw)
    monkeypatch.setattr(ctph, "SLICE", 777)
    assert ctph.fingerprint(raw) == whole
    assert ctph.fingerprint(b"") == "3::"


def test_likeness(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    a, b = " ".join(word() for _ in range(900)), " ".join(word() for _ in range(900))
    near = a.replace(a[3000:3010], "!!", 1)
    marks = [ctph.fingerprint(x.encode()) for x in (a, b, near, "")]
    df = spark.createDataFrame([(x, y) for x in marks for y in marks], "a string, b string")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", ctph.likeness(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(got[x, x] == 1.0 for x in marks) and got[marks[0], marks[2]] > 0.9
    assert got[marks[0], marks[1]] < 0.2 and got[marks[0], marks[3]] == 0.0
    assert all(got[x, y] == got[y, x] and 0 <= got[x, y] <= 1 for x, y in got)


def test_odd_tables(spark):
    got = ctph.fingerprint_documents(odd(spark)).collect()
    assert len(got) == 12
    assert ctph.fingerprint_documents(none(spark)).collect() == []
    one = ctph.fingerprint_documents(docs(spark, ["alone here"])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aloneaalone"[:5] + b"alone").hexdigest()


def slow_fingerprint(raw):
    """Byte by byte, from the definition."""

    def ends(block):
        out = []
        for i in range(len(raw)):
            total = sum(raw[i - k] * 0x01000193**k for k in range(7) if i >= k) % 2**32
            if (total * 2654435761 % 2**32 >> 7) % block == block - 1:
                out.append(i)
        return out

    def signature(block, most):
        pieces, start = [], 0
        for i in ends(block)[: most - 1]:
            pieces.append(raw[start : i + 1])
            start = i + 1
        pieces += [raw[start:]] if start < len(raw) else []
        return "".join((string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/")[zlib.crc32(p) % 64] for p in pieces)

    first = 3
    while first * 64 < len(raw):
        first *= 2
    block = first
    while block > max(3, first // 8) and len(ends(block)) < 32:
        block //= 2
    return f"{block}:{signature(block, 64)}:{signature(2 * block, 32)}"


def slow_likeness(x, y):
    """Edit distance cell by cell at the block sizes that both have."""

    def alike(a, b):
        if a == b:
            return 1.0
        if not a or not b or (min(len(a), len(b)) >= 4 and not {a[i : i + 4] for i in range(len(a) - 3)} & {b[i : i + 4] for i in range(len(b) - 3)}):
            return 0.0
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            before, row = row, [i]
            for j, d in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return 1 - row[-1] / max(len(a), len(b))

    if x == y:
        return 1.0
    (n, *s), (m, *t) = x.split(":"), y.split(":")
    pairs = [(a, b) for i, a in enumerate(s) for j, b in enumerate(t) if int(n) << i == int(m) << j and (i + j < 2 or (a and b))]
    return max((alike(a, b) for a, b in pairs), default=0.0)


def test_fingerprints_and_likeness_are_those_of_the_definition(spark):
    rng = random.Random(9)
    raw = [b"", b"a", b"abc" * 2, bytes(300), bytes(rng.choices(range(256), k=190)), bytes(rng.choices(b"abcdef ", k=2500)), b"one line again\n" * 200]
    raw += [raw[5][:1200] + b"changed here" + raw[5][1215:], raw[5][:1300], raw[4] + b"tail", raw[5] + raw[4]]
    marks = [ctph.fingerprint(r) for r in raw]
    assert marks == [slow_fingerprint(r) for r in raw]
    df = spark.createDataFrame([(x, y) for x in marks for y in marks], "a string, b string")
    for r in df.select("a", "b", ctph.likeness(F.col("a"), F.col("b")).alias("s")).collect():
        assert abs(r.s - slow_likeness(r.a, r.b)) < 1e-12, (r.a, r.b)
