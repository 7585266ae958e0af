"""Repeated substrings of a fixed length, removed by prefix-free parsing and suffix order, exactly and at any size.

Parsing. A rolling hash over GRAM bytes runs through every text; in each string of LENGTH bytes the place of the smallest hash
is a trigger. So every such string holds one, equal strings hold it at the same offset, and no phrase between triggers is longer than
LENGTH. A trigger cuts what surrounds it into the phrase before it and the phrase from it on, each as far as strings of LENGTH bytes
reach. Triggers whose gram occurs once in the corpus can't be in a repeat; a first pass finds the others.

Suffix order. The occurrences that share triggers meet in one task. The distinct phrases from the trigger on form a dictionary, sorted, with the
longest common prefixes of neighbours; so do the distinct phrases before it, read backwards. The parse is the pair of phrases of each
occurrence in corpus order. Dictionary order and parse together order the strings: two strings of LENGTH bytes are equal if and only if
their halves fall in the same interval of each dictionary. For each offset the first occurrence in corpus order stays. As no string is longer than
LENGTH, orders are needed to that depth alone and never over the whole corpus at once.

Strings that repeat within one task are settled there before anything is sent, so a passage that very many documents
share is sent once per task. A gram that very many documents hold in different surroundings (a line shorter than LENGTH) would still
bring all of them to one task. Such grams are told to all tasks (8 bytes each; see HOT_MOST), and each of the strings through
them is sent by its own hash instead. Data moves as packed binary columns: a few rows per task and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, arrow_batches, staged, unstaged

LENGTH = 100
GRAM = 32
SLICE = 1 << 20
#: Text bytes per bucket of triggers and of documents.
BUCKET_BYTES = 2 << 20
#: Rows that a Python worker gets at once; packed ones have tens of KB each, and a whole partition of them would fill a batch.
RECORDS = 128
#: Phrases that a task holds before it settles and sends them, and that it cuts out or hashes at once.
HELD, BLOCK = 60_000, 8192
#: A gram is hot from HOT_LEAST occurrences on, or 1 of HOT_GRAMS bytes if that is more, but from HOT_MOST at any size. So a task
#: gets less than HOT_MOST occurrences of a gram, and hot grams are at most HOT_GRAMS up to 130 GB and one for HOT_MOST triggers beyond.
HOT_LEAST, HOT_GRAMS, HOT_MOST = 2000, 1_000_000, 1 << 17
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
FLAG = np.dtype([("id", "<i8"), ("hash", "<i8"), ("ord", "<u4")])
SPAN = np.dtype([("id", "<i8"), ("hash", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
GRAM_AT = np.dtype([("key", "<u8"), ("id", "<i8"), ("hash", "<i8"), ("ord", "<u4"), ("count", "<u4")])
STRING = np.dtype([("key", "<u8"), ("check", "<u8"), ("id", "<i8"), ("hash", "<i8"), ("lo", "<u4")])


def phrase_type(length: int, gram: int) -> np.dtype:
    left = length - gram
    return np.dtype([("key", "<u8"), ("id", "<i8"), ("hash", "<i8"), ("pos", "<u4"), ("mask", "u1", (left + 8) // 8), ("bytes", "u1", left + length)])


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram of `gram` bytes (a power of two), by doubling."""
    h, size, mult = _TABLE[raw], 1, _BASE
    while size < gram:
        h = h[:-size] * np.uint64(pow(mult, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def triggers(raw: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, position in raw, least and greatest offset in a string, hash) of the triggers of texts laid end to end.

    starts has the beginning of each text and the end. Offsets: strings start so many bytes before the trigger.
    """
    reach = length - gram + 1
    if len(raw) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    h = gram_hashes(raw, gram)
    low = np.uint64((1 << 20) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: -(reach - size)], least[reach - size :])
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    s = np.flatnonzero(text[: len(raw) - length + 1] == text[length - 1 :])
    at = (least[s] & low).astype(np.int64)
    if not len(s):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(text[s]) != 0)]))
    end = np.concatenate([new[1:], [len(s)]]) - 1
    pos = at[new]
    return text[s[new]], pos, pos - s[end], pos - s[new], h[pos]


def _chunks(texts: list[tuple], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """(index of text, offset of the piece in it, bytes, starts) of about SLICE bytes; pieces of one text overlap by length - 1."""
    who, offset, parts, size = [], [], [], 0

    def done():
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return who, offset, np.frombuffer(b"".join(parts), np.uint8), starts

    for i, raw in enumerate(texts):
        for lo in range(0, max(1, len(raw) - length + 1), SLICE - length):
            piece = raw[lo : lo + SLICE - 1]
            if size + len(piece) > SLICE and parts:
                yield done()
                who, offset, parts, size = [], [], [], 0
            who.append(i)
            offset.append(lo)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield done()


def _bits(lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Packed masks of the offsets lo to hi."""
    k = np.arange(width)
    return np.packbits((k >= lo[:, None]) & (k <= hi[:, None]), axis=1, bitorder="little")


def dictionary(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of byte rows (phrases): the number of each in the sorted dictionary of the distinct ones, and for each of these the
    common prefix with the one before it."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    order = np.lexsort(padded.view(">u8").astype(np.uint64).T[::-1])
    common = np.zeros(n, np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    new = common < width
    new[0] = True
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    return number, common[new]


def settle(phrases: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase and offset: removed (an equal string stands earlier among these), and first (mask of the rest)."""
    n, left = len(phrases), length - gram
    live = np.unpackbits(phrases["mask"], axis=1, bitorder="little", count=left + 1).astype(bool)
    removed = np.zeros_like(live)
    if n < 2:
        return removed, live
    place = np.lexsort((phrases["pos"], phrases["hash"], phrases["id"]))
    step = np.concatenate([[False], (np.diff(phrases["pos"][place].astype(np.int64)) != 0) | (np.diff(phrases["hash"][place]) != 0) | (np.diff(phrases["id"][place]) != 0)])
    turn = np.cumsum(step)  # one number per place in the corpus, so a repeated row is not earlier than itself
    rows, live, removed = phrases["bytes"][place], live[place], removed[place]
    after, after_common = dictionary(rows[:, left:])
    before, before_common = dictionary(rows[:, :left][:, ::-1])
    for k in range(left + 1):  # the parse, with phrases told apart as far as strings at this offset reach
        a = np.cumsum(after_common < length - k)[after]
        b = np.cumsum(before_common < k)[before]
        at = np.flatnonzero(live[:, k])
        at = at[np.bincount(a[at], minlength=n + 1)[a[at]] > 1]
        if len(at) < 2:
            continue
        _, first, which = np.unique(a[at] * (n + 1) + b[at], return_index=True, return_inverse=True)
        removed[at, k] = turn[at] > turn[at[first[which]]]
    out = np.empty_like(removed)
    out[place] = removed
    rest = np.empty_like(live)
    rest[place] = live & ~removed
    return out, rest


def _spans(phrases: np.ndarray, removed: np.ndarray, length: int) -> np.ndarray:
    """Removed byte ranges of the phrases' texts: strings start at pos - offset."""
    edge = np.diff(np.pad(removed.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1] - 1
    out = np.zeros(len(row), SPAN)
    out["id"], out["hash"] = phrases["id"][row], phrases["hash"][row]
    out["lo"], out["hi"] = phrases["pos"][row] - hi, phrases["pos"][row] - lo + length
    return out


def _windows(raw: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, left: int, length: int) -> np.ndarray:
    """The bytes from `left` before to `length` after each place, 0 where that is outside the text from begin to end; a copy of no more than these."""
    padded = np.zeros(len(raw) + left + length, np.uint8)
    padded[left : left + len(raw)] = raw
    out = np.lib.stride_tricks.sliding_window_view(padded, left + length)[at]
    before, after = np.maximum(begin - (at - left), 0), np.minimum(end - (at - left), left + length)
    for row in np.flatnonzero((before > 0) | (after < left + length)):
        out[row, : before[row]] = 0
        out[row, after[row] :] = 0
    return out


def _strings(phrases: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The strings of phrases at the wanted offsets, each by a hash of 128 bits."""
    return np.concatenate([_hashed_strings(phrases[lo : lo + BLOCK], wanted[lo : lo + BLOCK], length) for lo in range(0, max(1, len(phrases)), BLOCK)])


def _hashed_strings(phrases: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    n, left = len(phrases), wanted.shape[1] - 1
    row, k = np.nonzero(wanted)
    out = np.zeros(len(row), STRING)
    out["id"], out["hash"], out["lo"] = phrases["id"][row], phrases["hash"][row], phrases["pos"][row] - k
    for name, base in (("key", 0x9E3779B97F4A7C15), ("check", 0xD1B54A32D192ED03)):
        sums = np.zeros((n, left + length + 1), np.uint64)
        for j in range(left + length):
            sums[:, j + 1] = sums[:, j] * np.uint64(base) + _TABLE[phrases["bytes"][:, j]]
        h = sums[row, left - k + length] - sums[row, left - k] * np.uint64(pow(base, length, 1 << 64))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out[name] = h ^ (h >> np.uint64(29))
    return out


def _repeated_strings(strings: np.ndarray, length: int) -> np.ndarray:
    """Removed byte ranges: of each string all but the first in corpus order."""
    rows = strings[np.lexsort((strings["lo"], strings["hash"], strings["id"], strings["check"], strings["key"]))]
    new = np.concatenate([[True], (np.diff(rows["key"].view(np.int64)) != 0) | (np.diff(rows["check"].view(np.int64)) != 0)])
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    later = (rows["id"] != rows["id"][first]) | (rows["hash"] != rows["hash"][first]) | (rows["lo"] != rows["lo"][first])
    out = np.zeros(int(later.sum()), SPAN)
    out["id"], out["hash"], out["lo"] = rows["id"][later], rows["hash"][later], rows["lo"][later]
    out["hi"] = out["lo"] + length
    return out


def _doc_bucket(ids: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (ids.view(np.uint64) * np.uint64(_BASE)) ^ hashes.view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _packed(bucket: np.ndarray, rows: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """(bucket, kind, bytes of its rows)"""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(bucket[lo]), kind, rows[lo:hi].tobytes()) for lo, hi in zip([0, *cut], [*cut, len(rows)], strict=True) if hi > lo]


PACKED = "bucket int, kind int, data binary"


def _emit(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 256):
        part = rows[lo : lo + 256]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], names=["bucket", "kind", "data"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def deduplicate_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    A byte goes if a string of `length` bytes covers it that also starts earlier in the corpus: in a text with a
    smaller key, or earlier in the same text. Null texts are empty, a null key is smaller than any other. Rows with one
    key are ordered by the hash of their text; rows repeated in full are one document, each answered as that one.
    Texts shorter than `length` are kept whole. Texts of any length are parsed in slices. Empty tables give empty results.
    """
    spark = docs.sparkSession
    left = length - gram
    kind_of = phrase_type(length, gram)
    plain = F.coalesce(docs[text].cast("string"), F.lit(""))
    base = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(plain).alias("hash"), plain.cast("binary").alias("data"))
    total = int(base.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    hot_at = min(max(HOT_LEAST, total // HOT_GRAMS), HOT_MOST)
    hot = np.zeros(0, np.uint64)

    def parsed(raws: list[bytes]) -> Iterator[tuple]:
        """(text index, position in the text, its triggers' offsets, hash, ordinal in the text, bytes, place in them)"""
        count = np.zeros(len(raws), np.int64)
        for who, offset, raw, starts in _chunks(raws, length):
            piece, at, lo, hi, h = triggers(raw, starts, length, gram)
            who, offset = np.array(who), np.array(offset)
            i = who[piece]
            n = np.bincount(i, minlength=len(raws))
            first = np.cumsum(n) - n
            ord_ = np.arange(len(i)) - first[i] + count[i]
            count += n
            yield i, at - starts[piece] + offset[piece], lo, hi, h, ord_, raw, at, starts[piece], starts[piece + 1]

    def find_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> list[tuple[int, int, bytes]]:
            rows = np.concatenate(held)
            held.clear()
            _, first, count = np.unique(rows["key"], return_index=True, return_counts=True)
            order = np.argsort(rows["key"], kind="stable")
            many = np.repeat(count > 1, count)
            twice = rows[order[many]]
            flags = np.zeros(len(twice), FLAG)
            for name in FLAG.names:
                flags[name] = twice[name]
            one = rows[first]
            one["count"] = count
            return _packed(_doc_bucket(flags["id"], flags["hash"], buckets), flags, 1) + _packed((one["key"] % np.uint64(buckets)).astype(np.int64), one, 0)

        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, _, _, h, ord_, *_ in parsed(batch.column(2).to_pylist()):
                rows = np.zeros(len(i), GRAM_AT)
                rows["key"], rows["id"], rows["hash"], rows["ord"] = h, ids[i], hashes[i], ord_
                held.append(rows)
                if sum(map(len, held)) > 500_000:
                    yield from _emit(flush())
        if held:
            yield from _emit(flush())

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where grams occur that several tasks have; what is known already passes through."""
        now, held = None, []

        def flush() -> list[tuple[int, int, bytes]]:
            rows = np.frombuffer(b"".join(held), GRAM_AT)
            held.clear()
            rows = rows[np.argsort(rows["key"], kind="stable")]
            same = np.diff(rows["key"].view(np.int64)) == 0
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            begin = np.concatenate([[0], np.flatnonzero(~same) + 1])
            often = rows["key"][begin[np.add.reduceat(rows["count"].astype(np.int64), begin) >= hot_at]]
            rows = rows[many & (rows["count"] == 1)]
            flags = np.zeros(len(rows), FLAG)
            for name in FLAG.names:
                flags[name] = rows[name]
            return _packed(_doc_bucket(flags["id"], flags["hash"], buckets), flags, 1) + ([(0, 2, often.tobytes())] if len(often) else [])

        for bucket, kind, data in _by_bucket(batches):
            if held and (bucket != now or kind != 0):
                yield from _emit(flush())
            now = bucket
            if kind == 0:
                held.append(data)
            else:
                yield from _emit([(bucket, kind, data)])
        if held:
            yield from _emit(flush())

    def send_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of the flagged triggers, after what repeats within the task is settled."""
        now, flags, ready = None, [], None
        texts: list[tuple[int, int, bytes]] = []
        held: list[np.ndarray] = []

        def flush() -> list[tuple[int, int, bytes]]:
            rows = np.concatenate(held)
            held.clear()
            removed, first = settle(rows, length, gram)
            spans = _spans(rows, removed, length)
            some = first.any(axis=1)
            rows = rows[some]
            rows["mask"] = np.packbits(first[some], axis=1, bitorder="little")
            is_hot = np.isin(rows["key"], hot)
            strings = _strings(rows[is_hot], first[some][is_hot], length)
            rows = rows[~is_hot]
            return _packed((strings["key"] % np.uint64(buckets)).astype(np.int64), strings, 2) + _packed(_doc_bucket(spans["id"], spans["hash"], buckets), spans, 1) + _packed((rows["key"] % np.uint64(buckets)).astype(np.int64), rows, 0)

        def read(texts) -> Iterator[tuple[int, int, bytes]]:
            for i, pos, lo, hi, h, ord_, raw, at, begin, end in parsed([t for _, _, t in texts]):
                wanted = np.zeros(len(i), bool)
                change = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]])
                for a, b in zip(change[:-1], change[1:], strict=True):
                    if b > a and (ords := ready.get((texts[i[a]][0], texts[i[a]][1]))) is not None:
                        wanted[a:b] = np.isin(ord_[a:b], ords)
                w = np.flatnonzero(wanted)
                for w in np.split(w, range(BLOCK, len(w), BLOCK)) if len(w) else ():
                    rows = np.zeros(len(w), kind_of)
                    rows["key"], rows["pos"] = h[w], pos[w]
                    rows["id"], rows["hash"] = np.array([t[0] for t in texts], np.int64)[i[w]], np.array([t[1] for t in texts], np.int64)[i[w]]
                    rows["mask"] = _bits(lo[w], hi[w], left + 1)
                    rows["bytes"] = _windows(raw, at[w], begin[w], end[w], left, length)
                    held.append(rows)
                    if sum(map(len, held)) >= HELD:
                        yield from flush()

        def index() -> dict:
            if not flags:
                return {}
            rows = np.frombuffer(b"".join(flags), FLAG)
            rows = rows[np.lexsort((rows["ord"], rows["hash"], rows["id"]))]
            cut = np.flatnonzero((np.diff(rows["id"]) != 0) | (np.diff(rows["hash"]) != 0)) + 1
            return {(int(p["id"][0]), int(p["hash"][0])): p["ord"] for p in np.split(rows, cut)}

        size = 0
        for bucket, kind, id_, hash_, data in _by_bucket(batches):
            if bucket != now or (kind == 0 and texts):
                yield from _emit(list(read(texts)))
                texts, size = [], 0
                now, flags, ready = bucket, [], None
            if kind == 0:
                flags.append(data)
                continue
            if ready is None:
                ready = index()
            if (id_, hash_) in ready:
                texts.append((id_, hash_, data))
                size += len(data)
                if size >= SLICE:
                    yield from _emit(list(read(texts)))
                    texts, size = [], 0
        yield from _emit(list(read(texts)))
        if held:
            yield from _emit(flush())

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> list[tuple[int, int, bytes]]:
            if now[1] == 0:
                rows = np.frombuffer(b"".join(held), kind_of)
                spans = _spans(rows, settle(rows, length, gram)[0], length)
            else:
                spans = _repeated_strings(np.frombuffer(b"".join(held), STRING), length)
            held.clear()
            return _packed(_doc_bucket(spans["id"], spans["hash"], buckets), spans, 1)

        for bucket, kind, data in _by_bucket(batches):
            if held and (bucket, kind) != now:
                yield from _emit(flush())
            now = bucket, kind
            if kind == 1:
                yield from _emit([(bucket, kind, data)])
            else:
                held.append(data)
        if held:
            yield from _emit(flush())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ready = None, [], None
        out: list[list] = [[] for _ in range(6)]
        size = 0

        def done() -> pa.RecordBatch:
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        for bucket, kind, id_, hash_, data in _by_bucket(batches):
            if bucket != now:
                now, parts, ready = bucket, [], None
            if kind == 0:
                parts.append(data)
                continue
            if ready is None:
                ready = {}
                rows = np.frombuffer(b"".join(parts), SPAN)
                rows = rows[np.lexsort((rows["lo"], rows["hash"], rows["id"]))]
                for p in np.split(rows, np.flatnonzero((np.diff(rows["id"]) != 0) | (np.diff(rows["hash"]) != 0)) + 1) if len(rows) else ():
                    top = np.maximum.accumulate(p["hi"])
                    new = np.flatnonzero(p["lo"][1:] > top[:-1]) + 1
                    ready[int(p["id"][0]), int(p["hash"][0])] = (p["lo"][np.concatenate([[0], new])].tolist(), top[np.concatenate([new - 1, [len(p) - 1]])].tolist())
            lows, highs = ready.get((id_, hash_), ([], []))
            keep = b"".join(data[a:b] for a, b in zip([0, *highs], [*lows, len(data)], strict=True))
            row = (None if id_ == NULL_ID else id_, len(data), len(data) - len(keep), len(lows), hashlib.sha256(keep).hexdigest(), keep)
            for c, v in zip(out, row, strict=True):
                c.append(v)
            size += len(keep)
            if size > 4 * SLICE:
                yield done()
                out, size = [[] for _ in range(6)], 0
        if out[0]:
            yield done()

    own_bucket = F.pandas_udf(lambda i, h: pd.Series(_doc_bucket(i.to_numpy(np.int64), h.to_numpy(np.int64), buckets).astype("int32")), "int")
    rows = base.select(own_bucket("id", "hash").alias("bucket"), F.lit(1).alias("kind"), "id", "hash", "data")

    def met(packed: DataFrame) -> DataFrame:
        """The rows of each bucket of documents, after what was found for them."""
        both = packed.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("hash"), "data").unionByName(rows)
        return both.repartition("bucket").sortWithinPartitions("bucket", "kind")

    def dealt(packed: DataFrame) -> DataFrame:
        return packed.repartition("bucket").sortWithinPartitions("bucket", "kind")

    with arrow_batches(spark, RECORDS):
        flags = staged(dealt(base.mapInArrow(find_grams, PACKED)).mapInArrow(repeated, PACKED), "parse")
    hot = np.frombuffer(b"".join(bytes(r[0]) for r in flags.where("kind = 2").select("data").collect()), np.uint64)
    with arrow_batches(spark, RECORDS):
        spans = staged(dealt(met(flags.where("kind = 1")).mapInArrow(send_phrases, PACKED)).mapInArrow(settled, PACKED), "spans")
    unstaged(flags)
    return met(spans).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
