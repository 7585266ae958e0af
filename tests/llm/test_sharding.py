import random
import zlib
from collections import Counter, defaultdict

from axiomill.llm import sharding as s

from .helpers import docs, none, odd


def one_by_one(sizes, capacity, bins):
    """Best fit decreasing, an item at a time, by looking at all bins."""
    room, out = {b: capacity for b in range(bins)}, []
    for size in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in room.items() if r >= size]
        b = min(fits)[1] if fits else max((r, b) for b, r in room.items())[1]
        room[b] -= size
        out.append((size, b))
    return Counter(out)


def test_runs_pack_like_single_items():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([3, 5, 8, 13, 40]) for _ in range(rng.randrange(1, 200))]
        capacity = -(-sum(sizes) // 7)
        runs = Counter()
        for size, n, b in s.best_fit_decreasing(list(Counter(sizes).items()), capacity, 7):
            runs[size, b] += n
        assert runs == one_by_one(sizes, capacity, 7)


def test_open_packing_keeps_the_capacity_and_is_near_the_least():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 60) for _ in range(900)]
    load = Counter()
    for size, n, b in s.best_fit_decreasing(list(Counter(sizes).items()), 100):
        load[b] += size * n
    assert max(load.values()) <= 100 and len(load) <= 1.06 * sum(sizes) / 100 + 1


def test_tree_keeps_its_order():
    rng, tree, keys = random.Random(3), s.CapacityTree(), set()
    for _ in range(3000):
        if keys and rng.random() < 0.45:
            k = rng.choice(sorted(keys))
            keys.remove(k)
            tree.remove(k)
        else:
            k = (rng.randrange(100), rng.randrange(1000))
            if k not in keys:
                keys.add(k)
                tree.insert(k)
        q = rng.randrange(110)
        assert tree.tightest(q) == min((k for k in keys if k[0] >= q), default=None)
        assert not keys or tree.roomiest() == max(keys)


def test_shards(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abé ", k=rng.randrange(0, 400))) for _ in range(2500)] + ["hot " * 20] * 1200 + ["pair of equal texts"] * 9 + [None, ""]
    got = s.shard_documents(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 40 + 420
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for t, x in where.items() if t != b"hot " * 20)


def test_odd_tables(spark):
    got = s.shard_documents(odd(spark)).collect()
    assert len(got) == 12 and all(0 <= r.shard < 40 for r in got)
    assert s.shard_documents(none(spark)).collect() == []


def test_large_sizes_are_packed_within_a_fine_step(spark):
    rng = random.Random(5)
    texts = ["x" * n for n in sorted({rng.randrange(1 << 16, 1 << 18) for _ in range(160)})]
    got = s.shard_documents(docs(spark, texts), shards=8).collect()
    exact = one_by_one([r.size for r in got], -(-sum(r.size for r in got) // 8), 8)
    load, want = Counter(), Counter()
    for r in got:
        load[r.shard] += r.size
    for (size, b), n in exact.items():
        want[b] += size * n
    mean = sum(load.values()) / 8
    assert max(load.values()) - min(load.values()) <= max(want.values()) - min(want.values()) + 0.005 * mean
