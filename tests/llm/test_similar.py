import random

from axiomill.llm import similar

from .helpers import docs, none, odd
from .test_simhash import groups


def shingles(t, n=5):
    w = t.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_pairs_over_the_similarity_are_found_and_others_left(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 9)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(300)]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for i in rng.sample(range(300), rng.randrange(1, 4)):
                copy[i] = word()
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["short text", "Short  text", "", " "]
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = groups(range(len(texts)), pairs)
    got = similar.similar_documents(docs(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id for r in got if r.first} == set(want.values())
    assert {r.doc_id for r in similar.keep_first(docs(spark, texts)).collect()} == set(want.values())


def test_odd_tables(spark):
    kept = similar.keep_first(odd(spark))
    rows = kept.collect()
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in rows if r.doc_id is not None and r.doc_id in (1, 2, 8)) == [(False, 1, "same text here for all of us"), (False, 8, "x")]
    assert [r.doc_id for r in rows if not r.text] == [3]
    assert similar.keep_first(none(spark)).collect() == []


def _edited(rng, base, wanted):
    """base with single words replaced until its similarity to base is as close above `wanted` as one more word allows."""
    copy, at = list(base), list(range(0, len(base), 6))
    rng.shuffle(at)
    x = shingles(" ".join(base))
    for i in at:
        new = [*copy[:i], f"new{rng.random()}", *copy[i + 1 :]]
        y = shingles(" ".join(new))
        if len(x & y) < wanted * len(x | y):
            return copy, new
        copy = new
    raise ValueError("base is too short")


def test_every_pair_at_the_similarity_and_none_below(spark):
    rng = random.Random(12)
    texts, linked = [], []
    for _ in range(40):
        base = [f"w{rng.random()}" for _ in range(200)]
        above, below = _edited(rng, base, 0.8)
        for copy, near in ((above, True), (below, False)):
            own = [f"{w}x" for w in base] if not near else base
            copy = [f"{w}x" for w in copy] if not near else copy
            texts += [" ".join(own), " ".join(copy)]
            linked.append(near)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, texts)).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(len(linked))] == linked


def test_the_fringe_of_a_large_group_is_linked(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(12):
        base = [f"w{rng.random()}" for _ in range(240)]
        group = [base]
        for i in range(14):
            copy = list(base)
            copy[3 * i] = f"copy{rng.random()}"
            group.append(copy)
        between, _ = _edited(rng, base, 0.87)
        fringe, _ = _edited(rng, between, 0.81)
        sets = [shingles(" ".join(t)) for t in (*group, fringe)]
        assert all(len(s & sets[-1]) < 0.8 * len(s | sets[-1]) for s in sets[:-1])
        texts += [" ".join(t) for t in (*group, between, fringe)]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, texts)).collect()}
    assert got == {i: i // 17 * 17 for i in range(len(texts))}


def test_links_do_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(14)
    texts = []
    for _ in range(30):
        base = [f"w{rng.random()}" for _ in range(60)]
        texts += [" ".join(base), " ".join([*base[:-4], f"end{rng.random()}"]), " ".join([f"start{rng.random()}", *base[3:]])]
    df = docs(spark, texts)
    found = [{r.doc_id: r.component_id for r in similar.similar_documents(df.repartition(n)).collect()} for n in (1, 7, 61)]
    assert found[0] == found[1] == found[2]


def test_texts_are_named_by_a_shuffle_beyond_the_bound(spark, monkeypatch):
    texts = [f"one two three four five six seven eight nine ten {'x ' * 30} {i}" for i in range(30)] + ["alone " * 40]
    want = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, texts)).collect()}
    monkeypatch.setattr(similar, "NAMED", 1)
    assert {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, texts)).collect()} == want


def test_rounds_of_leaders_change_nothing(spark, monkeypatch):
    rng = random.Random(15)
    base = [f"w{rng.random()}" for _ in range(100)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for i in rng.sample(range(100), rng.randrange(0, 6)):
            copy[i] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    want = groups(range(60), [(i, j) for j in range(60) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    for meetings in (0, 4):
        monkeypatch.setattr(similar, "MEETINGS", meetings)
        assert {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, texts)).collect()} == want
