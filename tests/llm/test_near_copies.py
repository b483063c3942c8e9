"""Near copies against the exact similarity of all pairs."""

import random

import numpy as np

import corpus_pipeline
from ledgerloom.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(5000)
    out = [None, "", "  ", "one two", "one  two", "one two three", "Four words are here"]
    for n in (12, 60, 200, 200, 200, 700):
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        for edits in (1, 1, 2, 3, 4, 5, 6, 8, 12, 20):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(n)] = word()
            out.append(" ".join(t))
        out.append(" ".join(base) + " " + " ".join(base[:4]))
    return out


def least_ids(own):
    root = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_pipeline_keeps_one_of_each_set_of_near_copies(spark, make):
    given = texts()
    own = [sets(t) for t in given]
    values = [similarity(a, b) for k, a in enumerate(own) for b in own[:k]]
    assert sum(0.8 <= v < 0.9 for v in values) >= 20 and sum(0.5 <= v < 0.8 for v in values) >= 20
    want = least_ids(own)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(given)]
    docs = make(rows, DOCS)
    out = {r.doc_id: r.component_id for r in near_copies.near_components(docs).collect()}
    assert out == dict(enumerate(want))
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))
    assert near_copies.near_components(make([], DOCS)).collect() == []


def test_rows_without_ids_or_with_repeated_ids(spark, make):
    rows = [(None, "zz", None, None, None), (4, "a b c d", None, None, None), (4, "a b c d", None, None, None), (5, "a b c d", None, None, None), (6, "else", None, None, None)]
    assert sorted((r.doc_id for r in near_copies.one_of_each(make(rows, DOCS)).collect()), key=repr) == [4, 6, None]


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(2000):
        h = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        a, b = np.unique(h[:81]), np.unique(np.r_[h[:72], h[81:]])  # 72 of 90: 0.8
        assert near_copies.near(a, b) and not near_copies.near(a, np.setdiff1d(b, h[:1]))
        found += bool((near_copies.bands(a) == near_copies.bands(b)).any())
    assert found >= 1990


def test_tiles_join_what_all_pairs_join(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets_ = []
    for k in range(90):
        own = rng.permutation(base)[: 60 - int(rng.integers(0, 14))]
        sets_.append(np.unique(np.r_[own, rng.integers(0, 1 << 63, int(rng.integers(0, 5)), dtype=np.uint64)]) if k % 9 else rng.integers(0, 1 << 63, 5, dtype=np.uint64))
        sets_[-1].sort()
    sets_.append(np.zeros(0, np.uint64))
    roots = np.array([k if k % 4 else 1000 for k in range(len(sets_))])
    want = {frozenset((i, j)) for i in range(len(sets_)) for j in range(i) if near_copies.near(sets_[i], sets_[j])}
    i, j = near_copies._near_pairs(sets_)
    assert {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)} == want and len(want) > 50
    monkeypatch.setattr(near_copies, "COLUMNS", 7)
    assert {frozenset(p) for p in zip(*(x.tolist() for x in near_copies._near_pairs(sets_)), strict=True)} == want

    def classes(pairs):
        root = {int(r): int(r) for r in roots}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {r: find(r) for r in root}

    expected = classes([(int(roots[a]), int(roots[b])) for a, b in map(tuple, want)])
    for few in (0, 1000):
        monkeypatch.setattr(near_copies, "FEW", few)
        u, v = near_copies.joined_roots(roots, sets_)
        assert classes(zip(u.tolist(), v.tolist(), strict=True)) == expected and len(u) < len(sets_)


def test_a_common_passage_links_no_documents(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE", 16)
    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(80))
    given = [" ".join(f"w{rng.randrange(9000)}" for _ in range(30)) + f" {passage} x{k}" for k in range(90)]
    given += [given[3] + " more", given[70] + " more"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(given)], DOCS)
    out = {r.doc_id: r.component_id for r in near_copies.near_components(docs).collect()}
    assert out == dict(enumerate(least_ids([sets(t) for t in given])))
