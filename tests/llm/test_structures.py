"""SimHash, neighbours, mixing, WARC, chat and URL filters against brute force and round trips."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import chat, mixing, neighbours, simhash, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_against_brute_force(spark, make):
    rng = random.Random(1)
    vocabulary = [f"Wort{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))]
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append("\t".join(v))
    texts += ["", None, " \n", "one", "one two", texts[0], texts[0].upper(), "É " * 40]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    fps = [plain_fingerprint(t) for t in texts]
    roots = groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(make(rows, DOCS)).collect()}
    assert out == {i: (f"{fps[i]:016x}", least[roots[i]]) for i in range(len(texts))}
    assert simhash.simhash_components(make([], DOCS)).collect() == []


def test_simhash_without_ids(spark, make):
    rows = [(None, "a b c d", None, None, None), (None, "zz", None, None, None), (4, "a b c d", None, None, None), (4, "a b c d", None, None, None)]
    out = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(make(rows, DOCS)).collect()), key=repr)
    assert out == sorted([(None, 4), (None, None), (4, 4), (4, 4)], key=repr)
    kept = simhash.one_of_each(make(rows[2:] + [(5, "a b c d", None, None, None), (6, "else", None, None, None)], DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == [4, 6]


def test_large_buckets_are_tiled(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 26)
    fp = np.unique(np.r_[[int(rng.integers(0, 1 << 37)) << 26 | int(base) for _ in range(2300)]])
    fp = np.unique(np.r_[fp, fp[:900] ^ (1 << rng.integers(26, 62, 900))])
    df = spark.createDataFrame([(int(x), [int(x)]) for x in fp], "fp long, fps array<long>")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    parent = {int(x): int(x) for x in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fp):
        for y in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ x) <= 3]:
            a, b = find(int(x)), find(int(y))
            parent[max(a, b)] = min(a, b)
    assert all(got.get(int(x), int(x)) == find(int(x)) for x in fp) and got


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    away = np.abs(np.bitwise_count(x[:, None] ^ simhash.PIVOTS).astype(int) - np.bitwise_count(y[:, None] ^ simhash.PIVOTS).astype(int))
    assert away.max() <= simhash.MAX_BITS


VECTORS = "vec_id long, embedding array<float>, label int"


def exact(rows, k):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, x in good.items():
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good.items() if i != q)[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def test_neighbours_are_exact_at_factor_one(spark, make):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1500, 8)).astype(np.float32).tolist()
    rows = [(i, p) for i, p in enumerate(points)] + [(2000 + i, points[100]) for i in range(400)]
    rows += [(3000, None), (3100, [0.0] * 8), (3200, [float("nan")] + [1.0] * 7), (3300, [None] + [1.0] * 7), (3400, [float("inf")] * 8), (3500, [])]
    df = make([(i, v, 0) for i, v in rows], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, "vec_id % 100 = 0", factor=1.0, shard_rows=200).collect())
    want = exact(rows, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    relaxed = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, "vec_id % 100 = 0", shard_rows=200).collect()}
    assert len(relaxed & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)


def test_no_query_is_left_short(spark, make):
    points = np.random.default_rng(4).normal(size=(3000, 2)).astype(np.float32).tolist()
    df = make([(i, p, 0) for i, p in enumerate(points)], VECTORS)
    got = neighbours.nearest(df, "vec_id >= 0").groupBy("query_id").count().collect()
    assert len(got) == 3000 and {r["count"] for r in got} == {10}


def test_few_or_no_neighbours(spark, make):
    few = make([(0, [1.0, 2.0], 1), (1, [1.0, 3.0], 1), (100, [5.0, 5.0], 1), (7, [1.0], 1)], VECTORS)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(few, "vec_id % 100 = 0").collect()) == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert neighbours.nearest(make([], VECTORS), "vec_id % 100 = 0").collect() == []


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, budget = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        share = budget / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in left}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        left -= over
    return target


def test_mix_meets_its_targets(spark, make, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 64)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "en", rng.choice(["a", "b", "c", "d", None, "a", "a", "a"]), 0) for i in range(3000)]
    rows += [(None, "x y", "en", "b", 0), (1, None, "en", "e", 0), (2, "one\u00a0word two", "en", "e", 0), (7, "same", "en", "a", 0), (7, "same", "en", "a", 0)]
    docs = make(rows, DOCS)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    want = plain_targets(sizes)
    by_target = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by_target.setdefault((r.source_size, round(r.target, 6)), 0)
        by_target[(r.source_size, round(r.target, 6))] += r.taken
    assert set(by_target) == {(sizes[s], round(t, 6)) for s, t in want.items()}
    assert all(abs(taken - target) <= 80 for (_, target), taken in by_target.items())
    assert sum(r.taken for r in out) == int(1.5 * sum(sizes.values()))
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=repr)
    assert mixing.mix(make([], DOCS)).collect() == []
    assert {r.taken for r in mixing.mix(make([(1, "", "en", "a", 0), (2, None, "en", None, 0)], DOCS)).collect()} == {0}
    chosen = mixing.mixed(docs)
    assert chosen.columns == [*docs.columns, "taken"] and chosen.where("taken = 0").count() == 0


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, make):
    big, small = "<p>é</p>" * 300, "<p>x</p>"
    rows = [(1, "http://a/ b", big), (5, "http://b", big), (3, None, big), (2, "http://c", small), (4, "http://d", small), (6, "http://e", None), (7, "", ""), (8, "http://f", "q" * 200_000), (None, "http://g", big), (5, "http://b", big), (9, "h", "\r\n\r\n" * 600)]
    out = warc.round_trip(make(rows, PAGES)).collect()
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        again = html == big and page_id != 5
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(make([], PAGES)).collect() == []


def test_warc_reader_checks_what_it_reads():
    digest = lambda b: hashlib.sha1(b).hexdigest()
    a, b = (warc.record(i, 0, "http://x", p, digest(p), None) for i, p in ((1, b"hello"), (2, b"x" * 900_000)))
    assert [p for _, _, p in warc.records(io.BytesIO(a + b))] == [b"hello", b"x" * 900_000]
    assert gzip.decompress(a).startswith(b"WARC/1.1\r\n")
    for broken in (a[:-4], a + b[:-9], gzip.compress(gzip.decompress(a).replace(b"hello", b"jello")), gzip.compress(gzip.decompress(a)[:-6])):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(broken)))


CHATS = "conv_id long, turn long, role string, text string"


def plain_digest(turns):
    h = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), h, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark, make):
    rng = random.Random(6)
    bits = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "\n", "assistant", "<", "|", "\\", "é", "n>", "<n>", " "]
    word = lambda n: "".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    rows, want = [], {}
    for conv in range(80):
        turns = [(rng.choice(["user", "assistant", "system", "a\nb", "<|im_end|>"]), word(9)) for _ in range(rng.randrange(1, 7))]
        want[conv] = plain_digest(turns)
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    rows += [(500, 0, None, None), (None, None, "assistant", "x" * 300_000)]
    want[500], want[None] = plain_digest([("", "")]), plain_digest([("assistant", "x" * 300_000)])
    formatted = chat.format_conversations(make(rows, CHATS))
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(formatted).collect()}
    assert out == want
    pieces = {}
    for r in formatted.collect():
        pieces.setdefault(r.conv_id, []).append((r.position, r.piece))
    for conv, parts in pieces.items():
        whole = "".join(p for _, p in sorted(parts))
        assert plain_digest([t[:2] for t in chat.parse(whole)]) == want[conv]
    assert chat.digests(chat.format_conversations(make([], CHATS))).collect() == []


def test_url_filter(spark, make):
    urls = [
        None, "", "no scheme", "HTTP://A.COM/en/1", "http://example.com/en/7x", "http://www.example.com/en/8", "http://com/en/", "http://example.net/de/8?x", "http://a.net/de/1", "http://notnet/de/1",
        "http://x.org/es", "http://x.org/es/#a", "http://a.example.org?casino=1&poker", "http://a.example.org/porn", "http://a.example.org/pornography", "http://a.io/free-casino", "http://a.io/casino/casino", "x://h:80/p?://q/r", "http://ÄB.com/EN/",
    ]
    out = {r.page_id: r for r in url_filter.judge(make([(i, u, "") for i, u in enumerate(urls)], PAGES)).collect()}
    assert len(out) == len(urls)
    assert [(out[i].rule, out[i].verdict) for i in range(12)] == [
        (None, "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "allow"), (None, "allow"), ("org/es/", "block"),
    ]
    assert [out[i].verdict for i in range(12, 17)] == ["block", "block", "allow", "block", "allow"]
    assert (out[17].host, out[17].path, out[18].host, out[18].path) == ("h:80", "/p", "Äb.com", "/EN/")
    assert url_filter.judge(make([], PAGES)).collect() == []
