"""Scores of both classifiers recomputed plainly from the fitted arrays, and what a text's parts do to them."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm import labelled, quality, toxicity

MASK = (1 << 64) - 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "!!", "a", "one", "Üben übt ÜBUNG", "漢字かな交じり文" * 9, "x_y-z a__b", "w " * 50, "long" * 5000, "ab" * 30 + " tail", "no\nline\tends", "a a a b a b", "…?! ?!", "İstanbul ǅ", "1 2 3"]


def words(seed, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ",", "!!"]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def plain_toxicity(model, text):
    def bucket(h):
        return (((h ^ h >> 29) * 0x9E3779B97F4A7C15 & MASK) >> 40) % toxicity.BUCKETS

    def value(word):
        marked = f"<{word}>"
        hashes = [sum(ord(c) * (k + 1) ** 3 * 0x9E3779B97F4A7C15 for k, c in enumerate(marked)) & MASK]
        for n in toxicity.GRAMS:
            for at in range(len(marked) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x9E3779B97F4A7C15 + ord(marked[at + k]) + k + 1) & MASK
                hashes.append(h)
        return sum(float(model.odds[bucket(h)]) for h in hashes) / len(hashes)

    found = []
    for w in re.findall(r"\w+", text.lower()):
        found += [w] if len(w) <= 40 else [w[at : at + 12] for at in range(0, len(w) - 4, 8)]
    values = [value(w) for w in found]
    starts = sorted({min(k, max(0, len(values) - 8)) for k in range(0, max(1, len(values) - 8 + 4), 4)}) if values else []
    z = max((sum(values[a : a + 8]) / len(values[a : a + 8]) for a in starts), default=0.0)
    return 1 / (1 + math.exp(-(z + model.bias)))


def plain_quality(model, text):
    tokens = re.findall(r"\w+|[^\w\s]+", text.lower())
    hashes = []
    for k, t in enumerate(tokens):
        again = k > 0 and tokens[k - 1] == t or k > 1 and t[0].isalnum() and tokens[k - 2] == t
        hashes.append(zlib.crc32(b"\0repeat") if again else zlib.crc32(t.encode()))
    mix, shift = 0x9E3779B97F4A7C15, 64 - quality.BITS
    at = [(h * mix & MASK) >> shift for h in hashes] + [(((a * 0xC2B2AE3D27D4EB4F + b) & MASK) * mix & MASK) >> shift for a, b in zip(hashes, hashes[1:], strict=False)]
    z = sum(float(model.weights[i]) for i in at) / math.sqrt(max(1, len(at))) + model.bias
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize(("module", "plain"), [(toxicity, plain_toxicity), (quality, plain_quality)])
def test_scores_against_a_plain_version(module, plain):
    fitted = words(1, 200)
    model = module.fit(fitted, np.array([len(t) % 2 for t in fitted]))
    texts = ODD + words(2, 150) + fitted[:20]
    got = model.score(texts)
    assert np.abs(got - [plain(model, t) for t in texts]).max() < 1e-6
    assert len(set(np.round(got, 9))) > 100
    alone = np.concatenate([model.score([t]) for t in texts])
    assert (got == alone).all()  # a score depends on its text alone


@pytest.mark.parametrize("at", [40, 64, 10_000])
def test_the_ends_of_long_words_count(at):
    a, b = "x" * at + "hello", "x" * at + "world"
    for f in (quality.features, lambda t: toxicity.subwords(toxicity.split(t)[2])):
        one, two = f([a]), f([b])
        assert one[0].shape != two[0].shape or (one[0] != two[0]).any() or (one[1] != two[1]).any()


def test_samples_take_rows_that_have_a_text(spark, make):
    docs = make([(i, "w " * 10 if i % 3 else "w " * 900, "en", "s", 1) for i in range(1, 200)] + [(1, "a w", "en", "s", 1)], DOCS)
    labels = make([(i, i % 2) for i in range(1, 4000)] + [(1, 0), (7, None)], "doc_id long, toxic int")
    texts, y = labelled.training_sample(docs, labels, "toxic", 40, 100)
    assert (y == 0).sum() == 40 and (y == 1).sum() == 40 and max(map(len, texts)) <= 100
    again, z = labelled.training_sample(docs.repartition(5), labels.repartition(3), "toxic", 40, 100)
    assert again == texts and (y == z).all()
    assert labelled.training_sample(make([], DOCS), labels, "toxic", 40, 100)[0] == []
