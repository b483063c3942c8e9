"""Stages of the pipeline against plain versions of their decisions."""

import collections
import os
import re

import pytest
from test_near_copies import least_ids, sets
from test_structures import plain_targets
from test_texts import SECRET_TEXTS

import corpus_pipeline
from ledgerloom.llm import queries, secrets
from ledgerloom.llm.common import row_hash, saved

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain_redaction(text):
    """Each secret's stretch, and those it overlaps, as one mask."""
    spans = []
    for rule in secrets.RULES:
        for m in re.finditer(rule.pattern, text, re.A | (re.I if rule.ignore_case else 0)):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                spans.append(m.span())
    hidden = set()
    for a, b in spans:
        hidden |= set(range(a, b))
    out = "".join("\0" if k in hidden else c for k, c in enumerate(text))
    return re.sub("\0+", "[secret]", out) if spans else text


def plain_mix(rows):
    """(row hash, taken) of (row hash, source, size): weighted fair queueing, one document after another."""
    total = collections.Counter()
    for _, source, size in rows:
        total[source] += size
    target = plain_targets(total)
    copies, done = [], collections.Counter()
    for row, source, size in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", (r[0] % (1 << 64)) >> 32, r[0], r[2])):
        done[source] += size
        for epoch in (0, 1):
            if size:
                copies.append(((done[source] + total[source] * epoch) / target[source], source is None, source or "", epoch, done[source], row, size))
    left, taken = int(1.5 * sum(total.values())), collections.Counter()
    for *_, source, _, at, row, size in sorted(copies):
        part = max(0, min(size, left))
        left -= part
        taken[(source, at, row)] += part
    return sorted((row, n) for (_, _, row), n in taken.items() if n)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        if name == "secrets":
            odd = spark.createDataFrame([(10**6 + k, t, "en", "s", len(t)) for k, t in enumerate(SECRET_TEXTS)], "doc_id long, text string, lang string, source string, n_chars int")
            before = saved(before.unionByName(odd.select(*[odd[c].cast(before.schema[c].dataType) for c in columns])), "test-odd")
        after = saved(stage(spark, before, SF), f"test-{name}")
        rows = {r.doc_id: r for r in before.collect()}
        kept = {r.doc_id: r for r in after.collect()}
        assert set(kept) <= set(rows)
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in queries.QUERIES["op1_toxicity"](spark, SF).collect()}
            assert set(kept) == {i for i, p in scores.items() if p == 0}
        if name == "near_dedup":
            ids = sorted(rows)
            roots = least_ids([sets(rows[i].text) for i in ids])
            assert set(kept) == {ids[r] for r in roots} and len(kept) < len(rows)
        if name == "decontaminate":
            leaks = {r.doc_id for r in queries.QUERIES["op10_decontaminate"](spark, SF).collect()}
            assert set(kept) == set(rows) - leaks
        if name == "secrets":
            assert {i: r.text for i, r in kept.items()} == {i: plain_redaction(r.text) for i, r in rows.items()}
            assert any(kept[i].text != rows[i].text for i in rows) and all(r.n_chars == len(r.text) for i, r in kept.items() if r.text != rows[i].text)
        if name == "mix":
            hashed = [(r.row, r.source, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))) for r in before.withColumn("row", row_hash(before)).collect()]
            own = {r.doc_id: h for r, (h, _, _) in zip(before.collect(), hashed, strict=True)}
            assert sorted((own[i], r.taken) for i, r in kept.items()) == plain_mix(hashed)
        if name != "mix":
            assert after.columns == columns
            before = after
    assert after.columns == [*columns, "taken"]


def test_run_gives_what_its_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "test-run")
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
