"""Secret scans by a trigram inverted index.

Each rule's regex is turned into a Boolean query of trigrams that any match must hold. Every Arrow batch
of documents is a shard: its case-folded bytes are looked up in one pass against the trigrams that some
query names, which gives each trigram's postings (document numbers, sorted); the queries intersect and
unite them, and only the candidates are matched against the regex. A rule without a mandatory trigram,
such as a run of hex digits, scans every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, reduce
from itertools import product
from re import _constants as sre
from re import _parser as sre_parse
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import trimmed


class Rule(NamedTuple):
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0  # the group whose length counts
    least: int = 0  # matches whose group is shorter are dropped


#: A header and what follows it: up to the END line, if one comes before another header, else the lines of base64
#: (and headers such as DEK-Info) below it. Line ends may be escaped, as in JSON.
_BREAK = r"(?:\s|\\[nr])+"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:{_BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:{_BREAK}[A-Za-z0-9+/]+={{1,2}}|(?:\n|\\n)[A-Za-z0-9+/]+(?=\s*(?:\n|\Z)))?)"
)

#: The base rules first; their spans are never replaced. Kinds rank in this order.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
    Rule("private_key", PRIVATE_KEY),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed_token", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,})"),
)
BASE = 3
MOST_STRINGS = 64
SLICE = 1 << 20


# --- Boolean trigram queries: True (no condition), a trigram, ("and", parts) or ("or", parts) ---


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]):
    return _any([_all([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _analyse(nodes) -> tuple[set[str] | None, list]:
    """(all strings the nodes can match, if they are few; else None) and conditions any match must meet."""
    run: set[str] = {""}
    whole, conditions = True, []

    def cut():
        nonlocal run, whole
        conditions.append(_of_strings(run))
        run, whole = {""}, False

    for op, value in nodes:
        strings, more = None, []
        if op is sre.LITERAL:
            strings = {chr(value).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            strings = {chr(v).lower() for _, v in value}
        elif op in (sre.SUBPATTERN, sre.ATOMIC_GROUP):
            strings, more = _analyse(value[-1] if op is sre.SUBPATTERN else value)
        elif op is sre.BRANCH:
            each = [_analyse(b) for b in value[1]]
            strings = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
            more = [_any([_all([*c, *([] if s is None else [_of_strings(s)])]) for s, c in each])] if strings is None else []
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            once, inner_more = _analyse(inner)
            if once is not None and high == 1:
                strings = once | {""} if low == 0 else once
            elif low >= 1:
                more = [*inner_more, *([_of_strings(once)] if once is not None else [])]
        elif op is sre.AT:
            continue
        conditions += more
        if strings is None or len(strings) > MOST_STRINGS:
            cut()
            continue
        if len(run) * len(strings) > MOST_STRINGS:
            cut()
        run = {a + b for a, b in product(run, strings)}
    if whole:
        return run, conditions
    conditions.append(_of_strings(run))
    return None, conditions


def trigram_query(pattern: str):
    """What trigrams (case-folded) a match of the pattern must hold; True if none is mandatory."""
    strings, conditions = _analyse(sre_parse.parse(pattern, re.ASCII))
    return _all([*conditions, *([_of_strings(strings)] if strings is not None else [])])


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def evaluate(query, postings: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    if query is True:
        return everything
    if isinstance(query, str):
        return postings.get(query, everything[:0])
    parts = [evaluate(q, postings, everything) for q in query[1]]
    return reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)


@cache
def _index(rules: tuple[Rule, ...]):
    """Queries, the trigrams they name, and a table from the 24 bits of a trigram to its number there (0: none)."""
    queries = [trigram_query(r.pattern) for r in rules]
    # A trigram with characters beyond ASCII has no single 24-bit code; such conditions are dropped.
    names = sorted(t for t in set().union(*map(trigrams_of, queries)) if t.isascii())
    queries = [_ascii_only(q) for q in queries]
    if len(names) > 65_000:
        raise ValueError("the rules name too many trigrams for one index")
    lookup = np.zeros(1 << 24, dtype=np.uint16 if len(names) > 254 else np.uint8)
    for k, t in enumerate(names, 1):
        a, b, c = t.encode()
        lookup[a << 16 | b << 8 | c] = k
    compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)) for r in rules]
    return queries, names, lookup, compiled


def _ascii_only(query):
    if isinstance(query, str):
        return query if query.isascii() else True
    return query if query is True else (_all if query[0] == "and" else _any)([_ascii_only(q) for q in query[1]])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def postings(data: np.ndarray, offsets: np.ndarray, names: list[str], lookup: np.ndarray) -> dict[str, np.ndarray]:
    """The inverted index of one shard: for each named trigram the numbers of the documents that hold it."""
    pairs = []
    for at in range(0, max(len(data) - 2, 0), SLICE):
        part = _FOLD[data[at : at + SLICE + 2]].astype(np.uint32)
        slot = lookup[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
        hit = np.flatnonzero(slot)
        doc = np.searchsorted(offsets, hit + at, side="right") - 1
        inside = hit + at + 3 <= offsets[doc + 1]
        pairs.append(np.unique(slot[hit[inside]].astype(np.int64) << 40 | doc[inside]))
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    of, doc = found >> 40, found & ((1 << 40) - 1)
    edges = np.searchsorted(of, np.arange(1, len(names) + 2))
    return {t: doc[edges[k] : edges[k + 1]] for k, t in enumerate(names)}


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; nulls are empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def find_spans(texts: list[str], data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per document its spans (start, rank of the kind, end) in code points, sorted."""
    queries, names, lookup, compiled = _index(rules)
    index = postings(data, offsets, names, lookup)
    everything = np.arange(len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for rank, (rule, query, regex) in enumerate(zip(rules, queries, compiled, strict=True)):
        for doc in evaluate(query, index, everything).tolist():
            for m in _matches(regex, rule, texts[doc]):
                out[doc].append((m[0], rank, m[1]))
    for spans in out:
        spans.sort()
    return out


def _matches(regex: re.Pattern, rule: Rule, text: str) -> Iterator[tuple[int, int]]:
    if rule.pattern == "[0-9a-f]+" and rule.least > 1:
        # A greedy run of one class is maximal, so runs of `least` and more are the same spans, found at once.
        regex = re.compile(f"[0-9a-f]{{{rule.least},}}", re.ASCII)
    for m in regex.finditer(text):
        a, b = m.span(rule.group)
        if b - a >= rule.least:
            yield m.span()


def _describe(spans, rules) -> str:
    return ",".join(f"{rules[rank].kind}:{start}:{end}" for start, rank, end in spans)


def _batches(rules: tuple[Rule, ...], base: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            column = b.column(1).fill_null(b"")
            data, offsets = _rows(column)
            texts = column.cast(pa.string()).to_pylist()
            found = find_spans(texts, data, offsets, rules)
            kept = [[s for s in spans if s[1] < base] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in kept], type=pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array([hashlib.sha256(_describe(s, rules).encode()).hexdigest() for s in kept], type=pa.string()), pa.array([_describe(s, rules) for s in found], type=pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the secrets of every whole text.

    Null texts count as empty and empty ones have no spans; repeated rows each return a row; a null
    doc_id stays null. Offsets are code points, ends exclusive. Matches of one kind never overlap, those
    of different kinds may. Other columns are ignored; an empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(trimmed(_batches(rules, BASE)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns with each secret in ``text`` replaced; spans that overlap become one mask.

    Texts without a secret, null and empty ones included, stay as they are; ``n_chars``, if there, is counted anew
    for texts that change. Rows keep their ids, null or repeated, and repeated rows change alike; an empty table
    stays empty.
    """
    names, at = docs.columns, docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            column = b.column(at)
            filled = column.fill_null("")
            data, offsets = _rows(filled.cast(pa.binary()))
            texts = filled.to_pylist()
            found = find_spans(texts, data, offsets, rules)
            arrays = list(b.columns)
            old = column.to_pylist()
            new = [masked(t, s, mask) if s else o for t, s, o in zip(texts, found, old, strict=True)]
            arrays[at] = pa.array(new, type=column.type)
            if "n_chars" in names:
                k = names.index("n_chars")
                arrays[k] = pa.array([len(n) if s else o for n, s, o in zip(new, found, b.column(k).to_pylist(), strict=True)], type=b.column(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)
