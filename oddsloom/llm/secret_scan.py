"""Secret scans by a trigram inverted index.

For each rule's regular expression a Boolean query over trigrams is derived from its parse: what every match must
contain. Documents are indexed in segments (the rows of a record batch): postings list, for each trigram that some
query names, the segment's documents that hold it. A query intersects and unites postings; only candidates are
verified with the expression. A rule without mandatory trigrams (a lone character class) scans all texts.

Matches are leftmost and non-overlapping for each kind; those below the kind's least length are dropped. Offsets are
code points, end exclusive. Null or empty texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

try:
    from re import _parser as _parse
except ImportError:  # before Python 3.11
    import sre_parse as _parse


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # whose length counts
    least: int


RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)

#: A query is True (no demand), a trigram, or ("and" | "or", queries).
Query = object
_MOST = 64  # exact strings followed at once


def trigram_query(pattern: str) -> Query:
    """What trigrams (ASCII lower case) a text must hold for a match; True if none are mandatory."""
    exact, query = _walk(list(_parse.parse(pattern)))
    return _both(query, _of_strings(exact))


def _of_strings(exact: set[str] | None) -> Query:
    """Any of some strings occurs: one of the conjunctions of their trigrams holds."""
    if not exact or any(len(s) < 3 for s in exact):
        return True
    return _either([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(exact)])


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _both(a: Query, b: Query) -> Query:
    return _all([a, b])


def _either(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _walk(items: list) -> tuple[set[str] | None, Query]:
    """(exact strings the items match or None, query) of a sequence. Strings that end are turned into demands."""
    exact, whole = {""}, True  # whole: the strings are all that the items match
    query: Query = True
    for op, arg in items:
        name, part, extra, closes = str(op), None, True, False
        if name == "LITERAL":
            part = {chr(arg).lower()} if arg < 128 else None
        elif name == "SUBPATTERN":
            part, extra = _walk(list(arg[-1]))
        elif name == "BRANCH":
            ways = [_walk(list(w)) for w in arg[1]]
            if all(e is not None for e, _ in ways) and sum(len(e) for e, _ in ways) <= _MOST:
                part, extra = set().union(*[e for e, _ in ways]), _either([q for _, q in ways])
            else:
                extra = _either([_both(q, _of_strings(e)) for e, q in ways])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            inner, demand = _walk(list(body))
            if inner is not None and low == 0 and high == 1:
                part = inner | {""}
            elif low >= 1:  # once for certain; what follows may be further on
                part, extra, closes = inner, demand, not low == high == 1
        elif name == "AT":
            part = {""}
        query = _both(query, extra)
        if part is not None and len(exact) * len(part) <= _MOST:
            exact = {a + b for a, b in product(exact, part)}
        else:
            query, whole = _both(query, _of_strings(exact)), False
            exact = part if part is not None and len(part) <= _MOST else {""}
        if closes:
            query, exact, whole = _both(query, _of_strings(exact)), {""}, False
    return (exact, query) if whole else (None, _both(query, _of_strings(exact)))


def _trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


class Segment:
    """Postings of the trigrams that queries name, over the texts of one batch."""

    def __init__(self, texts: pa.Array, known: dict[str, int], slots: np.ndarray):
        self.rows = len(texts)
        offsets = texts.buffers()[1]
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + self.rows + 1].astype(np.int64)
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        self.starts = at - at[0]
        low = _LOWER[self.data].astype(np.uint32)
        if len(low) > 2:
            slot = slots[(low[:-2] & 31) << 10 | (low[1:-1] & 31) << 5 | low[2:] & 31]
            hits = np.flatnonzero(slot)
            code = (low[hits] << 16 | low[hits + 1] << 8 | low[hits + 2]).astype(np.int64)
            row = np.searchsorted(self.starts, hits, "right") - 1
            inside = hits + 3 <= self.starts[row + 1]
            self.code, self.row = code[inside], row[inside]
        else:
            self.code = self.row = np.empty(0, np.int64)
        self.postings = {t: self._post(c) for t, c in known.items()}

    def _post(self, code: int) -> np.ndarray:
        out = np.zeros(self.rows, bool)
        out[self.row[self.code == code]] = True
        return out

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.ones(self.rows, bool)
        if isinstance(query, str):
            return self.postings[query]
        op = np.logical_and if query[0] == "and" else np.logical_or
        return op.reduce([self.candidates(q) for q in query[1]])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _scanner(rules: tuple[Rule, ...]) -> Callable[[pa.Array], list[list[tuple[int, int, str]]]]:
    """Spans (start, place of the kind, end) of each text of a column."""
    queries = [trigram_query(r.pattern) for r in rules]
    known = {t: ord(t[0]) << 16 | ord(t[1]) << 8 | ord(t[2]) for t in sorted(set().union(*map(_trigrams, queries)))}
    slots = np.zeros(1 << 15, bool)  # a sieve on five bits of each byte, ahead of the exact comparison
    for c in known.values():
        slots[(c >> 16 & 31) << 10 | (c >> 8 & 31) << 5 | c & 31] = True
    compiled = [re.compile(r.pattern) for r in rules]

    def scan(column: pa.Array) -> list[list[tuple[int, int, str]]]:
        column = pc.fill_null(column, "")
        segment = Segment(column, known, slots)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for k, (rule, query, expr) in enumerate(zip(rules, queries, compiled, strict=True)):
            for i in np.flatnonzero(segment.candidates(query)).tolist():
                text = column[i].as_py()
                if query is True and rule.group == 0 and (run := _RUNS.get(rule.pattern)):
                    spans = [m.span() for m in run(rule.least).finditer(text)]
                else:
                    spans = [m.span() for m in expr.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                found[i] += [(a, k, b) for a, b in spans]
        return [sorted(f) for f in found]

    return scan


#: A greedy class run of n or more is the same as the class run filtered by length, and skips short runs faster.
_RUNS = {r"[0-9a-f]+": lambda n: re.compile(rf"[0-9a-f]{{{n},}}")}


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``spans`` (array of kind, start, end in order of start, then of rules). No shuffle."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(rules)
        for batch in small_batches(batches):
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in f] for f in scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by ``mark``; overlapping spans are replaced as one. Columns stay;
    ``n_chars``, if there, is counted anew for texts that change. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(rules)
        at = None
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for batch in small_batches(iter([whole]), at):
                texts = batch.column(at).to_pylist()
                sizes = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
                for i, spans in enumerate(scan(batch.column(at))):
                    if spans:
                        texts[i] = _cut(texts[i], spans, mark)
                        if sizes:
                            sizes[i] = len(texts[i])
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if sizes:
                    n = batch.schema.get_field_index("n_chars")
                    columns[n] = pa.array(sizes, batch.schema.field(n).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _cut(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(spans: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by kind and the digest of ``kind:start:end`` joined by commas. Base spans are all there are here."""
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in rules]
    return spans.select(id_col, *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
