"""Secret scans: a trigram inverted index picks the texts that each rule is run on.

Each chunk of documents is a shard with its own postings.  A rule's Boolean
trigram query is derived from its regular expression; its postings are
intersected, and only the candidates are searched with the expression itself.  A
rule without mandatory trigrams (a run of hex digits) scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quire.llm import trigrams
from quire.llm._batches import bound_batches, map_chunks, settle, texts
from quire.llm.spans import SPAN, masked


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    flags: int = re.ASCII


#: The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: What the scan adds: credentials whose own form gives them away.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----", 27),
    Rule("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", 40),
)
RULES = BASE + MORE


class Scanner:
    """Rules, their queries and the index over the trigrams that these hold."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(k, r, re.compile(r.pattern, r.flags), trigrams.query(r.pattern, r.flags)) for k, r in enumerate(rules)]
        self.index = trigrams.TrigramIndex(set().union(*(trigrams.vocabulary(q) for *_, q in self.rules)))

    def scan(self, blobs: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """The spans of each text, by start, then by the rules' order."""
        self.index.fill(blobs)
        held = [b.decode("utf-8", "replace") for b in blobs]
        found: list[list[tuple[int, int, str, int]]] = [[] for _ in blobs]
        for k, rule, search, q in self.rules:
            for d in self.index.candidates(q).tolist():
                for m in search.finditer(held[d]):
                    s, e = m.span(rule.group)
                    if e - s >= rule.least:
                        found[d].append((m.start(), k, rule.kind, m.end()))
        return [[(kind, s, e) for s, _, kind, e in sorted(x)] for x in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end in code points) of each whole text; no shuffle.

    Spans are ordered by start, then by the rules' order; those of different rules
    may overlap.  A null or empty text has none; rows that repeat are each
    reported; an empty table gives an empty result.
    """

    def make():
        scanner = Scanner(rules)
        return lambda ids, blobs: {"doc_id": ids, "spans": [[dict(kind=k, start=s, end=e) for k, s, e in x] for x in scanner.scan(blobs)]}

    return map_chunks(texts(docs, id_col, text_col), f"doc_id long, spans {SPAN}", make)


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with each secret in the text replaced by its kind in brackets; a null text stays null.

    Columns are passed on by their place, so names that differ in case only do not clash.
    """

    def run(batches):
        import pyarrow as pa

        settle()
        scanner = Scanner(rules)
        for batch in batches:
            held = batch.column(at)
            size = max(1, batch.num_rows * (4 << 20) // max(1, held.nbytes))
            out = []
            for i in range(0, batch.num_rows, size):
                part = held.slice(i, size).to_pylist()
                spans = scanner.scan([(t or "").encode() for t in part])
                out += [masked(t, s) if s else t for t, s in zip(part, spans, strict=True)]
            columns = batch.columns
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    names = docs.columns
    at = names.index(text_col)
    bound_batches(docs.sparkSession)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    return plain.mapInArrow(run, plain.schema).toDF(*names)
