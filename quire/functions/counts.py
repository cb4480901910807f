"""What texts hold, counted in each text on Arrow batches, before any row is made of it."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

# A batch's bytes, which the JVM and its worker hold at once, and how many rows a batch of results has.
BATCH_BYTES, ROWS = 16 << 20, 20_000
_FOLD = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_GLUE = b"*`\\"
_WORD, _UNIT = re.compile(rb"[0-9a-z]+"), re.compile(rb"[0-9a-z]+[,.;:!)]")


def words(text: bytes) -> list[bytes]:
    """As text.words, on UTF-8."""
    return _WORD.findall(text.translate(_FOLD, _GLUE))


def units(text: bytes) -> list[bytes]:
    """As text.punctuation_units, on UTF-8."""
    return _UNIT.findall(text.translate(_FOLD, _GLUE))


def characters(text: bytes) -> str:
    return text.decode("utf-8", "replace")


def openings(text: bytes) -> list[bytes]:
    """The first word of each line that has one."""
    found = (_WORD.search(line) for line in text.translate(_FOLD, _GLUE).split(b"\n"))
    return [m[0] for m in found if m]


def drawn_evidence(text: bytes, wanted: set[bytes], most: int) -> Iterator[tuple[bytes, bytes]]:
    """(word, evidence) of each wanted word: the first `most` different lines that draw it, and how many more there are."""
    shown: dict[bytes, list[bytes]] = {}
    total: Counter[bytes] = Counter()
    for line in dict.fromkeys(text.split(b"\n")):
        here = wanted.intersection(words(line))
        total.update(here)
        for w in here:
            if total[w] <= most:
                shown.setdefault(w, []).append(line)
    for w, lines in shown.items():
        yield w, b" | ".join(lines) + (b" | +%d more lines" % (total[w] - most) if total[w] > most else b"")


def of_texts(df: DataFrame, key: str, texts: list[str], fields: dict[str, str], rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """(key, fields...) of rows(bytes of each text...) for each row of df; a null text is empty."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = conf.get(name).rstrip("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    types = {"bigint": LongType(), "string": StringType()}
    schema = StructType([df.schema[key], *(StructField(n, types[t]) for n, t in fields.items())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, out = batch.column(0), [], []

            def full() -> pa.RecordBatch:
                columns = zip(*out, strict=True)
                # Rows hold UTF-8 as bytes: an array of binary is read as strings without a copy.
                made = [pa.array(c, pa.binary()).view(pa.string()) if f.type == pa.string() else pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())).cast(arrow.field(0).type), *made], schema=arrow)

            for i in range(batch.num_rows):
                for row in rows(*(batch.column(k + 1)[i].as_py() or b"" for k in range(len(texts)))):
                    at.append(i)
                    out.append(row)
                    if len(out) >= ROWS:
                        yield full()
                        at, out = [], []
            if out:
                yield full()

    return df.select(key, *(F.col(t).cast("binary").alias(f"__{k}") for k, t in enumerate(texts))).mapInArrow(run, schema)


def differing(items: Callable[[bytes], list[bytes] | str], openings: Callable[[bytes], list[bytes]] | None, every: bool) -> Callable[..., Iterator[tuple]]:
    """rows(text, outputs...) of (item, how often it opens a line if that is asked for, its count in each).

    Without `every`, only items of which some output has another number than the text.
    """

    def rows(*texts: bytes) -> Iterator[tuple]:
        n = [Counter(items(texts[0]))]
        for k, t in enumerate(texts[1:], 1):
            same = next((j for j in range(k) if t == texts[j]), None)
            n.append(Counter(items(t)) if same is None else n[same])
        first = n[0]
        others = [m for m in n if m is not first]
        if every:
            found = set(first).union(*others)
        else:
            found = {w for m in others for w, _ in first.items() ^ m.items()}
        opens = Counter(openings(texts[0])) if openings and found else None
        for w in found:
            item = w.encode() if isinstance(w, str) else w
            yield (item, *([opens[w]] if opens is not None else []), *(m[w] for m in n))

    return rows


def evident(least: int, most: int) -> Callable[..., Iterator[tuple]]:
    """rows(text, outputs...) of drawn_evidence of the words whose inline occurrences some output lacks more than `least` of."""
    counts = differing(words, openings, False)

    def rows(*texts: bytes) -> Iterator[tuple]:
        wanted = {w for w, opening, drawn, *n in counts(*texts) if drawn - opening - min(n) > least}
        if wanted:
            yield from drawn_evidence(texts[0], wanted, most)

    return rows
