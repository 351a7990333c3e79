"""Token counts by offset-mapped attribution.

A document is one string: its fields joined by newlines.  It is encoded once,
as a whole.  The tokens of a byte-level vocabulary spell the text exactly, so
running sums of token byte lengths give byte spans, and a running count of
UTF-8 lead bytes turns those into character spans.  Token spans and section
spans are both sorted, so the interval join is a binary search.

A token that crosses a boundary is given to sections by one of these rules:

* ``start``: to the section that holds its first character;
* ``end``: to the section that holds its last character;
* ``overlap``: to the section with most of its characters, the first on ties;
* ``split``: to each section in proportion to characters (fractions).

Under the first three rules the counts add up to the document's tokens, and
under ``split`` they do so up to rounding.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RULES = ("start", "end", "overlap", "split")


@functools.cache
def built(ranks_file: bytes, pattern: str):
    """The encoder of a rank file's content, and its tokens' byte lengths."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


@functools.cache
def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(path: str, pattern: str):
    return built(read(path), pattern)


def token_char_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Character start and end of each token.  A token inside a character covers that character."""
    return char_spans(text, *encoder(path, pattern))


def char_spans(text: str, enc, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(enc.encode_ordinary(text), np.int64)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if ends[-1] == len(text):
        return starts, ends  # ASCII: bytes are characters
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    char = np.concatenate([[0], np.cumsum(lead)])  # characters that begin before each byte
    return char[starts + 1] - 1, char[ends]


def section_spans(fields: Sequence[str]) -> tuple[list[int], list[int], list[int]]:
    """Field number, start and end of each section: the lines of each field, with their newline.

    The newline between fields belongs to the field before it.  An empty last field has no section.
    """
    owner, starts, ends, at = [], [], [], 0
    for k, text in enumerate(fields):
        whole = text + "\n" * (k + 1 < len(fields))
        for line in re.findall(r"[^\n]*\n|[^\n]+", whole):
            owner.append(k)
            starts.append(at)
            at += len(line)
            ends.append(at)
    return owner, starts, ends


def attribute(tok_start: np.ndarray, tok_end: np.ndarray, sec_start: np.ndarray, sec_end: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """Tokens per section, and how many tokens cross a boundary.  Sections are sorted and tile the text."""
    n = len(sec_start)
    counts = np.zeros(n)
    if not n or not len(tok_start):
        return counts, 0
    first = np.searchsorted(sec_start, tok_start, "right") - 1
    last = np.searchsorted(sec_start, np.maximum(tok_end - 1, tok_start), "right") - 1
    crossing = first != last
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float), int(crossing.sum())
    counts += np.bincount(first if rule == "start" else first[~crossing], minlength=n)
    if rule in ("overlap", "split"):
        for a, b, i, j in zip(tok_start[crossing], tok_end[crossing], first[crossing], last[crossing], strict=True):
            part = np.minimum(sec_end[i : j + 1], b) - np.maximum(sec_start[i : j + 1], a)
            if rule == "overlap":
                counts[i + int(part.argmax())] += 1
            else:
                counts[i : j + 1] += part / (b - a)
    return counts, int(crossing.sum())


SCHEMA = "doc_id bigint, n_chars bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, field_tokens array<double>, section_start array<bigint>, section_tokens array<double>"


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, fields: Sequence[str] = ("text",), rule: str = "start") -> DataFrame:
    """One row per row of ``docs``: its tokens in all, by field, and by section (line).

    Rows are independent: no shuffle, and a batch is encoded row by row.  A
    null field is an empty one; a document without characters has no tokens
    and no sections.  Repeated rows repeat.  Other columns are ignored.
    ``vocabulary`` is read on the driver, and its content (a file of a few MB) is sent to the executors once.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    ranks = docs.sparkSession.sparkContext.broadcast(read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = built(ranks.value, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            columns = [batch.column(1 + k) for k in range(len(names))]
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                values = [c[i].as_py() or "" for c in columns]
                text = "\n".join(values)
                ts, te = char_spans(text, enc, sizes)
                owner, ss, se = section_spans(values)
                counts, crossing = attribute(ts, te, np.asarray(ss, np.int64), np.asarray(se, np.int64), rule)
                by_field = np.bincount(np.asarray(owner, np.int64), weights=counts, minlength=len(names)) if owner else np.zeros(len(names))
                for column, value in zip(out, (doc_id, len(text), len(ts), len(ss), crossing, by_field, ss, counts), strict=True):
                    column.append(value)
            types = [pa.int64()] * 5 + [pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", *(f"CAST(`{n}` AS string) AS f{k}" for k, n in enumerate(names))).mapInArrow(run, SCHEMA)
