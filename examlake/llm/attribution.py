"""Token counts of sections, from one encoding of each whole document.

Texts are encoded as wholes, so a count doesn't depend on how sections cut the text. Each token has a character span; spans are joined
with the sections' intervals by their sorted ends. A token that reaches over a boundary is allotted by RULE:
"most": to the section that holds most of its characters (ties: the earlier one); "first": to the section of its first character.
A token that holds a part of a character only (byte-level vocabularies cut characters) counts as spanning the whole character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encode, token_bytes
from .shared import releasing, text_column

RULE = "most"


def token_spans(text: str, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and the first and last + 1 character of each token."""
    ids, raw = encode(text, folder), np.frombuffer(text.encode(), np.uint8)
    stop = np.cumsum(token_bytes(folder)[ids])
    start = np.concatenate([[0], stop[:-1]]) if len(ids) else stop
    char = np.cumsum((raw & 0xC0) != 0x80)  # of each byte, counted from 1
    return ids, char[start] - 1 if len(ids) else start, char[stop - 1] if len(ids) else stop


def line_sections(text: str) -> np.ndarray:
    """The ends of the lines; a line holds the line end behind it. A text that ends with a line end has no empty line after it."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    return np.append(ends, len(text)) if not len(ends) or ends[-1] != len(text) else ends


def allotted(first: np.ndarray, last: np.ndarray, ends: np.ndarray, rule: str = RULE) -> tuple[np.ndarray, np.ndarray]:
    """For each token, its section and whether it crosses a boundary; sections lie between the sorted ends, starting at 0."""
    low, high = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last - 1, "right")
    owner, crossing = low.copy(), high > low
    if rule == "most":
        for t in np.flatnonzero(crossing):
            cuts = np.concatenate([[first[t]], ends[low[t] : high[t]], [last[t]]])
            owner[t] = low[t] + int(np.argmax(np.diff(cuts)))
    return owner, crossing


def _counted(rule: str, folder: str | None):
    names = ("doc_id", "section", "start", "stop", "n_tokens", "n_crossing", "doc_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, out, ids_of = batch.slice(i, 500), [], []
                given = part.column("ends").to_pylist() if "ends" in part.schema.names else [None] * part.num_rows
                for doc_id, text, own in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), given, strict=True):
                    ends = line_sections(text) if own is None else np.unique(np.append(np.clip(own, 0, len(text)), len(text)).astype(np.int64))
                    ids, first, last = token_spans(text, folder)
                    owner, crossing = allotted(first, last, ends, rule)
                    n = len(ends)
                    ids_of += [doc_id] * n
                    out.append((np.arange(n), np.concatenate([[0], ends[:-1]]), ends, np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n), np.full(n, len(ids))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(ids_of, pa.int64()), *[pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)]], names=list(names))

    return run


def section_tokens(docs: DataFrame, sections: DataFrame | None = None, rule: str = RULE, folder: str | None = None) -> DataFrame:
    """doc_id, section, start, stop (characters), n_tokens, n_crossing (of these, how many reach over a boundary), doc_tokens.

    sections (doc_id, stop): the ends of each document's sections; none: its lines. Sections cover the text, so a document's n_tokens sum
    up to doc_tokens. Null texts are empty and have one empty section; documents without a row in sections are taken by lines. Repeated ends
    count once. A null doc_id stays null and is taken by lines. Repeated rows of docs each give their sections; other columns don't matter; an empty table gives no rows.
    """
    plain = docs.select("doc_id", text_column())
    if sections is not None:
        ends = sections.where("doc_id is not null and stop is not null").groupBy("doc_id").agg(F.collect_set(F.col("stop").cast("long")).alias("ends"))
        plain = plain.join(ends, "doc_id", "left")
    schema = "doc_id long, section long, start long, stop long, n_tokens long, n_crossing long, doc_tokens long"
    return plain.mapInArrow(releasing(_counted(rule, folder)), schema)
