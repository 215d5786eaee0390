"""Fill-in-middle: each text is cut at two token borders, and middle and suffix change places behind marks.

One full match of a repeated unit covers the whole text and keeps every repetition as a capture, so its list of capture ends is the
list of token borders: its length is the number of tokens, and two lookups give both cuts. The quantifiers are possessive, because
a blank given back never helps a unit to match; so the match is linear and keeps no states to return to. Cuts and forms follow a
digest of the document's id alone, so reruns agree wherever a row lies.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import need

UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
# The marks, and what the numbers of a document are hashed with.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42:"
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
OUT_BYTES = 1 << 23
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(tokens, end of the prefix, end of the middle): the two numbers, modulo tokens + 1, count the units before each cut."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def transformed(doc_id: int | None, text: str, seed: str, cut_percent: int, suffix_first_percent: int) -> tuple:
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))
    n, a, b = cuts(text, h1, h2)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= cut_percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _batches(seed: str, cut_percent: int, suffix_first_percent: int):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                doc_id = doc_id.as_py()
                rows.append((doc_id, *transformed(doc_id, text.as_py() or "", seed, cut_percent, suffix_first_percent)))
                held += len(rows[-1][-1])
                if held > OUT_BYTES:  # rows leave in pieces of bounded size; a longer text comes alone
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)
    return run


def fill_in_middle(docs: DataFrame, seed: str = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per document; docs: doc_id, text.

    n counts the tokens: a run of blanks with the word behind it, or blanks at the end. The form is ``plain`` (output is the text,
    no cuts), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). Lengths are code points.

    A null text is an empty one: plain, n 0, output empty. A null id is hashed as an empty string. Equal cuts give an empty middle.
    Texts that hold a mark stay plain, so that a mark in an output is always one that was set. Very long texts are cut whole, with
    one list of borders at a time. Repeated rows are cut alike, each for itself. Other columns are dropped, whatever their names.
    Without documents there are no rows.
    """
    return need(docs, doc_id="long", text="string").mapInArrow(_batches(seed, cut_percent, suffix_first_percent), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The original text, from output and form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)))
            .when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(output))
