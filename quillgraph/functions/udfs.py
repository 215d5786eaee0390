"""Arrow-batched Python functions: only what the built-ins cannot express."""
from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc_fold(names: pd.Series) -> pd.Series:
    return names.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip().casefold())


def fold_name(col: Column) -> Column:
    """NFKC, trimmed, case folded."""
    return _nfkc_fold(col)


def with_folded(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds the folded name. Rows stay where they are: a join on distinct names would shuffle whole rows by name."""
    return df.select(name, *[c for c in df.columns if c != name]).withColumn(out, fold_name(F.col(name)))


def attempts(raw: bytes, detector: Callable[[bytes], str | None] | None) -> Iterator[tuple[str, int, str]]:
    """(codec, bytes to skip, label) in the order of trial. A mark settles the codec; guesses are tried only without one."""
    marks = ((codecs.BOM_UTF8, "utf-8", "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le", "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be", "utf-16-be"))
    marked = [(codec, len(mark), label) for mark, codec, label in marks if raw.startswith(mark)]
    if marked:
        yield marked[0]
        return
    yield "utf-8", 0, "utf-8"
    yield "gb18030", 0, "gb18030"
    guess = detector(raw) if detector else None
    for codec in ([guess] if guess else []) + ["utf-16-le", "utf-16-be"]:
        yield codec, 0, codec.lower()


def decoded(raw: bytes, detector: Callable[[bytes], str | None] | None = None) -> tuple[str | None, str | None]:
    """Strict decoding, never lossy. What is installed on an executor plays no part: a statistical detector is the caller's argument."""
    for codec, skip, label in attempts(raw, detector):
        try:
            return raw[skip:].decode(codec), label
        except (LookupError, UnicodeDecodeError):
            continue
    return None, None


PART_BYTES, PART_ROWS = 4_000_000, 8_192  # what a task turns into Python objects at a time


def parts(sizes: Iterable[int], most: int = PART_BYTES, rows: int = PART_ROWS) -> Iterator[slice]:
    """Consecutive slices of rows with these sizes: up to ``most`` together and ``rows`` in number, one row at least."""
    first = total = end = 0
    for size in sizes:
        if end > first and (total + size > most or end - first >= rows):
            yield slice(first, end)
            first, total = end, 0
        total += size
        end += 1
    if end > first:
        yield slice(first, end)


_ALNUM = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def pairs_of(texts: pa.StringArray) -> pa.ListArray:
    """The overlapping pairs of neighbouring A-Z, a-z, 0-9 and U+3400 to U+9FFF of each text, in order; null for null.

    They are found on the UTF-8 bytes of all texts at once: these characters take one byte, or three that begin with E3 90 to E9.
    """
    texts = pa.concat_arrays([texts])  # a slice comes with the bytes of the rows around it
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low = int(offsets[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:int(offsets[-1])] if offsets[-1] > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    first = np.flatnonzero((data & 0xC0) != 0x80)
    lead, second = data[first], data[np.minimum(first + 1, len(data) - 1)] if len(data) else data
    wide = ((lead >= 0xE4) & (lead <= 0xE9)) | ((lead == 0xE3) & (second >= 0x90))
    fits = _ALNUM[lead] | wide
    width = np.where(wide, 3, 1)
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True  # the first character of a text follows none
    here = np.flatnonzero(fits[:-1] & fits[1:] & ~opens[first[1:]])
    start, size = first[here], width[here] + width[here + 1]
    ends = np.concatenate(([0], np.cumsum(size)))
    taken = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    pairs = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(taken))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, offsets), pa.int32()), pairs, mask=texts.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _character_pairs(texts: pa.Array) -> pa.Array:
    own = [pairs_of(texts[part]) for part in parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), PART_BYTES // 4)]
    return pa.concat_arrays(own) if own else pa.array([], pa.list_(pa.string()))


def character_pairs(col: Column) -> Column:
    """Character pairs of every letter/digit/CJK run, a megabyte of text at a time."""
    return _character_pairs(col)


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, content) to (path, text, encoding), a few megabytes at a time: a batch of many files is never spelled out as a whole."""
    for batch in batches:
        path, content = batch.column("path"), batch.column("content")
        for part in parts(pc.fill_null(pc.binary_length(content), 0).to_pylist()):
            pairs = [decoded(c.as_py()) for c in content[part]]
            yield pa.RecordBatch.from_arrays([path[part], pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())],
                                             names=["path", "text", "encoding"])


def slice_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (corpus_id, text, spans[]) to one row per span with its text. The columns of the spans stay in Arrow; texts are decoded, and
    slices leave, a few megabytes at a time, so memory follows neither the rows of a batch nor the spans of a text."""
    for batch in batches:
        for part in parts(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
            ids, texts, lists = (batch.column(c)[part] for c in ("corpus_id", "text", "spans"))
            texts, flat, owner = texts.to_pylist(), lists.flatten(), pc.list_parent_indices(lists)
            starts, ends, owners = flat.field("start_char").to_pylist(), flat.field("end_char").to_pylist(), owner.to_pylist()
            for own in parts(max(0, (b or 0) - (a or 0)) for a, b in zip(starts, ends)):
                cut = [texts[o][a:b] for o, a, b in zip(owners[own], starts[own], ends[own])]
                yield pa.RecordBatch.from_arrays([ids.take(owner[own]), *[flat.field(n)[own] for n in names], pa.array(cut, pa.string())],
                                                 names=["corpus_id", *names, "text"])


def slice_text(corpus: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``text`` to spans (corpus_id, start_char, end_char and any other columns).

    The spans of a corpus travel to its text as one list, so a text is decoded once instead of once
    per span, and the slices leave with their columns: no text is shuffled to meet its span again.
    """
    fields = [f for f in spans.schema.fields if f.name not in ("corpus_id", "text")]
    names = [f.name for f in fields]
    lists = spans.groupBy("corpus_id").agg(F.collect_list(F.struct(*names)).alias("spans"))

    out = T.StructType([T.StructField("corpus_id", corpus.schema["corpus_id"].dataType), *[T.StructField(f.name, f.dataType) for f in fields],
                        T.StructField("text", T.StringType())])
    return corpus.select("corpus_id", "text").join(lists, "corpus_id").mapInArrow(lambda batches: slice_batches(batches, names), out)


def extract_candidates(windows: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """Runs a candidate extractor (window payload JSON -> batch JSON) over the windows in Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"corpus_id": frame["corpus_id"], "unit_id": frame["unit_id"], "payload": [fn(p) for p in frame["payload"]]})
    id_type = dict(windows.dtypes)["corpus_id"]
    return windows.select("corpus_id", "unit_id", "payload").mapInPandas(run, f"corpus_id {id_type}, unit_id string, payload string")
