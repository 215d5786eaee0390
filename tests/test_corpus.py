"""Golden rows for text preparation; texts are written for these tests."""
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import udfs
from quillgraph.functions.numerals import chinese_value, english_value, roman_value
from quillgraph.functions.spans import CHUNK_SIZES, PASSAGE_SIZES, Breaks, pieces
from quillgraph.functions.text import fold
from quillgraph.operators import headings as H
from quillgraph.operators import sections as S
from quillgraph.operators.lines import line_of, line_table
from quillgraph.sources.corpora import audit_manifests, decode_files, dedup_corpora, scan_text_corpus

BODY = "山风吹过旧城的石阶，行人各自归家。" * 30


def corpus(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "corpus_id bigint, text string")


def test_lines_follow_every_terminator(spark):
    text = "a\r\nb\rc\x0bd\x85e f\n\ng"
    rows = line_table(corpus(spark, text)).orderBy("line_no").collect()
    pieces_ = text.splitlines(keepends=True)
    assert [r.end_char - r.start_char for r in rows] == [len(p) for p in pieces_]
    assert [r.raw_text for r in rows] == [p.rstrip("\r\n") for p in pieces_]
    assert rows[-1].end_char == len(text)


def test_line_of_is_the_line_holding_the_position(spark):
    text = "one\ntwo\n\nthree"
    points = spark.createDataFrame([(0, p) for p in range(len(text))], "corpus_id bigint, pos bigint")
    got = {r.pos: r.line for r in line_of(points, line_table(corpus(spark, text)), "pos", "line").collect()}
    assert got == {p: text[:p].count("\n") + 1 for p in range(len(text))}


@pytest.mark.parametrize("value, expected", [("十", 10), ("二十三", 23), ("一百零八", 108), ("两千零二", 2002), ("一万二千", 12000), ("二〇二四", 2024), ("三百万", 3000000)])
def test_chinese_numerals(spark, value, expected):
    assert spark.range(1).select(chinese_value(F.lit(value)).alias("v")).first().v == expected


@pytest.mark.parametrize("value, expected", [("IV", 4), ("xlii", 42), ("MCMXC", 1990), ("seven", 7), ("12", 12)])
def test_english_numerals(spark, value, expected):
    assert spark.range(1).select(english_value(F.lit(value)).alias("v")).first().v == expected


def test_full_case_folding(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁne", "ŉ", "ΐ", "µ", "Ǆ", "plain"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold(F.col("w")).alias("f")).collect()
    assert {r.w: r.f for r in rows} == {w: w.casefold() for w in words}


@pytest.mark.parametrize("heads, detector", [
    (["第一章 起程", "第二章 渡口", "第三章 归来"], "di_unit"), (["1、起程", "2、渡口", "3、归来"], "numeric"), (["（一）起程", "（二）渡口", "（三）归来"], "chinese_numeric"),
    (["Chapter I Dawn", "Chapter II Noon", "Chapter III Dusk"], "english"), (["起程的早晨", "渡口的中午", "归来的夜里"], "plain")])
def test_heading_families(spark, heads, detector):
    text = "\n\n".join(f"{h}\n\n{BODY}" for h in heads)
    c = corpus(spark, text)
    scored = H.score_candidates(H.detector_stats(H.detect_candidates(line_table(c))))
    report = H.structure_report(c, scored).first()
    assert (report.strategy, report.heading_count, report.detectors_used) == ("detected_headings", 3, [detector])
    got = [r.raw_text for r in H.accepted_headings(scored).orderBy("start_char").collect()]
    assert got == heads


def test_dense_list_is_no_structure(spark):
    text = "\n".join(f"{i}、条目" for i in range(1, 20)) + "\n\n" + BODY
    c = corpus(spark, text)
    report = H.structure_report(c, H.score_candidates(H.detector_stats(H.detect_candidates(line_table(c))))).first()
    assert report.fallback_used and report.heading_count == 0 and report.confidence == 0.0


def test_sections_chunks_and_passages_are_slices(spark):
    text = "卷首的话。\n\n" + "\n\n".join(f"第{n}章 标题\n\n" + (BODY + "\n\n") * 8 for n in "一二三")
    flat = "没有标题的长文。" * 900
    c = corpus(spark, text, flat)
    chunks, sections = S.chunks_and_sections(c, H.headings_of(line_table(c)))
    rows = chunks.collect()
    texts = {0: text, 1: flat}
    assert all(texts[r.corpus_id][r.start_char:r.end_char] == r.text and len(r.text) <= 2500 for r in rows)
    titles = [r.title for r in sections.filter("corpus_id = 0").orderBy("section_order").collect()]
    assert titles == ["卷首内容", "第一章 标题", "第二章 标题", "第三章 标题"]
    loose = sections.filter("corpus_id = 1").orderBy("section_order").collect()
    assert len(loose) == len([r for r in rows if r.corpus_id == 1]) and not any(r.detected for r in loose)
    passages = S.passage_table(chunks).collect()
    assert all(texts[p.corpus_id][p.start_char:p.end_char] == p.text and len(p.text) <= 700 for p in passages)
    assert {p.parent_chunk_id for p in passages} == {r.chunk_id for r in rows}


@pytest.mark.parametrize("sizes", [CHUNK_SIZES, PASSAGE_SIZES])
def test_pieces_cover_and_end_at_breaks(sizes):
    rng = random.Random(5)
    text = "".join(rng.choice(["词", "word ", "。", "\n", "\n\n", "！", " "]) if rng.random() < .2 else "文" for _ in range(30000))
    found = list(pieces(text, 0, len(text), **sizes))
    covered = set()
    for a, b in found:
        assert b - a <= sizes["maximum"] and text[a:b] == text[a:b].strip()
        covered.update(range(a, b))
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)
    for a, b in found[:-1]:
        near = text[b:b + 1]
        assert near.isspace() or text[b - 1] in "。！？!?" or b - a == sizes["maximum"] or not re.search(r"[。！？!?\n]", text[a + sizes["minimum"]:a + sizes["maximum"]])


def test_numerals_of_any_shape(spark):
    """Units without digits, repeated and leading zeros, several digits in a row, two signs for ten thousand; Roman signs in any order."""
    rng = random.Random(9)
    digits, units = dict(zip("零〇一壹二两贰三叁四肆五伍六陆七柒八捌九玖", map(int, "001122233445566778899"))), {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}

    def part(text):
        pairs = re.findall("([^十拾百佰千仟]*)([十拾百佰千仟])", text)
        return sum(max(1, digits[d[-1]] if d else 1) * units[u] for d, u in pairs) + (digits[text[-1]] if text and text[-1] in digits else 0)

    def chinese(text):
        if all(c in digits for c in text):
            return int("".join(str(digits[c]) for c in text))
        *large, last = re.split("[万萬]", text)
        return 10_000 * sum(map(part, large)) + part(last)

    def roman(text):
        values = ["IVXLCDM".index(c) for c in text]
        return sum((-1 if any(w > v for w in values[i + 1:]) else 1) * (1, 5, 10, 50, 100, 500, 1000)[v] for i, v in enumerate(values))
    texts = ["".join(rng.choices("零〇一二两三五九十百千万萬贰拾佰", k=rng.randint(1, 8))) for _ in range(300)] + ["一百零五", "十", "二十", "三千零二十一", "一万零一", "百万", "零十", "二〇二四"]
    signs = ["".join(rng.choices("IVXLCDM", k=rng.randint(1, 7))) for _ in range(200)] + ["XIV", "MCMXCIV", "IIX", "VIX"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chinese_value(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == {t: chinese(t) for t in texts}
    got = spark.createDataFrame([(t,) for t in signs], "t string").select("t", roman_value(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == {t: roman(t) for t in signs} and roman("MCMXCIV") == 1994
    assert spark.createDataFrame([("",), ("y",), (None,)], "t string").select(chinese_value(F.col("t")).alias("v"), roman_value(F.col("t")).alias("w")).distinct().collect() == [(None, None)]


def nearest_rule(text, low, high, goal):
    """The closest end of a break among all matches inside the window, by distance, kind and position."""
    patterns = (r"\n\s*\n", r"[。！？!?]\s*", r"\n")
    found = [(abs(low + m.end() - goal), kind, low + m.end()) for kind, p in enumerate(patterns) for m in re.finditer(p, text[low:high])]
    return min(found)[2] if found else None


def test_breaks_by_binary_search_are_those_of_the_window():
    """Windows that cut runs of blanks, empty texts, texts without a blank and without anything else."""
    rng = random.Random(8)
    signs = ["词", "w", "。", "\n", "\n\n", "！ ", " ", "?", "\t", "\n \n", "𠮷", "\u3000", "\x1c"]
    for _ in range(1500):
        text = "".join(rng.choices(signs, [rng.random() ** 3 for _ in signs], k=rng.choice([0, 1, 6, 60])))
        breaks, low = Breaks(text), rng.randint(0, len(text))
        high = rng.randint(low, len(text))
        goal = rng.randint(low, high)
        assert breaks.nearest(low, high, goal) == nearest_rule(text, low, high, goal)
        body = text[low:high]
        a, b = breaks.tight(low, high)
        assert text[a:b] == body.strip() and (not body.strip() or a == low + len(body) - len(body.lstrip()))
        sizes = {"minimum": 5, "target": 9, "maximum": 14, "overlap": 3}
        shifted = [(low + x, low + y) for x, y in pieces(body, 0, len(body), **sizes)]
        assert list(breaks.pieces(low, high, **sizes)) == list(pieces(text, low, high, **sizes)) == shifted


def test_chunking_time_is_linear_in_the_sections(spark):
    """Four times the sections take about four times the time, in Python and through the chunk table."""
    def seconds(sections):
        text = "\n".join("word " * 480 for _ in range(sections))
        spans = [(k * 2401, min((k + 1) * 2401, len(text))) for k in range(sections)]
        runs = []
        for _ in range(3):
            started = time.perf_counter()
            breaks = Breaks(text)
            assert sum(1 for a, b in spans for _ in breaks.pieces(a, b, **CHUNK_SIZES)) == sections
            runs.append(time.perf_counter() - started)
        return min(runs)
    assert seconds(1600) < 6 * seconds(400)
    text = "".join(f"Chapter {k}\n\n" + "word " * 400 + "\n\n" for k in range(1, 401))
    corpus = spark.createDataFrame([(1, text)], "corpus_id bigint, text string")
    chunks, sections = S.chunks_and_sections(corpus, H.headings_of(line_table(corpus)))
    assert sections.count() == 400 and {(r.section_order, r.chunk_in_section) for r in chunks.collect()} == {(k, 0) for k in range(400)}


def test_decoding_of_files(spark, tmp_path):
    text = "第一行\n第二行：旧城\n"
    for name, codec in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "utf-16"), ("d", "gb18030")):
        (tmp_path / f"{name}.txt").write_bytes(text.encode(codec))
    (tmp_path / "blank.txt").write_bytes(b"  \n")
    good, bad = scan_text_corpus(spark, str(tmp_path))
    rows = good.collect()
    assert len(rows) == 4 and {r.text for r in rows} == {text} and len({r.source_hash for r in rows}) == 1
    assert {r.encoding for r in rows} == {"utf-8", "utf-8-sig", "utf-16-le", "gb18030"}
    assert [r.reason for r in bad.collect()] == ["blank"]


def test_dedup_keeps_the_earliest(spark):
    rows = [(1, "x", 5), (2, "x", 3), (3, "y", 1), (4, "x", 3)]
    got = dedup_corpora(spark.createDataFrame(rows, "corpus_id bigint, text string, created_at bigint")).collect()
    assert {(r.corpus_id, r.copies) for r in got} == {(2, 3), (3, 1)}


def test_texts_are_sliced_and_decoded_a_few_megabytes_at_a_time():
    texts = [f"{i:05d}" + "äb" * (i % 900) for i in range(12_000)]
    spans = [[{"start_char": a, "end_char": a + 40 * (i % 3), "n": a} for a in range(i % 4)] for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(spans)], names=["corpus_id", "text", "spans"])
    out = list(udfs.slice_batches(iter([batch.slice(3, 11_000)]), ["start_char", "end_char", "n"]))
    got = [(r["corpus_id"], r["start_char"], r["text"]) for b in out for r in b.to_pylist()]
    assert got == [(i, s["start_char"], texts[i][s["start_char"]:s["end_char"]]) for i in range(3, 11_003) for s in spans[i]]
    assert len(out) > 1 and max(b.num_rows for b in out) <= udfs.PART_ROWS
    files = pa.RecordBatch.from_arrays([pa.array(map(str, range(len(texts)))), pa.array([t.encode() for t in texts])], names=["path", "content"])
    out = list(udfs.decode_batches(iter([files])))
    assert [r["text"] for b in out for r in b.to_pylist()] == texts
    assert len(out) > 1 and max(sum(len(t.as_py().encode()) for t in b.column("text")) for b in out) <= udfs.PART_BYTES
    assert list(udfs.parts([])) == [] and list(udfs.parts([9, 1, 1, 5, 0], 6)) == [slice(0, 1), slice(1, 3), slice(3, 5)]
