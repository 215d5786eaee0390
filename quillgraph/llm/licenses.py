"""License texts in files through a positional index of rare words, in DataFrame functions only.

A template is a sentence of a license. It stands in a file where at least ``SHARE`` of its words stand at the same relative place and
the words of its key phrase all do. If e of its m words may differ, then of any e + 2 places two at least agree; so the index keeps
the e + 2 places with the highest inverse document frequency and no others. A file looks up those of its words that are in the index,
each posting gives the place at which the template would start, and only starts that two postings agree on are compared in full.
Rare words make few lookups, and which words are rare changes the work, never the result.

Templates are a list of bounded size; their index is a literal of the plan. A file is one row all along: nothing is exploded but
the few template words it holds, once, to count documents.
"""
from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import let, need
from quillgraph.llm.url_rules import fold

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE_PERCENT = 80
AGREEING = 2
# Phrases that name a license.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Label, a sentence of the license or of its usual notice, and the phrase in it that must stand unchanged.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mit", "spdx license identifier mit", "identifier mit"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "spdx license identifier apache 2 0", "identifier apache"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "spdx license identifier gpl 3 0 or later", "identifier gpl"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "in source and binary forms"),
    ("bsd", "spdx license identifier bsd 3 clause", "identifier bsd"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial")]

SPAN = "struct<label:string,start:int,end:int,share:double>"
PLACE = "struct<start:int,label:string>"
START_BITS = 32
_LOW = (1 << START_BITS) - 1


class Template(NamedTuple):
    label: str
    words: list[str]
    keys: list[int]  # places of the key phrase's words
    need: int  # words that must agree


def template(label: str, sentence: str, key: str) -> Template:
    words, phrase = sentence.split(), key.split()
    at = next((k for k in range(len(words) - len(phrase) + 1) if words[k:k + len(phrase)] == phrase), None)
    if at is None or not phrase:
        raise ValueError(f"the key phrase {key!r} does not stand in {sentence!r}")
    return Template(label, words, list(range(at, at + len(phrase))), -(-len(words) * SHARE_PERCENT // 100))


def words_of(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def inverse_frequencies(docs: DataFrame, templates: list[Template]) -> dict[str, float]:
    """Inverse document frequency of every template word, counted over all documents."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(words_of(fold(F.coalesce("text", F.lit("")))), F.array(*[F.lit(w) for w in vocabulary]))
    # one row per template word, and one for all documents, whatever the input
    counted = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r["word"]: r["n"] for r in counted.collect()}
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def positional_index(templates: list[Template], idf: dict[str, float]) -> dict[str, list[int]]:
    """word -> postings; a posting plus the place of the word in a file is the code of a template and the place where it starts.

    Starts are moved by the longest template, so that none is negative. A template with one needed word is posted twice.
    """
    longest, out = max(len(t.words) for t in templates), {}
    for number, t in enumerate(templates):
        rarest = sorted(range(len(t.words)), key=lambda j: (-idf[t.words[j]], j))[:len(t.words) - t.need + AGREEING]
        for j in rarest:
            out.setdefault(t.words[j], []).extend([(number << START_BITS) + longest - j] * (1 if t.need >= AGREEING else AGREEING))
    return out


def phrase_places(lowered: Column, words: Column, phrase: str, label: str) -> Column:
    """Places where the phrase's words stand one after the other; texts without its longest word are not searched."""
    own = phrase.split()
    fits = lambda i: F.forall(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for k, w in enumerate(own)]),
                              lambda p: F.coalesce(F.get(words, i + p["k"]) == p["w"], F.lit(False)))
    firsts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (F.get(words, i) == own[0]) & fits(i))
    found = F.transform(firsts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
    return F.when(lowered.contains(max(own, key=len)), found).otherwise(F.array().cast(f"array<{PLACE}>"))


def aligned(words: Column, templates: list[Template], index: dict[str, list[int]]) -> Column:
    """Spans of the templates that stand in the words, by label, start and end."""
    longest = max(len(t.words) for t in templates)
    postings = F.create_map(*[c for w, codes in index.items() for c in (F.lit(w), F.array(*[F.lit(v).cast("long") for v in codes]))])
    known = F.array(*[F.struct(F.lit(t.label).alias("label"), F.array(*map(F.lit, t.words)).alias("words"), F.array(*map(F.lit, t.keys)).alias("keys"),
                               F.lit(t.need).alias("need")) for t in templates])
    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*index))
    codes = F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(postings, F.get(words, i)), lambda p: p + i)))
    agreed = let(F.sort_array(codes), lambda s: F.array_distinct(F.filter(s, lambda c, k: F.get(s, k - (AGREEING - 1)) == c)))

    def compared(code: Column) -> Column:
        start = (code.bitwiseAND(F.lit(_LOW)) - longest).cast("int")

        def verdict(t: Column) -> Column:
            same = lambda j: F.coalesce(F.get(words, start + j) == F.get(t["words"], j), F.lit(False))
            equal = F.size(F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), same))
            span = F.struct(t["label"].alias("label"), F.greatest(start, F.lit(0)).alias("start"),
                            F.least(start + F.size(t["words"]), F.size(words)).alias("end"), (equal / F.size(t["words"])).alias("share"))
            return F.when((equal >= t["need"]) & F.forall(t["keys"], same), span)
        return let(F.get(known, F.shiftright(code, START_BITS).cast("int")), verdict)
    return F.when(F.size(hits) >= AGREEING, F.array_sort(F.array_compact(F.transform(agreed, compared)))).otherwise(F.array().cast(f"array<{SPAN}>"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = BASE) -> DataFrame:
    """(doc_id, n_words, places, spans, base_labels, labels, score), one row per document; docs: doc_id, text.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; places count them from 0. ``places`` are the
    starts of the phrases with their labels, by start; ``spans`` the templates that stand in the text (label, start, end exclusive,
    share of equal words), overlapping ones too. Labels are distinct, sorted and joined by commas. The score is 1 with a phrase,
    else the largest share, else 0.

    A null text is an empty one: no words, no labels, score 0. A template may hang over either end of a text if enough words agree.
    Very long texts are scanned whole, repeated rows each get their row, null ids are carried along; a tie of templates gives both
    spans. Other columns are dropped, whatever their names. Without documents there are no rows.
    """
    known = [template(*t) for t in templates]
    rows = need(docs, doc_id="long", text="string")
    index = positional_index(known, inverse_frequencies(rows, known))

    def scanned(lowered: Column) -> Column:
        return let(words_of(lowered), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.array_sort(F.concat(*[phrase_places(lowered, w, p, name) for p, name in phrases])).alias("places"),
            aligned(w, known, index).alias("spans")))
    found = rows.select("doc_id", let(fold(F.coalesce("text", F.lit(""))), scanned).alias("f")).select("doc_id", "f.*")
    of_base, of_spans = F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return found.select("doc_id", "n_words", "places", "spans", joined(of_base).alias("base_labels"), joined(F.concat(of_base, of_spans)).alias("labels"),
                        F.when(F.size("places") > 0, 1.0).otherwise(share).alias("score"))
