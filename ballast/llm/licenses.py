"""License scans with a positional rare-token index, in DataFrame functions only.

Templates are word sequences. The document frequency of every template word is counted over all documents; a template is
posted under its word of highest inverse document frequency (ties: the earlier) and, as that one may be altered in a copy,
under the rarest word of its mandatory key phrase, without which it can't count: so no place that counts is without a posting. Of each file only the words that have
postings are looked up; a word at position p and a posting at offset o propose the template at p - o. A place that only a
key phrase's word proposes is reported if it counts. The words around
are compared there by relative position: `coverage` is the share of the template's words that stand in their places. A
template counts at coverage 1 if it is a phrase, else from 0.8 if its mandatory key phrase is complete at that place.
Nothing is exchanged but the frequencies: a file's row never leaves its partition.

Defined results: a null or empty text has no words, labels '' and score 0; places are counted with overlaps; repeated rows
repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_COVERAGE = 0.8

#: (label, words, mandatory key phrase or None for a phrase that counts only as a whole, is it a base phrase)
TEMPLATES = [
    ("gpl", "gnu general public license", None, True),
    ("apache", "apache license", None, True),
    ("cc-by", "cc by", None, True),
    ("mit", "mit license", None, True),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted free of charge", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms", False),
    ("apache", "licensed under the apache license version 2 0", "apache license", False),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license", False),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice", False),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products", False),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "on an as is basis", False),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "in the hope that it will be useful", False),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright", False),
    ("lgpl", "gnu lesser general public license", None, False),
    ("agpl", "gnu affero general public license", None, False),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", False),
    ("mpl", "mozilla public license", None, False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee", False),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software", False),
    ("bsl", "boost software license", None, False),
    ("epl", "eclipse public license", None, False),
    ("cc-by-sa", "creative commons attribution sharealike", None, False),
    ("cc-by-nc", "cc by nc", None, False),
    ("cc-by-sa", "cc by sa", None, False),
    ("zlib", "this software is provided as is without any express or implied warranty", "express or implied warranty", False),
]


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _ascii_lower(w: Column) -> Column:
    """Lower case of words of ASCII only; others keep a mark that no template word has."""
    return F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.lit("\u0080"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def rarest(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Document frequency of each template word; at most as many rows as there are template words."""
    known = F.filter(F.transform(words(F.col(text_col)), _ascii_lower), lambda w: w.isin(vocabulary))
    found = docs.select(F.explode(F.array_distinct(known)).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in found}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str | None, bool]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, found): found has template number, first word and coverage of each template that counts, by place, and of the best other."""
    terms = [t[1].split() for t in templates]
    df = rarest(docs, text_col, sorted({w for t in terms for w in t}))
    keys = []
    for (_, text, key, _), t in zip(templates, terms, strict=True):
        at = text.split(key)[0].count(" ") if key else 0
        keys.append((at, len(key.split()) if key else len(t)))
    postings: dict[str, list[tuple[int, int, bool]]] = {}
    for i, (t, (at, n)) in enumerate(zip(terms, keys, strict=True)):
        anchor, in_key = (min(within, key=lambda k: (df[t[k]], k)) for within in (range(len(t)), range(at, at + n)))
        for o in {anchor, in_key}:
            postings.setdefault(t[o], []).append((i, o, o == anchor))
    lookup = F.create_map(*[x for w, own in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(i).alias("t"), F.lit(o).alias("o"), F.lit(a).alias("anchor")) for i, o, a in own]))])
    all_terms = F.array(*[_strings(t) for t in terms])
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w"))
    rare = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("i"), _ascii_lower(w).alias("w"))), lambda x: x["w"].isin(list(postings)))
    proposed = F.flatten(F.transform("rare", lambda x: F.transform(F.element_at(lookup, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["o"]).alias("at"), p["anchor"].alias("anchor")))))

    def stands(at: Column, k: Column, term: Column) -> Column:
        return F.coalesce(_ascii_lower(F.get("w", at + k)) == term, F.lit(False))

    def coverage(x: Column) -> Column:
        own = F.get(all_terms, x["t"])
        return F.size(F.filter(F.transform(own, lambda term, k: stands(x["at"], k, term)), lambda hit: hit)) / F.size(own)

    starts, sizes = (F.array(*[F.lit(k[i]) for k in keys]) for i in (0, 1))

    def key_stands(x: Column) -> Column:
        part = F.slice(F.get(all_terms, x["t"]), F.get(starts, x["t"]) + 1, F.get(sizes, x["t"]))
        return F.forall(F.transform(part, lambda term, k: stands(x["at"] + F.get(starts, x["t"]), k, term)), lambda hit: hit)

    # the anchor proposes a place itself if it stands there
    anchors = F.array(*[F.lit(next(w for w, own in postings.items() for j, _, a in own if a and j == i)) for i in range(len(terms))])
    offsets = F.array(*[F.lit(next(o for own in postings.values() for j, o, a in own if a and j == i)) for i in range(len(terms))])
    news = F.filter("proposed", lambda x: x["anchor"] | ~stands(x["at"], F.get(offsets, x["t"]), F.get(anchors, x["t"])))
    checked = F.transform(news, lambda x: F.struct(x["t"].alias("t"), x["at"].cast("long").alias("at"), coverage(x).alias("coverage"), key_stands(x).alias("key"), x["anchor"].alias("anchor")))
    checked = F.filter(checked, lambda x: x["anchor"] | (x["key"] & (x["coverage"] >= LEAST_COVERAGE)))
    checked = F.transform(checked, lambda x: x.dropFields("anchor"))
    return base.select("doc_id", F.size("w").cast("long").alias("n_words"), "w", rare.alias("rare")).select("doc_id", "n_words", "w", proposed.alias("proposed")).select("doc_id", "n_words", checked.alias("found"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = _strings([t[0] for t in TEMPLATES])
    is_base = F.array(*[F.lit(t[3]) for t in TEMPLATES])
    is_phrase = F.array(*[F.lit(t[2] is None) for t in TEMPLATES])
    places = F.filter("found", lambda x: F.get(is_base, x["t"]) & (x["coverage"] == 1))
    counted = F.filter("found", lambda x: F.when(F.get(is_phrase, x["t"]), x["coverage"] == 1).otherwise(x["key"] & (x["coverage"] >= LEAST_COVERAGE)))
    last = F.array_max(F.transform("places", lambda x: x["at"]))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(labels, x["t"])))), ",")
    return found.withColumns({"places": places, "counted": counted}).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.transform("places", lambda x: x["at"])).alias("first_word"), last.alias("last_word"),
        names("places").alias("base_labels"), names("counted").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    rows = ",".join(f"({i},'{label}','{text}',{len(text.split())},{'true' if b else 'false'},{'true' if key is None else 'false'},{text.split(key)[0].count(' ') if key else 0},{len((key or text).split())})" for i, (label, text, key, b) in enumerate(TEMPLATES))
    return rf"""
WITH t(t, label, text, n, base, phrase, ks, kn) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
tw AS (SELECT t, n, unnest(range(n)) o, unnest(string_split(text, ' ')) w, ks, kn FROM t),
dw AS (SELECT doc_id, p, w FROM (SELECT doc_id, unnest(range(len(w))) p, unnest(w) w FROM d) WHERE w IN (SELECT w FROM tw)),
df AS (SELECT tw.w, coalesce(any_value(c), 0) c FROM tw LEFT JOIN (SELECT w, count(DISTINCT doc_id) c FROM dw GROUP BY w) x ON x.w = tw.w GROUP BY tw.w),
a AS (SELECT t, arg_min(o, (c, o)) o FROM tw JOIN df USING (w) GROUP BY t),
h AS (SELECT doc_id, t, p - o pos, count(*) c, bool_or(o = (SELECT a.o FROM a WHERE a.t = tw.t)) anchored, count(*) FILTER (o >= ks AND o < ks + kn) kc FROM dw JOIN tw USING (w) GROUP BY ALL),
f AS (SELECT doc_id, t.t, pos, label, base, phrase, h.c / t.n coverage, kc = kn AS key FROM h JOIN t USING (t) WHERE anchored OR (kc = kn AND h.c / t.n >= {LEAST_COVERAGE})),
s AS (SELECT doc_id, count(*) FILTER (base AND coverage = 1) n_base, min(pos) FILTER (base AND coverage = 1) first_word, max(pos) FILTER (base AND coverage = 1) last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND coverage = 1) base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN phrase THEN coverage = 1 ELSE key AND coverage >= {LEAST_COVERAGE} END) labels, max(coverage) score FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(n_base, 0) AS BIGINT) n_base, CAST(first_word AS BIGINT) first_word, CAST(last_word AS BIGINT) last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0) score
FROM d LEFT JOIN s USING (doc_id)
"""


OP1_SQL = _sql()
