"""Licence scans by a positional index of rare words, in DataFrame operations only.

Each template is a sequence of words with a label and a mandatory key phrase. The document frequencies of the templates'
words over all documents rank them: the words of the highest IDF of each template are its postings, each with its places
in the template. The postings that a file holds are looked up; each answers with the places where the template may begin
(the place in the file less the place in the template). Where enough of them agree, give or take some words for longer
templates, the key phrase is verified word by word, and the words around it are held against the whole template: the
share of its words that are there is the score. Everything happens within the file's own row, in time that grows with
its length, so there is no key to skew and nothing to shuffle but the words' counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template that are looked up, at most; its rarest.
POSTINGS = 8
#: This share of a template's words has to be there; half of its postings have to agree.
COVER = 0.5


@dataclass(frozen=True)
class Template:
    """A label, the words that carry it, the key phrase among them that must stand in the text, and how far words may shift."""

    label: str
    words: tuple[str, ...]
    start: int
    size: int
    slack: int
    base: bool = False

    @classmethod
    def of(cls, label: str, text: str, phrase: str | None = None, base: bool = False) -> Template:
        words, key = tuple(text.split()), tuple((phrase or text).split())
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return cls(label, words, at, len(key), len(words) // 12, base)

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.start : self.start + self.size]

    def postings(self, frequency: dict[str, int]) -> dict[str, list[int]]:
        """The rarest words and their places."""
        rare = sorted(set(self.words), key=lambda w: (frequency.get(w, 0), w))[:POSTINGS]
        return {w: [i for i, x in enumerate(self.words) if x == w] for w in rare}

    def agree(self, postings: dict[str, list[int]]) -> int:
        """How many places have to agree; all of a base phrase."""
        n = sum(map(len, postings.values()))
        return n if self.base else max(1, -(-n // 2))


#: Phrases of the base scan; all of their words are mandatory.
BASE = (
    Template.of("cc-by", "cc by", base=True),
    Template.of("gpl", "general public license", base=True),
    Template.of("reserved", "all rights reserved", base=True),
)
_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {} for more details"
# The public wording of licence notices, in lower-case words, and the phrase of each that is mandatory.
TEMPLATES = (
    Template.of("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template.of("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "except in compliance with the license"),
    Template.of("mit", "released under the mit license", "mit license"),
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "permission is hereby granted free of charge"),
    Template.of("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "distribute this software for any purpose with or without fee"),
    Template.of("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    Template.of("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template.of("gpl-3.0", _FREE.format(*("general public license", 3, "general public license")), "free software foundation either version 3"),
    Template.of("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template.of("gpl-2.0", _FREE.format(*("general public license", 2, "general public license")), "free software foundation either version 2"),
    Template.of("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template.of("lgpl", _FREE.format(*("lesser general public license", 3, "lesser general public license")), "gnu lesser general public license as published"),
    Template.of("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4"),
    Template.of("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4"),
    Template.of("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    Template.of("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "the mozilla public license"),
    Template.of("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
    Template.of("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission is granted to anyone to use this software for any purpose"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_array(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, parted by ASCII bytes that are neither letters nor digits; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower()), SPLIT), lambda w: w != "")


def document_frequencies(docs: DataFrame, templates=BASE + TEMPLATES) -> dict[str, int]:
    """In how many of all documents each word of the templates stands; the result is no larger than the templates."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = docs.select(F.explode(F.array_intersect(word_array(F.col("text")), F.lit(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _places(t: Template, frequency: dict[str, int], hits: Column, words: Column) -> Column:
    """Where a template's postings agree and its key phrase stands: (at, cover), at the start of the key phrase."""
    postings = t.postings(frequency)
    offsets = F.create_map(*(F.lit(x) for pair in postings.items() for x in pair))
    own = F.filter(hits, lambda h: h["word"].isin(list(postings)))
    starts = F.array_sort(F.flatten(F.transform(own, lambda h: F.transform(F.element_at(offsets, h["word"]), lambda o: h["at"] - o))))
    # Sorted: as many as have to agree lie within the slack, if the last of them does.
    last = F.slice(starts, t.agree(postings), F.greatest(F.size(starts), F.lit(1)))
    agreed = F.array_distinct(F.filter(F.zip_with(starts, last, lambda a, b: F.when(b - a <= t.slack, a)), lambda s: s.isNotNull()))
    if t.slack:
        agreed = F.array_distinct(F.flatten(F.transform(agreed, lambda s: F.sequence(s, s + t.slack))))
    key, every = F.lit(list(t.key)), F.lit(sorted(set(t.words)))
    at = F.filter(F.transform(agreed, lambda s: s + t.start), lambda k: (k >= 0) & (F.slice(words, F.greatest(k, F.lit(0)) + 1, t.size) == key))

    def cover(k: Column) -> Column:
        first = F.greatest(k - (t.start + t.slack), F.lit(0))
        return F.size(F.array_intersect(F.slice(words, first + 1, k + (len(t.words) + t.slack - t.start) - first), every)) / len(set(t.words))

    return F.array_sort(F.filter(F.transform(at, lambda k: F.struct(k.alias("at"), cover(k).alias("cover"))), lambda x: x["cover"] >= COVER))


def scan(docs: DataFrame, frequency: dict[str, int], base=BASE, templates=TEMPLATES) -> DataFrame:
    """All columns of `docs` (text is read) and `licences`: label, base (whether a base phrase), starts, n_words of the key phrase, cover.

    And `n_licence_words`, the number of words of the text. Starts count words from 0; `cover` is the largest share of a
    template's words that stand there. A null or empty text has no words and no licence; a very long one is read whole;
    each row is judged by itself, so repeated rows, null keys and further columns of any name stay as they are (but for
    those named like the two added, which are replaced). Words of equal frequency rank by name. An empty table gives an
    empty result.
    """
    every = [*base, *templates]
    anchors = sorted({w for t in every for w in t.postings(frequency)})
    names = [c for c in docs.columns if c.lower() not in ("licences", "n_licence_words")]
    out = T.packed(docs.select(*(c for c, n in zip(T.columns(docs), docs.columns) if n in names)))
    out = out.withColumn("words", word_array(F.col("row.text")))
    marks = F.transform("words", lambda w, i: F.when(w.isin(anchors), F.struct(w.alias("word"), i.cast("int").alias("at"))))
    out = out.withColumn("hits", F.filter(marks, lambda h: h.isNotNull()))
    kind = "array<struct<at: int, cover: double>>"
    finds = []
    for t in every:
        places = F.when(F.size("hits") > 0, _places(t, frequency, F.col("hits"), F.col("words"))).otherwise(F.array().cast(kind))
        finds.append(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), places.cast(kind).alias("places"), F.lit(t.size).alias("n_words")))
    found = F.filter(F.array(*finds), lambda x: F.size(x["places"]) > 0)
    found = F.transform(found, lambda x: F.struct(x["label"].alias("label"), x["base"].alias("base"), x["places"]["at"].alias("starts"), x["n_words"].alias("n_words"), F.array_max(x["places"]["cover"]).alias("cover")))
    made = out.select("row", F.struct(found.alias("licences"), F.size("words").cast("long").alias("n")).alias("made"))
    return made.select(*(F.col("row").getField(c).alias(c) for c in names), F.col("made.licences").alias("licences"), F.col("made.n").alias("n_licence_words"))


def _labels(finds: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda x: x["label"]))), ",")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, document_frequencies(docs)).withColumn("phrases", F.filter("licences", lambda x: x["base"]))
    found = found.withColumn("starts", F.flatten(F.transform("phrases", lambda x: x["starts"])))
    # A base phrase alone scores 1/2, a notice the share of its words.
    score = F.coalesce(F.array_max(F.transform("licences", lambda x: F.when(x["base"], F.lit(0.5)).otherwise(x["cover"]))), F.lit(0.0))
    return found.select(
        "doc_id",
        F.col("n_licence_words").alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        _labels(F.col("phrases")).alias("base_labels"),
        _labels(F.col("licences")).alias("labels"),
        score.cast("double").alias("score"),
    )


#: The same with a row for each word, joins and windows.
SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT *, string_split(text, ' ') AS tw FROM (VALUES {", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, '{' '.join(t.words)}', {t.start}, {t.size}, {t.slack})" for i, t in enumerate(BASE + TEMPLATES))}) AS v(t, label, base, text, start, size, slack)),
places AS (SELECT t, unnest(tw) AS word, unnest(range(len(tw))) AS o FROM t),
tok AS MATERIALIZED (SELECT * FROM (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS at FROM d) WHERE word IN (SELECT word FROM places)),
df AS (SELECT word, count(DISTINCT rid) AS n FROM tok GROUP BY word),
ranked AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), word) AS r FROM (SELECT DISTINCT t, word FROM places) LEFT JOIN df USING (word)),
post AS MATERIALIZED (SELECT p.t, p.word, p.o, count(*) OVER (PARTITION BY p.t) AS n FROM places p JOIN ranked r ON r.t = p.t AND r.word = p.word AND r.r <= {POSTINGS}),
votes AS (SELECT k.rid, p.t, k.at - p.o AS s, CASE WHEN t.base THEN p.n ELSE greatest(1, (p.n + 1) // 2) END AS need, t.slack FROM tok k JOIN post p USING (word) JOIN t ON t.t = p.t),
agreed AS (SELECT DISTINCT rid, t, s FROM (SELECT *, lead(s, (need - 1)::INT) OVER (PARTITION BY rid, t ORDER BY s) AS e FROM votes) WHERE e - s <= slack),
tried AS (SELECT DISTINCT rid, t, k FROM (SELECT a.rid, a.t, unnest(range(s + start, s + start + slack + 1)) AS k FROM agreed a JOIN t USING (t)) WHERE k >= 0),
found AS MATERIALIZED (
  SELECT f.rid, t.label, t.base, f.k, len(list_intersect(ws[greatest(k - start - slack, 0) + 1 : k - start + len(tw) + slack], list_distinct(tw))) / len(list_distinct(tw)) AS cover
  FROM tried f JOIN t USING (t) JOIN d USING (rid) WHERE ws[k + 1 : k + size] = tw[start + 1 : start + size]),
best AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(k) FILTER (base) AS first_word, max(k) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN base THEN 0.5 ELSE cover END) AS score
  FROM found WHERE cover >= {COVER} GROUP BY rid)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN best USING (rid)
"""
