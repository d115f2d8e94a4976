"""Licence scan: a positional index of rare licence words, template postings met by relative position, key phrases verified.

Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case. Each template of ``TEMPLATES`` has a
label, its words, and a mandatory phrase. The words of all templates are counted over all documents; per template the
rarest of them (highest IDF) are its anchors: so many that whatever reaches ``COVERAGE`` has two of them in place. A text looks up its anchor words only,
every posting votes for a template at the position where its words would begin, and a template with two votes at one position (one, where
a single word can reach the coverage) is compared word by word: it counts when the
IDF-weighted share of its words that stand in their places reaches ``COVERAGE`` and the text holds its mandatory phrase.

Words may also be put in or left out: votes up to ``GAP`` positions apart count together, and a word then stands in its place if it is within
``GAP`` words of it. What only this finds is a hit of its own, where no exact one is. A hit of a licence of several versions names the version
whose words stand in the text right behind the licence's name.

Everything is built-in functions over one row at a time: no shuffle but the count of words, whose keys are the templates' words.

Defined cases: a null or empty text has no words, labels or places, and score 0; equal rows give equal rows; among equal
coverages the greatest counts; very long texts are read whole, in memory that grows with their words; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, words of a notice or of a licence's first sentence, mandatory phrase.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "licensed under the gnu general public license", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "gnu general public license"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "used to endorse or promote products derived from this software"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("mit", "spdx license identifier mit", "license identifier mit"),
    ("apache", "spdx license identifier apache 2 0", "license identifier apache"),
    ("gpl", "spdx license identifier gpl", "license identifier gpl"),
    ("lgpl", "spdx license identifier lgpl", "license identifier lgpl"),
    ("agpl", "spdx license identifier agpl", "license identifier agpl"),
    ("bsd", "spdx license identifier bsd", "license identifier bsd"),
    ("isc", "spdx license identifier isc", "license identifier isc"),
    ("mpl", "spdx license identifier mpl 2 0", "license identifier mpl"),
    ("epl", "spdx license identifier epl 2 0", "license identifier epl"),
    ("boost", "spdx license identifier bsl 1 0", "license identifier bsl"),
    ("cc0", "spdx license identifier cc0 1 0", "license identifier cc0"),
    ("unlicense", "spdx license identifier unlicense", "license identifier unlicense"),
]
#: By label, what a version follows, and the versions' words.
VERSIONS = {
    "gpl": (("general public license version", "general public license v", "identifier gpl"), ("2 0", "3 0", "2", "3")), "lgpl": (("lesser general public license version", "lesser general public license v", "identifier lgpl"), ("2 1", "3 0", "3")),
    "agpl": (("affero general public license version", "identifier agpl"), ("3 0", "3")), "apache": (("apache license version", "apache license", "identifier apache"), ("2 0", "1 1")),
    "bsd": (("identifier bsd", "bsd"), ("2 clause", "3 clause")), "mpl": (("mozilla public license version", "mozilla public license v", "identifier mpl"), ("2 0", "1 1")), "epl": (("eclipse public license version", "eclipse public license v", "identifier epl"), ("1 0", "2 0")),
}
COVERAGE, GAP = 0.7, 3
#: Of the SQL twin only: it looks for fewer words than scan(), so it misses changed notices that scan() finds.
ANCHORS, VOTES = 4, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t): the lower-cased words of each text, one blank between them and at either end."""
    # lower() also changes letters beyond ASCII, but never into a break or a letter of the phrases; translate() costs a string per character.
    # Of them only the kelvin sign becomes an ASCII letter: another letter stands for it.
    low = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _BREAK, " ")), F.lit(" ")).alias("t"))


def idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency over all documents of each word of the templates (as many rows as they have words)."""
    vocabulary = sorted({w for _, words, _ in TEMPLATES for w in words.split()})
    t = _words(docs.withColumn("__n", F.lit(1)), "__n", text_col)
    # The outer form: the inner one adds a test of the array's size, and so a second computation of it.
    seen = t.select(F.explode_outer(F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split("t", " "))).alias("w")).where("w is not null").groupBy("w").count().collect()
    n, df = docs.count(), {r["w"]: r["count"] for r in seen}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


def _array(values, kind: str) -> str:
    return f"array({', '.join(values)})" if values else f"cast(array() as array<{kind}>)"


def anchor_words(words: list[str], weights: dict[str, float], coverage: float = COVERAGE) -> tuple[list[str], int]:
    """The rarest words of a template, and how many of their places agree at least wherever the coverage is reached."""
    total, chosen, places = sum(weights[w] for w in words), [], []
    for w in sorted(set(words), key=lambda w: (-weights[w], w)):
        chosen.append(w)
        places += [weights[w]] * words.count(w)
        if sum(places) - max(places) > (1 - coverage) * total * (1 + 1e-9):  # all but one out of place: too little is left
            return chosen, 2
    return chosen, 1


def scan(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, n_words, base, hits): places of base phrases (start, label), and accepted templates (label, start, coverage, version or null)."""
    templates = [(label, words.split(), phrase) for label, words, phrase in TEMPLATES]
    anchors: dict[str, list[tuple[int, int]]] = {}
    chosen = [anchor_words(words, weights, coverage) for _, words, _ in templates]
    for k, (_, words, _) in enumerate(templates):
        for w in chosen[k][0]:
            anchors.setdefault(w, []).extend((k, i) for i, x in enumerate(words) if x == w)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = sorted(anchors)
    looked_up = _array(map(quoted, names), "string")
    postings = _array([_array([f"named_struct('k', {k}, 'i', {i})" for k, i in anchors[w]], "struct<k:int,i:int>") for w in names], "array<struct<k:int,i:int>>")
    text_of = _array([_array(map(quoted, words), "string") for _, words, _ in templates], "array<string>")
    weight_of = _array([_array([f"{weights[w]!r}D" for w in words], "double") for _, words, _ in templates], "array<double>")
    total_of = _array([f"{sum(weights[w] for w in words)!r}D" for _, words, _ in templates], "double")
    label_of = _array([quoted(label) for label, _, _ in templates], "string")
    votes_of = _array([str(n) for _, n in chosen], "int")
    phrase_of = _array([quoted(f" {p} ") for _, _, p in templates], "string")

    d = _words(docs, id_col, text_col)
    # Each stage is read at least twice by the next, so that nothing is computed anew for every element.
    maybe = " or ".join(f"contains(t, {quoted(f' {p} ')})" for p in sorted({p for _, _, p in templates} | set(BASE)))
    d = d.select("id", "t", F.expr("if(t = '  ', 0L, cast(length(t) - length(replace(t, ' ', '')) - 1 as bigint))").alias("n_words"), F.expr(f"if({maybe}, split(trim(t), ' '), cast(array() as array<string>))").alias("w"))
    base = f"""filter(transform(filter(sequence(0, size(w)), i -> get(w, i) = 'license'), i ->
        case when get(w, i - 1) = 'mit' then named_struct('start', i - 1, 'label', 'mit') when get(w, i - 1) = 'apache' then named_struct('start', i - 1, 'label', 'apache')
             when get(w, i - 1) = 'public' and get(w, i - 2) = 'general' then named_struct('start', i - 2, 'label', 'gpl') end), x -> x is not null)"""
    votes = f"""sort_array(flatten(transform(filter(sequence(0, size(w)), i -> array_contains({looked_up}, get(w, i))), i ->
        transform(get({postings}, cast(array_position({looked_up}, get(w, i)) as int) - 1), p -> named_struct('k', p.k, 'at', i - p.i)))))"""
    d = d.select("id", "t", "n_words", "w", F.expr(f"if(size(w) = 0, cast(array() as array<struct<start:int,label:string>>), {base})").alias("base"), F.expr(f"if(size(w) = 0, cast(array() as array<struct<k:int,at:int>>), {votes})").alias("v"))
    # Equal votes are neighbours now: a template needs so many of them at one position; those of one template that are near follow each other.
    d = d.select("id", "t", "n_words", "w", "base", "v", F.expr(f"filter(v, (x, i) -> get(v, i + get({votes_of}, x.k) - 1) = x and coalesce(get(v, i - 1) <> x, true))").alias("c"))
    near = f"coalesce(get(v, i + get({votes_of}, x.k) - 1).k = x.k and get(v, i + get({votes_of}, x.k) - 1).at - x.at between 0 and {GAP}, false) and coalesce(get(v, i - 1) <> x, true)"
    d = d.select("id", "t", "n_words", "w", "base", "c", F.expr(f"filter(v, (x, i) -> {near})").alias("n"))
    d = d.select("id", "t", "n_words", "w", "base", F.expr(f"filter(c, x -> contains(t, get({phrase_of}, x.k)))").alias("c"), F.expr(f"filter(n, x -> contains(t, get({phrase_of}, x.k)))").alias("n"))

    def share(place: str) -> str:
        return f"aggregate(sequence(0, size(get({text_of}, x.k)) - 1), 0D, (a, j) -> a + if({place}, get(get({weight_of}, x.k), j), 0D)) / get({total_of}, x.k)"

    def covered(of: str, place: str) -> str:
        """Those of the candidates that reach the coverage: computed once each."""
        return f"filter(transform({of}, x -> named_struct('k', x.k, 'start', x.at, 'coverage', {share(place)})), x -> x.coverage >= {coverage}D)"

    word = f"get(get({text_of}, x.k), j)"
    d = d.select("id", "t", "n_words", "w", "base", "n", F.expr(covered("c", f"get(w, x.at + j) = {word}")).alias("c"))
    d = d.select("id", "t", "n_words", "w", "base", "c", F.expr(f"filter(n, x -> not exists(c, y -> y.k = x.k and abs(y.start - x.at) <= {GAP}))").alias("n"))
    about = f"array_contains(slice(w, greatest(x.at + j - {GAP}, 0) + 1, greatest(x.at + j + {GAP} + 1 - greatest(x.at + j - {GAP}, 0), 0)), {word})"
    d = d.select("id", "t", "n_words", "base", F.expr(f"concat(c, if(size(n) = 0, cast(array() as array<struct<k:int,start:int,coverage:double>>), {covered('n', about)}))").alias("h"))
    version = "case " + " ".join(
        f"when get({label_of}, x.k) = {quoted(label)} and contains(t, {quoted(f' {name} {number} ')}) then {quoted(number.replace(' ', '.').replace('.clause', '-clause'))}" for label, (names, numbers) in VERSIONS.items() for name in names for number in numbers
    ) + " end"
    return d.select("id", "n_words", "base", F.expr(f"transform(h, x -> named_struct('label', get({label_of}, x.k), 'start', x.start, 'coverage', x.coverage, 'version', {version}))").alias("hits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels of every document, and the labels and score of the templates."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, idf(docs))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(base, x -> x.start)) as bigint)").alias("first_word"), F.expr("cast(array_max(transform(base, x -> x.start)) as bigint)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(base, x -> x.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(transform(base, x -> x.label), transform(hits, x -> x.label))), ',')").alias("labels"),
        F.expr("round(least(1D, greatest(coalesce(array_max(transform(hits, x -> x.coverage)), 0D), if(size(base) > 0, 0.5D, 0D))), 6)").alias("score"),
    )


def _oracle() -> str:
    """The same in DuckDB: postings, votes and coverages as rows."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    labels = ", ".join(f"({k}, {quoted(label)}, {quoted(words)}, {quoted(f' {phrase} ')})" for k, (label, words, phrase) in enumerate(TEMPLATES))
    return rf"""
with tm as (select * from (values {labels}) v(k, label, words, phrase)),
tw as (select k, label, phrase, unnest(string_split(words, ' ')) w, unnest(range(len(string_split(words, ' ')))) i from tm),
d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BREAK}'), lambda x: x <> '') ws from documents),
n as (select count(*) n from d), df as (select w, count(*) df from (select unnest(list_distinct(ws)) w from d) where w in (select w from tw) group by 1),
idf as (select distinct tw.w, ln((n + 1) / (coalesce(df, 0) + 1)) + 0.001 idf from tw left join df using (w), n),
an as (select k, w from (select distinct k, w, idf from tw join idf using (w)) qualify row_number() over (partition by k order by idf desc, w) <= {ANCHORS}),
p as (select doc_id, unnest(ws) w, unnest(range(len(ws))) pos from d),
lic as (select a.doc_id, a.pos, b.w w1, c.w w2 from p a left join p b on b.doc_id = a.doc_id and b.pos = a.pos - 1 left join p c on c.doc_id = a.doc_id and c.pos = a.pos - 2 where a.w = 'license'),
base as (select doc_id, case when w1 in ('mit', 'apache') then pos - 1 else pos - 2 end start, case when w1 = 'public' then 'gpl' else w1 end label from lic where w1 in ('mit', 'apache') or (w1 = 'public' and w2 = 'general')),
votes as (select doc_id, tw.k, pos - i at0 from p join tw using (w) join an on an.k = tw.k and an.w = tw.w group by all having count(*) >= {VOTES}),
cov as (select v.doc_id, v.k, v.at0, sum(case when p.w = tw.w then idf else 0 end) / sum(idf) coverage from votes v join tw on tw.k = v.k join idf on idf.w = tw.w left join p on p.doc_id = v.doc_id and p.pos = v.at0 + tw.i group by all),
hits as (select c.doc_id, label, coverage from cov c join tm using (k) join d using (doc_id) where coverage >= {COVERAGE} and contains(' ' || array_to_string(ws, ' ') || ' ', phrase)),
bs as (select doc_id, count(*) n_base, min(start) first_word, max(start) last_word, string_agg(distinct label, ',' order by label) base_labels from base group by 1),
hs as (select doc_id, max(coverage) coverage from hits group by 1),
ls as (select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from base union all select doc_id, label from hits) group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
  round(least(1, greatest(coalesce(coverage, 0), case when n_base > 0 then 0.5 else 0 end)), 6)::double score
from d left join bs using (doc_id) left join hs using (doc_id) left join ls using (doc_id)"""


ORACLE = _oracle()
