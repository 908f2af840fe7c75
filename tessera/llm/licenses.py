"""License scans as an exact set-similarity join, in DataFrame functions alone.

Text blocks (overlapping, over the words of the whole text, whatever its lines) are joined with license templates by
containment: the share of a template's words that some words in a row of the text hold. How many words in a row is the
template's window: ``WINDOW``, or five quarters of its length if that is more. Words are ordered globally from rare to
frequent, by how often the corpus uses them. A block that meets the threshold must hold a word of the template's prefix,
so only blocks with such a word are joined (prefix filter), if they have enough known words (length filter), and if
enough words are left on both sides of the first common one (positional filter). What remains is verified with every
window of the block that begins with a word of the template. Blocks overlap by the longest window, so every window of
the text lies in one, and a template is found if and only if some window meets the threshold, wherever it stands.

A template that another label's notice could pass for also needs one of the words that set it apart, in the same window.

Apart from that, fixed phrases are found at every place (the base); their labels always stay.

Words of all texts are counted where they are read, as one row for each template word and task. Matches are keyed by
a digest of the text, so equal texts are matched once. Templates are a list or a table of (label, text) with at most
``MOST_TEMPLATES`` rows, which is checked; their prefixes are broadcast.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows each get a result; a notice found
many times, or in a very long text, counts once; templates without a word are passed over, and without any template
only the base is left; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrase to label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label to notices that stand for it, as published by the licenses' stewards.
TEMPLATES = {
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public"
        " license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or"
        " agreed to in writing software distributed under the license is distributed on an as is basis without warranties or"
        " conditions of any kind either express or implied see the license for the specific language governing permissions and"
        " limitations under the license",
    ),
    "boost-1.0": ("distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions"
        " and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under cc by 4 0",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "cc-by-sa": ("licensed under cc by sa 4 0",),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty"
        " of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "lgpl": ("licensed under the gnu lesser general public license version 3",),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
        " files the software to deal in the software without restriction including without limitation the rights to use copy"
        " modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software"
        " is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the software",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed"
        " with this file you can obtain one at",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    "reserved": ("copyright all rights reserved",),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile"
        " sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non"
        " commercial and by any means",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for"
        " any damages arising from the use of this software",
    ),
}
THRESHOLD, WINDOW, MOST_TEMPLATES = 0.8, 48, 5000
Templates = Sequence[tuple[str, str]]


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SPLIT), lambda w: w != "")


def published() -> list[tuple[str, str]]:
    """The notices of ``TEMPLATES`` as rows (label, text)."""
    return [(label, t) for label, texts in sorted(TEMPLATES.items()) for t in texts]


def rows_of(templates: Templates | DataFrame | None) -> list[tuple[str, list[str]]]:
    """(label, words) of each template that has any; a ValueError for a table of more than ``MOST_TEMPLATES`` rows."""
    if templates is None:
        templates = published()
    if isinstance(templates, DataFrame):
        own = templates.select("label", "text").limit(MOST_TEMPLATES + 1).collect()
        templates = sorted(((r.label, r.text or "") for r in own if r.label is not None))
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"there are more than {MOST_TEMPLATES} templates")
    lowered = str.maketrans(UPPER, LOWER)
    split = re.compile(SPLIT)
    cut = [(label, [w for w in split.split(text.translate(lowered)) if w]) for label, text in templates]
    return [(label, own) for label, own in cut if own]


def _need(size: int, threshold: float = THRESHOLD) -> int:
    """How many of a template's words meet the threshold."""
    return -int(-threshold * size // 1)


def window_of(own: Sequence[str]) -> int:
    """How many words in a row are looked at for a template."""
    return max(WINDOW, len(own) * 5 // 4)


def apart(templates: Sequence[tuple[str, list[str]]], threshold: float = THRESHOLD) -> list[list[frozenset[str]]]:
    """For each template, the words that set it apart from each template of another label that could pass for it."""
    sets = [(label, frozenset(own)) for label, own in templates]
    return [
        list(dict.fromkeys(b - a for other, a in sets if other != label and b - a and len(a & b) >= _need(len(b), threshold))) for label, b in sets
    ]


def frequencies(texts: DataFrame, known: list[str]) -> dict[str, int]:
    """How often each template word occurs in all texts (column words); other words are not counted."""
    used = texts.select(F.explode(F.filter("words", lambda w: w.isin(known))).alias("w"))
    found = {r.w: r.n for r in used.groupBy("w").agg(F.count("*").alias("n")).collect()}  # no more than the template words
    return {w: found.get(w, 0) for w in known}


def blocks(own: Column, window: int) -> Column:
    """Overlapping blocks of an array of words; every ``window`` words in a row lie in one of them."""
    step = window // 2
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(own) - window + 1), F.lit(step))
    return F.transform(starts, lambda s: F.slice(own, s, window + step))


def join(keyed: DataFrame, templates: Sequence[tuple[str, list[str]]], ranks: dict[str, int], threshold: float = THRESHOLD) -> DataFrame:
    """(key, template, containment) of every text and template of which some window of the text meets the threshold.

    ``keyed`` has key and the text's words; ``ranks`` has the place of each template word in the global order, rare words first.
    """
    entries = []
    for n, ((_, own), sure) in enumerate(zip(templates, apart(templates, threshold))):
        ordered = sorted({ranks[w] for w in own})
        need = _need(len(ordered), threshold)
        marks = [sorted(ranks[w] for w in x) for x in sure]
        for at, rank in enumerate(ordered[: len(ordered) - need + 1]):
            entries.append((rank, n, at, len(ordered), need, window_of(own), ordered, marks))
    schema = "rank int, template int, at int, size int, need int, window int, own array<int>, sure array<array<int>>"
    prefix = keyed.sparkSession.createDataFrame(entries, schema)
    least, longest = min(e[4] for e in entries), max(e[5] for e in entries)
    starting = sorted({e[0] for e in entries})
    starting_words = sorted(w for w, r in ranks.items() if r in set(starting))
    rank_of = F.create_map(*[x for w, r in sorted(ranks.items()) for x in (F.lit(w), F.lit(r))])

    # Words that no template has keep their places as -1.
    placed = F.transform("words", lambda w: F.when(w.isin(list(ranks)), F.element_at(rank_of, w)).otherwise(-1))
    # A word of some prefix must be in the text before its blocks are looked at, and in the block before it is joined.
    start_set, start_words = F.array(*[F.lit(r) for r in starting]), F.array(*[F.lit(w) for w in starting_words])
    may = keyed.where(F.arrays_overlap("words", start_words)).select("key", placed.alias("placed"))
    cut = F.filter(blocks(F.col("placed"), longest), lambda b: F.arrays_overlap(b, start_set))
    own_blocks = may.select("key", F.explode(cut).alias("block"))
    enough = own_blocks.select("key", "block", F.array_sort(F.array_distinct(F.filter("block", lambda r: r >= 0))).alias("ranks"))
    enough = enough.where(F.size("ranks") >= least)
    probes = enough.select("key", "block", "ranks", F.posexplode("ranks").alias("pos", "rank"))
    left = F.least(F.col("size") - F.col("at"), F.size("ranks") - F.col("pos"))  # the common word and those after it

    def held(start: Column) -> Column:
        inside = F.slice("block", start, F.col("window"))
        return F.when(F.forall("sure", lambda x: F.arrays_overlap(x, inside)), F.size(F.array_intersect(inside, F.col("own")))).otherwise(0)

    starts = F.filter(F.sequence(F.lit(1), F.size("block")), lambda s: F.array_contains(F.col("own"), F.element_at("block", s)))
    met = (
        probes.join(F.broadcast(prefix), "rank")  # as many rows as the templates' prefixes have words
        .where((F.size("ranks") >= F.col("need")) & (F.col("at") + left >= F.col("need")))
        .where(F.size(F.array_intersect("ranks", "own")) >= F.col("need"))  # the block as a whole, before its windows
        .select("key", "template", "need", "size", F.array_max(F.transform(starts, held)).alias("held"))
        .where("held >= need")
        .select("key", "template", (F.col("held") / F.col("size")).alias("containment"))
    )
    return met.groupBy("key", "template").agg(F.max("containment").alias("containment"))


def best(met: DataFrame, templates: Sequence[tuple[str, list[str]]]) -> DataFrame:
    """(key, labels, score): the labels of all templates that a window of the text meets, and the largest containment."""
    labels = F.array(*[F.lit(label) for label, _ in templates])
    return met.groupBy("key").agg(
        F.collect_set(F.element_at(labels, F.col("template") + 1)).alias("more"),  # no more than the templates
        F.max("containment").alias("score"),
    )


def places(own: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively, from 0."""
    parts = phrase.split()
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(own) - len(parts) + 1))

    def here(i: Column) -> Column:
        tests = [F.try_element_at(own, i + k) == w for k, w in enumerate(parts)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return F.coalesce(out, F.lit(False))

    return F.when(F.array_contains(own, parts[0]), F.transform(F.filter(starts, here), lambda i: i - 1)).otherwise(
        F.array().cast("array<int>")
    )


def scan(documents: DataFrame, threshold: float = THRESHOLD, templates: Templates | DataFrame | None = None) -> DataFrame:
    """doc_id with n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words(F.col("text")))
    digest, rows = F.md5("text"), rows_of(templates)
    if rows:
        counts = frequencies(texts, sorted({w for _, own in rows for w in own}))
        ranks = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        found = best(join(texts.select(digest.alias("key"), "words"), rows, ranks, threshold), rows)
    else:
        found = documents.sparkSession.createDataFrame([], "key string, more array<string>, score double")
    based = (
        texts.withColumn("at", F.struct(*[places(F.col("words"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)]))
        .select(
            "doc_id",
            digest.alias("key"),
            F.size("words").cast("long").alias("n_words"),
            F.concat(*[F.col(f"at.p{i}") for i in range(len(PHRASES))]).alias("all"),
            F.array_compact(
                F.array(*[F.when(F.size(f"at.p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())])
            ).alias("base"),
        )
    )
    # Written first, so that the join deals both sides itself and can split the rows of a text that is very common.
    found = Scratch(documents.sparkSession, "licenses").write(found)
    joined = based.join(found.hint("shuffle_hash"), "key", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("all").cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"),
        F.array_max("all").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("base")).alias("base_labels"),
        F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({n: F.concat_ws(",", n) for n in ("base_labels", "labels")})


def op10_sql(threshold: float = THRESHOLD) -> str:
    """The same by DuckDB, without any filter: every window that begins with a word of a template, for every template."""
    rows = rows_of(None)
    whole, own_words = [], []
    for n, ((label, own), sure) in enumerate(zip(rows, apart(rows, threshold))):
        size = len(set(own))
        whole.append(f"({n}, '{label}', {size}, {_need(size, threshold)}, {window_of(own)}, {(1 << len(sure)) - 1}::BIGINT)")
        own_words += [f"({n}, '{w}', {sum(1 << k for k, x in enumerate(sure) if w in x)}::BIGINT)" for w in sorted(set(own))]

    def tests(phrase: str) -> str:
        return " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))

    found = ", ".join(
        f"list_filter(range(greatest(0, len(ws) - {len(p.split()) - 1})), lambda i: {tests(p)}) AS p{n}" for n, p in enumerate(PHRASES)
    )
    every = " || ".join(f"p{n}" for n in range(len(PHRASES)))
    base = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(PHRASES.values()))
    pattern = "[^" + SPLIT[1:]
    return f"""
    WITH t(n, label, size, need, span, marks) AS (VALUES {", ".join(whole)}),
    tw(n, word, mark) AS (VALUES {", ".join(own_words)}),
    d AS (
        SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents
    ), w AS (
        SELECT id, doc_id, regexp_extract_all(low, '{pattern}') AS ws FROM d
    ), b AS (
        SELECT id, doc_id, len(ws) AS n_words, {found} FROM w
    ), each AS (
        SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w
    ), hits AS (
        SELECT id, n, pos, word, mark, span FROM each JOIN tw USING (word) JOIN t USING (n)
    ), windows AS (
        SELECT id, n, count(DISTINCT word) OVER f AS held, bit_or(mark) OVER f AS marked FROM hits
        WINDOW f AS (PARTITION BY id, n ORDER BY pos RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING)
    ), more AS (
        SELECT id, list(DISTINCT label) AS labels, max(held / size) AS score FROM windows JOIN t USING (n)
        WHERE held >= need AND marked & marks = marks GROUP BY id
    )
    SELECT doc_id, n_words::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word,
           list_max({every})::BIGINT AS last_word,
           array_to_string(list_sort(list_filter([{base}], lambda x: x IS NOT NULL)), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_filter([{base}], lambda x: x IS NOT NULL) || coalesce(labels, []))), ',') AS labels,
           greatest(coalesce(score, 0.0), CASE WHEN len({every}) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
    FROM b LEFT JOIN more USING (id)
    """
