"""License scans with a positional index of rare tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.decontamination import words_of


@dataclass(frozen=True)
class Template:
    """label: what is reported. words: the template's text. key: start and length of its mandatory phrase.

    A template is found where its key phrase stands whole and at least `least` of its words stand at their
    places relative to it. Base templates are their key phrase.
    """

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    least: float = 1.0
    base: bool = False


def _base(label: str, text: str) -> Template:
    w = tuple(text.split())
    return Template(label, w, (0, len(w)), base=True)


def _own(label: str, text: str, phrase: str, least: float = 0.6) -> Template:
    w, p = tuple(text.split()), tuple(phrase.split())
    at = next(i for i in range(len(w)) if w[i : i + len(p)] == p)
    return Template(label, w, (at, len(p)), least)


#: Sentences of public licences, lower-cased words; fixed values. A licence may have several, each with its phrase.
TEMPLATES = (
    _base("cc-by", "cc by"),
    _base("gpl", "general public license"),
    _base("reserved", "all rights reserved"),
    _own("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _own("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    _own("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "distributed under the license is distributed"),
    _own("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "hereby granted free of charge"),
    _own("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "all copies or substantial portions"),
    _own("mit-name", "released under the mit license", "mit license"),
    _own("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    _own("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "redistributions in binary form must reproduce"),
    _own("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "used to endorse or promote products"),
    _own("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    _own("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable"),
    _own("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it"),
    _own("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    _own("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    _own("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _own("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    _own("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _own("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    _own("cc", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    _own("cc-nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    _own("proprietary", "this document is confidential and proprietary do not distribute", "confidential and proprietary"),
    _own("proprietary", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher", "may be reproduced distributed or transmitted"),
)


def _strings(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_counts(rows: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each licence word is: one row a word comes back, counted over the whole table."""
    own = F.array_intersect(F.col("w"), _strings(tuple(words)))
    counts = rows.select(F.explode(own).alias("t")).groupBy("t").count()
    return {r["t"]: r["count"] for r in counts.collect()}


def _by_idf(t: Template, counts: dict[str, int]) -> list[int]:
    """Offsets of the key phrase's words, highest IDF first, equal ones in the order of the text."""
    return sorted(range(t.key[0], sum(t.key)), key=lambda j: (counts.get(t.words[j], 0), j))


def _places(t: Template, counts: dict[str, int]) -> Column:
    """Where the template starts, as (start, share of its words in place), by its rarest key word's postings.

    Every place of the key phrase has that word at its offset, so no place is missed. Relative positions are
    intersected word by word, from the rarest on, and only places that pass the phrase are scored.
    """
    at, n = t.key
    anchor, *others = _by_idf(t, counts)
    word = t.words[anchor].replace("'", "''")
    starts = f"transform(filter(lic, p -> p.w = '{word}'), p -> p.i - {anchor})"
    checks = " and ".join([f"s + {at} >= 0", *[f"get(w, s + {j}) = '{t.words[j]}'" for j in others]])
    ok = f"filter({starts}, s -> {checks})"
    if len(t.words) == n:
        return F.expr(f"transform({ok}, s -> named_struct('s', s, 'share', 1.0D))")
    hit = " + ".join(f"if(s + {j} >= 0 and get(w, greatest(s + {j}, 0)) <=> '{w}', 1, 0)" for j, w in enumerate(t.words))
    return F.expr(f"filter(transform({ok}, s -> named_struct('s', s, 'share', ({hit}) / {len(t.words)}D)), x -> x.share >= {t.least}D)")


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs' columns with n_words, base places (starts, sorted), base_labels, labels and score.

    Words are lower-cased runs of digits, letters and anything outside ASCII; a null or empty text has none. score is
    the largest share of a found template's words that stand in place, 0 if none is found. Rows are judged
    each on its own, so repeated rows, ties and skew cost nothing; an empty table gives an empty result. Columns
    named like results are replaced, any other name may stand.
    """
    results = ("n_words", "places", "base_labels", "labels", "score")
    names = [c for c in docs.columns if c not in results]
    # the columns of a row as one, so that no name of theirs meets a helper's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), words_of(F.col("text").cast("string")).alias("w"))
    key_words = sorted({w for t in templates for w in t.words[t.key[0] : t.key[0] + t.key[1]]})
    counts = document_counts(rows, key_words)
    rare = sorted({t.words[_by_idf(t, counts)[0]] for t in templates})
    listed = ", ".join(f"'{w}'" for w in rare)
    # postings of the anchor words only: texts without one are done after one look at their words
    lic = f"if(arrays_overlap(w, array({listed})), filter(transform(w, (x, i) -> named_struct('i', i, 'w', x)), p -> p.w in ({listed})), array())"
    rows = rows.withColumn("lic", F.expr(lic))
    found = rows.withColumns({f"t{k}": _places(t, counts) for k, t in enumerate(templates)})
    base = [k for k, t in enumerate(templates) if t.base]

    def labels(ks: list[int]) -> Column:
        named = F.array(*[F.when(F.size(f"t{k}") > 0, F.lit(templates[k].label)) for k in ks])
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(named))), ",")

    shares = F.flatten(F.array(*[F.col(f"t{k}.share") for k in range(len(templates))]))
    return found.select(
        *[F.col(f"doc.`{c}`") for c in names],
        F.size("w").cast("long").alias("n_words"),
        F.array_sort(F.flatten(F.array(*[F.col(f"t{k}.s") for k in base]))).alias("places"),
        labels(base).alias("base_labels"),
        labels(list(range(len(templates)))).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )
