"""License scans with a positional rare-token index, DataFrame functions only.

Every licence template is a word list with mandatory key phrases. Words of the
templates get an inverse document frequency over all documents; the rarest of
each template form the index, with postings (template, position). A document
looks up the index words it holds; postings that agree on the relative
position (document position - template position) give a candidate placement,
which counts if its key phrases stand there word for word and the matched words
carry at least :data:`MIN_COVERAGE` of the template's IDF mass.

Base rules (plain phrases) are reported beside it and always stay.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows are scanned alike; texts of any length are read whole; input
columns named like the output column are replaced. The index is bounded by the
templates, whatever the input size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import ascii_lower, let, table

#: Everything ASCII but letters of either case and digits, so that words split alike before and after folding.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# Phrases of the base rules and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Fixed values: (label, opening words of the licence or of its usual notice, key phrases).
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "in compliance with the license"]),
    ("gpl", "licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
]

INDEX_WORDS = 4
MIN_COVERAGE = 0.6


def split_words(text: Column) -> Column:
    """Words in their own case; case folding never moves a separator."""
    return F.array_remove(F.split(text, GAPS, -1), "")


def lexicon() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def word_idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """IDF of every lexicon word over all documents (one row a word)."""
    terms = lexicon()
    t = F.coalesce(docs[text_col], F.lit(""))
    held = F.filter(F.array_distinct(split_words(t)), lambda x: F.lower(x).isin(terms))
    held = F.array_distinct(F.transform(held, ascii_lower))
    # one marker row a document, so that one aggregation also counts documents
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w"))
    df = {r["w"]: r["n"] for r in rows.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("w").isin([""] + terms)).collect()}
    total = df.get("", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1.0 for w in terms}


def _index(idf: dict[str, float]) -> list[tuple[str, int, int]]:
    """Postings (word, template, position) of each template's rarest words."""
    out = []
    for k, (_, text, _) in enumerate(TEMPLATES):
        tw = text.split()
        rare = sorted(set(tw), key=lambda w: (-idf[w], w))[:INDEX_WORDS]
        out += [(w, k, p) for p, w in enumerate(tw) if w in rare]
    return out


def _phrase_at(w: Column, words: list[str], i: Column) -> Column:
    ok = F.lit(True)
    for k, x in enumerate(words):
        ok = ok & F.coalesce(F.get(w, i + k) == x, F.lit(False))
    return ok


def base_places(w: Column) -> Column:
    """Array of (place, label) of the base phrases in lower-case words ``w``."""

    def places(phrase: str, label: str) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)))
        here = F.filter(at, lambda i: _phrase_at(w, phrase.split(), i))
        return F.transform(here, lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))

    return F.concat(*[places(p, label) for p, label in BASE.items()])


def _template_score(w: Column, k: int, at: Column, idf: dict[str, float]) -> Column:
    # share of the template's IDF mass that stands at its place; 0 without the key phrases
    _, text, keys = TEMPLATES[k]
    tw = text.split()
    total = sum(idf[x] for x in tw)
    got = F.lit(0.0)
    for p, x in enumerate(tw):
        got = got + F.when(F.get(w, at + p) == x, F.lit(idf[x] / total)).otherwise(F.lit(0.0))
    ok = F.lit(True)
    for key in keys:
        words = key.split()
        offset = next(i for i in range(len(tw)) if tw[i : i + len(words)] == words)
        ok = ok & _phrase_at(w, words, at + offset)
    return F.when(ok, F.least(got, F.lit(1.0))).otherwise(F.lit(0.0))


def matches(w: Column, idf: dict[str, float]) -> Column:
    """Array of (label, at, score) of verified placements in lower-case words;
    ``at`` is negative where the text starts inside the template, whose words
    before it count as unmatched (``F.get`` gives null outside the array)."""
    postings = _index(idf)
    index = F.array(*[F.struct(F.lit(x).alias("w"), F.lit(k).alias("k"), F.lit(p).alias("p")) for x, k, p in postings])
    rare = sorted({x for x, _, _ in postings})
    anchors = F.filter(
        F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare)
    )
    votes = F.flatten(
        F.transform(
            anchors,
            lambda a: F.transform(
                F.filter(index, lambda p: p["w"] == a["w"]),
                lambda p: F.struct(p["k"].alias("k"), (a["i"] - p["p"]).alias("at")),
            ),
        )
    )

    def agreed(v: Column) -> Column:  # sorted votes: placements with two or more
        twin = lambda x, j: F.coalesce(F.get(v, j + 1) == x, F.lit(False))
        return F.array_distinct(F.filter(v, twin))

    def scored(c: Column) -> Column:
        score = F.lit(0.0)
        label = F.lit(None).cast("string")
        for k, (name, _, _) in enumerate(TEMPLATES):
            score = F.when(c["k"] == k, _template_score(w, k, c["at"], idf)).otherwise(score)
            label = F.when(c["k"] == k, F.lit(name)).otherwise(label)
        return F.struct(label.alias("label"), c["at"].alias("at"), score.alias("score"))

    placed = let(F.sort_array(votes), agreed)
    return F.filter(F.transform(placed, scored), lambda x: x["score"] >= MIN_COVERAGE)


def _may_hold(t: Column, idf: dict[str, float]) -> Column:
    # a placement needs two index words and a base phrase its rarest word
    rare = {x for x, _, _ in _index(idf)} | {"gnu", "apache", "cc", "mit"}
    return t.rlike(rf"(?i)(?<!{_WORD})(?:{'|'.join(sorted(rare))})(?!{_WORD})")


def find_licenses(text: Column, idf: dict[str, float]) -> Column:
    """Struct (n_words, base: (place, label), found: (label, at, score)) of one text."""
    none = F.struct(
        F.array().cast("array<struct<place:int,label:string>>").alias("base"),
        F.array().cast("array<struct<label:string,at:int,score:double>>").alias("found"),
    )

    def found(w: Column) -> Column:
        return let(
            F.transform(w, ascii_lower), lambda x: F.struct(base_places(x).alias("base"), matches(x, idf).alias("found"))
        )

    def whole(t: Column) -> Column:
        return let(
            split_words(t),
            lambda w: let(
                F.when(_may_hold(t, idf), found(w)).otherwise(none),
                lambda f: F.struct(
                    F.size(w).cast("long").alias("n_words"), f["base"].alias("base"), f["found"].alias("found")
                ),
            ),
        )

    return let(F.coalesce(text, F.lit("")), whole)


def scan(docs: DataFrame, idf: dict[str, float], text_col: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with the struct column ``out`` of :func:`find_licenses`."""
    return docs.withColumn(out, find_licenses(docs[text_col], idf))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_licenses(docs["text"], word_idf(docs))

    def digest(x: Column) -> Column:
        base = F.transform(x["base"], lambda b: b["label"])
        more = F.transform(x["found"], lambda f: f["label"])
        places = F.transform(x["base"], lambda b: b["place"])
        joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
        return F.struct(
            x["n_words"].alias("n_words"),
            F.size(x["base"]).cast("long").alias("n_base"),
            F.array_min(places).cast("long").alias("first_word"),
            F.array_max(places).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.concat(base, more)).alias("labels"),
            F.coalesce(F.array_max(F.transform(x["found"], lambda f: f["score"])), F.lit(0.0)).alias("score"),
        )

    return docs.select("doc_id", let(found, digest).alias("d")).select("doc_id", "d.*")
