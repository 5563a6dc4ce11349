"""License scans by a positional index of rare words, in SQL functions only.

The index lists for each licence word where it stands in which template. Words are rare by their document frequency over all
texts. Of each template the highest-IDF words that a file holds are looked up; where one stands in the file gives a place at
which the template would begin, and the template's other index words have to stand at the same distances from there. What
enough of them confirm is verified by the template's mandatory phrases. A base phrase is a template all of whose words are
mandatory, so that its rarest word finds every place of it.

Each file is looked at by itself: no shuffle, and arrays that grow with the file's words only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import let

# The phrases that the base looks for, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


#: How licences open: label, words, and the phrases that have to be there.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("may not use this file except in compliance with the license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("public-domain", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)

#: Words in more than one text of so many aren't looked up, but for a template's RAREST.
COMMON, RAREST = 50, 3
#: How many of a template's words that the file holds are looked up, and which share of its index words has to stand in place.
LOOKED_UP, SHARE = 3, 0.6
#: By how many words an index word or a mandatory phrase may be off its place.
SLACK = 2

COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words_of(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased; null counts as empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def document_counts(docs: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many texts there are, and how many hold each licence word: one row a word of the templates."""
    held = F.array_append(F.array_intersect(words_of(F.col(text)), _strings(vocabulary)), F.lit(""))  # the empty word stands for the text
    found = {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


def _place(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase)


class Index:
    """The postings of all templates by rare word, ranked by document frequency; they are literals of the plan."""

    def __init__(self, templates: tuple[Template, ...], phrases: tuple[tuple[str, str], ...], total: int, counts: dict[str, int]):
        rank = lambda word: (counts.get(word, 0), word)
        self.anchored = []
        for phrase, label in phrases:
            split = phrase.split()
            anchor = min(split, key=rank)
            self.anchored.append((label, split, anchor, split.index(anchor)))
        self.words, rows = {a for *_, a, _ in self.anchored}, []
        for one in templates:
            split = one.text.split()
            ranked = sorted(set(split), key=rank)
            kept = [w for k, w in enumerate(ranked) if k < RAREST or counts.get(w, 0) * COMMON <= total]
            self.words |= set(kept)
            postings = [(w, at) for at, w in enumerate(split) if w in kept]
            mandatory = [(_place(split, p.split()), p.split()) for p in one.mandatory]
            rows.append(
                F.struct(
                    F.lit(one.label).alias("label"),
                    _strings(kept).alias("ranked"),
                    F.array(*[F.struct(F.lit(w).alias("word"), F.lit(at).alias("at")) for w, at in postings]).alias("postings"),
                    F.array(*[F.struct(F.lit(at).alias("at"), _strings(p).alias("words")) for at, p in mandatory]).alias("mandatory"),
                )
            )
        self.templates = F.array(*rows)

    def base(self, words: Column, places: Column) -> Column:
        """For each base phrase its label and all places where it stands."""

        def one(label: str, split: list[str], anchor: str, at: int) -> Column:
            begins = F.transform(F.filter(places, lambda i: F.get(words, i) == anchor), lambda i: i - at)
            stands = F.filter(begins, lambda s: F.when(s >= 0, F.slice(words, s + 1, F.lit(len(split))) == _strings(split)).otherwise(False))
            return F.struct(F.lit(label).alias("label"), stands.alias("starts"))

        return F.array(*[one(*a) for a in self.anchored])

    def matches(self, words: Column, places: Column) -> Column:
        """For each template its label and the greatest share of index words in place, among the places where all phrases stand; null without any."""
        present = F.array_distinct(F.transform(places, lambda i: F.get(words, i)))

        def begins(t: Column) -> Column:
            looked = F.slice(F.filter(t["ranked"], lambda w: F.array_contains(present, w)), 1, LOOKED_UP)
            near = let(looked, lambda chosen: F.filter(places, lambda i: F.array_contains(chosen, F.get(words, i))))
            return F.array_distinct(F.flatten(F.transform(near, lambda i: F.transform(F.filter(t["postings"], lambda p: p["word"] == F.get(words, i)), lambda p: i - p["at"]))))

        def confirmed(t: Column, s: Column) -> Column:
            def near(p: Column) -> Column:
                return F.slice(words, F.greatest(s + p["at"] - SLACK, F.lit(0)) + 1, F.lit(2 * SLACK + 1))

            return F.size(F.filter(t["postings"], lambda p: F.array_contains(near(p), p["word"])))

        def verified(t: Column, s: Column) -> Column:
            off = F.sequence(F.lit(-SLACK), F.lit(SLACK))

            def stands(m: Column) -> Column:
                return F.exists(off, lambda d: F.when(s + m["at"] + d >= 0, F.slice(words, s + m["at"] + d + 1, F.size(m["words"])) == m["words"]).otherwise(False))

            return F.forall(t["mandatory"], stands)

        def one(t: Column) -> Column:
            needed = F.size(t["postings"]) * SHARE
            rated = F.transform(begins(t), lambda s: F.struct(confirmed(t, s).alias("n"), s.alias("s")))
            good = F.filter(rated, lambda r: F.when(r["n"] >= needed, verified(t, r["s"])).otherwise(False))
            return F.struct(t["label"].alias("label"), (F.array_max(F.transform(good, lambda r: r["n"])) / F.size(t["postings"])).alias("share"))

        return F.transform(self.templates, one)


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """All columns of ``docs`` but the text, and COLUMNS in place of columns of these names.

    n_words; n_base, first_word and last_word: how many places the base phrases stand at, and the smallest and the largest (null
    without any); base_labels and labels: the labels of the base phrases, and these with the templates' labels, different ones in
    order; score: 1 with a base phrase, else the greatest share of a template's index words that stand in place, 0 without label.
    Null and empty texts have no words. Rows are scanned one by one, so repeated rows and null ids have their own results.
    """
    vocabulary = sorted({w for t in templates for w in t.text.split()} | {w for p, _ in phrases for w in p.split()})
    index = Index(templates, phrases, *document_counts(docs, text, vocabulary))
    rare = sorted(index.words)
    rest = [c for c in docs.columns if c not in (text, *COLUMNS)]

    def found(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(rare))
        both = lambda p: F.struct(index.base(words, p).alias("base"), index.matches(words, p).alias("matches"))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.when(F.arrays_overlap(words, _strings(rare)), let(places, both)).alias("at"))

    scanned = docs.select(*rest, let(words_of(F.col(text)), found).alias("_scan"))
    base = F.coalesce("_scan.at.base", F.array().cast(scanned.select("_scan.at.base").schema[0].dataType))
    matches = F.filter(F.coalesce("_scan.at.matches", F.array().cast(scanned.select("_scan.at.matches").schema[0].dataType)), lambda m: m["share"].isNotNull())
    split = scanned.select(*rest, F.col("_scan.n_words").alias("n_words"), F.filter(base, lambda b: F.size(b["starts"]) > 0).alias("_base"), matches.alias("_matches"))
    starts = F.flatten(F.transform("_base", lambda b: b["starts"]))
    own, all_labels = F.transform("_base", lambda b: b["label"]), F.transform("_matches", lambda m: m["label"])
    return split.select(
        *rest,
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, all_labels)), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("_matches", lambda m: m["share"])), F.lit(0.0))).alias("score"),
    )


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
