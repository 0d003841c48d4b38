"""License scan by a positional index of license words.

Each template is looked up by the word of highest IDF of its mandatory key phrase.
Every place of that word proposes the template at an offset (place in the file minus
place in the template). A template is found where enough of its IDF mass stands at
its relative places and its mandatory key phrase stands word for word; where the
phrase stands its rarest word does, so no template is missed. The score looks at
the places of all license words.

All of it works on one row's arrays; only word counts over the corpus are
aggregated, and those have one row per word of the license vocabulary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrase and label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Label, line of the license, mandatory key phrase.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
)

MIN_SHARE = 0.8


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _find(words: list[str], part: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def scan_licenses(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Words are runs of digits, letters and non-ASCII characters after A-Z is
    lower-cased. n_base counts the places where a phrase stands; first_word and
    last_word are the smallest and largest place, null without any. `labels` adds
    the templates found. score is the largest share of a template's IDF mass found
    at one offset, 0 without any; whole texts are kept only for files that hold some
    phrase's words, places of license words for all. A null or empty text has no words. Repeated
    rows and null keys give a row each; other columns are not looked at.
    """
    phrases = [(p.split(), label) for p, label in phrases]
    lines = [(label, line.split(), must.split()) for label, line, must in templates]
    vocabulary = sorted({w for p, _ in phrases for w in p} | {w for _, line, _ in lines for w in line})
    needed = [sorted(set(p)) for p, _ in phrases] + [sorted(set(m)) for _, _, m in lines]

    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    read = docs.select(F.col(key).alias("doc_id"), words.alias("w")).select(
        "doc_id", "w", F.array_intersect("w", _strings(vocabulary)).alias("lic"))
    has = [F.size(F.array_except(_strings(n), F.col("lic"))) == 0 for n in needed]
    possible = has[0]
    for h in has[1:]:
        possible = possible | h
    rows = settle(read.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), "lic", F.when(possible, F.col("w")).alias("w"),
        _spots(vocabulary).alias("spots")))

    total = rows.count()
    seen = {r["w"]: r["df"] for r in rows.select(F.explode("lic").alias("w")).groupBy("w").agg(F.count("*").alias("df")).collect()}
    idf = {w: math.log((1 + total) / (1 + seen.get(w, 0))) + 1e-9 for w in vocabulary}

    votes = _Votes(vocabulary, lines, idf)
    rows = rows.withColumn("places", _phrase_places(phrases)).withColumn("found", votes.alignments())
    rows = rows.withColumn("accepted", F.filter("found", lambda a: a["must"] & (a["share"] >= min_share)))
    starts = F.transform("places", lambda p: p["at"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(
        F.transform("places", lambda p: p["label"]), F.transform("accepted", lambda a: a["label"]))))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.coalesce(votes.score(), F.lit(0.0)).alias("score"),
    )


def _phrase_places(phrases) -> Column:
    """All (at, label) where a phrase's words stand one after the other."""
    parts = [
        F.when(F.size(F.array_except(_strings(sorted(set(phrase))), F.col("lic"))) == 0, _places_of(phrase, label))
        for phrase, label in phrases
    ]
    empty = F.expr("cast(array() as array<struct<at:int,label:string>>)")
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def _places_of(phrase: list[str], label: str) -> Column:
    def place(word: Column, i: Column) -> Column:
        here = (word == phrase[0]) & (F.slice("w", i + 1, F.lit(len(phrase))) == _strings(phrase))
        return F.when(here, i)

    found = F.filter(F.transform("w", place), lambda i: i.isNotNull())
    return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _spots(vocabulary: list[str]) -> Column:
    """Places of the license words, each as one number: the place, and the word's number in the low bits."""
    def spot(word: Column, i: Column) -> Column:
        at = F.shiftleft(i.cast("long"), len(vocabulary).bit_length())
        return F.when(word.isin(vocabulary), at + F.array_position(_strings(vocabulary), word) - 1)

    return F.array_compact(F.transform("w", spot))


class _Votes:
    """Templates at offsets, each as one number: the offset from -width on, the template, and the word's place in it."""

    def __init__(self, vocabulary: list[str], lines, idf: dict[str, float]):
        self.vocabulary, self.lines, self.idf = vocabulary, lines, idf
        self.width = max(len(line) for _, line, _ in lines)
        self.word_bits, self.place_bits = len(vocabulary).bit_length(), self.width.bit_length()
        self.low_bits = len(lines).bit_length() + self.place_bits

    def _mass(self, line: list[str]) -> list[float]:
        return [self.idf[w] / sum(self.idf[x] for x in line) for w in line]

    def _cast(self, postings: list[tuple[str, int, int]]) -> Column:
        """The votes of all spots by postings (word, template, place)."""
        held: dict[str, list[int]] = {}
        for word, t, j in postings:
            held.setdefault(word, []).append(((self.width - j) << self.low_bits) + (t << self.place_bits) + j)
        table = F.array(*[F.array(*[F.lit(d).cast("long") for d in held.get(w, [])]).cast("array<bigint>") for w in self.vocabulary])

        def of(spot: Column) -> Column:
            at = F.shiftleft(F.shiftright(spot, self.word_bits), self.low_bits)
            return F.transform(F.get(table, spot.bitwiseAND((1 << self.word_bits) - 1).cast("int")), lambda d: at + d)

        return F.flatten(F.transform("spots", of))

    def alignments(self) -> Column:
        """(label, share, must) of each template and offset that the rarest word of its mandatory phrase proposes."""
        rarest = [max(must, key=lambda w: (self.idf[w], w)) for _, _, must in self.lines]
        anchors = [(w, t, _find(line, must) + must.index(w)) for t, ((_, line, must), w) in enumerate(zip(self.lines, rarest))]
        library = F.array(*[F.struct(
            F.lit(label).alias("label"), _strings(line).alias("line"), F.array(*map(F.lit, self._mass(line))).alias("mass"),
            F.lit(_find(line, must)).alias("from"), _strings(must).alias("must"),
        ) for label, line, must in self.lines])

        def checked(v: Column) -> Column:
            t = F.shiftright(v, self.place_bits).bitwiseAND((1 << (self.low_bits - self.place_bits)) - 1).cast("int")
            tpl, off = F.get(library, t), (F.shiftright(v, self.low_bits) - self.width).cast("int")
            share = F.aggregate(
                F.sequence(F.lit(0), F.size(tpl["line"]) - 1), F.lit(0.0),
                lambda acc, j: acc + F.when(F.get("w", off + j) == F.get(tpl["line"], j), F.get(tpl["mass"], j)).otherwise(0.0))
            at = off + tpl["from"]
            must = (at >= 0) & (F.slice("w", F.greatest(at, F.lit(0)) + 1, F.size(tpl["must"])) == tpl["must"])
            return F.struct(tpl["label"].alias("label"), F.least(share, F.lit(1.0)).alias("share"), must.alias("must"))

        empty = F.expr("cast(array() as array<struct<label:string,share:double,must:boolean>>)")
        return F.coalesce(F.when(F.col("w").isNotNull(), F.transform(self._cast(anchors), checked)), empty)

    def score(self) -> Column:
        """The largest share at one offset: votes of all license words, summed in order of offset and template."""
        postings = [(w, t, j) for t, (_, line, _) in enumerate(self.lines) for j, w in enumerate(line)]
        masses = [0.0] * (len(self.lines) << self.place_bits)
        for t, (_, line, _) in enumerate(self.lines):
            masses[t << self.place_bits : (t << self.place_bits) + len(line)] = self._mass(line)
        mass = F.array(*map(F.lit, masses))

        def add(acc: Column, v: Column) -> Column:
            here = F.shiftright(v, self.place_bits)
            more = F.get(mass, v.bitwiseAND((1 << self.low_bits) - 1).cast("int"))
            return F.struct(
                here.alias("here"), (F.when(acc["here"] == here, acc["share"]).otherwise(0.0) + more).alias("share"),
                F.greatest(acc["best"], acc["share"]).alias("best"))

        none = F.struct(F.lit(-1).cast("long").alias("here"), F.lit(0.0).alias("share"), F.lit(0.0).alias("best"))
        return F.aggregate(
            F.sort_array(self._cast(postings)), none, add, lambda acc: F.least(F.greatest(acc["best"], acc["share"]), F.lit(1.0)))
