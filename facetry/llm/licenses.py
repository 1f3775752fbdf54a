"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import ascii_lower, text_of

#: A word is a run of 0-9, A-Z, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: label, SPDX short name in words, names in words, versions.
FAMILIES = [
    ("mit", "mit", ("mit", "expat"), ()),
    ("apache", "apache", ("apache", "apache software"), ("1 0", "1 1", "2 0")),
    ("gpl", "gpl", ("gpl", "gnu gpl", "general public", "gnu general public"), ("1 0", "2 0", "3 0", "2", "3")),
    ("lgpl", "lgpl", ("lgpl", "gnu lgpl", "lesser general public", "library general public"), ("2 0", "2 1", "3 0")),
    ("agpl", "agpl", ("agpl", "gnu agpl", "affero general public"), ("1 0", "3 0")),
    ("gfdl", "gfdl", ("gfdl", "free documentation"), ("1 1", "1 2", "1 3")),
    ("bsd", "bsd", ("bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "simplified bsd", "new bsd", "original bsd"), ()),
    ("mpl", "mpl", ("mpl", "mozilla public"), ("1 0", "1 1", "2 0")),
    ("epl", "epl", ("epl", "eclipse public"), ("1 0", "2 0")),
    ("edl", "edl", ("edl", "eclipse distribution"), ("1 0",)),
    ("cddl", "cddl", ("cddl", "common development and distribution"), ("1 0", "1 1")),
    ("cpl", "cpl", ("cpl", "common public"), ("1 0",)),
    ("isc", "isc", ("isc", "internet systems consortium"), ()),
    ("zlib", "zlib", ("zlib", "zlib libpng"), ()),
    ("bsl", "bsl", ("bsl", "boost software"), ("1 0",)),
    ("artistic", "artistic", ("artistic",), ("1 0", "2 0")),
    ("cc by", "cc by", ("cc by", "creative commons attribution"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc by sa", "cc by sa", ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("2 0", "3 0", "4 0")),
    ("cc by nc", "cc by nc", ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("3 0", "4 0")),
    ("cc0", "cc0", ("cc0", "creative commons zero"), ("1 0",)),
    ("unlicense", "unlicense", ("unlicense",), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ("1", "2")),
    ("eupl", "eupl", ("eupl", "european union public"), ("1 0", "1 1", "1 2")),
    ("osl", "osl", ("osl", "open software"), ("1 0", "2 0", "3 0")),
    ("afl", "afl", ("afl", "academic free"), ("2 0", "2 1", "3 0")),
    ("ms pl", "ms pl", ("ms pl", "microsoft public"), ()),
    ("ms rl", "ms rl", ("ms rl", "microsoft reciprocal"), ()),
    ("odbl", "odbl", ("odbl", "open database"), ("1 0",)),
    ("ofl", "ofl", ("ofl", "sil open font", "open font"), ("1 0", "1 1")),
    ("php", "php", ("php",), ("3 0", "3 01")),
    ("psf", "psf", ("psf", "python", "python software foundation"), ("2", "2 0")),
    ("ruby", "ruby", ("ruby",), ()),
    ("qpl", "qpl", ("qpl", "q public"), ("1 0",)),
    ("upl", "upl", ("upl", "universal permissive"), ("1 0",)),
    ("vim", "vim", ("vim",), ()),
    ("ncsa", "ncsa", ("ncsa",), ()),
]

#: label, keyword (part of every match), words of a sentence that only this text has.
SENTENCES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "implied", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("bsl", "boost", r"distributed under the boost software license"),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this license"),
    ("public domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("cc0", "waive", r"waived all copyright and related or neighboring rights"),
]

#: The phrases of the contract: label and words.  They are never suppressed.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Confidence of a rule by its priority.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.7}
LEVELS = len(CONFIDENCE)


@dataclass(frozen=True)
class Rule:
    """``keywords``: the rule is tried where the text has one of them."""

    priority: int
    label: str
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False


def rules() -> list[Rule]:
    """All rules in their order: tag, sentence, grant, version, name, and the phrases of the contract."""
    out = []
    for label, short, names, versions in FAMILIES:
        words = tuple(f" {n} " for n in names)
        name = "(?:" + "|".join(sorted(names, key=len, reverse=True)) + ")"
        out.append(Rule(1, label, (f" identifier {short} ",), rf"spdx license identifier {short}(?: [0-9]+)*(?: only| or later)?"))
        out.append(Rule(3, label, words, rf"(?:licensed|released|distributed|available|published|provided|covered|offered) under (?:the )?(?:terms of )?(?:the )?{name} licen[cs]es?"))
        out.append(Rule(3, label, (f" {short} ",), rf"licensed? (?:is |as |type )?{short}(?: [0-9]+)+"))
        out.append(Rule(3, label, words, rf"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name} licen[cs]e"))
        out.extend(Rule(4, label, words, rf"{name}(?: licen[cs]e)? (?:version |v )?v?{v}(?: or (?:later|newer|any later version))?") for v in versions)
        out.append(Rule(5, label, words, rf"{name} licenses?"))
        out.append(Rule(5, label, words, rf"{name} licences?"))
    out.extend(Rule(2, label, (keyword,), pattern) for label, keyword, pattern in SENTENCES)
    out.extend(Rule(5, label, (f" {pattern} ",), pattern, True) for label, pattern in BASE)
    return sorted(out, key=lambda r: r.priority)


#: All rules but those of a version hold "license" or "licence", or they are sentences and hold their keyword.
GATE = ("licens", "licenc", *sorted({max(keyword.split(), key=len) for _, keyword, _ in SENTENCES}))

#: What every version rule needs, in lower-case text that is not yet split into words: a whole name of a family with versions and a number behind it.
VERSIONED = (WORD.replace("[^", "(?<![^", 1)[:-1] + ")(?:" + "|".join(sorted({n.replace(" ", GAP) for _, _, names, versions in FAMILIES if versions for n in names}))
             + f"){GAP}(?:licen[cs]e{GAP})?(?:version{GAP}|v{GAP})?v?[0-9]")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(norm: Column, pattern: Column) -> Column:
    """(first, last) word of every place of the pattern: matches are marked, and blanks before each mark are counted."""
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    parts = F.split(F.regexp_replace(norm, bounded, F.lit("\x01$0\x02")), "\x01")
    start = F.struct(F.lit(-1).cast("bigint").alias("seen"), F.lit(False).alias("hit"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("found"))

    def step(s: Column, p: Column) -> Column:
        place = F.struct(s["seen"].alias("first"), (s["seen"] + _spaces(F.substring_index(p, "\x02", 1))).alias("last"))
        return F.struct((s["seen"] + _spaces(p)).cast("bigint").alias("seen"), F.lit(True).alias("hit"),
                        F.when(s["hit"], F.concat(s["found"], F.array(place))).otherwise(s["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda s: s["found"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License labels of every row of ``docs``.

    Texts become lower-case words between single blanks.  A rule is tried only where the
    text holds its keyword; a text that meets no rule's need (``GATE``, ``VERSIONED``) is
    never rewritten.  Detections
    are word intervals.  One that lies inside an interval of a rule of higher priority
    is suppressed; the phrases of the contract always keep their label.

    Null and empty texts have no words and no labels, and equal rows equal results; an
    empty table gives no rows.  ``score`` is the confidence of the best kept detection.
    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_detections, n_suppressed.
    """
    known = rules()
    table = F.array(*[F.struct(F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.array(*[F.lit(k) for k in r.keywords]).alias("keywords"),
                               F.lit(r.pattern).alias("pattern"), F.lit(r.base).alias("base")) for r in known])
    low = ascii_lower(F.col("text"))
    folded = F.lower("text")
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(folded, F.lit(word))
    gate = gate | F.rlike(low, F.lit(VERSIONED))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("n_words"),
                       F.when(gate, F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))).alias("norm"))
    tried = rows.withColumn("rule", F.explode_outer(F.when(F.col("norm").isNotNull(), F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("norm"), k))))))
    placed = tried.withColumn("at", F.explode_outer(F.when(F.col("rule").isNotNull(), _places(F.col("norm"), F.col("rule.pattern"))))).select(
        "uid", "doc_id", "n_words", "rule.label", "rule.priority", "rule.base", F.col("at.first").alias("first"), F.col("at.last").alias("last"))
    upto = Window.partitionBy("uid").orderBy(F.asc("first"), F.desc("last")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = [F.max(F.when(F.col("priority") < p, F.col("last"))).over(upto) for p in range(2, LEVELS + 1)]
    covered = F.lit(False)
    for p, reach in zip(range(2, LEVELS + 1), over, strict=True):
        covered = covered | ((F.col("priority") == p) & F.coalesce(reach >= F.col("last"), F.lit(False)))
    found = F.col("first").isNotNull()
    judged = placed.withColumn("kept", found & ~covered).withColumn("base", found & F.col("base"))
    confidence = F.element_at(F.array(*[F.lit(CONFIDENCE[p]) for p in sorted(CONFIDENCE)]), F.col("priority"))
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    base = F.col("base")
    return judged.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(base | F.col("kept")).alias("labels"),
        F.coalesce(F.max(F.when(base | F.col("kept"), confidence)), F.lit(0.0)).alias("score"),
        F.count_if(F.col("kept")).alias("n_detections"), F.count_if(found & ~F.col("kept")).alias("n_suppressed")).drop("uid")
