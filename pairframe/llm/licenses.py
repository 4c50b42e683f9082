"""License detection by ordered signature rules.

Texts are reduced to their words, one space apart, and every rule is a regular expression
over that form. A text must hold one of a few gate strings to be looked at at all, and a
rule runs only on texts that hold its keyword. Detections are word intervals: one inside
another (of a longer match, or of the same length and an earlier rule) is suppressed, and of
two that only overlap the one of the later rule gives way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pairframe.llm.common import ascii_lower

NON_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Every rule's pattern holds one of these strings, so other texts need no rule.
GATES = ("licen", "cc by", "cc0", "copyright", "public domain", "spdx", "redistribution", "permission", "as is", "unlicense", "creative commons")


@dataclass(frozen=True)
class Family:
    """One license: its label, the keyword its names hold, its names and versions.

    `own` gives the keyword of each name that does not hold that of the family.
    """

    label: str
    keyword: str
    names: tuple[str, ...]
    versions: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    own: tuple[tuple[str, str], ...] = ()

    def keyword_of(self, name: str) -> str:
        return dict(self.own).get(name, self.keyword)


FAMILIES = (
    Family("agpl", "affero", ("gnu affero general public licen[cs]e", "affero general public licen[cs]e"), ("1", "3"), ("agpl 1 0", "agpl 3 0")),
    Family("lgpl", "gnu", ("gnu (?:lesser|library) general public licen[cs]e",), ("2", "2 1", "3"), ("lgpl 2 0", "lgpl 2 1", "lgpl 3 0")),
    Family("gfdl", "gnu", ("gnu free documentation licen[cs]e",), ("1 1", "1 2", "1 3"), ("gfdl 1 1", "gfdl 1 2", "gfdl 1 3")),
    Family("gpl", "gnu", ("gnu general public licen[cs]e", "gnu gpl licen[cs]e"), ("1", "2", "3"), ("gpl 1 0", "gpl 2 0", "gpl 3 0")),
    Family("apache", "apache", ("apache(?: software)? licen[cs]e",), ("1 0", "1 1", "2 0"), ("apache 1 0", "apache 1 1", "apache 2 0")),
    Family("mit", "mit", ("mit licen[cs]e", "mit x11 licen[cs]e", "expat mit licen[cs]e"), (), ("mit", "mit 0")),
    Family("bsd-2-clause", "bsd", ("(?:2|two) clause bsd licen[cs]e", "simplified bsd licen[cs]e", "freebsd licen[cs]e"), (), ("bsd 2 clause",), (("freebsd licen[cs]e", "freebsd"),)),
    Family("bsd-3-clause", "bsd", ("(?:3|three) clause bsd licen[cs]e", "(?:new|modified|revised) bsd licen[cs]e"), (), ("bsd 3 clause",)),
    Family("bsd-4-clause", "bsd", ("(?:4|four) clause bsd licen[cs]e", "original bsd licen[cs]e"), (), ("bsd 4 clause",)),
    Family("bsd", "bsd", ("bsd licen[cs]e", "bsd style licen[cs]e"), (), ("0bsd",)),
    Family("mpl", "mozilla", ("mozilla public licen[cs]e",), ("1 0", "1 1", "2 0"), ("mpl 1 0", "mpl 1 1", "mpl 2 0")),
    Family("epl", "eclipse", ("eclipse public licen[cs]e", "eclipse distribution licen[cs]e"), ("1 0", "2 0"), ("epl 1 0", "epl 2 0")),
    Family("cddl", "development", ("common development and distribution licen[cs]e",), ("1 0", "1 1"), ("cddl 1 0", "cddl 1 1")),
    Family("cpl", "common", ("common public licen[cs]e",), ("1 0",), ("cpl 1 0",)),
    Family("eupl", "union", ("european union public licen[cs]e",), ("1 0", "1 1", "1 2"), ("eupl 1 1", "eupl 1 2")),
    Family("artistic", "artistic", ("artistic licen[cs]e",), ("1 0", "2 0"), ("artistic 1 0", "artistic 2 0")),
    Family("isc", "isc", ("isc licen[cs]e", "internet systems consortium isc licen[cs]e"), (), ("isc",)),
    Family("zlib", "zlib", ("zlib(?: libpng)? licen[cs]e",), (), ("zlib",)),
    Family("boost", "boost", ("boost software licen[cs]e",), ("1 0",), ("bsl 1 0",)),
    Family("bsl", "business", ("business source licen[cs]e",), ("1 0", "1 1"), ("busl 1 1",)),
    Family("sspl", "server", ("server side public licen[cs]e",), ("1",), ("sspl 1 0",)),
    Family("elastic", "elastic", ("elastic licen[cs]e",), ("1 0", "2 0"), ("elastic 2 0",)),
    Family("postgresql", "postgresql", ("postgresql licen[cs]e",), (), ("postgresql",)),
    Family("python", "python", ("python software foundation licen[cs]e", "psf licen[cs]e agreement for python"), ("2",), ("psf 2 0", "python 2 0")),
    Family("php", "php", ("php licen[cs]e",), ("3 0", "3 01"), ("php 3 0", "php 3 01")),
    Family("ruby", "ruby", ("ruby licen[cs]e", "same licen[cs]e as ruby"), (), ("ruby",)),
    Family("openssl", "openssl", ("openssl licen[cs]e", "openssl toolkit licen[cs]e"), (), ("openssl",)),
    Family("wtfpl", "you", ("do what the (?:f ck|fuck) you want to public licen[cs]e",), ("2",), ("wtfpl",)),
    Family("unlicense", "unlicense", ("the unlicense", "unlicense org"), (), ("unlicense",)),
    Family("ofl", "font", ("sil open font licen[cs]e", "open font licen[cs]e"), ("1 0", "1 1"), ("ofl 1 0", "ofl 1 1")),
    Family("odbl", "database", ("open database licen[cs]e", "odc open database licen[cs]e"), ("1 0",), ("odbl 1 0",)),
    Family("odc-by", "data", ("open data commons attribution licen[cs]e",), ("1 0",), ("odc by 1 0",)),
    Family("ms-pl", "microsoft", ("microsoft public licen[cs]e",), (), ("ms pl",)),
    Family("ms-rl", "microsoft", ("microsoft reciprocal licen[cs]e",), (), ("ms rl",)),
    Family("apsl", "apple", ("apple public source licen[cs]e",), ("1 0", "2 0"), ("apsl 1 0", "apsl 2 0")),
    Family("ipl", "ibm", ("ibm public licen[cs]e",), ("1 0",), ("ipl 1 0",)),
    Family("osl", "open", ("open software licen[cs]e",), ("1 0", "2 0", "3 0"), ("osl 2 0", "osl 3 0")),
    Family("afl", "academic", ("academic free licen[cs]e",), ("1 2", "2 1", "3 0"), ("afl 2 1", "afl 3 0")),
    Family("ncsa", "illinois", ("university of illinois(?: ncsa)? open source licen[cs]e",), (), ("ncsa",)),
    Family("qpl", "q", ("q public licen[cs]e",), ("1 0",), ("qpl 1 0",)),
    Family("upl", "universal", ("universal permissive licen[cs]e",), ("1 0",), ("upl 1 0",)),
    Family("vim", "vim", ("vim licen[cs]e",), (), ("vim",)),
    Family("curl", "curl", ("curl licen[cs]e",), (), ("curl",)),
    Family("json", "json", ("json licen[cs]e",), (), ("json",)),
    Family("cecill", "cecill", ("cecill(?: [abc])?(?: free software)? licen[cs]e",), ("1 0", "2 0", "2 1"), ("cecill 1 0", "cecill 2 1")),
    Family("cc-by-nc-sa", "nc", ("cc by nc sa", "creative commons attribution non ?commercial share ?alike licen[cs]e"), ("2 0", "2 5", "3 0", "4 0"), (), (("creative commons attribution non ?commercial share ?alike licen[cs]e", "creative"),)),
    Family("cc-by-nc-nd", "nc", ("cc by nc nd",), ("2 0", "2 5", "3 0", "4 0")),
    Family("cc-by-nc", "nc", ("cc by nc",), ("2 0", "2 5", "3 0", "4 0")),
    Family("cc-by-nc", "creative", ("creative commons attribution non ?commercial(?: licen[cs]e)?",), ("3 0", "4 0")),
    Family("cc-by-sa", "sa", ("cc by sa",), ("2 0", "2 5", "3 0", "4 0")),
    Family("cc-by-sa", "creative", ("creative commons attribution share ?alike(?: licen[cs]e)?",), ("3 0", "4 0")),
    Family("cc-by-nd", "nd", ("cc by nd",), ("2 0", "2 5", "3 0", "4 0")),
    Family("cc-by", "cc", ("cc by",), ("2 0", "2 5", "3 0", "4 0")),
    Family("cc-by", "creative", ("creative commons attribution licen[cs]e",), ("2 0", "2 5", "3 0", "4 0")),
    Family("cc0", "cc0", ("cc0", "cc0 1 0(?: universal)?"), (), ("cc0 1 0",)),
    Family("llama-community", "community", ("llama(?: [23])? community licen[cs]e",), ("2", "3", "3 1")),
    Family("openrail", "rail", ("(?:creativeml |bigscience |bigcode )?open rail(?: m)? licen[cs]e", "creativeml openrail m licen[cs]e"), (), ("openrail",), (("creativeml openrail m licen[cs]e", "openrail"),)),
)

#: Sentences of license texts, without the license's name: (label, keyword, pattern).
SENTENCES = (
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "modify", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "redistribute", "redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "redistribute", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "redistribute", "redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("apache", "compliance", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache", "required", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented(?: \\w+){0,12} licen[cs]e"),
    ("boost", "boost", "distributed under the boost software licen[cs]e"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "public domain dedication"),
    ("warranty-disclaimer", "as", "the software is provided as is without warranty of any kind"),
    ("proprietary", "rights", "copyright(?: c)?(?: \\d{4})?(?: \\w+){1,6} all rights reserved"),
    ("proprietary", "permission", "no part of this (?:publication|work|document) may be reproduced(?: \\w+){0,20} permission"),
    ("proprietary", "proprietary", "proprietary licen[cs]e"),
    ("commercial", "commercial", "commercial licen[cs]e"),
    ("evaluation", "evaluation", "evaluation licen[cs]e"),
    ("freeware", "freeware", "freeware licen[cs]e"),
    ("shareware", "shareware", "shareware licen[cs]e"),
    ("eula", "user", "end user licen[cs]e agreement"),
)

GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|covered) under(?: the terms of)?(?: the| an?)? "


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    score: float


def signature_rules() -> list[Rule]:
    """All rules in order of priority: tags, sentences, versions, grants, names."""
    tags, sentences, versions, grants, names = [], [], [], [], []
    for f in FAMILIES:
        for tag in f.tags:
            tags.append(Rule(f.label, "spdx", f"spdx licen[cs]e identifier {tag}(?: only| or later)?", 1.0))
        for name in f.names:
            for version in f.versions:
                versions.append(
                    Rule(f.label, f.keyword_of(name), f"(?:{GRANT})?{name}(?: version| v)? {version}(?: (?:only|or later|international|unported))?", 0.95)
                )
            grants.append(Rule(f.label, f.keyword_of(name), f"{GRANT}{name}", 0.9))
            names.append(Rule(f.label, f.keyword_of(name), name, 0.6))
    for label, keyword, pattern in SENTENCES:
        sentences.append(Rule(label, keyword, pattern, 0.85))
    return tags + sentences + versions + grants + names


def word_form(text: Column) -> Column:
    """The words, lower-cased in A-Z, one space apart; null and wordless texts: empty."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORDS, " "))


def word_count(form: Column) -> Column:
    spaces = F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit("")))
    return F.when(form == "", 0).otherwise(spaces + 1).cast("long")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def rule_table(spark: SparkSession) -> DataFrame:
    """(rule, label, keyword, pattern, confidence, base); base rules come last and number below zero."""
    rows = [(i, r.label, r.keyword, r.pattern, r.score, False) for i, r in enumerate(signature_rules())]
    rows += [(-1 - i, label, phrase.split(" ")[0], phrase, 0.5, True) for i, (phrase, label) in enumerate(BASE)]
    return spark.createDataFrame(rows, "rule int, label string, keyword string, pattern string, confidence double, base boolean")


def detect(forms: DataFrame, key_col: str, form_col: str) -> DataFrame:
    """Every place where a rule matches: key, rule, label, confidence, base, first_word, end_word.

    `forms` holds each text once. Keywords select the rules by an equi join with the table
    of rules, which is fixed in size and therefore broadcast.
    """
    rules = rule_table(forms.sparkSession)
    keywords = sorted({r.keyword for r in signature_rules()} | {p.split(" ")[0] for p, _ in BASE})
    padded = F.concat(F.lit(" "), F.col(form_col), F.lit(" "))
    held = F.filter(
        F.array(*[F.when(F.contains("_padded", F.lit(f" {k} ")), F.lit(k)) for k in keywords]), lambda k: k.isNotNull()
    )
    gated = forms.select(key_col, padded.alias("_padded")).select(key_col, "_padded", F.explode(held).alias("keyword"))
    lazily = F.concat(F.lit(r"(?s)\G(.*?) ("), F.col("pattern"), F.lit(")(?= )"))
    found = (
        gated.join(F.broadcast(rules), "keyword")
        .withColumn("_match", F.regexp_extract_all("_padded", lazily, F.lit(2)))
        .filter(F.size("_match") > 0)
        .withColumn("_gap", F.regexp_extract_all("_padded", lazily, F.lit(1)))
    )
    # words before match k: those of all gaps up to it and of all matches before it
    spans = F.zip_with("_gap", "_match", lambda g, m: F.struct(_spaces(g).alias("gap"), (_spaces(m) + 1).alias("words")))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))
    placed = F.aggregate(
        spans,
        none,
        lambda s, x: F.struct(
            (s["end"] + x["gap"] + x["words"]).alias("end"),
            F.concat(
                s["done"],
                F.array(F.struct((s["end"] + x["gap"]).alias("a"), (s["end"] + x["gap"] + x["words"]).alias("b"))),
            ).alias("done"),
        ),
        lambda s: s["done"],
    )
    place = F.explode(placed).alias("place")
    return found.select(key_col, "rule", "label", "confidence", "base", place).select(
        key_col, "rule", "label", "confidence", "base", F.col("place.a").alias("first_word"), F.col("place.b").alias("end_word")
    )


def resolve(detections: DataFrame, key_col: str) -> DataFrame:
    """Detections without those inside another and without the later rule of two that overlap.

    In order of start, a longer one first, an interval lies inside an earlier one exactly
    if the largest end so far reaches its own. What remains has rising starts and ends, so
    only neighbours can overlap.
    """
    ordered = Window.partitionBy(key_col).orderBy("first_word", F.col("end_word").desc(), "rule")
    reach = F.max("end_word").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    outer = detections.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("end_word")))
    line = Window.partitionBy(key_col).orderBy("first_word")
    beaten = (
        (F.lag("end_word").over(line) > F.col("first_word")) & (F.lag("rule").over(line) < F.col("rule"))
    ) | ((F.lead("first_word").over(line) < F.col("end_word")) & (F.lead("rule").over(line) < F.col("rule")))
    marked = outer.withColumn("_beaten", F.coalesce(beaten, F.lit(False)))
    return marked.filter(~F.col("_beaten")).drop("_reach", "_beaten")


def gated(form: Column) -> Column:
    any_gate = F.lit(False)
    for gate in GATES:
        any_gate = any_gate | F.contains(form, F.lit(gate))
    return any_gate


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row of `docs` its columns and n_words, n_base, first_word, last_word, base_labels, labels, score.

    Columns of those names are replaced. Equal texts are scanned once. Null or empty texts
    have no words, no labels and score 0; repeated rows have the same result each.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in docs.columns if c not in added]
    form = word_form(F.col(text_col))
    # as a generated column the form is computed once, not in every condition on it
    formed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.explode(F.array(form)).alias("_form"))
    digest = F.sha2("_form", 256)
    hits = formed.filter(gated(F.col("_form"))).select(digest.alias("_key"), "_form").dropDuplicates(["_key"])
    places = detect(hits, "_key", "_form")
    base = (
        places.filter("base")
        .groupBy("_key")
        .agg(
            F.count("*").alias("n_base"),
            F.min("first_word").cast("long").alias("first_word"),
            F.max("first_word").cast("long").alias("last_word"),
            F.array_sort(F.collect_set("label")).alias("_base"),
        )
    )
    own = (
        resolve(places.filter("not base"), "_key")
        .groupBy("_key")
        .agg(F.collect_set("label").alias("_own"), F.max("confidence").alias("_score"))
    )
    result = base.join(own, "_key", "full")
    none = F.array().cast("array<string>")
    # a text without a gate string meets nothing; the row's own words spread such rows
    key = F.when(gated(F.col("_form")), digest).otherwise(F.concat(F.lit("-"), F.xxhash64("_row").cast("string")))
    rows = formed.select("_row", word_count(F.col("_form")).alias("n_words"), key.alias("_key"))
    return rows.join(result, "_key", "left").select(
        "_row.*",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.coalesce("_base", none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("_base", none), F.coalesce("_own", none))), ",").alias("labels"),
        F.coalesce("_score", F.when(F.col("n_base") > 0, 0.5), F.lit(0.0)).alias("score"),
    )


def licensed_documents(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).drop("text")
