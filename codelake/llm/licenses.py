"""License scans: ordered signature rules over the words of a text, in DataFrame functions only.

A text's lower-case words, joined by single blanks, are what the rules read.  A rule's
regular expression runs only where its keyword is among the words.  Of the detections,
one that lies inside another goes: the longer one says more ("licensed under the apache
license version 2 0" over "apache license").  Between equal intervals the rule with the
better priority stays, then the one named first.  Detections that only cross both stay.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import table, unclashed
from codelake.llm.registry import query

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are looked for as they stand, in any case.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, keyword (a word of every match), expression of the name.
NAMES = [
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?"),
    ("apache", "apache", r"(?:the )?apache (?:software )?licen[cs]e"),
    ("mit", "mit", r"(?:the )?mit licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("gpl-1.0", "gnu", r"gnu general public licen[cs]e (?:version |v)1(?: 0)?"),
    ("gpl-2.0", "gnu", r"gnu general public licen[cs]e (?:version |v)2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu general public licen[cs]e (?:version |v)3(?: 0)?"),
    ("gpl-2.0-or-later", "gnu", r"gnu general public licen[cs]e (?:version |v)2(?: 0)? or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "gnu", r"gnu general public licen[cs]e (?:version |v)3(?: 0)? or (?:at your option )?any later version"),
    ("gpl", "gnu", r"(?:the )?gnu (?:general public licen[cs]e|gpl)"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3"),
    ("lgpl-2.0", "gnu", r"gnu library general public licen[cs]e(?: (?:version |v)2(?: 0)?)?"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public licen[cs]e (?:version |v)2 1"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public licen[cs]e (?:version |v)3(?: 0)?"),
    ("lgpl", "gnu", r"gnu (?:lesser general public licen[cs]e|lgpl)"),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2(?: 1)?"),
    ("lgpl-3.0", "lgplv3", r"(?:gnu )?lgplv3"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[cs]e(?: (?:version |v)3(?: 0)?)?"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e (?:version |v)1(?: 0)?"),
    ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3"),
    ("gfdl-1.2", "gnu", r"gnu free documentation licen[cs]e (?:version |v)1 2"),
    ("gfdl-1.3", "gnu", r"gnu free documentation licen[cs]e (?:version |v)1 3"),
    ("gfdl", "gnu", r"gnu free documentation licen[cs]e"),
    ("bsd-1-clause", "bsd", r"(?:1|one) clause bsd licen[cs]e|bsd (?:1|one) clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:(?:2|two) clause|simplified|freebsd) bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:(?:3|three) clause|new|modified|revised) bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four) clause|original|old) bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)?"),
    ("0bsd", "bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?"),
    ("bsd", "bsd", r"(?:the )?bsd (?:style )?licen[cs]e"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"(?:the )?libpng licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "want", r"do what the fuck you want to public licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version |v)?1 0)?"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?2 0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?2 0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version |v)?1 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: (?:version |v)?1 0)?"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e(?: (?:version |v)?1 0)?"),
    ("cddl-1.1", "distribution", r"common development and distribution licen[cs]e (?:version |v)?1 1"),
    ("cpl-1.0", "common", r"common public licen[cs]e(?: (?:version |v)?1 0)?"),
    ("cpal-1.0", "attribution", r"common public attribution licen[cs]e(?: (?:version |v)?1 0)?"),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?: (?:version |v)?1 0)?"),
    ("apsl-2.0", "apple", r"apple public source licen[cs]e(?: (?:version |v)?2 0)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: (?:version |v)?1 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v)?2 0"),
    ("afl-3.0", "academic", r"academic free licen[cs]e(?: (?:version |v)?3 0)?"),
    ("osl-3.0", "open", r"open software licen[cs]e(?: (?:version |v)?3 0)?"),
    ("eupl-1.1", "eupl", r"eupl (?:version |v)?1 1"),
    ("eupl-1.2", "eupl", r"eupl (?:version |v)?1 2"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?(?: (?:agreement )?(?:version |v)?2 1)?"),
    ("python-2.0", "python", r"python software foundation licen[cs]e(?: (?:version |v)?2(?: 0)?)?|python licen[cs]e"),
    ("php-3.01", "php", r"php licen[cs]e(?: (?:version |v)?3 0(?:1| 1))?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[cs]e|ncsa open source licen[cs]e"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e"),
    ("ofl-1.1", "sil", r"sil open font licen[cs]e(?: (?:version |v)?1 1)?"),
    ("odbl-1.0", "database", r"open database licen[cs]e(?: (?:version |v)?1 0)?"),
    ("odc-by-1.0", "data", r"open data commons attribution licen[cs]e(?: (?:version |v)?1 0)?"),
    ("pddl-1.0", "domain", r"public domain dedication and licen[cs]e(?: (?:version |v)?1 0)?"),
    ("public-domain", "domain", r"(?:in(?:to)?|placed in) the public domain|public domain dedication"),
    ("beerware", "beerware", r"beerware(?: licen[cs]e)?"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e(?: (?:version |v)?1 0)?"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:version |v)?2 0)?"),
    ("sspl-1.0", "sspl", r"sspl(?: (?:version |v)?1(?: 0)?)?"),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: (?:version |v)?1 1)?"),
    ("llama", "llama", r"llama [0-9]+(?: [0-9]+)? community licen[cs]e(?: agreement)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?"),
]

#: Creative Commons: the parts of a licence's short name and its long name.
CC_KINDS = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative)?s(?: works)?",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: label, keyword, sentence that grants or reserves rights.
GRANTS = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "software", r"this software is provided as is without any express or implied warranty"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser |affero )?general public licen[cs]e"),
    ("cc0-1.0", "dedicated", r"dedicated (?:to|all copyright) .{0,200}?public domain"),
    ("proprietary", "reserved", r"all rights reserved"),
]


@dataclass(frozen=True)
class Signature:
    priority: int  # smaller is better
    keyword: str
    pattern: str
    label: str
    score: float


def signatures() -> list[Signature]:
    """All rules in order: identifiers and grants first, plain mentions last."""
    names = list(NAMES) + [("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?")]
    for kind, long_name in CC_KINDS.items():
        label = "cc-" + kind.replace(" ", "-")
        names.append((label, "cc", f"cc {kind}(?: licen[cs]e)?"))
        names.append((label, "creative", f"creative commons {long_name}(?: licen[cs]e)?"))
        for v in CC_VERSIONS:
            names.append((f"{label}-{v.replace(' ', '.')}", "cc", f"cc {kind} (?:version |v)?{v}"))
            names.append((f"{label}-{v.replace(' ', '.')}", "creative", f"creative commons {long_name} (?:version |v)?{v}(?: (?:international|unported))?(?: licen[cs]e)?"))
    spoken = r"(?:licen[cs]ed|released|distributed|published|available|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?"
    out = [Signature(0, "spdx", f"spdx licen[cs]e identifier {label.replace('-', ' ').replace('.', ' ')}(?: only)?", label, 1.0) for label in dict.fromkeys(n[0] for n in names)]
    out += [Signature(1, k, p, label, 0.95) for label, k, p in GRANTS]
    out += [Signature(2, k, f"{spoken}(?:{p})", label, 0.9) for label, k, p in names]
    out += [Signature(3, k, p, label, 0.8 if label[-1].isdigit() else 0.6) for label, k, p in names]
    # whole words only
    return [Signature(s.priority, s.keyword, f"(?<= )(?:{s.pattern})(?= )", s.label, s.score) for s in out]


def _marked(words: Column, pattern: Column) -> Column:
    """The words again, with \\u0001 before a match's first and \\u0002 behind its last."""
    return F.split(F.trim(F.regexp_replace(words, pattern, F.lit("\u0001$0\u0002"))), " ")


def _places(marked: Column, first: bool) -> Column:
    at = F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\u0001")) if first else F.endswith(w, F.lit("\u0002")), i))
    return F.filter(at, lambda i: i.isNotNull())


def scan_licenses(df: DataFrame, text: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """All rows with n_words, n_base, first_word, last_word, base_labels, labels, score and ``detections``.

    ``detections`` is what the suppression leaves: array of (start, end, priority, rule,
    label, score), in words from 0, the end exclusive.  ``labels`` also holds the base
    labels.  ``score`` is the best detection's, 0.5 for base phrases alone, 0 for none.  A
    null or empty text has no words, empty label lists and a null first and last word.
    Rows are judged one by one and all stay; columns with the new names are replaced.
    """
    rules = signatures() if rules is None else rules
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections", "_words", "_keys", "_text", "_base", "_found", "_kept"]
    frame = unclashed(df, new)
    # lower() also changes letters beyond ASCII, but only into letters of the words' class, and never into those of a phrase
    frame = frame.withColumn("_words", F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)))
    keywords = sorted({r.keyword for r in rules} | {p.split()[0] for p in BASE})
    frame = frame.withColumn("_keys", F.array_intersect("_words", F.split(F.lit(" ".join(keywords)), " ")))
    some = F.size("_keys") > 0
    frame = frame.withColumn("_text", F.when(some, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))))

    base = _marked(F.col("_text"), F.lit(f"(?<= )(?:{'|'.join(BASE)})(?= )"))
    frame = frame.withColumn("_base", F.when(some, _places(base, True)))
    holds = F.array(*[F.when(F.contains(F.col("_text"), F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()])
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.filter(holds, lambda x: x.isNotNull()))), F.array().cast("array<string>"))

    # one literal, not thousands of them, keeps planning short
    written = json.dumps([{"priority": r.priority, "rule": k, "keyword": r.keyword, "pattern": r.pattern, "label": r.label, "score": r.score} for k, r in enumerate(rules)])
    table_ = F.from_json(F.lit(written), "array<struct<priority:int,rule:int,keyword:string,pattern:string,label:string,score:double>>")
    gated = F.filter(table_, lambda r: F.array_contains(F.col("_keys"), r["keyword"]) & F.regexp_like(F.col("_text"), r["pattern"]))

    def spans(r: Column) -> Column:
        marked = _marked(F.col("_text"), r["pattern"])
        ends = _places(marked, False)
        return F.transform(_places(marked, True), lambda s, k: F.struct(
            s.alias("start"), (-(F.get(ends, k) + 1)).alias("less_end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["score"].alias("score")))

    shape = "array<struct<start:int,less_end:int,priority:int,rule:int,label:string,score:double>>"
    frame = frame.withColumn("_found", F.when(some, F.array_sort(F.flatten(F.transform(gated, spans)))).cast(shape))
    # sorted by start, then the longest first, then priority: what ends no later than something before lies inside it
    kept = F.aggregate(
        "_found", F.struct(F.lit(0).alias("reach"), F.array().cast(shape).alias("kept")),
        lambda a, d: F.when(-d["less_end"] <= a["reach"], a).otherwise(
            F.struct((-d["less_end"]).alias("reach"), F.concat(a["kept"], F.array(d)).alias("kept"))),
        lambda a: a["kept"])
    frame = frame.withColumn("_kept", F.coalesce(kept, F.array().cast(shape)))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("_kept", lambda d: d["label"]))))
    n_base = F.coalesce(F.size("_base"), F.lit(0))
    n_base = F.when(some, n_base).otherwise(0).cast("bigint")
    return frame.select(
        *[F.col(f"`{c}`") for c in frame.columns if c not in new],
        F.size("_words").cast("bigint").alias("n_words"),
        n_base.alias("n_base"),
        F.get("_base", F.lit(0)).cast("bigint").alias("first_word"),
        F.when(n_base > 0, F.element_at("_base", -1)).cast("bigint").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_kept", lambda d: d["score"])), F.when(n_base > 0, 0.5), F.lit(0.0)).alias("score"),
        F.transform("_kept", lambda d: F.struct(
            d["start"].alias("start"), (-d["less_end"]).alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["score"].alias("score"))).alias("detections"),
    )


@query("op2_license_scans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
