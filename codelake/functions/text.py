"""Text column functions; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

META = re.compile(r"([\\.\[\]{}()*+?^$|\-/#&~])")


def quote_regex(text: str) -> str:
    """Escape regex metacharacters in a way that Java and RE2 both read."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def alternation(words: Sequence[str]) -> str:
    return "|".join(quote_regex(w) for w in words)


def java_trim(col: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.btrim(col, F.lit("".join(map(chr, range(0x21)))))


def csv_cell(col: Column) -> Column:
    text = F.coalesce(col.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def html_to_text(col: Column) -> Column:
    """Drop script and style blocks, tags to spaces, four entities, collapse white space."""
    # Fixed patterns and order.
    steps = [
        ("(?s)<(script|style)[^>]*>.*?</(script|style)>", ""),
        ("<[^>]+>", " "),
        ("&nbsp;", " "),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("[ \\t\\n\\x0B\\f\\r]{2,}", " "),
    ]
    return java_trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col))


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def json_slice(col: Column) -> Column:
    """First ``{`` to last ``}``, or the input when there is no such span."""
    span = F.regexp_extract(col, "(?s)\\{.*\\}", 0)
    return F.when(span != "", span).otherwise(col)


def json_strings(col: Column) -> Column:
    """JSON array to its non-blank strings; anything else to an empty array."""
    parsed = F.from_json(col, "array<string>")
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull() & (java_trim(x) != "")), F.array().cast("array<string>"))


def simple_name(col: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(col, ".", -1)


def owner_of(col: Column) -> Column:
    """Text before ``#``; the whole text when ``#`` is absent or first."""
    return F.when(F.instr(col, "#") > 1, F.substring_index(col, "#", 1)).otherwise(col)


def strip_generics(col: Column) -> Column:
    return F.substring_index(col, "<", 1)


def first_sentence(col: Column) -> Column:
    """Up to and including the first dot that a space follows, else everything."""
    text = F.regexp_replace(col, "^\\s+|\\s+$", "")
    dot = F.instr(text, ". ")
    return F.when(dot > 1, F.substr(text, F.lit(1), dot)).otherwise(text)


def truncate(col: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(mark))).otherwise(col)


def duration_label(seconds: Column) -> Column:
    """``—`` for nothing, ``12s`` below a minute, else ``1m 03s``."""
    s = F.floor(seconds + F.lit(0.5)).cast("bigint")
    return (
        F.when(seconds.isNull() | (seconds <= 0), "—")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s")))
    )


# Fixed HTML escapes; the ampersand goes first.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def html_escape(col: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), HTML_ESCAPES, col)


def highlight(col: Column, terms: Sequence[str]) -> Column:
    """HTML-escape, then mark every term in one case-insensitive pass."""
    real = [t.strip() for t in terms if t.strip()]
    escaped = html_escape(col)
    if not real:
        return escaped
    return F.regexp_replace(escaped, f"(?i)({alternation(real)})", "<mark>$1</mark>")


def rewrite(col: Column, corrections: Sequence[tuple[str, str]]) -> Column:
    """Ordered literal corrections."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), corrections, col)


# Fixed package lists of the javax to jakarta move.
MOVED = [
    "activation", "batch", "decorator", "ejb", "el", "enterprise", "faces", "inject", "interceptor", "jms", "json",
    "mail", "persistence", "resource", "servlet", "validation", "websocket", "ws\\.rs", "security\\.auth\\.message",
    "security\\.enterprise", "security\\.jacc", "xml\\.bind", "xml\\.soap", "xml\\.ws", "transaction", "annotation",
]
STAYS = ["transaction\\.xa", "annotation\\.processing"]


def javax_to_jakarta(col: Column) -> Column:
    """Rewrite ``javax.`` only in front of packages that moved."""
    end = "(?![a-zA-Z0-9_])"
    pattern = f"\\bjavax\\.(?!(?:{'|'.join(STAYS)}){end})(?=(?:{'|'.join(MOVED)}){end})"
    return F.regexp_replace(col, pattern, "jakarta.")


FENCE = "```"


def strip_fences(col: Column) -> Column:
    """Content of a leading fence up to the next fence; text before a stray fence."""
    s = F.regexp_replace(col, "^\\s+|\\s+$", "")
    newline = F.instr(s, "\n")
    inner = F.substr(s, newline + 1, F.length(s))
    opened = F.when(newline == 0, F.lit("")).otherwise(F.substring_index(inner, FENCE, 1))
    out = F.when(s.startswith(FENCE), opened).otherwise(F.substring_index(s, FENCE, 1))
    return F.regexp_replace(out, "\\s+$", "")


def strip_prose(content: Column, path: Column) -> Column:
    """Drop prose in front of the first tag (XML) or the first code line (Java)."""
    lower = F.lower(path)
    lt = F.instr(content, "<")
    xml = F.when(
        (lt > 1) & (F.regexp_replace(F.substr(content, F.lit(1), lt - 1), "\\s+", "") != ""),
        F.substr(content, lt, F.length(content)),
    ).otherwise(content)
    code = F.regexp_extract(
        content, "(?ms)^[ \\t]*(?:package\\s|import\\s|@|//|/\\*|\\*|public\\s|final\\s|abstract\\s|class\\s|interface\\s|enum\\s|record\\s).*", 0
    )
    java = F.when(code != "", code).otherwise(content)
    return F.when(lower.endswith(".xml"), xml).when(lower.endswith(".java"), java).otherwise(content)


# Fixed marker pattern of a multi-file response.
FILE_MARKER = "(?m)^={2,}[ \\t]*FILE:[ \\t]*(.+?)[ \\t]*={2,}[ \\t]*$"


def split_files(col: Column) -> Column:
    """Multi-file response to ``array<struct<path, body>>``; a repeated path keeps its last body."""
    # A lambda evaluates all of its body for each element, so what it shares is bound by a lambda around it.
    found = F.array(F.struct(F.regexp_extract_all(col, F.lit(FILE_MARKER), 1).alias("names"), F.split(col, FILE_MARKER, -1).alias("bodies")))
    pairs = F.transform(found, lambda f: F.filter(
        F.transform(f["names"], lambda n, i: F.struct(
            java_trim(n).alias("path"), F.btrim(F.element_at(f["bodies"], (i + 2).cast("int")), F.lit(" \t\n\x0b\f\r")).alias("body"))),
        lambda p: p["path"] != ""))
    last = F.transform(pairs, lambda ps: F.filter(
        ps,
        lambda p, i: ~F.exists(
            F.slice(ps, (i + 2).cast("int"), F.greatest(F.size(ps) - i - 1, F.lit(0)).cast("int")),
            lambda q: q["path"] == p["path"],
        )))
    return F.get(last, F.lit(0))


def has_marker(col: Column, markers: Sequence[str]) -> Column:
    """Case-sensitive: contains any of the markers."""
    return F.coalesce(col.rlike(alternation(markers)), F.lit(False))


# Fixed file suffixes.
MIGRATABLE = [".java", ".xml", ".yml", ".yaml", ".properties", ".gradle", ".gradle.kts"]


def is_migratable(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(f"({alternation(MIGRATABLE)})$"), F.lit(False))


def notes(features: Column) -> Column:
    """``Migrate: id -> target; id`` from an array of (id, target); null when empty."""
    parts = F.transform(
        features, lambda f: F.concat(f["id"], F.coalesce(F.concat(F.lit(" -> "), f["target"]), F.lit("")))
    )
    return F.when(F.size(features) > 0, F.concat(F.lit("Migrate: "), F.array_join(parts, "; ")))
