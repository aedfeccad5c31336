"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Emails, addresses, card and phone numbers are the protected entities.  The words that stand
near an entity are terms.  Corpus counts say how strongly a term reveals the entity: the
share of the term's texts that hold the entity, and how many bits the term adds to the
entity's own share of all texts.  A term beyond both thresholds is removed where it
almost names the entity, and generalised otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import apart, saved, table, text_key, unclashed
from codelake.llm.registry import query

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns.  \G and the look-behind let a match begin only where a run
# begins or the last match ended, and the possessive repeats never go back: the same
# matches, in time linear in the text.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"[\p{L}\p{N}]+"
FILTER_BITS = 18
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
NO_SPANS = f"array() as {SPAN}"


def places(text: Column, pattern: Column, kind: int) -> Column:
    """(start, kind, end, value) of every match, in code points, the end exclusive."""
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    shape = F.array().cast(SPAN)
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
        F.concat(a["out"], F.array(F.struct(
            (a["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"),
            (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("value")))).alias("out"))
    pairs = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), shape.alias("out")), step, lambda a: a["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    figures = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(figures, lambda d, k: F.when(k % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind; a null or empty text has none.  Matches that fail their test are dropped, not retried."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    number = F.regexp_like(text, F.lit("[0-9]"))
    found = [
        F.when(F.contains(text, F.lit("@")), places(text, F.lit(EMAIL), 0)).otherwise(none),
        F.when(number, F.filter(places(text, F.lit(IP), 1), lambda s: F.regexp_like(s["value"], F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")))).otherwise(none),
        F.when(number, F.filter(places(text, F.lit(CARD), 2), lambda s: F.when(F.length(_digits(s["value"])).between(12, 19), _luhn(s["value"])).otherwise(F.lit(False)))).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(places(text, F.lit(PHONE), 3), lambda s: F.length(_digits(s["value"])).between(9, 15))).otherwise(none),
    ]
    return F.array_sort(F.concat(*found))


def _entity(span: Column) -> Column:
    """One spelling for each protected value: numbers by their digits, the rest in lower case."""
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"])))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _maybe(keys: DataFrame):
    """Tests whether a long may be among ``keys``: a bitmap of 2**18 bits, whatever their number.

    More keys make it let more through, never less; the join behind it decides.
    """
    place = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = keys.select(place.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).collect()
    bits = {r.word: r.bits for r in rows}
    # one constant when folded
    table = F.split(F.lit(",".join(str(bits.get(k, 0)) for k in range(1 << FILTER_BITS - 6))), ",").cast("array<bigint>")

    def test(key: Column) -> Column:
        at = key.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        word = F.get(table, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(_k, text, spans) of ``docs``, one row for each text key; written, for all counts read it."""
    return saved(docs.select(text_key(F.col("text")).alias("_k"), "text", "spans").dropDuplicates(["_k"]))


def disclosing_terms(docs: DataFrame, **thresholds) -> DataFrame:
    """The terms of ``docs`` with (text, spans), of whose copies one counts; see ``terms_of_texts``."""
    return terms_of_texts(distinct_texts(docs), **thresholds)


def terms_of_texts(
    docs: DataFrame,
    window_words: int = 8,
    window_chars: int = 160,
    min_texts: int = 3,
    min_share: float = 0.5,
    min_bits: float = 4.0,
    min_bits_part: float = 0.8,
    remove_share: float = 0.9,
) -> DataFrame:
    """(entity, term, n_texts, share, bits, action) of the terms beyond the thresholds.

    ``docs`` has (_k, text, spans), a row for each text.  A term is a lower-case word of three characters or more
    within ``window_words`` words and ``window_chars`` code points of the entity.  ``share``
    is P(entity | term) and ``bits`` log2 of it over P(entity), counted in distinct texts:
    copies of one text prove nothing.  The least is ``min_bits``, or ``min_bits_part`` of
    the entity's own bits, -log2 P(entity), where that is less: no term adds more than
    those, so a common entity's terms could never reach ``min_bits``.  A term that adds
    nothing, as every term of an entity in all texts, and a pair seen in fewer than
    ``min_texts`` texts are left alone.
    """
    near = docs.filter(F.size("spans") > 0).select("_k", "text", F.explode("spans").alias("s")).select(
        "_k", _entity(F.col("s")).alias("entity"),
        F.regexp_extract(F.expr(f"substring(text, greatest(1, s.start + 1 - {window_chars}), s.start - greatest(0, s.start - {window_chars}))"), rf"((?:\S+\s+){{0,{window_words}}}\S*)$", 1).alias("before"),
        F.regexp_extract(F.expr(f"substring(text, s.end + 1, {window_chars})"), rf"^(\S*(?:\s+\S+){{0,{window_words}}})", 1).alias("after"))
    pairs = (
        near.select("_k", "entity", F.explode(F.array_distinct(F.concat(_words(F.col("before")), _words(F.col("after"))))).alias("term"))
        .filter((F.length("term") >= 3) & ~F.regexp_like("term", F.lit("^[0-9]+$"))).distinct()
    )
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") >= min_texts)
    together = saved(together)
    entity_texts = docs.filter(F.size("spans") > 0).select(F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # Each text's words are counted once and summed per task before the shuffle, so what moves is a task's vocabulary.
    # Written, or Spark would join every word of every text before counting.
    term_texts = saved(
        docs.select(F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    )
    total = docs.count()
    share = F.least(F.lit(1.0), F.col("n_texts") / F.col("n_term"))
    return (
        together.join(entity_texts, "entity").join(term_texts, "term")
        .withColumn("share", share)
        .withColumn("bits", F.log2(F.col("share") * F.lit(float(max(1, total))) / F.col("n_entity")))
        .withColumn("least", F.least(F.lit(min_bits), F.lit(min_bits_part) * F.log2(F.lit(float(max(1, total))) / F.col("n_entity"))))
        .filter((F.col("share") >= min_share) & (F.col("bits") > 0) & (F.col("bits") >= F.col("least")))
        .select("entity", "term", "n_texts", "share", "bits", F.when(F.col("share") >= remove_share, "remove").otherwise("generalise").alias("action"))
    )


#: Kinds of the method's spans.
GENERALISE, REMOVE = 4, 5
NAMES = (*KINDS, "term", "removed_term")


def find_pii(df: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """All rows with ``base`` and ``spans``: arrays of (start, kind, end, value) in code points.

    Kinds 0 to 3 are the base kinds in their order, 4 a term to generalise, 5 one to
    remove.  ``spans`` holds the base spans and every place of a disclosing term in any
    text, with its entity or without, other than inside a base span.  A term that is one to
    remove for any entity is removed everywhere.  A null or empty text has none.  Repeated
    rows get the same spans and stay.  Columns named base or spans are replaced.
    """
    frame, restored = apart(unclashed(df, ["base", "spans"]), [text])
    frame = frame.withColumn("base", base_spans(F.col(text)))
    texts = distinct_texts(frame.select(F.col(text).alias("text"), F.col("base").alias("spans")))
    terms = saved(terms_of_texts(texts, **thresholds))
    keyed = frame.withColumn("_k", text_key(F.col(text)))
    actions = saved(terms.groupBy("term").agg(F.max("action").alias("action")))
    # Only words that may be terms travel; both sides are written, so that a hot term can be split.
    term_words = _maybe(actions.select(F.xxhash64("term").alias("key")))
    candidates = saved(texts.select("_k", F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("term")).filter(term_words(F.xxhash64("term"))))
    own = saved(candidates.join(actions, "term").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("term", "action"))).alias("_terms")))
    # Rows whose text surely holds no term pass without a shuffle.
    met = _maybe(own.select(F.col("_k.k1").alias("key")))
    clean = keyed.filter(~met(F.col("_k.k1"))).withColumn("spans", F.col("base")).drop("_k")
    marked = keyed.filter(met(F.col("_k.k1"))).join(own, "_k", "left")

    def of(action: str, kind: int) -> Column:
        chosen = F.transform(F.filter("_terms", lambda t: t["action"] == action), lambda t: t["term"])
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(chosen, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        return F.when(F.size(chosen) > 0, places(F.col(text), pattern, kind)).otherwise(F.array().cast(SPAN))

    terms_at = F.when(F.col("_terms").isNotNull(), F.concat(of("generalise", GENERALISE), of("remove", REMOVE))).otherwise(F.array().cast(SPAN))
    outside = F.filter(terms_at, lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    marked = marked.withColumn("spans", F.array_sort(F.concat("base", outside)))
    return restored(clean.unionByName(marked.select(*clean.columns)).drop("_terms"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced: base kinds and generalised terms by their name in brackets, removed terms by nothing.

    Of spans that cross, the first is replaced and the rest of the other goes with it.
    """
    stand_in = F.array(*map(F.lit, ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(stand_in, s["kind"])).alias("out")),
    ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    return F.when(F.size(spans) > 0, F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))).otherwise(text)


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[n(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
