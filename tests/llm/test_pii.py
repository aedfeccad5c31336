"""Spans against Python's engine, disclosing terms against counts by hand, and the sanitised text."""

import re

from pyspark.sql import functions as F

from codelake.llm import pii as P

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for n, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "nothing", "a.b@c.de.f, 4111 1111 1111 1111 and 300.1.1.1 10.0.0.1 +1 (132) 555-1352 😀 x@y.z", "a@b.c_d@e.f a@b @x.y z@-.- a@b.c.", "1.2.3.4.5.6.7.8.9 001.02.255.256 0000255.1.1.1",
    "5500-0000-0000-0004 4111111111111112 4111  1111 1111 1111 12345", "+49 (0)30 12345678 +1 +12345678 ++123456789 +1.", "9" * 3000 + "@", "x" * 20000 + "@" + "y.z" * 50, "mail ünï@x.de 日本a@b.cd",
    "ip 1.1.1.1" * 500, "+" + "1 " * 5000, "card 4111111111111111" * 3, "a@b.c" * 40,
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in df.withColumn("spans", P.base_spans(F.col("text"))).collect():
        assert [(s.start, s.kind, s.end) for s in r.spans] == plain(r.text), r.doc_id


def corpus():
    """Codename 'Zephyrine' only ever stands by one address; 'team' stands everywhere."""
    rows = [(k, f"note {k} zephyrine asked the team at boss{k % 1}@corp.example about item {k}") for k in range(5)]
    rows += [(1000 + k, f"plain talk {k} of the team about nothing") for k in range(300)]
    rows += [(100, "Zephyrine alone has no entity beside it"), (101, None), (102, ""), (0, rows[0][1]), (None, rows[1][1])]
    return rows


def test_disclosing_terms_are_removed_and_common_ones_stay(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string").withColumn("SPANS", F.lit("old"))
    terms = {r.term: r for r in P.disclosing_terms(df.select("text", P.base_spans(F.col("text")).alias("spans"))).collect()}
    assert "zephyrine" in terms and "team" not in terms
    # five different texts hold the word with the entity and one more holds it alone; the two copies don't count
    assert terms["zephyrine"].n_texts == 5 and abs(terms["zephyrine"].share - 5 / 6) < 1e-9 and terms["zephyrine"].action == "generalise"
    rows = P.find_pii(df).withColumn("clean", P.sanitised(F.col("text"), F.col("spans"))).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert [s for s in r.spans if s.kind < 4] == r.base
        if r.base:
            assert "boss" not in r.clean and "zephyrine" not in r.clean and "[EMAIL]" in r.clean and "[TERM]" in r.clean and "team" in r.clean
        else:
            # a term that discloses goes where its entity isn't, too
            assert r.clean == (r.text and r.text.replace("Zephyrine", "[TERM]"))
    removed = P.find_pii(df, remove_share=0.6).withColumn("clean", P.sanitised(F.col("text"), F.col("spans"))).filter("size(base) > 0").collect()
    assert all("[TERM]" not in r.clean and "zephyrine" not in r.clean for r in removed)
    assert P.find_pii(df.limit(0)).count() == 0


def test_written_spans_and_replacement(spark):
    text = "a@b.cd 4111111111111111 +4111111111111111"
    row = spark.createDataFrame([(text,)], "text string").withColumn("s", P.base_spans(F.col("text"))).select(P.written(F.col("s")).alias("w"), P.sanitised(F.col("text"), F.col("s")).alias("c")).collect()[0]
    names = [k for k, _ in KINDS]
    assert row.w == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in plain(text))
    assert row.c == "[EMAIL] [CARD] +[CARD]"


def terms_of(spark, texts, **thresholds):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {(r.entity, r.term): r for r in P.disclosing_terms(df.select("text", P.base_spans(F.col("text")).alias("spans")), **thresholds).collect()}


def test_copies_change_no_count(spark):
    """Four texts of a term with three copies each give what they give once, and so do many copies elsewhere."""
    texts = [f"memo {k} quillon wrote to x@y.example" for k in range(4)] + [f"idle talk {k}" for k in range(96)]
    once = terms_of(spark, texts)
    assert once["0:x@y.example", "quillon"].share == 1.0 and abs(once["0:x@y.example", "quillon"].bits - 4.643856) < 1e-5
    assert terms_of(spark, texts[:4] * 3 + texts[4:]) == once
    assert terms_of(spark, texts + texts[4:5] * 500) == once


def test_terms_go_where_the_entity_is_not(spark):
    """A term beyond the thresholds is marked in every text, whatever its case, and nothing else is."""
    texts = [f"memo {k} quillon wrote to x@y.example" for k in range(4)] + ["Ask QUILLON, not quillons", "Ask Quillon", None, ""] + [f"idle talk {k}" for k in range(96)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[4]])], "doc_id bigint, text string")
    got = P.find_pii(df).withColumn("clean", P.sanitised(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    assert len(got) == len(texts) + 1 and got[4].clean == got[-1].clean == "Ask [TERM], not quillons" and got[5].clean == "Ask [TERM]"
    assert all("quillon" not in r.clean and "[EMAIL]" in r.clean for r in got[:4])
    assert all(r.clean == r.text and not r.spans for r in got[6:-1])
    assert P.find_pii(df.limit(0)).count() == 0


def test_terms_of_a_common_entity(spark):
    """An address in a third of the texts: what only ever stands by it goes, common words stay; in all texts nothing is told."""
    hot = [f"memo {k} the quillon desk: x@y.example" for k in range(40)]
    texts = hot + [f"idle talk {k} of the desk" for k in range(80)]
    found = terms_of(spark, texts)
    assert {t for _, t in found} == {"memo", "quillon"} and all(r.action == "remove" and abs(r.bits - 1.5849625) < 1e-5 for r in found.values())
    # 40 of 54 texts: over half, but under 0.8 of the entity's bits
    assert {t for _, t in terms_of(spark, texts + [f"quillon {k}" for k in range(14)])} == {"memo"}
    assert terms_of(spark, hot) == {}
