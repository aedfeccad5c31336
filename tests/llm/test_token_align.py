"""Alignment against whole-text encoding and plain counting."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from sentencepiece import SentencePieceProcessor

from codelake.llm import token_align as A

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Each text's measures, with both tokenizers run over whole texts."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=FILES[1])
    letters = A.byte_letters()
    rows, links = [], Counter()
    for text in texts:
        spaced = " " + (text or "")
        x = a.encode(spaced, add_special_tokens=False).ids if text else []
        y = b.encode([text])[0] if text else []
        xb = [bytes(letters[c] for c in a.id_to_token(k)) for k in x]
        yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not text or b"".join(xb) != spaced.encode() or b"".join(yb) != spaced.encode():
            rows.append(None)
            continue
        ends = lambda t: {sum(map(len, t[: k + 1])): k for k in range(len(t))} if len(t) < 400 else dict(running(t))
        ex, ey = ends(xb), ends(yb)
        both = sorted(set(ex) & set(ey))
        groups, i, j = [], 0, 0
        for e in both:
            groups.append(f"{','.join(map(str, x[i : ex[e] + 1]))}|{','.join(map(str, y[j : ey[e] + 1]))}")
            i, j = ex[e] + 1, ey[e] + 1
        own = [(x[ex[e]], y[ey[e]]) for e in both]
        links.update(own)
        rows.append((len(x), len(y), len(groups), own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, q), n in links.items():
        best[q] = max(best.get(q, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], r[2], len(r[3]), sum(links[p] == best[p[1]] for p in r[3]), sum(links[p] for p in r[3]), r[4]) for r in rows]


def running(tokens):
    at = 0
    for k, t in enumerate(tokens):
        at += len(t)
        yield at, k


def texts():
    rng = random.Random(5)
    pieces = ["a", "B", "word", " ", "  ", "   ", "\n", "\t", "\r\n", "é", "ﬁ", "日本", "🎉", "▁", "<0x41>", "<s>", "<unk>", "<|endoftext|>", "'s", "can't", "1", "23", ".", "...", " ", " ", "\x00", "\x85", "ÿ ", "x́", "​", "ß", "Ω "]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    return [*made, None, "", " ", "  ", " \n", "a", "a ", " a", "the end ", "x" * 3000, "word " * 5000, *made[:40], made[3], made[3]]


@pytest.mark.parametrize("sizes", [{}, {"segment_bytes": 200}])
def test_alignment_equals_plain_counting(spark, sizes):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("N_A", F.lit("old")).withColumn("name", F.lit("n")).withColumn("row", F.lit(1)).withColumn("copies", F.lit("c")).withColumn("_heavy", F.lit(2))
    done = A.align(df, *FILES, **sizes)
    got = {r.doc_id: tuple(r[c] for c in A.MEASURES) for r in done.collect()}
    want = dict(enumerate(plain([t for _, t in rows])))
    assert [k for k in want if got[k] != want[k]] == [] and len(got) == len(want)
    assert done.columns == ["doc_id", "name", "row", "copies", "_heavy", *A.MEASURES]


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in A.MEASURES) for r in A.op11(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([r.doc_id for r in rows], plain([r.text for r in rows]), strict=True))


def test_pair_counts_cut_or_whole_and_empty_table(spark):
    df = spark.createDataFrame([(t,) for t in texts()[:80]], "text string")
    cut, whole = ({tuple(r) for r in A.pair_counts(df, *FILES, cut=c).collect()} for c in (True, False))
    assert cut == whole and cut
    assert A.align(spark.createDataFrame([], "doc_id bigint, text string"), *FILES).count() == 0
