"""Manifests against trees built in one place, for many sizes, arities and exchanges of several rounds."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from codelake.llm import merkle as M

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    """(root, the siblings of each node from its level up)."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a - a % arity : a - a % arity + arity]
            ways[k] += [(x, j < a % arity) for j, x in enumerate(run) if j != a % arity]
            at[k] = a // arity
        level = [sha("".join(level[j : j + arity])) for j in range(0, len(level), arity)]
    return level[0], ways


def plain(docs, arity=2):
    """Rows of the contract, by one list of leaves for each language."""
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {}
    for g in order:
        rows = sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d)))
        inner[g] = rows, *tree([leaf_of(r) for r in rows], arity)
    root, above = tree([inner[g][1] for g in order], arity) if order else ("", [])
    out = []
    for g, more in zip(order, above, strict=True):
        rows, sub, ways = inner[g]
        for row, w in zip(rows, ways, strict=True):
            proof = "".join(x for x, _ in [*w, *more])
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            out.append((row[0], leaf_of(row), sub, root, sha(proof), not bad))
    return sorted(out, key=str)


def run(spark, docs, **sizes):
    df = spark.createDataFrame(docs, SCHEMA).withColumn("G", F.lit("old")).withColumn("position", F.lit(1)).withColumn("siblings", F.lit("x"))
    raised = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    done = M.folded(M.manifest(df, changed={"n_chars": raised}, **sizes))
    rows = done.withColumn("proof", F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256)).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root == r.root) for r in rows), key=str)


def docs_of(seed, sizes):
    rng = random.Random(seed)
    docs = [(rng.randrange(10**6), rng.choice(["a", None, "é"]), lang, rng.choice([None, 5, 70]), rng.choice([None, "", "text é", "long " * 3000])) for lang, n in sizes.items() for _ in range(n)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("arity, block, rounds", [(2, 10, 4), (2, 1, 1), (3, 1, 1), (4, 1, 2)])
def test_manifest_equals_one_plain_tree(spark, arity, block, rounds):
    """Blocks of two to four leaves make exchanges of up to seven rounds, with short subtrees at the end."""
    docs = docs_of(arity + block, {"en": 131, "de": 17, None: 5, "": 4, "é": 1, "z": 3, "fr": 64})
    docs += [docs[0]] * 3 + [(None, None, None, None, None), (None, "s", "en", 3, "x"), (7, "s", "en", 2**63 - 2, "x")]
    assert run(spark, docs, arity=arity, block_levels=block, round_levels=rounds) == plain(docs, arity)


def test_sizes_around_powers(spark):
    docs = docs_of(4, {f"size {n}": n for n in (1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33)})
    assert run(spark, docs, block_levels=1, round_levels=1) == plain(docs)


def test_query_on_the_given_table_and_empty_table(spark):
    got = M.op12(spark, "/root/testdata/sf0.001")
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got.collect()), key=str) == plain(docs)
    assert M.folded(M.manifest(spark.createDataFrame([], SCHEMA))).count() == 0


def test_every_change_of_a_proof_shows(spark):
    leaf, levels = bytes(32), M.climb([bytes([k]) * 32 for k in range(11)], 2, 4)
    for k in range(11):
        siblings, turns = M.way(levels, k, 2)
        assert M.fold(levels[0][k], siblings, turns) == levels[-1][0]
        assert k == 0 or M.fold(leaf, siblings, turns) != levels[-1][0]
        for at in range(0, len(siblings), 32):
            assert M.fold(levels[0][k], siblings[:at] + bytes(32) + siblings[at + 32 :], turns) != levels[-1][0] or siblings[at : at + 32] == bytes(32)
