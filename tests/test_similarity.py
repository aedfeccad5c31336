import itertools
import random

from pyspark.sql import functions as F

from codelake.operators.similarity import jaccard, signature, similar_plans

SCHEMA = "id bigint, version string, sig array<string>"


def test_jaccard(spark):
    df = spark.createDataFrame(
        [(["a", "b", "c"], ["a", "b", "d"]), (["a"], ["a"]), (["a"], ["b"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 1.0]


def test_signature(spark):
    df = spark.createDataFrame([([" B ", "a", "", None, "b"],)], "t array<string>")
    assert df.select(signature(F.col("t"))).first()[0] == ["a", "b"]


def test_versions(spark):
    q = spark.createDataFrame([(1, "3", ["a", "b"]), (2, "2", ["a", "b"]), (3, "", ["a", "b"]), (4, "3", [])], SCHEMA)
    cache = spark.createDataFrame([(10, "3", ["a", "b"]), (11, "", ["z"])], SCHEMA)
    assert {r.id: r.match_id for r in similar_plans(q, cache).collect()} == {1: 10, 3: 10}


def brute(rows, threshold):
    best = {}
    for (i, vi, a), (j, vj, b) in itertools.permutations(rows, 2):
        if not a or not b or (vi and vj and vi != vj):
            continue
        s = len(set(a) & set(b)) / len(set(a) | set(b))
        if s >= threshold and (i not in best or (-s, j) < (-best[i][1], best[i][0])):
            best[i] = (j, s)
    return best


def test_random_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        if rows and rnd.random() < 0.7:  # near copies, and one signature in very many rows
            base = set(rows[0][2] if rnd.random() < 0.4 else rnd.choice(rows)[2])
            for _ in range(rnd.randint(0, 2)):
                base ^= {rnd.choice(words)}
        else:
            base = set(rnd.sample(words, rnd.randint(1, 25)))
        rows.append((i, rnd.choice(["", "2", "3"]), sorted(base)))
    df = spark.createDataFrame(rows, SCHEMA)
    for threshold in (0.6, 0.85, 1.0):
        got = {r.id: (r.match_id, round(r.score, 9)) for r in similar_plans(df, df, threshold, skip_self=True).collect()}
        want = {k: (j, round(s, 9)) for k, (j, s) in brute(rows, threshold).items()}
        assert got == want


def test_many_frequent_tokens_give_few_pairs(spark, monkeypatch):
    """Sets from one small vocabulary share leading tokens; sketches keep the pairs that don't match from being compared."""
    import codelake.operators.similarity as S

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, "", sorted(rnd.sample(words, n))) for i, n in enumerate([40] * 300 + [400] * 100 + [1100] * 40)]
    rows += [(1000 + k, "", sorted(set(sig) - set(sig[:2]) | {"x"})) for k, (_, _, sig) in enumerate(rows[::20])]
    found, candidates = [], S._candidates
    monkeypatch.setattr(S, "_candidates", lambda *a: found.append(candidates(*a)) or found[-1])
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.match_id, round(r.score, 9)) for r in S.similar_plans(df, df, 0.85, skip_self=True).collect()}
    assert got == {k: (j, round(s, 9)) for k, (j, s) in brute(rows, 0.85).items()} and len(got) == 44
    assert sum(x.count() for x in found) < 50


def test_cluster_gives_few_pairs(spark, monkeypatch):
    """In a cluster of near copies each set meets those that can beat its best partner, not all others."""
    import codelake.operators.similarity as S

    rnd = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(rnd.randrange(10**6) * 1000 + i, rnd.choice(["", "2"]), sorted(base[rnd.randint(1, 3):] + [f"own{i}"])) for i in range(300)]
    rows += [(i, "2", sorted(base[k:])) for i, k in ((1, 1), (2, 1), (3, 2))]
    found, candidates = [], S._candidates
    monkeypatch.setattr(S, "_candidates", lambda *a: found.append(candidates(*a)) or found[-1])
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.match_id, round(r.score, 9)) for r in S.similar_plans(df, df, 0.85, skip_self=True).collect()}
    assert got == {k: (j, round(s, 9)) for k, (j, s) in brute(rows, 0.85).items()} and len(got) == 303
    assert sum(x.count() for x in found) < 4000  # of 45,753


def test_frequent_token_dealt_over_cells(spark, monkeypatch):
    """Blocks of one token's rows meet pairwise, also between two tables; an unknown version fits blank ones."""
    import codelake.operators.similarity as S

    monkeypatch.setattr(S, "HOT", 20)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(9)]
    rows = [(i, rnd.choice(["", "2", "3", None]), sorted(rnd.sample(words, rnd.randint(1, 9)))) for i in range(200)]
    blank = lambda v: v if v is not None else f"unknown{rnd.random()}"
    want = brute([(i, blank(v), sig) for i, v, sig in rows], 0.7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.match_id, r.score) for r in S.similar_plans(df, df, 0.7, skip_self=True).collect()}
    assert got == want
    shifted = df.select((df.id + 1000).alias("id"), "version", "sig")
    other = {r.id: (r.match_id - 1000, r.score) for r in S.similar_plans(df, shifted, 0.7).collect()}
    for i, v, sig in rows:
        mine = {j: len(set(sig) & set(s)) / len(set(sig) | set(s)) for j, w, s in rows if w == "" or v == "" or (v == w and v is not None)}
        best = min(((-s, j) for j, s in mine.items() if s >= 0.7), default=None)
        assert other.get(i) == (best and (best[1], -best[0]))


def test_sets_stay_where_they_are(spark):
    """Keys are sent to the sets, however small a table Spark would broadcast by itself."""
    import codelake.operators.similarity as S

    rows = S._rows(spark.createDataFrame([(1, "", ["a", "b"]), (2, "", ["b", "a", "a"]), (3, "", ["c"])], SCHEMA))
    small = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(small)
    spark.conf.set(small, "-1")
    try:
        units = S._units(rows, S._ids(rows))
        assert "SortMergeJoin" not in units._jdf.queryExecution().toString() and sorted(r.id for r in units.collect()) == [1, 3]
    finally:
        spark.conf.set(small, before)
