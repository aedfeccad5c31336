"""Set-similarity join: best cached signature per query signature, exact."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from codelake.session import checkpoint, small_batches


def signature(tokens: Column) -> Column:
    """Sorted distinct lowercase non-blank tokens."""
    clean = F.transform(tokens, lambda t: F.trim(F.lower(t)))
    return F.sort_array(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != ""))))


def jaccard(a: Column, b: Column) -> Column:
    """1.0 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def versions_compatible(a: Column, b: Column) -> Column:
    return (F.trim(a) == "") | (F.trim(b) == "") | (a == b)


def _rows(df: DataFrame) -> DataFrame:
    """(id, version, u0, u1, tokens): non-empty sets of 64-bit token hashes, written once.

    ``u0`` and ``u1`` are a 128-bit hash of set and version, the set's unit.  Repeated and
    blank tokens are dropped here, so ``sig`` may be any list of tokens.
    """
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))
            values = lists.flatten()
            token, solid = np.asarray(values.fill_null(0)), np.asarray(values.is_valid())
            rows, found, units, start = [], [], [], 0
            for i, (end, version) in enumerate(zip(ends, batch.column("version").to_pylist())):
                own = np.unique(token[start:end][solid[start:end]])
                start = end
                if len(own):
                    rows.append(i)
                    found.append(own)
                    mark = b"\0" if version is None else b"\1" + version.encode() + b"\0"
                    units.append(hashlib.blake2b(mark + own.tobytes(), digest_size=16).digest())
            if rows:
                kept = batch.take(pa.array(rows))
                unit = np.frombuffer(b"".join(units), np.int64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [kept.column("id"), kept.column("version"), pa.array(unit[:, 0]), pa.array(unit[:, 1]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], ["id", "version", *UNIT, "tokens"])

    hashed = df.select("id", "version", F.transform("sig", lambda t: F.when(F.trim(t) != "", F.xxhash64(t))).alias("tokens"))
    return checkpoint(hashed.mapInArrow(sets, f"id {df.schema['id'].dataType.simpleString()}, version string, u0 long, u1 long, tokens array<long>"))


def _ids(rows: DataFrame) -> DataFrame:
    """(u0, u1, id1, id2): each unit's two smallest ids."""
    smallest = Window.partitionBy(*UNIT).orderBy("id")
    low = rows.select(*UNIT, "id").withColumn("_n", F.row_number().over(smallest)).filter("_n <= 2")
    return checkpoint(low.groupBy(*UNIT).agg(F.min("id").alias("id1"), F.max(F.when(F.col("_n") == 2, F.col("id"))).alias("id2")))


def _few(df: DataFrame) -> DataFrame:
    """Keys to pick sets by, written; up to a number of them they go to every task, so that the sets need not move."""
    keys = checkpoint(df)
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def _units(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows without further copies of a unit: a set shared by a third of the rows is one row in the join below.

    Sets move only if the copies are too many to be sent to every task.
    """
    first = ids.filter("id2 IS NOT NULL").select(*UNIT, F.col("id1").alias("first"))
    copies = _few(rows.select(*UNIT, "id").join(first, list(UNIT)).filter(F.col("id") != F.col("first")).select(*UNIT, "id"))
    return rows.join(copies, [*UNIT, "id"], "left_anti")


UNIT = ("u0", "u1")
PAIR = ("q_u0", "q_u1", "c_u0", "c_u1")
#: Token counts by hash, over about so many rows chosen by hash: they only decide in which order a set's tokens stand.
BUCKETS, SAMPLE = 1 << 21, 100_000
#: From how many expected rows on a token's rows are dealt over several cells.
HOT = 50_000
#: A sketch has at least half as many bits as its set has tokens, within these bounds in words of 64 bits.
WORDS = (2, 128)
#: Rows that a task compares at once, and pairs that it looks at in a step.
ROWS, STEP = 200_000, 1 << 19
#: Partners of a row that are scored first; the others must be able to beat the best of these.
FIRST = 4
LAST_ID = (1 << 63) - 1
#: Keys of sets that are sent to every task (tens of MB); more are joined by a shuffle of the sets.
MOST_KEYS = 1 << 20


def _counts(rows: DataFrame) -> tuple[np.ndarray, float]:
    """How many sampled rows hold a token of each hash bucket, and how many rows one of these stands for."""
    part = min(1.0, SAMPLE / max(1, rows.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(np.asarray(batch.column("tokens").flatten()) & (BUCKETS - 1), minlength=BUCKETS)
        for at in np.array_split(np.flatnonzero(n), 16):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    sample = rows.filter(F.pmod("u0", F.lit(1 << 20)) < int(part * (1 << 20))).select("tokens").mapInArrow(count, "bucket int, n long")
    found = sample.groupBy("bucket").agg(F.sum("n").cast("int").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int32)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts, 1 / part


def _prefix(units: DataFrame, threshold: float, counts: Broadcast, weight: float, side: int) -> DataFrame:
    """(token, cell, at, body): a set's leading n - ceil(t n) + 1 tokens, rarest first.

    Two sets at or above t share one of these tokens, whatever the order is, if it's the
    same for all sets.  ``at`` packs the set's size, the token's place and the side.  ``body``
    is the unit, its version and id, the score and the id that a partner has to beat, and a
    sketch: the parity of the set's tokens by hash.  Sketches differ in no more bits than
    sets in tokens.  The rows of a frequent token are dealt over blocks, and a cell gets two
    of these: ``cell`` packs both and the row's own.
    """
    def words(n: int) -> int:
        """A power of two."""
        return min(WORDS[1], max(WORDS[0], 1 << (n // 128).bit_length()))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            size = np.asarray(lists.value_lengths(), np.int64)
            token = np.asarray(lists.flatten())
            seen = counts.value[token & (BUCKETS - 1)].astype(np.int64)
            rank = (seen << 43) | ((token >> 21) & ((1 << 43) - 1))  # tokens are sorted, so equal ranks keep their order
            unit = np.stack([np.asarray(batch.column(c)).view(np.int64) for c in (*UNIT, "kind", "number", "bound", "rival")], 1)
            lead, bodies, start = [], [], 0
            for i, n in enumerate(size):
                own = slice(start, start + n)
                lead.append(start + np.argsort(rank[own], kind="stable")[:n - int(np.ceil(n * threshold - 1e-9)) + 1])
                bits = 64 * words(int(n))
                odd = np.bincount((token[own] >> 32) & (bits - 1), minlength=bits) & 1
                bodies.append(unit[i].tobytes() + np.packbits(odd.astype(np.uint8)).tobytes())
                start += n
            length = np.array([len(x) for x in lead])
            of = np.repeat(np.arange(len(size)), length)
            place = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
            at, lead = (size[of] << 32) | (place << 1) | side, np.concatenate(lead)
            blocks = np.ceil(seen[lead] * weight / HOT).astype(np.int64)
            cell = np.zeros(len(of), np.int64)
            if (blocks > 1).any():
                blocks = np.maximum(blocks, 1)
                again = np.repeat(np.arange(len(of)), blocks)
                other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                of, at, lead, blocks = of[again], at[again], lead[again], blocks[again]
                mine = (unit[of, 1] & ((1 << 40) - 1)) % blocks
                cell = (np.minimum(mine, other) << 40) | (np.maximum(mine, other) << 20) | mine
            body = pa.array(bodies, pa.binary())
            for part in np.array_split(np.arange(len(of)), len(of) // 20_000 + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[lead[part]]), pa.array(cell[part]), pa.array(at[part]), body.take(pa.array(of[part]))], ["token", "cell", "at", "body"])

    # blank versions fit all others, an unknown one fits blank ones only
    kind = F.when(F.col("version").isNull(), F.lit(-1)).when(F.trim("version") == "", F.lit(0)).otherwise(F.shiftleft(F.xxhash64("version"), 1) + 2)
    number = F.col("id").cast("long") if isinstance(units.schema["id"].dataType, IntegralType) else F.lit(0).cast("long")
    if "bound" not in units.columns:
        units = units.withColumn("bound", F.lit(0.0)).withColumn("rival", F.lit(0).cast("long"))
    return units.select(*UNIT, kind.cast("long").alias("kind"), number.alias("number"), "bound", "rival", "tokens").mapInArrow(
        prefixes, "token long, cell long, at long, body binary")


def _near(threshold: float, same: bool, first: bool) -> Callable[[pa.Table], np.ndarray]:
    """Of rows sorted by token: the pairs of units with one token, fitting sizes and places, and sketches near enough.

    The first time they are each row's nearest partners only.  A pair that neither of its rows
    keeps marks both as crowded, which is a pair of the unit with itself and 1 behind it.  Later
    they are those that can beat what is known of one of both.
    A closure, so that workers need not import this module.
    """
    head = 48

    def near(part: pa.Table) -> np.ndarray:
        part = part.combine_chunks()
        at = part.column("at").to_numpy()
        token, cell, n, place, side = part.column("token").to_numpy(), part.column("cell").to_numpy(), at >> 32, (at & 0xFFFFFFFF) >> 1, at & 1
        order = np.lexsort((n, cell >> 20, token))
        token, cell, n, left, side = token[order], cell[order], n[order], (n - place)[order], side[order]
        group = np.concatenate([[0], np.cumsum((token[1:] != token[:-1]) | (cell[1:] >> 20 != cell[:-1] >> 20))])
        key = (group << 32) | n
        end = np.searchsorted(key, (group << 32) | np.floor(n / threshold + 1e-6).astype(np.int64), "right")
        # what two sets that match have in common, for each token of both
        share = threshold / (1 + threshold)
        width = np.where(left >= 2 * share * n - 1e-6, end - np.arange(len(n)) - 1, 0)
        bodies = part.column("body").combine_chunks().take(pa.array(order))
        start = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset:bodies.offset + len(bodies) + 1].astype(np.int64)
        data = np.frombuffer(bodies.buffers()[2], np.uint8)
        words = (np.diff(start) - head) // 8
        unit, (kind, number, bound, rival) = data[start[:-1, None] + np.arange(16)].view(np.int64), data[start[:-1, None] + np.arange(16, head)].view(np.int64).T
        bound = np.ascontiguousarray(bound).view(np.float64)
        # by width, the sketches at least as wide, folded to it: a sketch's halves give the one of half the width
        sketches, where, wide, rows = {}, {}, None, np.zeros(0, np.int64)
        for w in [WORDS[1] >> i for i in range(WORDS[1].bit_length() - WORDS[0].bit_length() + 1)]:
            own = np.flatnonzero(words == w)
            exact = data[start[own, None] + head + np.arange(8 * w)].view(np.uint64)
            wide = exact if wide is None else np.concatenate([wide[:, :w] ^ wide[:, w:], exact])
            rows = np.concatenate([rows, own])
            sketches[w], where[w] = wide, np.zeros(len(n), np.int64)
            where[w][rows] = np.arange(len(rows))
        found, kept, limit = [], np.zeros((3, 0)), STEP
        crowded, last_score, last_number = np.zeros(len(n), bool), np.full(len(n), -1.0), np.zeros(len(n), np.int64)

        def foremost(kept):
            """The best few partners of each row, ties by the lesser id."""
            row, other = kept[:2].astype(np.int64)
            order = np.lexsort((number[other], -kept[2], row))
            row, other = row[order], other[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            crowded[row[rank >= FIRST]] = True
            last = rank == FIRST - 1
            last_score[row[last]], last_number[row[last]] = kept[2, order[last]], number[other[last]]
            return kept[:, order[rank < FIRST]]

        active = np.flatnonzero(width > 0)
        total = np.cumsum(width[active])
        cuts = np.searchsorted(total, np.arange(STEP, total[-1] if len(total) else 0, STEP))
        for rows in np.split(active, np.unique(cuts)):
            a = np.repeat(rows, width[rows])
            if not len(a):
                continue
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(width[rows]) - width[rows], width[rows])
            least = share * (n[a] + n[b]) - 1e-6
            fits = (left[a] >= least) & (left[b] >= least)
            a, b = a[fits], b[fits]
            fits = (kind[a] == 0) | (kind[b] == 0) | ((kind[a] == kind[b]) & (kind[a] != -1))
            fits &= (unit[a] != unit[b]).any(1) if same else side[a] != side[b]
            # a cell of two blocks is for pairs between them
            fits &= ((cell[a] >> 40) == ((cell[a] >> 20) & 0xFFFFF)) | (cell[a] != cell[b])
            a, b = a[fits], b[fits]
            common = np.minimum(words[a], words[b])
            apart = np.zeros(len(a), np.int64)
            for w in np.unique(common).tolist():
                for of in np.array_split(np.flatnonzero(common == w), 1 + len(a) * w // STEP):
                    apart[of] = np.bitwise_count(sketches[w][where[w][a[of]]] ^ sketches[w][where[w][b[of]]]).sum(1, dtype=np.int64)
            close = apart <= (n[a] + n[b]) * ((1 - threshold) / (1 + threshold)) + 1e-6
            x, y, apart = a[close], b[close], apart[close]
            score = (n[x] + n[y] - apart) / (n[x] + n[y] + apart)  # at most
            if first:
                row, other, most = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([score, score])
                better = (most > last_score[row]) | ((most == last_score[row]) & (number[other] < last_number[row]))
                crowded[row[~better]] = True
                kept = np.concatenate([kept, [row[better], other[better], most[better]]], 1)
                if kept.shape[1] > limit:
                    kept = foremost(kept)
                    limit = max(STEP, 2 * kept.shape[1])
            else:
                wins = (score >= bound[x]) & ((score > bound[x]) | (number[y] < rival[x]))
                wins |= (score >= bound[y]) & ((score > bound[y]) | (number[x] < rival[y]))
                found.append(np.stack([x[wins], y[wins]]))
        kept = foremost(kept)
        x, y = np.concatenate([np.zeros((2, 0), np.int64), kept[:2].astype(np.int64), *found], 1)
        # the query's unit first, or in one table the lesser
        swap = side[x] == 1 if not same else (unit[x, 0] > unit[y, 0]) | ((unit[x, 0] == unit[y, 0]) & (unit[x, 1] > unit[y, 1]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        many = np.flatnonzero(crowded)
        pairs = np.concatenate([unit[x], unit[y], np.zeros((len(x), 1), np.int64)], 1)
        marks = np.concatenate([unit[many], unit[many], 1 + side[many, None]], 1)
        return np.unique(np.concatenate([pairs, marks]), axis=0)

    return near


def _candidates(prefixes: DataFrame, threshold: float, same: bool, first: bool) -> DataFrame:
    """(q_u0, q_u1, c_u0, c_u1, crowded): units with a common leading token that can match by sizes, places and sketches.

    Rows come to a task sorted by token, so it holds few tokens' rows at a time.
    """
    names, compare = [*PAIR, "crowded"], _near(threshold, same, first)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part):
            found = compare(part)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(5)], names)

        held, rows, limit = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                part = pa.Table.from_batches(held).combine_chunks()
                token, cell = part.column("token").to_numpy(), part.column("cell").to_numpy() >> 20
                other = (token != token[-1]) | (cell != cell[-1])
                whole = int(np.flatnonzero(other)[-1]) + 1 if other[0] else 0
                if whole:
                    yield out(part.slice(0, whole))
                held = part.slice(whole).to_batches()
                rows -= whole
                limit = max(ROWS, 2 * rows)
        if rows:
            yield out(pa.Table.from_batches(held))

    tasks = max(int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), prefixes.count() // 1_000_000)
    dealt = prefixes.repartition(tasks, "token", F.shiftright("cell", 20)).sortWithinPartitions("token", "cell")
    return dealt.mapInArrow(pairs, ", ".join(f"{c} long" for c in names)).distinct()


def _scores(pairs: DataFrame, q_units: DataFrame, c_units: DataFrame, threshold: float) -> DataFrame:
    """(q_u0, q_u1, c_u0, c_u1, score) of the pairs that match."""
    names = pairs.columns

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in ("q_tokens", "c_tokens"):
                lists = batch.column(c)
                sides.append(np.split(np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths(), np.int64))[:-1]))
            score = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(*sides)):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                score[i] = shared / (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(score)], [*names, "score"])

    def side(df, x):
        keys = [F.col(f"{x}_{u}").alias(u) for u in UNIT]
        used = df.join(_few(pairs.select(keys[0]).distinct()), "u0", "left_semi")
        return used.select(*[F.col(c).alias(f"{x}_{c}") for c in (*UNIT, "version", "tokens")])

    met = pairs.join(side(q_units, "q"), ["q_u0", "q_u1"]).join(side(c_units, "c"), ["c_u0", "c_u1"]).filter(
        versions_compatible(F.col("q_version"), F.col("c_version")))
    kinds = ", ".join(f"{c} long" for c in names) + ", score double"
    return met.select(*names, "q_tokens", "c_tokens").mapInArrow(both, kinds).filter(F.col("score") >= threshold)


def similar_plans(queries: DataFrame, cache: DataFrame, threshold: float = 0.85, skip_self: bool = False) -> DataFrame:
    """Best cache entry per query: (id, version, sig) tables to (id, match_id, score).

    Highest Jaccard first, then smallest id.  An empty query signature never matches.
    ``skip_self`` is for one table joined with itself.

    Candidates come from prefix filtering with bounds by sizes, by the places of a common
    token and by sketches, so that whole signatures meet for few pairs that don't match.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = queries.sparkSession
    small_batches(spark)
    same = cache is queries
    q_rows = _rows(queries)
    c_rows = q_rows if same else _rows(cache)
    c_ids = _ids(c_rows)
    q_units, c_units = _units(q_rows, c_ids if same else _ids(q_rows)), _units(c_rows, c_ids)

    counts, weight = _counts(c_rows)
    counts = spark.sparkContext.broadcast(counts)

    def pairs(q, c, first):
        prefixes = _prefix(q, threshold, counts, weight, 0)
        if not same:
            prefixes = prefixes.unionByName(_prefix(c, threshold, counts, weight, 1))
        return checkpoint(_candidates(checkpoint(prefixes), threshold, same, first))

    found = pairs(q_units, c_units, True)
    near = found.filter("crowded = 0").select(*PAIR)
    scored = checkpoint(_scores(near, q_units, c_units, threshold))
    key = lambda x: [F.col(f"{x}_{u}").alias(u) for u in UNIT]
    turned = lambda df, a, b: df.select(*key(a), F.col(f"{b}_u0").alias("m0"), F.col(f"{b}_u1").alias("m1"), "score")
    both_ways = lambda df: turned(df, "q", "c").unionByName(turned(df, "c", "q")) if same else turned(df, "q", "c")
    with_ids = lambda df: df.join(c_ids.select(F.col("u0").alias("m0"), F.col("u1").alias("m1"), "id1", "id2"), ["m0", "m1"])
    if not found.filter("crowded > 0").isEmpty():
        # units with more partners than were scored: the others are scored if they can beat the best one known
        best = with_ids(both_ways(scored)).groupBy(*UNIT).agg(F.min_by(F.struct("score", "id1"), F.struct(-F.col("score"), "id1")).alias("b"))
        number = F.col("b.id1").cast("long") if isinstance(queries.schema["id"].dataType, IntegralType) else F.lit(LAST_ID)
        # a set with copies, or one that may match itself, has a score of 1
        own = c_ids.filter("id2 IS NOT NULL" if skip_self else "true") if same else c_ids.filter("false")
        bounds = _few(
            found.filter("crowded = 1").select(*key("q")).distinct().join(best, list(UNIT), "left").join(own.select(*UNIT, F.lit(True).alias("own")), list(UNIT), "left").select(
                *UNIT, F.when(F.col("own"), 1.0).otherwise(F.coalesce("b.score", F.lit(threshold))).alias("bound"),
                F.when(F.col("own"), LAST_ID).otherwise(F.coalesce(number, F.lit(LAST_ID))).alias("rival")))
        # no bound is asked of the cache's side
        c_crowded = None if same else c_units.join(_few(found.filter("crowded = 2").select(*key("c")).distinct()), list(UNIT), "left_semi").withColumn(
            "bound", F.lit(2.0)).withColumn("rival", F.lit(0).cast("long"))
        more = pairs(q_units.join(bounds, list(UNIT)), c_crowded, False).select(*PAIR)
        more = checkpoint(more.join(near, list(PAIR), "left_anti"))
        scored = scored.unionByName(checkpoint(_scores(more, q_units, c_units, threshold)))
    match = both_ways(scored)
    if same:
        # a pair of units was scored once; a unit's own copies need no comparison
        own = q_units.filter(versions_compatible(F.col("version"), F.col("version"))).select(*UNIT, F.col("u0").alias("m0"), F.col("u1").alias("m1"), F.lit(1.0).alias("score"))
        match = match.unionByName(own)
    # Per query unit keep the best two candidate ids: one of them may be the query itself.
    ids = with_ids(match).select(
        *UNIT, "score", F.explode(F.array("id1", "id2")).alias("match_id")).filter("match_id IS NOT NULL")
    best = Window.partitionBy(*UNIT).orderBy(F.desc("score"), "match_id")
    top = ids.withColumn("_n", F.row_number().over(best)).filter("_n <= 2")
    matched = q_rows.select("id", *UNIT).join(top, list(UNIT))
    if skip_self:
        matched = matched.filter(F.col("id") != F.col("match_id"))
    return (
        matched.groupBy("id")
        .agg(F.min_by(F.struct("match_id", "score"), F.struct(-F.col("score"), "match_id")).alias("_b"))
        .select("id", "_b.match_id", "_b.score")
    )
