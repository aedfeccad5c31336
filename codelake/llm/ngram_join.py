"""N-gram Jaccard join: documents whose shingle sets overlap enough, by T-occurrence search.

Equal sets count once.  A set's shingles in hash order give an opening that any similar
set's opening shares a known number of shingles with; a set whose opening shares too few
with others has no partner and is done.  The rest meet through the rarest shared shingles of their
openings in clusters.  Inside a cluster each set is looked up in inverted lists of whole
sets by DivideSkip: the short lists are merged, the long ones are probed for what the
merge leaves, and sets that reach the required overlap are linked.

A cluster larger than one index is searched twice.  First all its sets look for a bounded
number of leaders.  What then hangs together needs no more links, so afterwards all sets
look for those outside of the largest component, in slices.  Any two linked sets that
aren't yet connected meet there, as at least one of them is outside.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import LOWER, SPACE, apart, extended, flat, hash_segments, key_filter, may_hold, mix, output, saved, segments, slices, spread, table, trim, unclashed, windows
from codelake.llm.linking import components
from codelake.llm.order import attached
from codelake.llm.registry import query

WORDS, PERCENT = 5, 80
#: Shingles of the sets in one index, and of the sets that one task looks up.
INDEX_SHINGLES, QUERY_SHINGLES = 1_000_000, 2_000_000
#: Shingles of openings that one task counts.
COUNTED = 1_000_000


# ---------------------------------------------------------------- sets


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text; fewer words than a shingle has count as one."""
    data, offsets = flat(texts)
    data = LOWER[data]
    n = len(offsets) - 1
    starts, ends, doc = segments(data, offsets, SPACE)
    hashes = hash_segments(data, starts, ends)
    h, first = windows(hashes, doc, words)
    of = doc[first]
    size = spread(doc, n)
    for k in range(1, words):
        some = np.flatnonzero(size[doc] == k)
        if len(some):
            short, at = windows(hashes[some], doc[some], k)
            h, of = np.append(h, mix(short + np.uint64(k))), np.append(of, doc[some][at])
    by = np.argsort(of, kind="stable")
    h = h[by]
    cuts = np.searchsorted(of[by], np.arange(n + 1))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set that doesn't depend on any order."""
    return int(mix(np.array([np.sum(mix(shingles ^ np.uint64(0x5DEECE66D))) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def members(docs: DataFrame, words: int, keep: list[str]) -> DataFrame:
    """The kept columns with k1 (the set's name; null without words) and n_shingles."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                yield output(part, keep, k1=pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), n_shingles=pa.array([len(s) for s in sets], pa.int64()))
            trim()

    return docs.select(*keep, "text").mapInArrow(run, extended(docs.select(*keep), "k1 bigint, n_shingles bigint"))


def overlap_floor(n: int, percent: int) -> int:
    """A partner shares at least this many of a set's n shingles."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    """By how many shingles an opening exceeds the least one; never falls with n."""
    return max(1, n // 5)


def opening(n: int, percent: int) -> int:
    return n - overlap_floor(n, percent) + slack(n)


def required(n: int, percent: int) -> int:
    """So many shingles the openings of a set of n and of any partner have in common: the smallest partner decides."""
    return slack(max(1, overlap_floor(n, percent)))


# ---------------------------------------------------------------- openings


def _openings(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """The shingles of all openings, packed by bucket: each value holds those of one slice of texts."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for s in shingle_sets(part.column("text"), words) if len(s)]
                for k in range(0, len(sets), 1 << 16):
                    own = sets[k : k + (1 << 16)]
                    head = [s[: opening(len(s), percent)] for s in own]
                    if not head:
                        continue
                    token = np.concatenate(head)
                    of = np.repeat(np.arange(len(own), dtype=np.uint16), [len(x) for x in head])
                    bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                    by = np.argsort(bucket, kind="stable")
                    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                    token, of = token.astype(np.uint32)[by], of[by]
                    names = np.array([set_id(s) for s in own], np.int64)
                    sizes = np.array([len(s) for s in own], np.int32)
                    rows = [(b, *_packed(names, sizes, of[x:y], token[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[j] for r in rows], pa.binary()) for j in range(1, 5)]], ["bucket", "names", "sizes", "owner", "token"])
            trim()

    return docs.select("text").mapInArrow(run, "bucket int, names binary, sizes binary, owner binary, token binary")


def _packed(names, sizes, of, token):
    held, back = np.unique(of, return_inverse=True)
    return names[held].tobytes(), sizes[held].tobytes(), back.astype(np.uint16).tobytes(), token.tobytes()


def _shared(part: pa.Table, buckets: int) -> pa.Table:
    """The shingles of a bucket that stand in openings of several sets, with the number of those sets.

    They are packed again, by the sets' names: what is known of one set meets in one place.
    """
    bucket = part.column("bucket")[0].as_py()
    name, size, token = [], [], []
    for row in zip(*(part.column(c).to_pylist() for c in ("names", "sizes", "owner", "token")), strict=True):
        owner = np.frombuffer(row[2], np.uint16)
        name.append(np.frombuffer(row[0], np.int64)[owner])
        size.append(np.frombuffer(row[1], np.int32)[owner])
        token.append(np.frombuffer(row[3], np.uint32))
    name, size, token = np.concatenate(name), np.concatenate(size), np.concatenate(token)
    trim()
    by = np.lexsort((name, token))
    name, size, token = name[by], size[by], token[by]
    new = np.append(True, (token[1:] != token[:-1]) | (name[1:] != name[:-1]))
    name, size, token = name[new], size[new], token[new]  # copies of a set count once
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sets = np.diff(np.append(first, len(token)))
    found = np.repeat(sets, sets)
    keep = found > 1
    name, size, token, found = name[keep], size[keep], token[keep], found[keep]
    to = name % buckets
    by = np.lexsort((name, to))
    name, size, to, found = name[by], size[by], to[by], np.minimum(found[by], 65535).astype(np.uint16)
    token = np.int64(bucket) << 32 | token[by].astype(np.int64)
    ends = np.searchsorted(to, np.arange(buckets + 1))
    rows = []
    for k, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if y > x:
            first = np.flatnonzero(np.append(True, name[x + 1 : y] != name[x : y - 1])) + x
            held = np.diff(np.append(first, y)).astype(np.int32)
            rows.append((k, *(v.tobytes() for v in (name[first], size[first], held, token[x:y], found[x:y]))))
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6)]], names=["to", "names", "sizes", "held", "token", "sets"])


def _routes_part(part: pa.Table, percent: int) -> pa.Table:
    """(k1, n, route): the rarest shared shingles of each set that may have a partner; partners share one of them."""
    kinds = {"names": np.int64, "sizes": np.int32, "held": np.int32, "token": np.int64, "sets": np.uint16}
    name, size, held, token, sets = (np.concatenate([np.frombuffer(b, kind) for b in part.column(c).to_pylist()]) for c, kind in kinds.items())
    name, size = np.repeat(name, held), np.repeat(size, held)
    # what no other opening holds is rarer still and would come before these
    by = np.lexsort((token, sets, name))
    name, size, token = name[by], size[by], token[by]
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    count = np.diff(np.append(first, len(name)))
    take = np.maximum(0, count + 1 - np.array([required(int(n), percent) for n in size[first]], np.int64))
    chosen = np.arange(len(name)) - np.repeat(first, count) < np.repeat(take, count)
    some = take > 0
    ends = np.append(0, np.cumsum(take[some])).astype(np.int32)
    return pa.table([pa.array(name[first][some]), pa.array(size[first][some]), pa.ListArray.from_arrays(pa.array(ends), pa.array(token[chosen]))], names=["k1", "n", "route"])


# ---------------------------------------------------------------- T-occurrence search


class InvertedLists:
    """Sets by shingle: lists of the sets' numbers, ascending, behind one another."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(token, kind="stable")
        self.token, first = np.unique(token[by], return_index=True)
        self.owner = owner[by]
        self.first, self.last = first, np.append(first[1:], len(token))
        # (list, set) in one number, ascending: what probing searches
        self.entry = np.repeat(np.arange(len(self.token)), self.last - self.first) << 32 | self.owner

    def lists_of(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.token, shingles)
        at = at[at < len(self.token)] if len(at) and at[-1] >= len(self.token) else at
        return at[self.token[at] == shingles[: len(at)]]

    def merge(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets of some lists and how often each occurs: the sorted lists are merged into one."""
        a, n = self.first[lists], self.last[lists] - self.first[lists]
        total = int(n.sum())
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)
        return np.unique(self.owner[at], return_counts=True)

    def probe(self, lists: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """In how many of the lists each set stands: a binary search for every list and set."""
        wanted = lists[:, None] << 32 | sets[None, :]
        at = np.minimum(np.searchsorted(self.entry, wanted), len(self.entry) - 1)
        return np.count_nonzero(self.entry[at] == wanted, axis=0)


def long_lists(threshold: int, longest: int, weight: float = 0.01) -> int:
    """DivideSkip's rule for the number of lists to probe instead of merging."""
    return min(threshold - 1, int(threshold / (weight * math.log2(max(2, longest)) + 1)))


class Groups:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def roots(self, xs: np.ndarray) -> np.ndarray:
        r = self.parent[xs]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def search(names: np.ndarray, sets: list[np.ndarray], indexed: np.ndarray, asking: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar between asking and indexed sets, none between sets already connected."""
    number = np.flatnonzero(indexed)
    index = InvertedLists([sets[k] for k in number])
    groups, links = Groups(len(sets)), []
    for q in np.flatnonzero(asking):
        shingles = sets[q]
        threshold = overlap_floor(len(shingles), percent)
        lists = index.lists_of(shingles)
        if len(lists) < threshold:
            continue
        length = index.last[lists] - index.first[lists]
        lists = lists[np.argsort(length, kind="stable")]
        n_long = long_lists(threshold, int(length.max()))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found, count = index.merge(short)
        least, most = overlap_floor(len(shingles), percent), 100 * len(shingles) // percent
        fits = (count >= threshold - n_long) & (index.sizes[found] >= least) & (index.sizes[found] <= most)
        found, count = found[fits], count[fits]
        by = np.argsort(-count, kind="stable")
        found, count = found[by], count[by]
        step = 4
        while len(found):
            open_ = groups.roots(number[found]) != groups.root(q)
            found, count = found[open_], count[open_]
            some, had = found[:step], count[:step]
            found, count = found[step:], count[step:]
            step = min(4 * step, 256)
            if len(some):
                both = had + (index.probe(long, some) if len(long) else 0)
                union = len(shingles) + index.sizes[some] - both
                for k in number[some[100 * both >= percent * union]]:
                    if groups.join(int(q), int(k)):
                        links.append((int(names[q]), int(names[k])))
    return links


def _search_part(part: pa.Table, percent: int) -> pa.Table:
    sets = [np.frombuffer(b, np.uint64) for b in part.column("shingles").to_pylist()]
    flags = [part.column(c).to_numpy() for c in ("indexed", "asking")]
    links = search(part.column("k1").to_numpy(), sets, *flags, percent)
    del sets
    trim()
    return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["src", "dst"])


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    """``rows``: (part, k1, indexed, asking, shingles); each part is one index with what looks into it."""
    return rows.groupBy("part").applyInArrow(lambda t: _search_part(t, percent), "src bigint, dst bigint")


# ---------------------------------------------------------------- the join


def _sets_of(docs: DataFrame, words: int, names: DataFrame) -> DataFrame:
    """(k1, shingles) of the named sets, once for each task that reads one of their documents."""
    shared = key_filter(names)

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                own = {set_id(s): s for s in shingle_sets(part.column("text"), words) if len(s)}
                asked = may_hold(shared.value, np.array(list(own), np.int64))
                new = [k for k, a in zip(own, asked.tolist(), strict=True) if a and k not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([own[k].tobytes() for k in new], pa.binary())], ["k1", "shingles"])
            trim()

    return docs.select("text").mapInArrow(run, "k1 bigint, shingles binary")


def similar_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, index_shingles: int = INDEX_SHINGLES, query_shingles: int = QUERY_SHINGLES) -> DataFrame:
    """(node, component) of all sets with a partner; the component is its least set's name.

    The links found connect what similarity connects, which isn't every similar pair.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    buckets = max(1, round(size / 16 / COUNTED))  # a shingle takes some 6 bytes of text, and openings hold two fifths of them
    shared = _openings(docs, words, percent, buckets).groupBy("bucket").applyInArrow(lambda part: _shared(part, buckets), "to int, names binary, sizes binary, held binary, token binary, sets binary")
    routes = saved(shared.groupBy("to").applyInArrow(lambda part: _routes_part(part, percent), "k1 bigint, n int, route array<bigint>"))
    ways = routes.select("k1", F.explode("route").alias("way"))
    # written, so that the join deals out both sides itself and can split a way that very many sets take
    leaders = saved(ways.groupBy("way").agg(F.min("k1").alias("leader"), F.max("k1").alias("other")).filter("leader != other").select("way", "leader"))
    edges = ways.join(leaders, "way").filter("k1 != leader").select(F.col("k1").alias("src"), F.col("leader").alias("dst")).distinct()
    clusters = components(edges)
    weighed = saved(clusters.withColumnRenamed("node", "k1").join(routes.select("k1", "n"), "k1"))
    sizes = saved(weighed.groupBy("component").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("m")))
    totals = sizes.agg(F.sum("m").alias("m"), F.sum(F.when(F.col("w") <= index_shingles, F.col("w"))).alias("w")).collect()[0]
    placed = saved(attached(weighed, sizes, "component", "m", totals["m"] or 0).select("k1", "component", "n", "w"))
    sets = saved(_sets_of(docs, words, placed.select("k1")).join(placed, "k1").dropDuplicates(["k1"]))

    # an index is bounded by its shingles: sets differ in size by thousands
    small, large = sets.filter(F.col("w") <= index_shingles), sets.filter(F.col("w") > index_shingles)
    bins = max(1, -(-(totals["w"] or 0) // index_shingles))
    yes, no = F.lit(True), F.lit(False)
    columns = ["k1", "indexed", "asking", "shingles"]
    together = small.select(F.struct(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("a"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c")).alias("part"), "k1", yes.alias("indexed"), yes.alias("asking"), "shingles")
    slices_of = lambda n, each: F.ceil(n / each).cast("bigint")
    share = lambda seed, n: F.pmod(F.xxhash64("k1", F.lit(seed)), n)
    part = lambda a, b, c: F.struct(a.alias("a"), b.cast("bigint").alias("b"), c.cast("bigint").alias("c")).alias("part")
    q = slices_of(F.col("w"), query_shingles)
    leading = large.filter(share(1, F.col("w")) < index_shingles).select(F.explode(F.sequence(F.lit(0).cast("bigint"), q - 1)).alias("s"), "component", *["k1", "shingles"])
    first = together.unionByName(leading.select(part(F.col("component"), F.lit(0), F.col("s")), "k1", yes.alias("indexed"), no.alias("asking"), "shingles"))
    first = first.unionByName(large.select(part(F.col("component"), F.lit(0), share(2, q)), "k1", no.alias("indexed"), yes.alias("asking"), "shingles"))
    links = saved(_searched(first.select("part", *columns), percent))
    if sizes.filter(F.col("w") > index_shingles).isEmpty():
        return components(links)

    joined = components(links).select(F.col("node").alias("k1"), F.col("component").alias("found"))
    labelled = saved(placed.filter(F.col("w") > index_shingles).join(joined, "k1", "left").withColumn("found", F.coalesce("found", "k1")))
    held = labelled.groupBy("component", "found").agg(F.sum("n").alias("n"))
    largest = held.groupBy("component").agg(F.max(F.struct("n", "found")).alias("top"), F.sum("n").alias("n"))
    facts = largest.select("component", F.col("top.found").alias("found"), slices_of(F.col("n") - F.col("top.n"), index_shingles).alias("slices"))
    facts = saved(facts.join(sizes.select("component", "m"), "component"))
    outside = saved(labelled.join(facts, ["component", "found"], "left_anti").select("k1"))
    asked = attached(large, facts.select("component", "slices", "m"), "component", "m", totals["m"]).filter("slices > 0")
    s = F.col("slices")
    indexed = asked.join(outside, "k1").select("k1", "component", "shingles", share(3, s).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), q - 1)).alias("s"))
    second = indexed.select(part(F.col("component"), F.col("i") + 1, F.col("s")), "k1", yes.alias("indexed"), no.alias("asking"), "shingles").unionByName(
        asked.select("k1", "component", "shingles", share(2, q).alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), s - 1)).alias("i"))
        .select(part(F.col("component"), F.col("i") + 1, F.col("s")), "k1", no.alias("indexed"), yes.alias("asking"), "shingles"))
    more = saved(_searched(second.select("part", *columns), percent))
    return components(links.unionByName(more))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, **sizes) -> DataFrame:
    """All rows, the text left out, with n_shingles, component_id, the least id that links reach, and group_key.

    ``group_key`` names the group itself (ids may repeat); it's null where the set is empty.

    Two documents link when 100 * intersection >= percent * union of their shingle sets.  A
    text with fewer words than a shingle is one shingle; a null text or one without words
    has an empty set, links with nothing and keeps its own id, as does a document without
    partners.  Repeated rows link; among them the least id counts, and null ids only
    where there is no other.  Sets are compared by 64-bit hashes.  An empty table gives an
    empty one.  Columns with the new names are replaced.
    """
    frame, restored = apart(unclashed(df, ["n_shingles", "component_id", "group_key"]), [doc_id, text])
    keep = [c for c in frame.columns if c != text]
    docs = frame.withColumnRenamed(text, "text")
    found = similar_sets(docs.select("text"), words, percent, **sizes)
    own = saved(members(docs, words, keep))
    named = own.join(found.select(F.col("node").alias("k1"), "component"), "k1", "left").withColumn("group_key", F.coalesce("component", "k1")).drop("component")
    least = saved(named.filter("group_key IS NOT NULL").groupBy("group_key").agg(F.min(doc_id).alias("component_id")))
    out = named.join(least, "group_key", "left").withColumn("component_id", F.when(F.col("group_key").isNull(), F.col(doc_id)).otherwise(F.col("component_id")))
    return restored(out.select(*keep, "n_shingles", "component_id", "group_key"))


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
