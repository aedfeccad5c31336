"""Exact removal of repeated byte strings by suffix arrays built in shards.

A string of ``span`` bytes that stands in two places holds the same anchor in both: the
(span/2)-gram with the least hash.  All places that share an anchor meet in one shard, each
with the bytes that strings around the anchor can reach.  Places whose surroundings are
equal meet as one.  A shard sorts its suffixes by induced sorting; permuted common
prefixes of ``span`` bytes or more tell which strings repeat, and those bytes go.

An anchor with very many different surroundings is dealt over several shards, each with an
array of its own; the hashes of the strings that a shard can't decide alone are then
counted over its shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import SPACE, _BYTE, _powers, apart, filtered, flat, hash_segments, key_filter, mix, release_inner, saved, segments, slices, table, text_key, trim, unclashed, written_so_far
from codelake.llm.registry import query
from codelake.llm.suffix_array import SEPARATOR, _prefix_sums, closed, permuted_common_prefixes, suffix_array
from codelake.llm.word_passages import shared_passages

SPAN = 400
#: Surroundings in a shard, each of at most 1.5 spans: about 1.5 MB of text.
PER_SHARD = 2500


# ---------------------------------------------------------------- anchors


def find_anchors(data: np.ndarray, offsets: np.ndarray, span: int):
    """(text number, place in the text, anchor hash, hash of the surroundings) of all anchors."""
    n, gram = len(data), span // 2
    if n < span:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    # the least hash of each string, the first of equal ones: low bits carry the place
    low = (np.uint64(1) << np.uint64(n.bit_length())) - np.uint64(1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, step = span - gram + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    inside = np.ones(len(least), bool)
    for border in offsets[1:-1]:
        inside[max(0, border - span + 1) : border] = False
    chosen = np.zeros(n, bool)
    chosen[(least[inside] & low).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(offsets, at, side="right") - 1
    lo, hi = np.maximum(offsets[doc], at - (span - gram)), np.minimum(offsets[doc + 1], at + span)
    around = mix((sums[hi] - sums[lo]) * inverse[lo] + mix(((hi - lo) << 20 | at - lo).astype(np.uint64)))
    return doc, at - offsets[doc], hashes[at], around


def _anchors(keyed: DataFrame, span: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                doc, at, h, around = find_anchors(data, offsets, span)
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1").take(rows), part.column("k2").take(rows), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(around.view(np.int64))],
                    ["k1", "k2", "pos", "h", "ctx"])

    return keyed.mapInArrow(run, "k1 bigint, k2 bigint, pos int, h bigint, ctx bigint")


# ---------------------------------------------------------------- shards


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:  # a[:lo] == b[:lo], a[:n] != b[:n]
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


def _reach(sides: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with another one of the list."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for a, b in zip(order, order[1:]):
        n = _common(sides[a], sides[b])
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


def candidates(rows: list[tuple], span: int):
    """Strings that may hold repeats: (bytes, bytes before the anchor, several places?, place, members, split).

    ``rows``: (h, ctx, several, split, left, place, bytes) of distinct surroundings, those of
    an anchor together.  What no other place of the anchor shares is cut off both ends
    first; places that then are equal become one.  A dealt-out anchor isn't cut: its other
    places are elsewhere.
    """
    found: dict[tuple, list] = {}
    groups: dict[int, list[tuple]] = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for h, group in groups.items():
        lefts, rights = _reach([r[6][: r[4]][::-1] for r in group]), _reach([r[6][r[4] :] for r in group])
        for r, a, b in zip(group, lefts, rights, strict=True):
            _, ctx, several, split, left, place, data = r
            if several or split:
                a, b = left, len(data) - left
            if a + b < span:
                continue
            cut = data[left - a : left + b]
            key = (h, a, cut) if not split else (h, ctx)
            if key in found:
                found[key][2] = True
                found[key][4].append((h, ctx))
            else:
                found[key] = [cut, a, several, place + left - a, [(h, ctx)], split]
    return list(found.values())


def repeats(strings: list[list], span: int):
    """Suffix array and common prefixes of the strings: (flags of repeated windows, windows that lie in one string, string of each place, text)."""
    text = closed([s[0] for s in strings])
    order = suffix_array(text)
    shared = permuted_common_prefixes(text, order)[order] >= span
    ends = np.flatnonzero(text == SEPARATOR)
    of = np.searchsorted(ends, np.arange(len(text)))
    first = np.append(0, ends[:-1] + 1)
    whole = ends[of] - np.arange(len(text)) >= span
    place = np.array([s[3] & (1 << 63) - 1 for s in strings], np.uint64)[of] + (np.arange(len(text)) - first[of]).astype(np.uint64)
    several = np.array([s[2] for s in strings], bool)[of]
    begins = np.flatnonzero(~shared)
    ordered = place[order]
    twice = np.minimum.reduceat(ordered, begins) != np.maximum.reduceat(ordered, begins)
    twice |= np.maximum.reduceat(several[order].astype(np.int8), begins) > 0
    repeated = np.zeros(len(text), bool)
    repeated[order] = np.repeat(twice, np.diff(np.append(begins, len(order))))
    return repeated & whole, whole, of, text, first


FOUND = "h bigint, ctx bigint, lo int, hi int, bucket int, windows binary"
#: A window of a dealt-out anchor; a settled one was found twice in its shard already.
WINDOW = np.dtype([("window", "i8"), ("place", "i8"), ("h", "i8"), ("ctx", "i8"), ("rel", "i4"), ("settled", "?")])
#: Windows that one task compares.
COMPARED = 2_000_000


def _search_shard(part: pa.Table, span: int, buckets: int) -> pa.Table:
    """Repeated ranges of each surrounding, from the anchor on; and the windows of dealt-out anchors, packed by hash."""
    columns = [part.column(c).to_pylist() for c in ("h", "ctx", "several", "split", "left", "place", "bytes")]
    rows = {(r[0], r[1]): r for r in zip(*columns, strict=True)}
    strings = candidates(sorted(rows.values(), key=lambda r: (r[0], r[1])), span)
    out: list[list] = [[], [], [], [], [], []]
    if strings:
        repeated, whole, of, text, first = repeats(strings, span)
        at = np.flatnonzero(repeated)
        if len(at):
            begin = np.append(True, (np.diff(at) > span) | (np.diff(of[at]) != 0))
            starts, lasts = at[begin], at[np.append(np.flatnonzero(begin)[1:] - 1, len(at) - 1)]
            for s, a, b in zip(of[starts].tolist(), (starts - first[of[starts]]).tolist(), (lasts - first[of[starts]] + span).tolist(), strict=True):
                for h, ctx in strings[s][4]:
                    for column, v in zip(out, (h, ctx, a - strings[s][1], b - strings[s][1], None, None), strict=True):
                        column.append(v)
        split = np.array([s[5] for s in strings], bool)[of] & whole
        at = np.flatnonzero(split)
        if len(at):
            sums, inverse = _prefix_sums(text)
            rows_ = np.empty(len(at), WINDOW)
            rows_["window"] = mix((sums[at + span] - sums[at]) * inverse[at]).view(np.int64)
            rows_["settled"] = repeated[at]
            rows_["rel"] = at - first[of[at]] - np.array([s[1] for s in strings])[of[at]]
            rows_["place"] = np.array([s[3] for s in strings])[of[at]] + at - first[of[at]]
            for k, name in enumerate(("h", "ctx")):
                rows_[name] = np.array([s[4][0][k] for s in strings], np.int64)[of[at]]
            # of what is settled, one row tells the other shards
            _, one = np.unique(rows_["window"], return_index=True)
            once = np.zeros(len(rows_), bool)
            once[one] = True
            rows_ = rows_[once | ~rows_["settled"]]
            bucket = rows_["window"] % buckets
            for k in np.unique(bucket).tolist():
                for column, v in zip(out, (None, None, None, None, k, rows_[bucket == k].tobytes()), strict=True):
                    column.append(v)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    found = pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["h", "ctx", "lo", "hi", "bucket", "windows"])
    del rows, strings, out
    trim()
    return found


def _settle(part: pa.Table, span: int) -> pa.Table:
    """Windows that weren't found twice in their shard, but are in another one or at another place.

    One place can stand in two shards when its text holds the anchor twice.
    """
    rows = np.concatenate([np.frombuffer(b, WINDOW) for b in part.column("windows").to_pylist()])
    rows = rows[np.argsort(rows["window"], kind="stable")]
    first = np.flatnonzero(np.append(True, rows["window"][1:] != rows["window"][:-1]))
    twice = np.minimum.reduceat(rows["place"], first) != np.maximum.reduceat(rows["place"], first)
    twice |= np.maximum.reduceat(rows["settled"].view(np.int8), first) > 0
    rows = rows[np.repeat(twice, np.diff(np.append(first, len(rows)))) & ~rows["settled"]]
    # neighbours in one surrounding are one range
    rows = rows[np.lexsort((rows["rel"], rows["ctx"], rows["h"]))]
    begin = np.append(True, (rows["h"][1:] != rows["h"][:-1]) | (rows["ctx"][1:] != rows["ctx"][:-1]) | (np.diff(rows["rel"]) > span))[: len(rows)]
    starts = np.flatnonzero(begin)
    lasts = np.append(starts[1:] - 1, len(rows) - 1)[: len(starts)]
    return pa.table([pa.array(rows["h"][starts]), pa.array(rows["ctx"][starts]), pa.array(rows["rel"][starts]), pa.array(rows["rel"][lasts] + np.int32(span))], names=["h", "ctx", "lo", "hi"])


def _surroundings(needed: DataFrame, span: int) -> DataFrame:
    """The bytes round each needed anchor, cut out of its text."""
    gram = span // 2
    names = ["shard", "h", "ctx", "several", "split", "left", "place", "bytes"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                out: list[list] = [[] for _ in names]
                for k1, text, wants in zip(part.column("k1").to_pylist(), part.column("text").to_pylist(), part.column("wants").to_pylist(), strict=True):
                    data = text.encode()
                    base = int(mix(np.array([k1], np.int64).view(np.uint64))[0]) & (1 << 62) - 1
                    for w in wants:
                        lo, hi = max(0, w["pos"] - (span - gram)), min(len(data), w["pos"] + span)
                        row = (w["shard"], w["h"], w["ctx"], w["several"], w["split"], w["pos"] - lo, base + lo, data[lo:hi])
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return needed.select("k1", "text", "wants").mapInArrow(run, "shard int, h bigint, ctx bigint, several boolean, split boolean, left int, place bigint, bytes binary")


def repeated_ranges(keyed: DataFrame, span: int = SPAN, per_shard: int | None = None) -> DataFrame:
    """(k1, k2, ranges): the byte ranges of each distinct text that strings of ``span`` bytes found twice cover.

    A range may go on beyond its text's start or end; ``merged`` cuts it there.
    ``keyed`` has (k1, k2, text), one row for each document: copies count as places.
    Shorter spans have more surroundings in a shard, so that its text stays as long.
    """
    per_shard = per_shard or PER_SHARD * SPAN // span
    spark, first = keyed.sparkSession, written_so_far(keyed.sparkSession)
    anchors = saved(_anchors(keyed, span))
    # written, so that the join below deals out both sides itself and can split a hot anchor
    twice = saved(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    hits = saved(anchors.join(twice, "h"))
    release_inner(spark, first)  # anchors are the largest table here, and nothing reads them again
    around = hits.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("at"))
    around = saved(around)
    sizes = saved(around.groupBy("h").agg(F.count(F.lit(1)).alias("n_around")))
    total, dealt_out = (n or 0 for n in sizes.filter("n_around > 1").agg(F.sum("n_around"), F.sum(F.when(F.col("n_around") > per_shard, F.col("n_around")))).first())
    shards = max(1, -(-total // per_shard))
    placed = around.join(sizes, "h")
    # an anchor whose places all have the same surroundings needs no array: all of these repeat
    alone = placed.filter("n_around = 1").select("h", "ctx", F.lit(span // 2 - span).alias("lo"), F.lit(span).alias("hi"))
    dealt = placed.filter("n_around > 1").select(
        "h", "ctx", "at.k1", "at.k2", "at.pos", (F.col("n") > 1).alias("several"), (F.col("n_around") > per_shard).alias("split"),
        F.xxhash64("h", F.pmod("ctx", F.ceil(F.col("n_around") / per_shard))).alias("home"),
    ).withColumn("shard", F.pmod("home", F.lit(shards)).cast("int"))
    wants = saved(dealt.groupBy("k1", "k2").agg(F.collect_list(F.struct("shard", "h", "ctx", "several", "split", "pos")).alias("wants")))
    texts = filtered(keyed, key_filter(wants.select("k1")), once=True)
    cut = _surroundings(texts.join(wants, ["k1", "k2"]), span)
    buckets = max(1, -(-dealt_out * (span - span // 2 + 1) // COMPARED))
    found = saved(cut.groupBy("shard").applyInArrow(lambda part: _search_shard(part, span, buckets), FOUND))
    settled = found.filter("bucket IS NOT NULL").groupBy("bucket").applyInArrow(lambda part: _settle(part, span), "h bigint, ctx bigint, lo int, hi int")
    covers = found.filter("bucket IS NULL").select("h", "ctx", "lo", "hi").unionByName(settled).unionByName(alone)
    ranges = hits.join(covers, ["h", "ctx"]).select("k1", "k2", (F.col("pos") + F.col("lo")).alias("start"), (F.col("pos") + F.col("hi")).alias("end")).distinct()
    return ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


# ---------------------------------------------------------------- passages of many words


PASSAGE = "h bigint, k1 bigint, k2 bigint, several boolean, start int, end int"


def passages(data: np.ndarray, runs: list[tuple[int, int]], over_words: int, span: int):
    """(starts, ends) of the strings of ``over_words`` + 1 whole words inside the runs, and of those of ``span`` bytes that hold no such string."""
    begin, end, _ = segments(data, np.array([0, len(data)]), SPACE)
    starts, ends = [], []
    for a, b in runs:
        lo, hi = np.searchsorted(begin, a), np.searchsorted(end, b, side="right")
        if hi - lo > over_words:
            starts.append(begin[lo : hi - over_words])
            ends.append(end[lo + over_words : hi])
        if b - a >= span:
            at = np.arange(a, b - span + 1)
            first, last = np.searchsorted(begin, at), np.searchsorted(end, at + span, side="right")
            at = at[last - first <= over_words]
            starts.append(at)
            ends.append(at + span)
    if not starts:
        return (np.zeros(0, np.int64),) * 2
    return np.concatenate(starts), np.concatenate(ends)


def long_ranges(keyed: DataFrame, ranges: DataFrame, over_words: int, span: int = SPAN) -> DataFrame:
    """(k1, k2, ranges) of what strings found twice cover that have more than ``over_words`` words or ``span`` bytes.

    ``ranges`` are those of repeated strings of at most 2 * ``over_words`` + 1 bytes: what is looked for lies inside
    them, but they may also be chains of shorter strings that repeat in different places.
    """
    copied = saved(keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2", F.lit(True).alias("several")))
    marked = saved(ranges.join(copied, ["k1", "k2"], "left"))

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                for k1, k2, text, spans, several in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text", "ranges", "several")), strict=True):
                    data = np.frombuffer(text.encode(), np.uint8)
                    starts, ends = passages(data, merged([(r["start"], r["end"]) for r in spans], len(data)), over_words, span)
                    if not len(starts):
                        continue
                    same = [np.full(len(starts), x) for x in (np.int64(k1), np.int64(k2), bool(several))]
                    columns = [hash_segments(data, starts, ends).view(np.int64), *same, starts.astype(np.int32), ends.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "k1", "k2", "several", "start", "end"])

    found = saved(filtered(keyed, key_filter(marked.select("k1")), once=True).join(marked, ["k1", "k2"]).mapInArrow(run, PASSAGE))
    # written, so that the join below can split a hot passage
    place = F.xxhash64("k1", "k2", "start")
    twice = saved(found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("several").alias("several")).filter("a <> b OR several").select("h"))
    return found.join(twice, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


# ---------------------------------------------------------------- removal


def merged(ranges: list[tuple[int, int]], size: int | None = None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, of a text of ``size`` bytes."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        a, b = max(a, 0), b if size is None else min(b, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs drawn in to the borders of characters, so that what is kept stays text."""
    out = []
    for a, b in runs:
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _removed(texts: DataFrame) -> DataFrame:
    """(k1, k2, text, ranges) to what is left of each text, and its figures."""
    types = {"k1": pa.int64(), "k2": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                rows = []
                for k1, k2, text, ranges in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text", "ranges")), strict=True):
                    data = text.encode()
                    runs = merged([(r["start"], r["end"]) for r in ranges], len(data))
                    rows.append((k1, k2, sum(b - a for a, b in runs), len(runs), hashlib.sha256(_without(data, runs)).hexdigest(), _without(data, _whole_characters(data, runs)).decode()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], list(types))

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")


def remove_repeats(df: DataFrame, text: str = "text", span: int = SPAN, with_text: bool = True, over_words: int | None = None, shared_words: int | None = None) -> DataFrame:
    """All rows with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the text without its repeats.

    Every byte goes that a string of ``span`` bytes covers which also starts anywhere else,
    in the same text or another row's; the first place goes too.  Strings never cross texts
    and are judged on the input.  ``kept_sha256`` is of the remaining bytes; the text is cut
    at whole characters only, so it may keep up to three bytes at each border more.

    With ``over_words`` the strings are those of more than so many whole words (runs between
    white space), however short, and those of ``span`` bytes, however few their words.

    With ``shared_words`` (and without the text) there are n_passages and n_passage_bytes
    too: the passages of more than so many words that another row has as well, however few
    their bytes.  They are only measured; see ``shared_passages``.

    A null text is empty: nothing is removed, and it stays null.  Texts shorter than
    ``span`` bytes stay whole, copies too; longer copies lose everything.  An empty table
    gives an empty one.  Columns with the new names are replaced.
    """
    measured = [] if shared_words is None else ["n_passages", "n_passage_bytes"]
    frame, restored = apart(unclashed(df, ["n_bytes", "n_removed", "n_spans", "kept_sha256", *measured]), [text])
    keyed = frame.withColumn("_k", text_key(F.col(text))).select("*", "_k.k1", "_k.k2").drop("_k")
    plain = keyed.select("k1", "k2", F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark, first = df.sparkSession, written_so_far(df.sparkSession)
    if over_words is None:
        ranges = saved(repeated_ranges(plain, span))
    else:
        # so many words and one have a byte each and one between them at least
        short = min(span, 2 * over_words + 1)
        # shards of half the text: these arrays come in the middle of a pipeline, beside what earlier stages hold
        ranges = saved(repeated_ranges(plain, short, max(1, PER_SHARD * SPAN // (2 * short))))
        release_inner(spark, first)
        ranges = saved(long_ranges(plain, ranges, over_words, span))
        release_inner(spark, first)
    words = key_filter(ranges.select("k1"))
    done = _removed(filtered(plain, words, once=True).join(ranges, ["k1", "k2"])).dropDuplicates(["k1", "k2"])
    body = F.coalesce(F.col(text), F.lit(""))
    if not with_text:
        rows = keyed.withColumns({"n_bytes": F.octet_length(body).cast("bigint"), "_whole": F.sha2(body, 256)}).drop(text)
        found = saved(done.drop("kept"))
        release_inner(spark, first)
        if measured:
            # one row for each text, so that the one join with the rows can split a text that many of them have
            found = saved(found.join(shared_passages(plain, shared_words), ["k1", "k2"], "full"))
            release_inner(spark, first)
        out = rows.join(found, ["k1", "k2"], "left")
        return restored(out.withColumns({
            **{c: F.coalesce(c, F.lit(0).cast("bigint")) for c in measured},
            "n_removed": F.coalesce("n_removed", F.lit(0).cast("bigint")), "n_spans": F.coalesce("n_spans", F.lit(0).cast("bigint")),
            "kept_sha256": F.coalesce("kept_sha256", "_whole")}).drop("k1", "k2", "_whole"))
    # only rows that may have lost something meet the results; the others pass without a shuffle
    passed = filtered(keyed, words, keep=False).withColumns({
        "n_bytes": F.octet_length(body).cast("bigint"), "n_removed": F.lit(0).cast("bigint"), "n_spans": F.lit(0).cast("bigint"), "kept_sha256": F.sha2(body, 256)})
    met = filtered(keyed, words).join(done, ["k1", "k2"], "left").withColumns({
        "n_bytes": F.octet_length(body).cast("bigint"), "n_removed": F.coalesce("n_removed", F.lit(0).cast("bigint")), "n_spans": F.coalesce("n_spans", F.lit(0).cast("bigint")),
        "kept_sha256": F.coalesce("kept_sha256", F.sha2(body, 256)), text: F.coalesce("kept", text)})
    return restored(passed.unionByName(met.drop("kept").select(*passed.columns)).drop("k1", "k2"))


#: A passage of more words that two documents share is reported, however few its bytes.
PASSAGE_WORDS = 50


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, with_text=False, shared_words=PASSAGE_WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes")
