"""Passages of many words that stand in several documents, found by anchors over word hashes.

A run of so many words that stands in two texts holds the same anchor in both: the gram of a
third of its words with the least hash.  Anchors in one text only are dropped.  The texts
with the others are read again, in slices; each slice asks for the hashes of all runs at
such anchors, and is told which of them stand in another text as well.  Runs are compared
at every word, so what is found is exact: nothing is sampled, and nothing shorter is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import _ODD, SPACE, filtered, flat, hash_segments, key_filter, mix, release_inner, saved, segments, slices, trim, written_so_far

#: Runs of words that one task compares.
COMPARED = 500_000
#: The place of a gram in its slice; the bits above are of its hash.  Always as many, so that equal runs have one anchor everywhere.
PLACE = np.uint64((1 << 31) - 1)


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` neighbours from each on, put together from halves."""
    n, size, done, out = len(hashes) - width + 1, 1, 0, None
    while True:
        if width & size:
            out = hashes[:n] if out is None else mix(out * _ODD + hashes[done : done + n])
            done += size
        if size * 2 > width:
            return out
        hashes = mix(hashes[:-size] * _ODD + hashes[size:])
        size *= 2


def word_anchors(data: np.ndarray, offsets: np.ndarray, words: int):
    """(starts, ends, text numbers and hashes of all words, first word of each run of ``words``, its anchor's first word, hashes of the grams)."""
    begin, end, doc = segments(data, offsets, SPACE)
    n, gram = len(begin) - words + 1, max(1, words // 3)
    if n <= 0:
        none, nowhere = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return begin, end, doc, none, nowhere, nowhere, none
    hashes = hash_segments(data, begin, end)
    grams = chained(hashes, gram)
    least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, step = words - gram + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    first = np.flatnonzero(doc[:n] == doc[words - 1 :])
    return begin, end, doc, hashes, first, (least[first] & PLACE).astype(np.int64), grams


def _anchors(keyed: DataFrame, words: int) -> DataFrame:
    """For each text its anchors; and for each row with enough words one without, with the bytes from its first word to its last."""
    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                begin, end, doc, _, _, anchor, grams = word_anchors(data, offsets, words)
                n_words = np.bincount(doc, minlength=len(part))
                long = np.flatnonzero(n_words >= words)
                last = np.cumsum(n_words)[long] - 1
                size = end[last] - begin[last - n_words[long] + 1] if len(long) else last
                new = np.zeros(len(part), bool)
                keys = list(zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), strict=True))
                for k in long.tolist():
                    new[k] = keys[k] not in seen
                    seen.add(keys[k])
                at = np.zeros(len(begin), bool)
                at[anchor] = True
                at = np.flatnonzero(at & new[doc])
                _, one = np.unique(mix(grams[at]) + mix(doc[at].astype(np.uint64)), return_index=True)
                at = at[np.sort(one)]
                rows = pa.array(np.concatenate([long, doc[at]]))
                none = np.arange(len(rows)) < len(long)
                h = np.concatenate([np.zeros(len(long), np.int64), grams[at].view(np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1").take(rows), part.column("k2").take(rows), pa.array(h, mask=none), pa.array(np.concatenate([size, np.zeros(len(at), np.int64)]), mask=~none)],
                    ["k1", "k2", "h", "size"])
        trim()

    return keyed.mapInArrow(run, "k1 bigint, k2 bigint, h bigint, size bigint")


RUN = np.dtype([("run", "i8"), ("text", "i4"), ("start", "i4"), ("end", "i4")])
ASK = np.dtype([("run", "i8"), ("text", "i8")])
SLICE = "slice bigint, k1 array<bigint>, k2 array<bigint>, runs binary, bucket int, asks binary"


def asked(runs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each run of a slice with a text that holds it, and with another one if there is any."""
    order = np.argsort(runs["run"], kind="stable")
    run, text = runs["run"][order], keys[runs["text"][order]]
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    low, high = np.minimum.reduceat(text, first), np.maximum.reduceat(text, first)
    more = low != high
    out = np.empty(len(first) + int(more.sum()), ASK)
    out["run"] = np.concatenate([run[first], run[first][more]])
    out["text"] = np.concatenate([low, high[more]])
    return out


def _runs(texts: DataFrame, words: int, buckets: int) -> DataFrame:
    """For each slice of texts the runs at wanted anchors, and by bucket what it asks for."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                begin, end, doc, hashes, first, anchor, grams = word_anchors(data, offsets, words)
                if not len(first):
                    continue
                wants = part.column("wants")
                of = np.repeat(np.arange(len(part)), np.asarray(wants.value_lengths()))
                named = mix(wants.flatten().to_numpy().view(np.uint64)) + mix(of.astype(np.uint64))
                take = np.flatnonzero(np.isin(mix(grams[anchor]) + mix(doc[anchor].astype(np.uint64)), named))
                if not len(take):
                    continue
                at = first[take]
                runs = np.empty(len(at), RUN)
                runs["run"] = chained(hashes, words)[at].view(np.int64)
                runs["text"] = doc[at]
                runs["start"] = begin[at] - offsets[doc[at]]
                runs["end"] = end[at + words - 1] - offsets[doc[at]]
                k1, k2 = part.column("k1"), part.column("k2")
                keys = (k1.to_numpy().view(np.uint64) ^ mix(k2.to_numpy().view(np.uint64))).view(np.int64)
                asks = asked(runs, keys)
                place = asks["run"] % buckets
                order = np.argsort(place, kind="stable")
                asks, place = asks[order], place[order]
                cut = [*np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist(), len(asks)]
                rows = [(number, k1.to_pylist(), k2.to_pylist(), runs.tobytes(), None, None)]
                rows += [(number, None, None, None, int(place[a]), asks[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
                number += 1
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["slice", "k1", "k2", "runs", "bucket", "asks"])
        trim()

    return texts.select("k1", "k2", "text", "wants").mapInArrow(run, SLICE)


def _answer(part: pa.Table) -> pa.Table:
    """The runs of a bucket that stand in several texts, for each slice that asked for them."""
    blocks = part.column("asks").to_pylist()
    asks = np.frombuffer(b"".join(blocks), ASK)
    of = np.repeat(np.arange(len(blocks)), [len(b) // ASK.itemsize for b in blocks])
    order = np.argsort(asks["run"], kind="stable")
    run, text = asks["run"][order], asks["text"][order]
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    several = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)
    take = np.zeros(len(asks), bool)
    take[order] = np.repeat(several, np.diff(np.append(first, len(run))))
    of, run = of[take], asks["run"][take]
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: len(of)].tolist()
    slices_ = part.column("slice").to_numpy()[of[cut]] if cut else np.zeros(0, np.int64)
    shared = [np.unique(run[a:b]).tobytes() for a, b in zip(cut, [*cut[1:], len(run)])]
    out = pa.table([pa.array(slices_, pa.int64()), pa.array(shared, pa.binary())], names=["slice", "shared"])
    trim()
    return out


def covered(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(passages, bytes) of each text number 0..n-1: runs in the order of their starts that overlap or touch are one passage."""
    begin = np.flatnonzero(np.append(True, (texts[1:] != texts[:-1]) | (starts[1:] > ends[:-1])))[: len(texts)]
    last = np.append(begin[1:], len(texts))[: len(begin)] - 1
    of = texts[begin]
    return np.bincount(of, minlength=n), np.bincount(of, ends[last] - starts[begin], minlength=n).astype(np.int64)


def _measured(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                runs = np.frombuffer(row["runs"], RUN)
                runs = runs[np.isin(runs["run"], np.frombuffer(b"".join(row["shared"]), np.int64))]
                n, size = covered(runs["text"], runs["start"], runs["end"], len(row["k1"]))
                yield pa.RecordBatch.from_arrays([pa.array(row["k1"], pa.int64()), pa.array(row["k2"], pa.int64()), pa.array(n, pa.int64()), pa.array(size)], ["k1", "k2", "n", "size"]).filter(pa.array(n > 0))
        trim()

    return rows.select("k1", "k2", "runs", "shared").mapInArrow(run, "k1 bigint, k2 bigint, n bigint, size bigint")


def shared_passages(keyed: DataFrame, over_words: int) -> DataFrame:
    """(k1, k2, n_passages, n_passage_bytes) of each text with a passage of more than ``over_words`` words that another document has too.

    ``keyed`` has (k1, k2, text), one row for each document.  Words are runs between white
    space, compared byte by byte; the space between them may differ.  The bytes are those from
    a passage's first word to its last; passages that overlap are one.  A text that stands
    in several rows is one passage from its first word to its last.  What a text repeats only
    in itself isn't counted.
    """
    spark, before, words = keyed.sparkSession, written_so_far(keyed.sparkSession), over_words + 1
    found = saved(_anchors(keyed, words))
    anchors = found.filter("h IS NOT NULL").select("k1", "k2", "h")
    # written, so that the join below can split a hot anchor
    shared = saved(anchors.groupBy("h").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("k1", "k2") for f in (F.min, F.max)]).filter("min_k1 <> max_k1 OR min_k2 <> max_k2").select("h"))
    wants = saved(anchors.join(shared, "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("wants")))
    # about so many runs have their anchor at one place
    total = (wants.agg(F.sum(F.size("wants"))).first()[0] or 0) * (words - words // 3 + 1)
    texts = filtered(keyed, key_filter(wants.select("k1")), once=True).join(wants, ["k1", "k2"])
    asks = saved(_runs(texts, words, max(1, -(-total // COMPARED))))
    answers = asks.filter("bucket IS NOT NULL").select("bucket", "slice", "asks").groupBy("bucket").applyInArrow(_answer, "slice bigint, shared binary")
    told = answers.groupBy("slice").agg(F.collect_list("shared").alias("shared"))
    parts = _measured(asks.filter("bucket IS NULL").select("slice", "k1", "k2", "runs").join(told, "slice"))
    copied = found.filter("h IS NULL").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size")).filter("rows > 1").select("k1", "k2", F.lit(1).cast("bigint").alias("n"), "size")
    # a copied text as a whole holds all of its parts
    out = saved(parts.unionByName(copied).groupBy("k1", "k2").agg(F.max_by("n", "size").alias("n_passages"), F.max("size").alias("n_passage_bytes")))
    release_inner(spark, before)
    return out
