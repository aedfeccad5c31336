"""Best-fit packing into bins of several permitted sizes.

Pieces go longest first into the open bin that they leave fullest.  Where none has room, a
bin of the size with the least cost per token opens; at the end each bin shrinks to the
smallest permitted size that holds its contents.  Shards of a bounded number of pieces
are packed by themselves, so no task holds more than that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import SPACE, extended, flat, output, saved, segments, slices, spread, table, unclashed
from codelake.llm.registry import query

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Pieces of a shard; what packing in shards wastes is a few open bins for so many pieces.
PIECES_PER_SHARD = 50_000


def sequence_cost(capacity: int) -> float:
    """Cost of one padded sequence: a fixed part, its tokens, and attention over them."""
    return 256 + capacity + capacity * capacity / 16384


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost):
    """(bin, offset, capacity) of each length, given in the order in which they are to be placed.

    Among equally full bins the one opened last takes the piece; among equally dear sizes
    the smaller opens.
    """
    sizes = sorted(set(capacities))
    # the cheapest size per token from each permitted size upwards
    opens = {c: min(sizes[k:], key=lambda s: (cost(s) / s, s)) for k, c in enumerate(sizes)}
    room: dict[int, list[int]] = {}
    left = 0  # bit r is set when a bin has room r
    used: list[int] = []
    at: list[tuple[int, int]] = []
    for n in lengths:
        if not 0 < n <= sizes[-1]:
            raise ValueError(f"a piece of {n} fits no bin")
        fits = left >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                left ^= 1 << r
        else:
            r = opens[next(c for c in sizes if c >= n)]
            b = len(used)
            used.append(0)
        at.append((b, used[b]))
        used[b] += n
        if r > n:
            room.setdefault(r - n, []).append(b)
            left |= 1 << (r - n)
    final = [next(c for c in sizes if c >= u) for u in used]
    return [(b, offset, final[b]) for b, offset in at]


def pack(
    df: DataFrame,
    length: str,
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
    pieces_per_shard: int = PIECES_PER_SHARD,
) -> DataFrame:
    """One row for each piece: the input's columns with piece_start, piece_len, bin_id, bin_offset and capacity.

    A row longer than the largest size is cut into pieces of that size and a rest.  A row
    of length zero or null has one piece of length 0 in no bin (bin_id null, capacity 0).
    Repeated rows are packed each for itself.  An empty table gives an empty one.
    Columns named like the new ones are replaced.
    """
    new = ["piece_start", "piece_len", "bin_id", "bin_offset", "capacity"]
    largest = max(capacities)
    # Written once: the row numbers below stay the same when a task runs again.
    rows = saved(unclashed(df, [*new, "_row", "_shard"]))
    n = F.greatest(F.coalesce(F.col(length).cast("bigint"), F.lit(0)), F.lit(0))
    cut = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("piece_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)), F.lit(largest).cast("bigint"))))
        .withColumn("piece_len", F.least(n - F.col("piece_start"), F.lit(largest).cast("bigint")))
    )
    total = cut.count()
    shards = max(1, -(-total // pieces_per_shard))
    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64("_row", "piece_start"), F.lit(shards)))
    placed_shape = "_row bigint, piece_start bigint, bin_id bigint, bin_offset bigint, capacity bigint"

    def place(key, part):
        part = part.sort_values(["piece_len", "_row", "piece_start"], ascending=[False, True, True])
        found = np.array(best_fit(part["piece_len"].tolist(), capacities, cost), np.int64).reshape(-1, 3)
        return pd.DataFrame({
            "_row": part["_row"].to_numpy(), "piece_start": part["piece_start"].to_numpy(),
            "bin_id": int(key[0]) * (1 << 32) + found[:, 0], "bin_offset": found[:, 1], "capacity": found[:, 2]})

    full = dealt.filter("piece_len > 0").select("_shard", "_row", "piece_start", "piece_len")
    placed = full.groupBy("_shard").applyInPandas(place, placed_shape)
    out = cut.join(placed, ["_row", "piece_start"], "left").withColumn("capacity", F.coalesce("capacity", F.lit(0).cast("bigint")))
    return out.select(*rows.columns, *new)


def word_counts(df: DataFrame, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """All rows with the number of words `[^\\x20\\x09-\\x0D]+` of the whole text, which is left out; null has none."""
    frame = unclashed(df, [name])
    rest = [c for c in frame.columns if c != text]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = flat(part.column(text))
                yield output(part, rest, **{name: spread(segments(data, offsets, SPACE)[2], len(part))})

    return frame.mapInArrow(run, extended(frame, f"{name} bigint", (text,)))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stand for tokens: the length is a column, and any tokenizer's count can take its place."""
    counted = word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pack(counted, "n_tokens")
