"""Order-dependent folds over bounded tables.

A machine's state depends on every earlier row of its key, so a fold is sequential inside
a key.  Two ways around that, both exact and the same for every key:

``fold_finite``, for machines with few states, stays in the JVM.  A block of rows is a map
from the state before it to the state after it.  Maps compose, so blocks are combined into
larger ones level by level, as in a prefix sum; then start states go down the same levels.

``fold`` runs any machine.  Rows are cut at sampled ranges of (key, order), so few keys are
cut at all.  Slices of a cut key are folded in parallel from the state each is believed to
start in; slices whose true start state turns out different are folded again.  The first
slice is always right, so every round settles at least one more of each key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.operators import slices
from codelake.session import checkpoint
from codelake.streaming import machines

#: Rows in a block, and blocks in a block of the next level.
BLOCK = 256


def _field_list(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _pass(df: DataFrame, keys: list[str], order: list[str], keep: list[str], machine, emit: bool) -> DataFrame:
    """Fold every (key, slice) of ``df`` once; give output rows, or final states."""
    group, extra = [*keys, "slice"], list(machine.inputs)
    used = [*dict.fromkeys([*group, "carry", "ts_ms", *extra, *keep])]
    start = json.dumps(machine.start(), sort_keys=True)
    out_cols = [c.split()[0] for c in machine.outputs.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        names = [*keep, *out_cols] if emit else [*group, "final"]
        for pdf in batches:
            rows = []
            inputs = [pdf[c].tolist() for c in extra]
            keeps = [pdf[c].tolist() for c in keep]
            for i, key in enumerate(zip(*[[None if pd.isna(v) else v for v in pdf[c].tolist()] for c in group])):
                if key != current:
                    if current is not None and not emit:
                        rows.append((*current, json.dumps(state, sort_keys=True)))
                    carry = pdf["carry"].iat[i]
                    current, state = key, json.loads(carry if isinstance(carry, str) else start)
                out = machine.step(state, int(pdf["ts_ms"].iat[i]), *[c[i] for c in inputs])
                if emit and out is not None:
                    rows.append((*[c[i] for c in keeps], *out))
            yield pd.DataFrame(rows, columns=names)
        if current is not None and not emit:
            yield pd.DataFrame([(*current, json.dumps(state, sort_keys=True))], columns=names)

    schema = f"{_field_list(df, keep)}, {machine.outputs}" if emit else f"{_field_list(df, group)}, final string"
    placed = df.select(*used, *[c for c in order if c not in used])
    placed = placed.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, *order)
    return placed.select(*used).mapInPandas(fold, schema)


def fold(events: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, machine, slice_by: Column | None = None,
         keep: Sequence[str] = (), hot_rows: int = 0) -> DataFrame:
    """Run ``machine`` over each key's rows in ``order``; output rows carry ``keep``.

    ``slice_by`` must not decrease along the order; without it rows are cut at sampled
    ranges.  Keys with at most ``hot_rows`` rows stay whole.
    """
    keys, order, keep = list(keys), list(order), list(keep)
    if slice_by is None:
        used = list(dict.fromkeys([*keys, *order, ts, *machine.inputs, *keep]))
        events, slice_by = slices.ranged(events.select(*used), keys, order), slices.by_range()
    ms = F.unix_micros(F.col(ts).cast("timestamp")) / 1000
    rows = events.withColumn("ts_ms", F.floor(ms)).withColumn("_cut", slice_by)
    # keys with several slices; with ranges there are at most as many as ranges
    cut = rows.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_slices"))
    cut = checkpoint(cut.filter((F.col("_slices") > 1) & (F.col("_n") > hot_rows)).select(*keys, F.lit(True).alias("_several")))
    none = F.lit(None).cast("string")
    r = slices.join_keys(rows, cut, keys, "left")
    # the slice keeps its own type: as text, 10 would sort before 2
    r = r.withColumn("slice", F.when(F.col("_several"), F.col("_cut")))
    if cut.isEmpty():
        return _pass(r.withColumn("carry", none), keys, order, keep, machine, emit=True)

    several = r.filter("_several")
    start = json.dumps(machine.start(), sort_keys=True)
    first = _pass(several.withColumn("carry", none), keys, order, [], machine, emit=False)
    states = checkpoint(first.withColumn("carry", F.lit(start)))
    previous = Window.partitionBy(*keys).orderBy("slice")
    group = [*keys, "slice"]
    while True:
        known = states.withColumn("believed", F.coalesce(F.lag("final").over(previous), F.lit(start)))
        wrong = checkpoint(known.filter(F.col("believed") != F.col("carry")).select(*group, F.col("believed").alias("carry")))
        if wrong.isEmpty():
            break
        again = _pass(slices.join_keys(several, wrong, group), keys, order, [], machine, emit=False)
        again = slices.join_keys(again, wrong, group)
        kept = slices.join_keys(states, wrong.select(*group), group, "left_anti")
        states = checkpoint(kept.unionByName(again.select(*states.columns)))
    carried = slices.join_keys(several, states.select(*group, "carry"), group)
    both = r.filter("_several IS NULL").withColumn("carry", none).unionByName(carried)
    return _pass(both, keys, order, keep, machine, emit=True)


# ---- machines with few states ----------------------------------------------------------


@dataclass(frozen=True)
class Finite:
    """States as JSON, and for each symbol the number of the state that follows each state, and the output there."""

    states: list[dict]
    symbols: list
    after: list[list[int]]
    outputs: list[list[tuple]]


def finite(machine, symbols: Sequence) -> Finite:
    """All states that the symbols reach from the machine's start; the machine may not look at the time."""
    states, number = [machine.start()], {json.dumps(machine.start(), sort_keys=True): 0}
    after, outputs = [[] for _ in symbols], [[] for _ in symbols]
    at = 0
    while at < len(states):
        for k, symbol in enumerate(symbols):
            state = json.loads(json.dumps(states[at]))
            outputs[k].append(machine.step(state, 0, symbol))
            text = json.dumps(state, sort_keys=True)
            if text not in number:
                number[text] = len(states)
                states.append(state)
            after[k].append(number[text])
        at += 1
    return Finite(states, list(symbols), after, outputs)


def fold_finite(rows: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str, table: Finite, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``before`` and ``after``, the numbers of the states around each row; ``symbol`` is a number of ``table``.

    A block's map is an array with a state for each state, composed by ``aggregate``.  There
    are as many levels as it takes to bring the longest key down to one block; what a task
    holds is one block, whatever the key.
    """
    keys, order = list(keys), list(order)
    keep = [c for c in rows.columns if c not in (*keys, slices.RANGE)]
    n = len(table.states)
    flat = F.array(*[F.lit(x) for row in table.after for x in row])
    follow = lambda state, sym: F.get(flat, sym * n + state)
    same = F.array(*[F.lit(k) for k in range(n)])
    cut = rows if slices.RANGE in rows.columns else slices.ranged(rows, keys, order)
    placed = slices.row_numbers(cut, keys, order, "_place", slices.by_range())
    upper = lambda c: F.floor(F.col(c) / block).cast("bigint")
    placed = placed.withColumn("_block", F.floor((F.col("_place") - 1) / block).cast("bigint"))
    packed = placed.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("_place", F.col(symbol).alias("_symbol"), F.struct(*keep).alias("_row")))).alias("_rows"))
    packed = checkpoint(packed)
    run = F.aggregate("_rows", same, lambda m, r: F.transform(m, lambda x: follow(x, r["_symbol"])))
    most = packed.agg(F.max("_block").alias("m")).collect()[0]["m"]
    # where every key is one block, all start at the machine's start and no map is needed
    levels = [checkpoint(packed.select(*keys, "_block", run.alias("_map"))) if most else packed.select(*keys, "_block")]
    while most:
        parents = levels[-1].groupBy(*keys, upper("_block").alias("_upper")).agg(F.sort_array(F.collect_list(F.struct("_block", "_map"))).alias("_maps"))
        whole = F.aggregate("_maps", same, lambda m, child: F.transform(m, lambda x: F.get(child["_map"], x)))
        levels.append(checkpoint(parents.select(*keys, F.col("_upper").alias("_block"), "_maps", whole.alias("_map"))))
        most //= block
    starts = levels[-1].select(*keys, "_block", F.lit(0).alias("_start"))
    for parents in reversed(levels[1:]):
        path = F.aggregate("_maps", F.array("_start"), lambda seen, child: F.concat(seen, F.array(F.get(child["_map"], F.element_at(seen, -1)))))
        told = slices.join_keys(parents.select(*keys, "_block", "_maps"), starts, [*keys, "_block"]).withColumn("_path", path)
        child = told.select(*keys, F.explode(F.arrays_zip(F.transform("_maps", lambda c: c["_block"]).alias("b"), F.slice("_path", F.lit(1), F.size("_maps")).alias("s"))).alias("_c"))
        starts = checkpoint(child.select(*keys, F.col("_c.b").alias("_block"), F.col("_c.s").alias("_start")))
    path = F.aggregate("_rows", F.array("_start"), lambda seen, r: F.concat(seen, F.array(follow(F.element_at(seen, -1), r["_symbol"]))))
    told = slices.join_keys(packed, starts, [*keys, "_block"]).withColumn("_path", path)
    size = F.size("_rows")
    out = told.select(*keys, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.slice("_path", F.lit(1), size).alias("before"), F.slice("_path", F.lit(2), size).alias("after"))).alias("_z"))
    return out.select(*keys, *[F.col(f"_z.r._row.{c}").alias(c) for c in keep], F.col("_z.before").alias("before"), F.col("_z.after").alias("after"))


def looked_up(table: Finite, values, symbol: Column, state: Column) -> Column:
    """``values[symbol][state]`` as a column of constants."""
    flat = F.array(*[F.lit(v) for row in values for v in row])
    return F.get(flat, symbol * len(table.states) + state)


def session_states(log: DataFrame, threshold: int = 3) -> DataFrame:
    """A session log (run_id, ts, event_id, action) with accepted, status, paused_from and errors, in the JVM.

    Errors are the failures since the last success, a running sum; what is left of the
    machine is status and origin of the pause, a few dozen states.
    """
    keys, order = ["run_id"], ["ts", "event_id"]
    machine = machines.SessionState(threshold)
    known = [*machine.targets, "resume", "agent_ok", *machine.failures]
    table = finite(machine, [*known, None])
    log = slices.ranged(log.select("run_id", "ts", "event_id", "action"), keys, order)
    log = slices.running_sum(log.withColumn("_f", (F.col("action") == "agent_failure").cast("bigint")), keys, order, "_f", "_failed", slices.by_range())
    log = log.withColumn("_mark", F.when(F.col("action") == "agent_ok", F.col("_failed")))
    log = slices.last_known(log, keys, order, "_mark", "_base", slices.by_range())
    errors = (F.col("_failed") - F.coalesce("_base", F.lit(0))).cast("int")
    symbol = F.when(F.col("action") == "agent_failure", F.when(errors >= threshold, known.index("failure_pauses")).otherwise(known.index("failure_fails")))
    for k, action in enumerate(known[: -len(machine.failures)]):
        symbol = symbol.when(F.col("action") == action, k)
    rows = log.select("run_id", "ts", "event_id", "action", slices.RANGE, errors.alias("errors"), symbol.otherwise(len(known)).alias("_symbol"))
    done = fold_finite(rows, keys, order, "_symbol", table)
    status, origin = ([[s[c] for s in table.states]] for c in ("status", "from"))
    ok = [[o[0] for o in row] for row in table.outputs]
    return done.select(
        "run_id", "event_id", "action", looked_up(table, ok, F.col("_symbol"), F.col("before")).alias("accepted"),
        looked_up(table, status, F.lit(0), F.col("after")).alias("status"), looked_up(table, origin, F.lit(0), F.col("after")).alias("paused_from"), "errors")
