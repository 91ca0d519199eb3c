"""A rule at every step of cases of any length, by an associative scan of automaton transition functions.

Going backwards, the truth of all parts of a rule at a step depends on their truth one step later and on the atom: a small
automaton that reads a case from its end. Events are range-partitioned by (case, order), so a long case lies in many
partitions. Each partition composes the maps state -> state of its own steps, for all starting states at once; the map of
its whole part of a case goes into a table of parts. The parts of a case are composed in order, FAN of them at a time, level by
level; then every part knows the state behind it, and every step's map gives its value. No window and no group holds more than
a partition, or FAN parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import settled
from . import formula as fm

#: Parts of a case that are composed at once.
FAN = 256


def backward(rule: str) -> tuple[list[str], list[list[int]], list[bool]]:
    """atoms, moves, holds: an automaton that reads a case from its end. State 0 is behind the end; moves[state][k] for atom k, or for any other atom (the last)."""
    parts: list[fm.Formula] = []

    def number(g: fm.Formula) -> None:
        if g not in parts:
            for p in g[1:]:
                if isinstance(p, tuple):
                    number(p)
            parts.append(g)

    number(fm.core(fm.parse(rule)))
    atoms = sorted({g[1] for g in parts if g[0] == "atom"})

    def before(later: tuple[bool, ...] | None, atom: str | None) -> tuple[bool, ...]:
        now: list[bool] = []
        for me, g in enumerate(parts):
            k = [parts.index(p) for p in g[1:] if isinstance(p, tuple)]
            then = lambda i, end: end if later is None else later[i]
            op = g[0]
            now.append(
                atom == g[1] if op == "atom"
                else op == "true" if op in ("true", "false")
                else not now[k[0]] if op == "not"
                else now[k[0]] and now[k[1]] if op == "and"
                else now[k[0]] or now[k[1]] if op == "or"
                else then(k[0], False) if op == "X"
                else now[k[0]] or then(me, False) if op == "F"
                else now[k[0]] and then(me, True) if op == "G"
                else now[k[1]] or (now[k[0]] and then(me, op == "W"))
            )
        return tuple(now)

    states: list[tuple[bool, ...] | None] = [None]
    moves: list[list[int]] = []
    while len(moves) < len(states):
        row = []
        for atom in (*atoms, None):
            to = before(states[len(moves)], atom)
            if to not in states:
                states.append(to)
            row.append(states.index(to))
        moves.append(row)
    return atoms, moves, [bool(s and s[-1]) for s in states]


def composed(maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """maps[i] after all maps before it back to the last start, for rows in the order of reading; by doubling."""
    n = len(maps)
    out, at = maps.copy(), np.arange(n)
    begin = np.maximum.accumulate(np.where(starts, at, 0))
    reach = 1
    while reach < n:
        rows = np.flatnonzero(at - reach >= begin)
        if not len(rows):
            break
        out[rows] = np.take_along_axis(out[rows], out[rows - reach], axis=1)
        reach *= 2
    return out


def step_maps(rows: DataFrame, case: str, moves: list[list[int]], schema: str) -> DataFrame:
    """Adds `_part` (the partition), `_map` (state behind this part of the case -> state at this step) and `_whole` (the part's first step in time).

    rows: sorted by case and falling order in each partition, with `_code`, the number of the atom."""
    table = np.array(moves, np.int16).T.copy()  # by atom, then state
    k = table.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, carried, held = None, np.arange(k), None
        for batch in batches:
            if not batch.num_rows:
                continue
            cases = batch.column(case)
            names = cases.dictionary_encode()
            codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[True], codes[1:] != codes[:-1]])
            maps = composed(table[batch.column("_code").to_numpy(zero_copy_only=False)], starts)
            first = (cases[0].as_py(),)
            if last == first:  # the case goes on from the batch before
                own = len(starts) if starts.sum() == 1 else int(np.flatnonzero(starts)[1])
                maps[:own] = maps[:own][:, carried]
            last, carried = (cases[-1].as_py(),), maps[-1]
            ends = np.concatenate([starts[1:], [False]])
            made = [*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(maps.reshape(-1), pa.int16()), k).cast(pa.list_(pa.int16()))]
            if held is not None:  # its last row ends a part if the case changes here
                yield ended(held, last_ends=held[1] != first)
            held = ([*made, ends], last, batch.schema.names)
        if held is not None:
            yield ended(held, last_ends=True)

    def ended(held: tuple, last_ends: bool) -> pa.RecordBatch:
        columns, _, names = held
        ends = columns[-1].copy()
        ends[-1] = last_ends
        return pa.RecordBatch.from_arrays([*columns[:-1], pa.array(ends)], [*names, "_part", "_map", "_whole"])

    return rows.mapInArrow(run, f"{schema}, _part int, _map array<smallint>, _whole boolean")


def _after(maps: Column, states: Column) -> Column:
    """For each of the states, where a map takes it."""
    return F.transform(states, lambda s: F.get(maps, s.cast("int")))


def states_behind(parts: DataFrame, states: int) -> DataFrame:
    """case, part, behind: the state behind each part. parts: case, part, map; parts with greater numbers are later. Null cases are one case."""
    most = parts.groupBy("case").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    listed = F.array_sort(F.collect_list(F.struct((-F.col("part")).alias("k"), "map")))
    if most <= FAN:
        start = F.struct(F.array().cast("array<struct<part: int, behind: smallint>>").alias("out"), F.lit(0).cast("smallint").alias("s"))
        add = lambda acc, x: F.struct(F.concat(acc["out"], F.array(F.struct((-x["k"]).alias("part"), acc["s"].alias("behind")))).alias("out"), F.get(x["map"], acc["s"].cast("int")).alias("s"))
        return parts.groupBy("case").agg(F.aggregate(listed, start, add)["out"].alias("o")).select("case", F.inline("o"))
    # numbers of parts without gaps aren't needed: FAN neighbouring numbers are one block
    same = F.array(*[F.lit(s).cast("smallint") for s in range(states)])
    block = F.floor(F.col("part") / FAN).cast("int").alias("block")
    blocks = settled(parts.groupBy("case", block).agg(F.aggregate(listed, same, lambda acc, x: _after(x["map"], acc)).alias("map")))
    outer = states_behind(blocks.withColumnRenamed("block", "part"), states).select(F.col("case").alias("_c"), F.col("part").alias("_b"), F.col("behind").alias("_s"))
    inner = parts.groupBy("case", block).agg(listed.alias("l")).join(outer, F.col("case").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    start = F.struct(F.array().cast("array<struct<part: int, behind: smallint>>").alias("out"), F.col("_s").alias("s"))
    add = lambda acc, x: F.struct(F.concat(acc["out"], F.array(F.struct((-x["k"]).alias("part"), acc["s"].alias("behind")))).alias("out"), F.get(x["map"], acc["s"].cast("int")).alias("s"))
    return inner.select("case", F.inline(F.aggregate("l", start, add)["out"]))


def at_each_step(df: DataFrame, rule: str, case: str, order: list[str], atom: str, name: str = "holds", parts: int | None = None) -> DataFrame:
    """The rows with the rule's value at each of them, as `temporal.at_each_step`, for cases of any length.

    A null case is a case; a null atom is none; rows of one case and order come in any order among themselves. `parts`: how many
    range partitions are made (the session's shuffle partitions)."""
    atoms, moves, holds = backward(rule)
    if len(moves) > 1 << 15:
        raise ValueError("the rule's automaton has too many states")
    code = F.coalesce(*[F.when(F.col(atom) == a, F.lit(i)) for i, a in enumerate(atoms)], F.lit(len(atoms)))
    rows = df.select(*df.columns, F.col(case).alias("_case"), code.cast("int").alias("_code"))
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("_case"), *[F.col(c) for c in order]]
    # sorted by falling order within a case; range partitions with greater numbers are later
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(F.col("_case"), *[F.col(c).desc() for c in order])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = settled(step_maps(rows, "_case", moves, schema))
    behind = states_behind(rows.filter("_whole").select(F.col("_case").alias("case"), F.col("_part").alias("part"), F.col("_map").alias("map")), len(moves))
    good = F.array(*[F.lit(h) for h in holds])
    # at most one row a case and part; AQE splits the other side where a case is hot
    behind = behind.select(F.col("case").alias("_c"), F.col("part").alias("_p"), "behind")
    out = rows.join(behind.hint("merge"), F.col("_case").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    return out.select(*df.columns, F.get(good, F.get("_map", F.col("behind").cast("int")).cast("int")).alias(name))
