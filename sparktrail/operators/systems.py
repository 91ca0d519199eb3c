"""Labelled transition systems, all systems of a table at once: stuttering blocks, quotients, signatures, and products with automata.

moves: sys, src, label (array of atoms, empty for a silent move), dst (null for a state that needs no move), initial. Every step is a
join or an aggregate over the union of all systems, so one system of many states is spread like many small ones. Loops write
their tables to the shared folder (`graph.settled`). Tables of systems are merged, not broadcast, in the products: written files are
small beside their rows, so Spark would take large ones for small and pass them through the driver.

Silent components are made one state first; then silent moves have no cycles, and the states that silent moves lead to are
found once (`_weak`): rows are pairs of states that silent moves join, so long silent chains cost the square of their length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import formula as fm
from . import graph
from .graph import reachable, settled, spread, strong_components


def _moves(moves: DataFrame, key: str) -> DataFrame:
    label = F.array_sort(F.coalesce("label", F.array().cast("array<string>")))
    return moves.filter(F.col("dst").isNotNull()).select(F.col(key).alias("sys"), "src", label.alias("label"), "dst").distinct()


def _states(moves: DataFrame, key: str) -> DataFrame:
    rows = moves.select(F.col(key).alias("sys"), F.explode(F.array("src", "dst")).alias("state"))
    return rows.filter("sys IS NOT NULL AND state IS NOT NULL").distinct()


def _node(column: str) -> Column:
    return F.struct("sys", F.col(column).alias("state"))


def _edges(moves: DataFrame) -> DataFrame:
    return moves.select(_node("src").alias("src"), _node("dst").alias("dst"))


def _silent() -> Column:
    return F.size("label") == 0


def alike(moves: DataFrame, key: str, initial: str | None = None) -> tuple[DataFrame, DataFrame]:
    """names (sys, like) and the distinct rows (sys, src, label, dst, initial) of the systems that stand for all with the same rows, the
    least ones. Rows are compared by 128 bits of their set and their number; rows without a system go."""
    label = F.array_sort(F.coalesce("label", F.array().cast("array<string>")))
    rows = settled(moves.filter(F.col(key).isNotNull()).select(F.col(key).alias("sys"), "src", label.alias("label"), "dst", *([F.col(initial).alias("initial")] if initial else [])).distinct())
    ends = [c for c in rows.columns if c not in ("sys", "label")]
    seen = [F.size("label"), "label", *[x for c in ends for x in (F.col(c).isNull(), c)]]  # hashes skip nulls and brackets
    marks = settled(rows.groupBy("sys").agg(*[F.bit_xor(F.xxhash64(F.lit(k), *seen)).alias(f"h{k}") for k in (0, 1)], F.count("*").alias("n")))
    least = marks.groupBy("h0", "h1", "n").agg(F.min("sys").alias("like"))
    names = settled(marks.join(least.hint("merge"), ["h0", "h1", "n"]).select("sys", "like"))
    if names.filter("sys <> like").isEmpty():
        return names, rows
    return names, settled(rows.join(names.filter("sys = like").select("sys").hint("merge"), "sys", "left_semi"))


def told(names: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """What was found for the systems that stand for others, for all that they stand for."""
    rest = [c for c in found.columns if c != "sys"]
    return names.join(found.withColumnRenamed("sys", "like").hint("merge"), "like").select(F.col("sys").alias(key), *rest)


def _silent_loops(moves: DataFrame) -> DataFrame | None:
    """sys, state, leader (least state): the states on silent cycles with their components; None if there are none."""
    silent = moves.filter(_silent())
    if silent.isEmpty():
        return None
    parts = settled(strong_components(_edges(silent)).filter("cyclic").select("node.sys", "node.state", F.col("component.state").alias("leader")))
    return None if parts.isEmpty() else parts


def _led(moves: DataFrame, leaders: DataFrame | None) -> DataFrame:
    """Moves between leaders, without silent moves that stay."""
    if leaders is None:
        return moves
    for end in ("src", "dst"):
        moves = moves.join(leaders.select("sys", F.col("state").alias(end), "leader").hint("merge"), ["sys", end], "left").withColumn(end, F.coalesce("leader", end)).drop("leader")
    return moves.select("sys", "src", "label", "dst").filter(~_silent() | (F.col("src") != F.col("dst"))).distinct()


def _ahead(moves: DataFrame) -> DataFrame | None:
    """sys, src, mid: other states that silent moves lead to; None if there are no silent moves. Their graph has no cycles."""
    silent = moves.filter(_silent())
    if silent.isEmpty():
        return None
    edges = _edges(silent)
    pairs = reachable(edges, edges.select(F.col("src").alias("node")).distinct()).filter("depth > 0")
    return pairs.select("root.sys", F.col("root.state").alias("src"), F.col("node.state").alias("mid"))


def _weak(moves: DataFrame, ahead: DataFrame | None) -> DataFrame:
    """sys, src, mid, label, dst: moves that a state can make after silent ones; `mid` makes them."""
    own = moves.select("sys", "src", F.col("src").alias("mid"), "label", "dst")
    if ahead is None:
        return own
    return own.unionByName(ahead.join(moves.withColumnRenamed("src", "mid").hint("merge"), ["sys", "mid"]).select(own.columns))


def divergent(moves: DataFrame, key: str = "sys") -> DataFrame:
    """sys, state, divergent: the states that can go on silently for ever, without their blocks."""
    names, rows = alike(moves, key)
    return told(names, _divergent(_moves(rows, "sys"), _states(rows, "sys")), key)


def _divergent(m: DataFrame, states: DataFrame) -> DataFrame:
    bad = graph.divergence(_edges(m.filter(_silent()))).select("node.sys", "node.state", F.lit(True).alias("bad"))
    return states.join(bad, ["sys", "state"], "left").select("sys", "state", F.coalesce("bad", F.lit(False)).alias("divergent"))


def _bits(*parts: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), *parts) for k in (0, 1)]


def _split(rows: DataFrame, by: list[str]) -> DataFrame:
    """The distinct `by` of rows (by, a0, a1, b0, b1) in which some a has several b."""
    b = F.struct("b0", "b1")
    return rows.groupBy(*by, "a0", "a1").agg(F.min(b).alias("x"), F.max(b).alias("y")).filter("x <> y").select(*by).distinct()


def _rounds(now: DataFrame, weak: DataFrame, silent: bool) -> DataFrame:
    """g, id, b0, b1: the blocks of numbered states. now: g, id, b0, b1. weak: g, src, mid, dst, l0, l1 (null for silent moves).

    A row has numbers and 128 bits of a block or label only. Systems without a block that a round has split are done, and once half
    of them are, the moves of the rest are written anew."""
    done: list[DataFrame] = []
    held = left = None
    while True:
        block = lambda c, n, now=now: now.select(F.col("id").alias(c), F.col("b0").alias(f"{n}0"), F.col("b1").alias(f"{n}1"))
        rows = weak.join(block("dst", "d"), "dst")
        if silent:
            rows = rows.join(block("mid", "m"), "mid")
        rows = rows.join(block("src", "s"), "src")
        if silent:
            rows = rows.filter("m0 = s0 AND m1 = s1 AND (l0 IS NOT NULL OR d0 <> s0 OR d1 <> s1)")
        # silent moves have no label, and hashes skip nulls
        seen = rows.select("src", *[x.alias(f"e{k}") for k, x in enumerate(_bits(F.col("l0").isNull(), "l0", "l1", "d0", "d1"))]).distinct()
        signed = seen.groupBy(F.col("src").alias("id")).agg(F.bit_xor("e0").alias("h0"), F.bit_xor("e1").alias("h1"))
        named = _bits(F.col("h0").isNull(), "b0", "b1", "h0", "h1")
        new = settled(now.join(signed, "id", "left").select("g", "id", F.col("b0").alias("a0"), F.col("b1").alias("a1"), named[0].alias("b0"), named[1].alias("b1")))
        grown = settled(_split(new, ["g"]))
        left = grown.count()
        if not left:
            done.append(new.select("g", "id", "b0", "b1"))
            return reduce(DataFrame.unionByName, done)
        told_ = settled(new.join(grown.withColumn("on", F.lit(True)), "g", "left").select("g", "id", "b0", "b1", F.col("on").isNotNull().alias("on")))
        done.append(told_.filter("NOT on").drop("on"))
        now = told_.filter("on").drop("on")
        if held is None or 2 * left < held:
            weak, held = settled(weak.join(grown, "g", "left_semi")), left


def stuttering(moves: DataFrame, key: str = "sys") -> DataFrame:
    """sys, state, block (its least state), divergent: divergence-keeping stuttering equivalence within each system.

    States start in two blocks, divergent and not. A round's signature of a state is the set of (label, block) of the moves that
    it can make after silent moves to states of its own block, without silent moves inside the block; rounds go on for the systems
    whose number of blocks has grown. Equal systems are refined once."""
    names, rows = alike(moves, key)
    return told(names, _blocks(_moves(rows, "sys"), _states(rows, "sys")).select("sys", "state", "block", "divergent"), key)


def _blocks(m: DataFrame, states: DataFrame) -> DataFrame:
    """sys, g, state, block, id, divergent: as `stuttering`, with a number of the system and one of the block."""
    m, states = settled(m), settled(states)
    lead = _silent_loops(m)
    if lead is None:
        states = states.select("sys", "state", F.col("state").alias("leader"), F.lit(False).alias("divergent"))
    else:
        bad = _divergent(m, states)
        states = settled(bad.join(lead, ["sys", "state"], "left").select("sys", "state", F.coalesce("leader", "state").alias("leader"), "divergent"))
    led = m if lead is None else settled(_led(m, lead))
    ahead = _ahead(led)
    number = lambda rows, n: settled(rows.withColumn(n, F.monotonically_increasing_id()))
    systems = number(states.select("sys").distinct(), "g")
    ids = number(states.select("sys", F.col("leader").alias("state"), "divergent").distinct().join(systems, "sys"), "id")
    weak = _weak(led, ahead).withColumns({f"l{k}": F.when(~_silent(), F.xxhash64(F.lit(k), "label")) for k in (0, 1)})
    for end in ("src", "mid", "dst"):
        weak = weak.join(ids.select("sys", F.col("state").alias(end), "g", F.col("id").alias(f"_{end}")).drop(*(["g"] if end != "src" else [])), ["sys", end])
    weak = settled(weak.select("g", F.col("_src").alias("src"), F.col("_mid").alias("mid"), F.col("_dst").alias("dst"), "l0", "l1"))
    first = _bits("divergent")
    found = settled(_rounds(ids.select("g", "id", first[0].alias("b0"), first[1].alias("b1")), weak, ahead is not None))
    named = found.join(ids.select("id", "sys", "state"), "id").groupBy("g", "b0", "b1").agg(F.min(F.struct("state", "id")).alias("least"))
    of = found.join(named, ["g", "b0", "b1"]).select("id", F.col("least.id").alias("block_id"), F.col("least.state").alias("block"))
    out = states.join(ids.select("sys", "g", F.col("state").alias("leader"), "id"), ["sys", "leader"]).join(of, "id")
    return settled(out.select("sys", "g", "state", "block", F.col("block_id").alias("id"), "divergent"))


def _quotient(m: DataFrame, blocks: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        m = m.join(blocks.select("sys", F.col("state").alias(end), F.col("block").alias(f"_{end}")), ["sys", end])
    m = m.select("sys", F.col("_src").alias("src"), "label", F.col("_dst").alias("dst"))
    return m.filter(~_silent() | (F.col("src") != F.col("dst"))).distinct()


def quotients(moves: DataFrame, key: str = "sys") -> DataFrame:
    """sys, src, label, dst between blocks, which their least state names."""
    names, rows = alike(moves, key)
    return told(names, _quotient(_moves(rows, "sys"), _blocks(_moves(rows, "sys"), _states(rows, "sys"))), key)


def signatures(moves: DataFrame, key: str = "sys", initial: str = "initial") -> DataFrame:
    """sys, signature: equal for two systems if and only if their first states are equivalent in the union of both.

    Blocks of the quotients are hashed with what they lead to, round by round: systems whose hashes stand still are done; the
    others (cyclic ones) go on until a round tells no more blocks apart, over all of them together. Equal systems are hashed once."""
    names, rows = alike(moves, key, initial)
    return told(names, _signatures(rows), key)


def _signatures(rows: DataFrame) -> DataFrame:
    m = _moves(rows, "sys")
    blocks = _blocks(m, _states(rows, "sys"))
    ids = blocks.select("sys", "g", "block", "id", "divergent").distinct()
    q = _quotient(m, blocks).withColumns({f"l{k}": F.when(~_silent(), F.xxhash64(F.lit(k), "label")) for k in (0, 1)})
    for end in ("src", "dst"):
        q = q.join(ids.select("sys", F.col("block").alias(end), F.col("id").alias(f"_{end}")), ["sys", end])
    q = settled(q.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "l0", "l1"))
    first = _bits("divergent")
    now = settled(ids.select("g", "id", "divergent", first[0].alias("b0"), first[1].alias("b1")))
    done: list[DataFrame] = []
    held = None
    while True:
        seen = q.join(now.select(F.col("id").alias("dst"), F.col("b0").alias("d0"), F.col("b1").alias("d1")), "dst").select("src", *[x.alias(f"e{k}") for k, x in enumerate(_bits(F.col("l0").isNull(), "l0", "l1", "d0", "d1"))])
        signed = seen.distinct().groupBy(F.col("src").alias("id")).agg(F.bit_xor("e0").alias("h0"), F.bit_xor("e1").alias("h1"))
        named = _bits("divergent", F.col("h0").isNull(), "h0", "h1")
        new = settled(now.join(signed, "id", "left").select("g", "id", "divergent", F.col("b0").alias("a0"), F.col("b1").alias("a1"), named[0].alias("b0"), named[1].alias("b1")))
        moved = settled(new.filter("a0 <> b0 OR a1 <> b1").select("g").distinct())
        new = settled(new.join(moved.withColumn("on", F.lit(True)), "g", "left").withColumn("on", F.col("on").isNotNull()))
        on = new.filter("on")
        if moved.isEmpty() or _split(on, []).isEmpty():
            done.append(new.select("id", "b0", "b1"))
            break
        done.append(new.filter("NOT on").select("id", "b0", "b1"))
        now = on.select("g", "id", "divergent", "b0", "b1")
        left = moved.count()
        if held is None or 2 * left < held:
            q, held = settled(q.join(now.select(F.col("id").alias("src")), "src", "left_semi")), left
    hashes = reduce(DataFrame.unionByName, done)
    first = rows.select("sys", F.col("initial").alias("state")).distinct().join(blocks.select("sys", "state", "id"), ["sys", "state"])
    return settled(first.join(hashes, "id").select("sys", F.format_string("%016x%016x", "b0", "b1").alias("signature")))


def clusters(moves: DataFrame, key: str = "sys", initial: str = "initial") -> DataFrame:
    """sys, signature, representative, singleton: systems by `signatures`; fewest states, then moves, then name stand for them."""
    names, rows = alike(moves, key, initial)
    states = _states(rows, "sys").groupBy("sys").agg(F.count("*").alias("states"))
    steps = _moves(rows, "sys").groupBy("sys").agg(F.count("*").alias("moves"))
    many = names.groupBy(F.col("like").alias("sys")).agg(F.count("*").alias("many"))
    signed = settled(_signatures(rows).join(states, "sys").join(steps, "sys", "left").fillna(0, ["moves"]).join(many, "sys"))
    # the least name of equal systems stands for them, so the representative of all is one of these
    lead = signed.groupBy("signature").agg(F.min_by("sys", F.struct("states", "moves", "sys")).alias("representative"), (F.sum("many") == 1).alias("singleton"))
    return told(names, signed.join(lead, "signature").select("sys", "signature", "representative", "singleton"), key)


def bisimilar(moves: DataFrame, pairs: DataFrame, key: str = "sys", initial: str = "initial") -> DataFrame:
    """a, b, bisimilar: whether the first states of both systems are equivalent. Pairs with an unknown system give no row."""
    s = settled(signatures(moves, key, initial))
    side = lambda c: s.select(F.col(key).alias(c), F.col("signature").alias(f"_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("_a") == F.col("_b")).alias("bisimilar"))


def collapsed(moves: DataFrame, key: str = "sys") -> DataFrame:
    """sys, src, label, dst with each silent component as one state, named by its least."""
    m = settled(_moves(moves, key))
    return _led(m, _silent_loops(m)).withColumnRenamed("sys", key)


def lift_report(moves: DataFrame, key: str = "sys", initial: str = "initial") -> DataFrame:
    """States, silent and visible moves, dead ends, unreachable states and complexity of each system."""
    m, states = settled(_moves(moves, key)), settled(_states(moves, key))
    first = moves.select(F.col(key).alias("sys"), F.col(initial).alias("state")).distinct()
    live = spread(_edges(m), first.select(_node("state").alias("node"))).select("node.sys", "node.state", F.lit(1).alias("live"))
    stop = states.join(m.select("sys", F.col("src").alias("state")), ["sys", "state"], "left_anti").select("sys", "state", F.lit(1).alias("stop"))
    count = states.join(live, ["sys", "state"], "left").join(stop, ["sys", "state"], "left").groupBy("sys").agg(F.count("*").alias("states"), F.count("stop").alias("dead_ends"), F.count_if(F.col("live").isNull()).alias("unreachable"))
    steps = m.groupBy("sys").agg(F.count_if(_silent()).alias("silent"), F.count_if(~_silent()).alias("visible"))
    out = count.join(steps, "sys", "left").fillna(0, ["silent", "visible"])
    return out.select(F.col("sys").alias(key), *[F.col(c).cast("int").alias(c) for c in ("states", "silent", "visible", "dead_ends", "unreachable")], (F.col("silent") + F.col("visible") - F.col("states") + 2).cast("int").alias("complexity"))


def _explored(steps: DataFrame, starts: DataFrame, advance: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search of the product of systems and automata, a level at a time over all of them.

    steps: sys, src, label, dst. starts: sys, rule, state, q. `advance` adds `then` to rows of rule, q and label; `judge` adds `bad`
    and `ended`. Each node keeps its least run of each length; a pair of system and rule ends with its first bad level.
    Returns (sys, rule, run) of the least bad runs, and the pairs (sys, rule) of which some run ended."""
    where = ["sys", "rule", "state", "q"]
    now = starts.select(*where, F.array().cast("array<string>").alias("run"))
    levels: list[DataFrame] = []
    bad: list[DataFrame] = []
    while True:
        level = settled(judge(now))
        if level.isEmpty():
            break
        levels.append(level)
        bad.append(level.filter("bad").groupBy("sys", "rule").agg(F.min("run").alias("run")))
        on = level.join(bad[-1].select("sys", "rule").hint("merge"), ["sys", "rule"], "left_anti") if not bad[-1].isEmpty() else level
        word = F.when(_silent(), F.col("run")).otherwise(F.concat("run", F.array(F.array_join("label", " & "))))
        ahead = advance(on.join(steps.withColumnRenamed("src", "state").hint("merge"), ["sys", "state"])).select("sys", "rule", F.col("dst").alias("state"), F.col("then").alias("q"), word.alias("run"))
        seen = reduce(DataFrame.unionByName, [x.select(where) for x in levels])
        ahead = ahead.groupBy(*where, F.size("run").alias("_n")).agg(F.min("run").alias("run")).drop("_n")
        now = ahead.join(seen.hint("merge"), where, "left_anti")
    if not levels:
        none = now.filter("false").select("sys", "rule", "run")
        return none, none.drop("run")
    return reduce(DataFrame.unionByName, bad), reduce(DataFrame.unionByName, [x.filter("ended").select("sys", "rule") for x in levels]).distinct()


def _cyclic(m: DataFrame, first: DataFrame) -> DataFrame:
    """sys: systems with a cycle that their first state reaches. first: sys, state."""
    edges = settled(_edges(m))
    if graph.long_walk_ends(edges).isEmpty():
        return first.select("sys").filter("false")
    live = spread(edges, first.select(_node("state").alias("node")))
    return graph.long_walk_ends(settled(edges.join(live.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi"))).select("node.sys").distinct()


def conformance(moves: DataFrame, rules: dict[str, str], key: str = "sys", initial: str = "initial") -> DataFrame:
    """sys, rule, verdict, counterexample, unmatched, cyclic: each rule against the finite runs of each system.

    Runs end in states without a move; the empty run satisfies nothing; of a move's atoms the first one that the rule knows counts,
    and silent moves don't. VIOLATION if a run ends where the automaton doesn't accept, with the least of the shortest such runs; a
    cycle of the product is walked once, so this is exact for cyclic systems too. COMPLIANT if there is a finite run and all are
    accepted. INCONCLUSIVE if the system lacks an atom of the rule, or has no finite run at all. Equal systems are searched once."""
    known, labelled, other, good = {}, {}, {}, {}
    for name, text in rules.items():
        f = fm.parse(text)
        atoms = sorted(set(fm.atoms(f)))
        table, accepting = fm.automaton(f, [*atoms, None])
        to = {(s, x): F.lit(int(then)) for s, x, then in table}
        known[name] = F.array(*map(F.lit, atoms)).cast("array<string>")
        labelled[name] = F.array(*[F.create_map(*[x for a in atoms for x in (F.lit(a), to[s, a])]).cast("map<string, int>") for s in range(len(accepting))])
        other[name] = F.array(*[to[s, None] for s in range(len(accepting))])
        good[name] = F.array(*[F.lit(bool(ok)) for ok in accepting])

    def of_rule(values: dict[str, Column], kind: str) -> Column:
        """The rule's entry of a literal map, so the automata are part of the expressions: a broadcast a level would be a page of the driver's memory each."""
        return F.try_element_at(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]).cast(f"map<string, {kind}>"), F.col("rule"))

    names, rows = alike(moves, key, initial)
    m = settled(_moves(rows, "sys"))
    first = settled(rows.select("sys", F.col("initial").alias("state")).distinct())
    own = first.select("sys").join(m.select("sys", F.explode("label").alias("atom")).groupBy("sys").agg(F.collect_set("atom").alias("own")).hint("merge"), "sys", "left")
    missing = F.array_except(of_rule(known, "array<string>"), F.coalesce("own", F.array().cast("array<string>")))
    every = own.withColumn("rule", F.explode(F.array(*map(F.lit, rules)).cast("array<string>")))
    cases = settled(every.select("sys", "rule", F.array_sort(missing).alias("unmatched")))

    lead = _silent_loops(m)
    led = m if lead is None else settled(_led(m, lead))
    ahead = _ahead(led)
    steps = settled(_weak(led.filter(~_silent()), ahead).select("sys", "src", "label", "dst").distinct()) if ahead is not None else led
    # a state on a silent cycle has a move, so it is no end, whatever becomes of that cycle
    ends = _states(rows, "sys").join(m.select("sys", F.col("src").alias("state")).hint("merge"), ["sys", "state"], "left_anti")
    if ahead is not None:
        ends = ends.unionByName(ahead.join(ends.withColumnRenamed("state", "mid").hint("merge"), ["sys", "mid"]).select("sys", F.col("src").alias("state"))).distinct()
    ends = settled(ends.withColumn("ended", F.lit(True)))
    begin = first if lead is None else first.join(lead.hint("merge"), ["sys", "state"], "left").select("sys", F.coalesce("leader", "state").alias("state"))
    starts = cases.filter(F.size("unmatched") == 0).select("sys", "rule").join(begin.hint("merge"), "sys").withColumn("q", F.lit(0))

    def advance(rows: DataFrame) -> DataFrame:
        atom = F.get(F.filter("label", lambda a: F.array_contains(of_rule(known, "array<string>"), a)), F.lit(0))
        rows = rows.withColumn("atom", atom)
        seen = F.try_element_at(F.get(of_rule(labelled, "array<map<string, int>>"), F.col("q")), F.col("atom"))
        return rows.withColumn("then", F.when(F.col("atom").isNull(), F.get(of_rule(other, "array<int>"), F.col("q"))).otherwise(seen))

    def judge(rows: DataFrame) -> DataFrame:
        rows = rows.join(ends.hint("merge"), ["sys", "state"], "left").withColumn("ended", F.coalesce("ended", F.lit(False)))
        return rows.withColumn("bad", F.col("ended") & (~F.get(of_rule(good, "array<boolean>"), F.col("q")) | (F.size("run") == 0)))

    bad, ended = _explored(steps, starts, advance, judge)
    loops = _cyclic(m, first).withColumn("_c", F.lit(True))
    out = cases.join(bad.hint("merge"), ["sys", "rule"], "left").join(ended.withColumn("_e", F.lit(True)).hint("merge"), ["sys", "rule"], "left").join(loops.hint("merge"), "sys", "left")
    lost = F.size("unmatched") > 0
    verdict = F.when(lost, "INCONCLUSIVE").when(F.col("run").isNotNull(), "VIOLATION").when(F.col("_e"), "COMPLIANT").otherwise("INCONCLUSIVE")
    out = out.select("sys", "rule", verdict.alias("verdict"), F.coalesce("run", F.array().cast("array<string>")).alias("counterexample"), "unmatched", (F.coalesce("_c", F.lit(False)) & ~lost).alias("cyclic"))
    return told(names, settled(out), key)


def reachability_monitor(label: str) -> list[tuple[str, str, str]]:
    """Moves (src, label, dst) of a monitor that is violated once it sees the label; it stays where it is on any other."""
    return [("ok", label, "violated")]


def loop_bound_monitor() -> list[tuple[str, str, str]]:
    """A monitor without moves of its own: the system's trap states violate it."""
    return []


def monitored(moves: DataFrame, monitors: dict[str, list[tuple[str, str, str]]], key: str = "sys", initial: str = "initial", trap: str = "_loop_exceeds_bound_error") -> DataFrame:
    """sys, monitor, violated, run: whether the product of a system and a monitor reaches a violation, and the labels of a way there.

    Of the ways with the fewest moves, silent ones counted, the one with the least list of labels is given."""
    spark, (names, rows) = moves.sparkSession, alike(moves, key, initial)
    m = settled(_moves(rows, "sys"))
    first = settled(rows.select("sys", F.col("initial").alias("state")).distinct())
    every = F.broadcast(spark.createDataFrame([(n,) for n in monitors], "rule string"))  # a row a monitor
    starts = first.crossJoin(every).withColumn("q", F.lit("ok"))
    table = F.create_map(*[F.lit(x) for n, steps in monitors.items() for s, a, t in steps for x in ("\0".join((n, s, a)), t)]) if any(monitors.values()) else F.create_map().cast("map<string, string>")
    key_of = lambda a: F.concat_ws("\0", F.col("rule"), F.col("q"), a)

    def advance(rows: DataFrame) -> DataFrame:
        to = F.get(F.filter(F.transform("label", lambda a: F.try_element_at(table, key_of(a))), lambda t: t.isNotNull()), F.lit(0))
        return rows.withColumn("then", F.coalesce(to, F.col("q")))

    def judge(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bad", (F.col("q") == "violated") | F.endswith(F.col("state"), F.lit(trap))).withColumn("ended", F.lit(False))

    bad, _ = _explored(m, starts, advance, judge)
    out = first.select("sys").crossJoin(every).join(bad.hint("merge"), ["sys", "rule"], "left")
    return told(names, out.select("sys", F.col("rule").alias("monitor"), F.col("run").isNotNull().alias("violated"), F.coalesce("run", F.array().cast("array<string>")).alias("run")), key)
