"""How mutants, bases, variants, scores, atoms and tags come together, and what is told of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_bases(mutants: DataFrame, bases: DataFrame) -> DataFrame:
    """Mutants beside what is known of their base: base columns with base_ in front. Mutants without a base go."""
    named = bases.select(*[F.col(c).alias("base_uid" if c == "uid" else f"base_{c}") for c in bases.columns])
    return mutants.join(named, "base_uid")


def with_scores(mutants: DataFrame, scores: DataFrame) -> DataFrame:
    """Mutants with their scores; those without a score go. scores: one row a mutant_id."""
    return mutants.join(scores, "mutant_id")


def with_corpus(variants: DataFrame, corpus: DataFrame) -> DataFrame:
    return variants.join(corpus, "uid")


def atoms_of(nodes: DataFrame, atoms: DataFrame) -> DataFrame:
    """nodes(node) with `atoms`, the node itself where none are known. atoms: node, atoms."""
    return nodes.join(atoms.select("node", "atoms"), "node", "left").withColumn("atoms", F.coalesce("atoms", F.array("node")))


def changed_conditions(original: DataFrame, mutant: DataFrame) -> DataFrame:
    """src, dst, was, now: edges of both whose conditions differ. Both sides: src, dst, condition."""
    a, b = original.withColumnRenamed("condition", "was"), mutant.withColumnRenamed("condition", "now")
    return a.join(b, ["src", "dst"]).filter(~F.col("was").eqNullSafe(F.col("now"))).select("src", "dst", "was", "now")


def variable_kinds(nodes: DataFrame) -> DataFrame:
    """program, control, data: variables of branch conditions, and the others. nodes: program, control_vars, data_vars."""
    gathered = nodes.groupBy("program").agg(F.flatten(F.collect_list("control_vars")).alias("c"), F.flatten(F.collect_list("data_vars")).alias("d"))
    control = F.array_sort(F.array_distinct("c"))
    return gathered.select("program", control.alias("control"), F.array_sort(F.array_except("d", "c")).alias("data"))


def first_tag(tags: Column) -> Column:
    """The first tag that isn't a number, or unknown."""
    return F.coalesce(F.get(F.filter(tags, lambda t: ~t.rlike(r"^\d+$")), F.lit(0)), F.lit("unknown"))


def tasks_in_order(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """graph, tasks: distinct names of tasks in the order in which they are first seen. nodes: graph, pos, type, name."""
    first = nodes.filter(F.col("type").isin(kinds)).groupBy("graph", "name").agg(F.min("pos").alias("pos"))
    return first.groupBy("graph").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("tasks"))


def applicable(results: DataFrame) -> DataFrame:
    """Rules that a model complies with and whose atoms it knows. results: verdict, unmatched."""
    return results.filter((F.col("verdict") == "COMPLIANT") & (F.size("unmatched") == 0))


def unsupported(elements: DataFrame, known: list[str]) -> DataFrame:
    """graph, type, n: elements of a kind that isn't known. elements: graph, type."""
    return elements.filter(~F.col("type").isin(known)).groupBy("graph", "type").agg(F.count("*").cast("bigint").alias("n"))


def recovered(elements: DataFrame, mapped: DataFrame) -> DataFrame:
    """Elements with an id that no scan has mapped, in diagrams that aren't covered whole. Both: graph, node."""
    return elements.filter(F.col("node").isNotNull()).join(mapped.select("graph", "node"), ["graph", "node"], "left_anti")


def disjoint_union(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two systems as one, states told apart by a prefix. Both sides: src, label, dst."""
    own = lambda df, n: df.select(F.concat(F.lit(f"{n}."), "src").alias("src"), "label", F.concat(F.lit(f"{n}."), "dst").alias("dst"))
    return own(a, names[0]).unionByName(own(b, names[1]))


def sample(df: DataFrame, key: str, seed: str, n: int = 10) -> DataFrame:
    """n rows for a check by hand: those of least seeded hash."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def capped(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group, for reports."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def drivers(calls: DataFrame) -> DataFrame:
    """program, driver, n: the function that calls most of its siblings; the first one of equal ones. calls: program, fn, fn_pos, callee."""
    n = calls.filter(F.col("fn") != F.col("callee")).groupBy("program", "fn").agg(F.count("*").cast("bigint").alias("n"), F.min("fn_pos").alias("p"))
    return n.groupBy("program").agg(F.max(F.struct("n", (-F.col("p")).alias("p"), "fn")).alias("m")).select("program", F.col("m.fn").alias("driver"), F.col("m.n").alias("n"))


def canonical(entries: Column) -> Column:
    """A map as sorted pairs, so that equal maps are equal."""
    return F.array_sort(F.map_entries(entries))


def prompt_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def rate_cell(k: Column, n: Column, low: Column, high: Column) -> Column:
    """'k/n = .9800 [.9296, .9976]', or 'n/a' without cases."""
    short = lambda c: F.regexp_replace(F.format_number(c, 4), "^0", "")
    return F.when(n == 0, "n/a").otherwise(F.concat(k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" = "), short(k / n), F.lit(" ["), short(low), F.lit(", "), short(high), F.lit("]")))
