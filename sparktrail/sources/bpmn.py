"""Process diagrams (BPMN 2.0 XML, whole texts) as node and edge rows, by Spark's own XML parser: no Python worker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import settled

#: Element names of executable flow nodes.
NODE_TYPES = ["startEvent", "endEvent", "intermediateCatchEvent", "intermediateThrowEvent", "boundaryEvent", "task", "userTask", "serviceTask", "scriptTask", "manualTask", "sendTask", "receiveTask", "businessRuleTask", "callActivity", "subProcess", "exclusiveGateway", "parallelGateway", "inclusiveGateway", "eventBasedGateway"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """graph, xml."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^.]*$", 1).alias("graph"), F.col("value").alias("xml"))


#: A mark before every value and text, so that nothing is taken for a number, date or truth value; it is taken out again.
_MARK = "\ue000"


def _marked(xml: Column) -> Column:
    """The text without its declaration, with marks, and with a dot for the colon of prefixed attributes, which aren't BPMN's own."""
    out = F.regexp_replace(xml, r"^\s*<\?xml[^>]*\?>", "")
    out = F.regexp_replace(out, r"(\s(?!xml)[\w.-]+):([\w.-]+\s*=\s*[\"'])(?=[^<]*>)", "$1.$2")
    out = F.regexp_replace(out, r"(\s[\w:.-]+\s*=\s*[\"'])", f"$1{_MARK}")
    out = F.regexp_replace(out, r">(\s*[^<\s])", f">{_MARK}$1")
    return F.replace(out, F.lit("<![CDATA["), F.lit(f"<![CDATA[{_MARK}"))


def _root(xml: Column) -> Column:
    """Whether one definitions element spans the text, but for comments and instructions."""
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    after = F.regexp_replace(bare, r"(?s)^.*?</(?:[\w.-]+:)?definitions\s*>", "")
    closed = F.trim(F.regexp_replace(after, r"\s+", " ")) == ""
    return bare.rlike(r"(?s)^\s*\ufeff?<(?:[\w.-]+:)?definitions[\s/>]") & (closed | bare.rlike(r"(?s)^\s*\ufeff?<[^<>]*/>\s*$"))


def checked(diagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diagrams that the parser takes and whose root is a definitions element, and the others with a reason."""
    broken = F.expr("from_xml(xml, '_broken string', map('ignoreNamespace', 'true', 'columnNameOfCorruptRecord', '_broken'))._broken")
    why = F.when(F.col("xml").isNull(), "no text").when(broken.isNotNull(), "not well-formed").when(~_root(F.col("xml")), "no definitions element around all")
    told = diagrams.select("graph", "xml", why.alias("reason"))
    return told.filter("reason IS NULL").drop("reason"), told.filter("reason IS NOT NULL")


def _attribute(name: str) -> Column:
    return F.replace(F.try_variant_get("value", f"$['@{name}']", "string"), F.lit(_MARK), F.lit(""))


def tree(diagrams: DataFrame) -> DataFrame:
    """graph, path, type, shown, inside, members, value: every element of readable diagrams, a level of all diagrams at a time.

    `inside` is the id of the nearest subProcess around it, `shown` elements belong to the drawing, `members` are attributes (with
    an @) and children by name. Text of nested elements isn't part of an element's text."""
    members = F.map_keys(F.try_variant_get("value", "$", "map<string, variant>")).alias("members")
    parsed = F.expr("from_xml(xml, 'variant', map('ignoreNamespace', 'true', 'attributePrefix', '@'))")
    root = checked(diagrams)[0].select("graph", _marked(F.col("xml")).alias("xml")).select("graph", parsed.alias("value"))
    level = settled(root.select("graph", F.lit("/definitions").alias("path"), F.lit("definitions").alias("type"), F.lit(False).alias("shown"), F.lit(None).cast("string").alias("inside"), members, "value"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        own = F.when(F.col("type") == "subProcess", _attribute("id")).otherwise(F.col("inside"))
        down = level.filter("members IS NOT NULL").select("graph", "path", "shown", own.alias("inside"), F.explode(F.try_variant_get("value", "$", "map<string, variant>")).alias("type", "v"))
        down = down.filter("NOT startswith(type, '@') AND type != '_VALUE'")
        each = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
        down = down.select("graph", "path", "shown", "inside", "type", F.posexplode(each).alias("k", "value"))
        path = F.format_string("%s/%s[%d]", "path", "type", F.col("k"))
        level = settled(down.select("graph", path.alias("path"), "type", (F.col("shown") | (F.col("type") == "BPMNDiagram")).alias("shown"), "inside", members, "value"))
    return reduce(DataFrame.unionByName, levels) if levels else level


def elements(diagrams: DataFrame) -> DataFrame:
    """graph, type, node, shown: every element of readable diagrams, with its id; `shown` ones belong to the drawing. For recovery and for kinds that aren't known."""
    return tree(diagrams).select("graph", "type", _attribute("id").alias("node"), "shown")


def recovery(diagrams: DataFrame) -> DataFrame:
    """graph, type, node: flow nodes anywhere in a diagram that `parsed` hasn't mapped, in diagrams where it has left some out."""
    mapped = parsed(checked(diagrams)[0])[0]
    found = elements(diagrams).filter(~F.col("shown") & F.col("type").isin(NODE_TYPES) & F.col("node").isNotNull())
    return found.select("graph", "type", "node").join(mapped.select("graph", "node"), ["graph", "node"], "left_anti")


def _all(kind: str, attribute: str):
    return F.expr(f"xpath(xml, '//*[local-name()=\"{kind}\"]/@{attribute}')")


def _text(path: str) -> Column:
    """Trimmed text of an element without children, or of one with its text in parts; null if there is none."""
    plain = lambda p: F.try_variant_get("value", p, "string")
    parts = F.array_join(F.try_variant_get("value", f"{path}._VALUE", "array<string>"), "")
    found = F.coalesce(parts, plain(f"{path}._VALUE"), plain(path))
    return F.nullif(F.regexp_replace(F.replace(found, F.lit(_MARK), F.lit("")), r"^\s+|\s+$", ""), F.lit(""))


def parsed(diagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (graph, node, type, name, default_flow, parent, loop) and edges (graph, flow, src, dst, condition) outside the drawing, at any depth.

    Nodes need an id, edges both ends. A node without a name is named by its id; an edge without a condition has its name as one."""
    rows = tree(diagrams).filter("NOT shown")
    named = lambda n: F.nullif(_attribute(n), F.lit(""))
    loop = F.coalesce(F.exists("members", lambda m: F.endswith(m, F.lit("LoopCharacteristics"))), F.lit(False))
    n = rows.filter(F.col("type").isin(NODE_TYPES)).select("graph", named("id").alias("node"), "type", F.coalesce(named("name"), named("id")).alias("name"), _attribute("default").alias("default_flow"), F.col("inside").alias("parent"), loop.alias("loop"))
    condition = F.coalesce(_text("$.conditionExpression"), _text("$.conditionExpression[0]"), _attribute("name"))
    e = rows.filter("type = 'sequenceFlow'").select("graph", _attribute("id").alias("flow"), named("sourceRef").alias("src"), named("targetRef").alias("dst"), condition.alias("condition"))
    return n.filter("node IS NOT NULL"), e.filter("src IS NOT NULL AND dst IS NOT NULL")


def census(diagrams: DataFrame) -> DataFrame:
    """type, n: independent of `parsed`, by constant XPaths."""
    counts = F.array(*[F.struct(F.lit(t).alias("type"), F.size(_all(t, "id")).cast("bigint").alias("n")) for t in NODE_TYPES])
    return diagrams.select(F.inline(counts)).groupBy("type").agg(F.sum("n").alias("n")).filter("n > 0")
