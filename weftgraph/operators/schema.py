"""Schemas as data: differences, merges, and batch checks of names with suggestions, as joins over catalog tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Farthest edit distance of a suggestion.
MOST_EDITS = 3


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, name, property, change) between two GraphCatalog.describe() tables: added, removed or retyped."""
    key = ["kind", "name", "property"]
    a = old.select(*[F.col(c).alias(f"a_{c}") for c in (*key, "type")], F.lit(1).alias("o"))
    b = new.select(*[F.col(c).alias(f"b_{c}") for c in (*key, "type")], F.lit(1).alias("n"))
    on = (F.col("a_kind") == F.col("b_kind")) & (F.col("a_name") == F.col("b_name")) & F.col("a_property").eqNullSafe(F.col("b_property"))
    retyped = ~F.col("a_type").eqNullSafe(F.col("b_type"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(retyped, "retyped")
    both = a.join(b, on, "full").withColumn("change", change).where("change IS NOT NULL")
    return both.select(*[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in key], "change")


def moved_ends(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old_source, old_target, new_source, new_target) of the relationship types whose ends differ."""
    ends = lambda d, p: d.where("kind = 'relationship'").select("name", F.col("source").alias(f"{p}_source"), F.col("target").alias(f"{p}_target")).distinct()
    both = ends(old, "old").join(ends(new, "new"), "name")
    return both.where("old_source != new_source OR old_target != new_target")


def described_from(spark: SparkSession, schema: dict | str) -> DataFrame:
    """GraphCatalog.describe()'s table of {"nodes": {label: [property]}, "relationships": {type: [source, target, [property]]}},
    as a dict or its JSON text; property types are not known there and null."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    rows = []
    for label, names in schema.get("nodes", {}).items():
        if not isinstance(names, (list, tuple)):
            raise ValueError(f"the properties of {label} are no list")
        rows += [("node", label, None, None, p, None) for p in names] or [("node", label, None, None, None, None)]
    for type_, (source, target, names) in schema.get("relationships", {}).items():
        rows += [("relationship", type_, source, target, p, None) for p in names] or [("relationship", type_, source, target, None, None)]
    return spark.createDataFrame(rows, "kind string, name string, source string, target string, property string, type string")


def schema_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of two descriptions; a type that both have keeps the first's ends and property types."""
    known = first.select(F.col("kind").alias("__k"), F.col("name").alias("__n"), F.coalesce("property", F.lit("")).alias("__p"))
    same = (F.col("kind") == F.col("__k")) & (F.col("name") == F.col("__n")) & (F.coalesce("property", F.lit("")) == F.col("__p"))
    new = second.join(known, same, "left_anti")
    ends = first.where("kind = 'relationship'").groupBy("name").agg(F.first("source").alias("__s"), F.first("target").alias("__t"))
    kept = new.join(ends, "name", "left")
    kept = kept.withColumns({"source": F.coalesce("__s", "source"), "target": F.coalesce("__t", "target")})
    return first.unionByName(kept.select(*first.columns))


def check_names(used: DataFrame, described: DataFrame) -> DataFrame:
    """(code, owner, name, suggestion) for the unknown names in used (kind, owner, name), in one pass for any number.

    kind is label, type, property (of the label or type in owner). Codes: E201 unknown label, E211 unknown type, E301 and
    E302 unknown property of a label and of a type; an unknown owner is not reported again for its properties. The
    suggestion is the nearest known name (edit distance without case up to MOST_EDITS, then by name), or null.
    """
    names = described.where("kind = 'node'").select(F.lit("label").alias("k"), F.lit("").alias("own"), F.col("name").alias("known")).distinct()
    types = described.where("kind = 'relationship'").select(F.lit("type").alias("k"), F.lit("").alias("own"), F.col("name").alias("known")).distinct()
    props = described.where("property IS NOT NULL").select(F.lit("property").alias("k"), F.col("name").alias("own"), F.col("property").alias("known"), F.col("kind").alias("of"))
    known = names.unionByName(types).withColumn("of", F.lit(None).cast("string")).unionByName(props)
    asked = used.distinct().select("kind", F.when(F.col("kind") == "property", F.col("owner")).otherwise("").alias("owner"), "name")
    met = asked.join(known, (F.col("kind") == F.col("k")) & (F.col("owner") == F.col("own")), "inner")
    edits = F.levenshtein(F.lower("name"), F.lower("known"))
    scored = met.withColumns({"edits": edits, "exact": F.col("name") == F.col("known")})
    per = scored.groupBy("kind", "owner", "name", "of").agg(
        F.bool_or("exact").alias("found"), F.min(F.when(F.col("edits") <= MOST_EDITS, F.struct("edits", "known"))).alias("best")
    )
    code = (
        F.when(F.col("kind") == "label", "E201").when(F.col("kind") == "type", "E211").when(F.col("of") == "node", "E301").otherwise("E302")
    )
    return per.where("NOT found").select(code.alias("code"), "owner", "name", F.col("best.known").alias("suggestion"))


def violations_unique(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The key values that occur more than once, with their count; nulls are no values."""
    rows = nodes.dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations_present(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(property, missing): how many nodes lack each property that must be there."""
    counts = nodes.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "property", "missing")


def dangling(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Relationships (src, dst) of which an end does not exist; sources and targets have a column id."""
    no_src = edges.join(sources.select(F.col("id").alias("src")), "src", "left_anti")
    no_dst = edges.join(targets.select(F.col("id").alias("dst")), "dst", "left_anti")
    return no_src.select("src", "dst").unionByName(no_dst.select("src", "dst")).distinct()


def property_fill(nodes: DataFrame) -> DataFrame:
    """(property, filled): how many nodes have each property."""
    return nodes.agg(*[F.count(c).alias(c) for c in nodes.columns]).unpivot([], nodes.columns, "property", "filled")


def ddl(described: DataFrame) -> DataFrame:
    """(name, statement): an index statement for each property that is no vector."""
    rows = described.where("kind = 'node' AND property IS NOT NULL AND type NOT LIKE 'array<%' AND property NOT LIKE '%embedding'")
    text = F.format_string("CREATE INDEX idx_%s_%s IF NOT EXISTS FOR (n:%s) ON (n.%s)", F.lower("name"), "property", "name", "property")
    return rows.select("name", text.alias("statement"))
