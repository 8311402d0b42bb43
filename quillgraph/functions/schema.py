"""JSON schemas of tools cut down to what a function's declaration may hold.

A schema is a tree, and trees are rewritten level by level: a node is a row with its object as a map of variants; its properties and items are the rows of the next level; the texts of children are joined to their parents from the lowest level up. All of it is built-in expressions
and joins on (tool, path); the number of levels is that of the deepest schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys that stay, in the order in which they are written.
KEYS = ("type", "description", "properties", "items", "required", "enum", "default")
MOST_LEVELS = 64


def _object(v: Column) -> Column:
    """A variant as a map, null where it is no object."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v.try_cast("map<string,variant>"))


def _list(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), v.try_cast("array<variant>"))


def _collapsed(m: Column) -> Column:
    """anyOf, or else oneOf, as its first branch that isn't null, with what stands outside of it where the branch has none of its own."""
    real = lambda k: F.get(F.filter(_list(m[k]), lambda o: F.schema_of_variant(o).startswith("OBJECT") & (F.coalesce(F.try_variant_get(o, "$.type", "string"), F.lit("")) != "null")), F.lit(0))
    branch = _object(F.coalesce(real("anyOf"), real("oneOf")))
    outside = F.map_filter(m, lambda k, _: ~k.isin("anyOf", "oneOf") & ~F.coalesce(F.map_contains_key(branch, k), F.lit(False)))
    return F.when(branch.isNull(), m).otherwise(F.map_concat(branch, outside))


def _quoted(s: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(s)), r"(?s)^\[|\]$", "")


def clean_schemas(tools: DataFrame, key: str = "name", schema: str = "schema") -> DataFrame:
    """key and schema (JSON text) of each tool (keys differ) with only KEYS in every node, unions collapsed, null defaults left out, required as texts; nodes without a type are objects if they have properties, else strings, and so is what is no object. Properties come by name. A text that is no JSON is a string."""
    level = tools.select(F.col(key).alias("k"), F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(schema)).alias("v"))
    levels = []
    while len(levels) < MOST_LEVELS:
        level = level.select("k", "path", _object(F.col("v")).alias("m")).select("k", "path", F.when(F.col("m").isNotNull(), _collapsed(F.col("m"))).alias("m"))
        levels.append(level)
        kids = F.concat(
            F.coalesce(F.transform(F.map_entries(_object(F.col("m")["properties"])), lambda e: F.struct(F.concat(F.lit("p"), e["key"]).alias("step"), e["value"].alias("v"))), F.array().cast("array<struct<step:string,v:variant>>")),
            F.when(F.map_contains_key("m", F.lit("items")), F.array(F.struct(F.lit("i").alias("step"), F.col("m")["items"].alias("v")))).otherwise(F.array().cast("array<struct<step:string,v:variant>>")),
        )
        level = level.where("m is not null").select("k", "path", F.explode(kids).alias("c")).select("k", F.concat("path", F.array("c.step")).alias("path"), F.col("c.v").alias("v"))
        if level.isEmpty():
            break
    below = None
    for nodes in reversed(levels):
        if below is None:
            nodes = nodes.withColumns({"props": F.lit(None).cast("string"), "items": F.lit(None).cast("string")})
        else:
            step = F.element_at("path", -1)
            one = F.when(step.startswith("p"), F.struct(F.substring(step, 2, 1 << 20).alias("n"), "text"))
            up = below.select("k", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), one.alias("p"), F.when(step == "i", F.col("text")).alias("i"))
            up = up.groupBy("k", "path").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.max("i").alias("items"))  # a node's own properties
            props = F.when(F.size("ps") > 0, F.concat(F.lit("{"), F.array_join(F.transform("ps", lambda x: F.concat(_quoted(x["n"]), F.lit(":"), x["text"])), ","), F.lit("}")))
            nodes = nodes.join(up.select("k", "path", props.alias("props"), "items"), ["k", "path"], "left")
        m, absent = F.col("m"), F.lit(None).cast("string")
        has = lambda k: F.coalesce(F.map_contains_key("m", F.lit(k)), F.lit(False))
        raw = lambda k: F.when(has(k), F.to_json(m[k]))
        is_object = F.coalesce(F.try_variant_get(m["type"], "$", "string") == "object", F.lit(False))
        # Properties that are no object stay as they are; an object without any has none.
        props = F.when(has("properties"), F.coalesce(F.col("props"), F.when(_object(m["properties"]).isNotNull(), "{}"), raw("properties"))).when(is_object, "{}")
        required = F.when(_list(m["required"]).isNotNull(), F.to_json(F.transform(_list(m["required"]), lambda v: v.cast("string")))).otherwise(raw("required"))
        default = F.when(has("default") & ~F.coalesce(F.is_variant_null(m["default"]), F.lit(True)), F.to_json(m["default"]))
        kind = F.when(has("type"), raw("type")).when(props.isNotNull(), '"object"').otherwise('"string"')
        fields = {"type": kind, "description": raw("description"), "properties": props, "items": F.when(has("items"), F.col("items")), "required": required, "enum": raw("enum"), "default": default}
        text = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), F.coalesce(fields[n], absent)) for n in KEYS)), F.lit("}"))
        below = nodes.select("k", "path", F.when(m.isNull(), '{"type":"string"}').otherwise(text).alias("text"))
    return below.select(F.col("k").alias(key), F.col("text").alias(schema))
