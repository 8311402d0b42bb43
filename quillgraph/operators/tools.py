"""Registries of tools and servers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def registry(tools: DataFrame, name: str = "name", order: str = "ord", only: DataFrame | None = None) -> DataFrame:
    """The first tool of each name; with only (column name), those named there."""
    first = tools.withColumn("k_", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("k_ = 1").drop("k_")
    return first if only is None else first.join(only.select(name).distinct(), name, "left_semi")


def described(tools: DataFrame, overrides: DataFrame) -> DataFrame:
    """tools with the description that overrides has for them, else their own."""
    o = overrides.select("name", F.nullif(F.trim("description"), F.lit("")).alias("o_"))
    return tools.join(o, "name", "left").withColumn("description", F.coalesce("o_", "description")).drop("o_")


def override(overrides: DataFrame, name: str, description: str | None) -> DataFrame:
    """overrides with a tool's description set, or cleared where it is blank."""
    rest = overrides.where(F.col("name") != name).select("name", "description")
    if not (description or "").strip():
        return rest
    return rest.unionByName(overrides.sparkSession.createDataFrame([(name, description.strip())], "name string, description string"))


def catalog(base: DataFrame, custom: DataFrame, connected: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Servers (name, label, spec) with custom, connected and, given tools (source), n_tools: a custom entry takes the place of a base one."""
    both = base.select("name", "label", "spec", F.lit(False).alias("custom")).unionByName(custom.select("name", "label", "spec", F.lit(True).alias("custom")))
    one = both.groupBy("name").agg(F.max_by(F.struct("label", "spec", "custom"), "custom").alias("s")).select("name", "s.*")
    out = one.join(connected.select("name", F.lit(True).alias("connected")).distinct(), "name", "left").withColumn("connected", F.coalesce("connected", F.lit(False)))
    if tools is not None:
        out = out.join(tools.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n_tools")), "name", "left").withColumn("n_tools", F.coalesce("n_tools", F.lit(0)))
    return out


def configuration(servers: DataFrame) -> DataFrame:
    """name and spec of the connected servers."""
    return servers.where("connected").select("name", "spec")


def of_role(tools: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """The tools that a role (role, name) may use."""
    return registry(tools, only=roles.where(F.col("role") == role))


def loop_totals(steps: DataFrame, key: str = "run_id") -> DataFrame:
    """For each run: steps, tokens, and its distinct searches in the order they were first made. steps: seq, tokens, search (null for other steps)."""
    searches = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("search").isNotNull(), F.struct("seq", "search")))), lambda x: x["search"]))  # a run's own steps, ten at most
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("steps"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), searches.alias("searches"))
