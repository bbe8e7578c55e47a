"""Build-matrix planner: JSON lines of evaluated jobs to grouped matrix rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: labels of the systems known without configuration
DEFAULT_RUNNERS = {
    "x86_64-linux": ["ubuntu-latest"],
    "aarch64-linux": ["ubuntu-24.04-arm"],
    "x86_64-darwin": ["macos-15-intel"],
    "aarch64-darwin": ["macos-latest"],
}
FIELDS = "attr string, drvPath string, system string, isCached boolean, error string, meta string"


class MatrixError(ValueError):
    """A job list that must not be planned in part."""


def runner_map(overrides: list[str]) -> dict[str, list[str]]:
    """Default labels with ``system=a,b`` overrides; bad specifications raise."""
    out = dict(DEFAULT_RUNNERS)
    for spec in overrides:
        system, eq, labels = spec.partition("=")
        named = [x.strip() for x in labels.split(",") if x.strip()]
        if not eq or not system.strip() or not named:
            raise MatrixError(f"bad runner specification {spec!r}")
        out[system.strip()] = named
    return out


def parse_labels(os: Column) -> Column:
    """An array of labels from JSON text that is a string or a list; else null."""
    as_list = F.filter(F.from_json(os, "array<string>"), lambda x: x.isNotNull())
    return F.when(os.rlike(r"^\s*\["), as_list).when(os.isNotNull() & (os != "") & ~os.rlike(r"^\s*[{]"), F.array(os))


def parse_jobs(lines: DataFrame, space: str = "build") -> DataFrame:
    """``lines`` (line_no, line) as jobs; blank lines are skipped. ``space`` is the member
    of a job's ``meta`` that holds our settings (os, group).

    ``problem`` says why a line cannot be planned: an evaluation error, or a line that is
    no JSON or lacks a field. :func:`check` turns problems into one error.
    """
    rows = lines.filter(F.trim("line") != "")
    j = rows.withColumn("j", F.from_json("line", FIELDS))
    label = F.get_json_object("line", f"$.meta.{space}.os")
    sound = F.get_json_object("line", "$").isNotNull()
    missing = F.when(F.col("j.drvPath").isNull(), "missing field drvPath").when(F.col("j.system").isNull(), "missing field system")
    problem = (
        F.when(~sound, "malformed")
        .when(F.col("j.error").isNotNull(), F.concat(F.coalesce("j.attr", F.lit("<unknown>")), F.lit(": "), F.col("j.error")))
        .otherwise(missing)
    )
    return j.select(
        "line_no", F.coalesce("j.attr", F.lit("<unknown>")).alias("attr"), F.col("j.drvPath").alias("drv_path"),
        F.col("j.system").alias("system"), F.coalesce("j.isCached", F.lit(False)).alias("is_cached"),
        parse_labels(label).alias("runner_override"), F.get_json_object("line", f"$.meta.{space}.group").alias("grp"),
        problem.alias("problem"),
    )


def check(jobs: DataFrame, most: int = 20) -> DataFrame:
    """``jobs`` if no line has a problem; else raises with the first of them."""
    bad = jobs.filter("problem is not null").orderBy("line_no").limit(most).collect()
    if bad:
        raise MatrixError("\n".join(r["problem"] for r in bad))
    return jobs.drop("problem")


def plan_rows(jobs: DataFrame, runners: dict[str, list[str]], prefix: str = "", skip_unmapped: bool = False) -> DataFrame:
    """One row per job to build, with labels; the first line of a recipe decides, also if
    that line is cached. ``unmapped`` marks systems without labels (skipped on request)."""
    spark = jobs.sparkSession
    first = Window.partitionBy("drv_path").orderBy("line_no")
    once = jobs.withColumn("_n", F.row_number().over(first)).filter("_n = 1 AND NOT is_cached").drop("_n")
    known = spark.createDataFrame(list(runners.items()), "system string, labels array<string>")
    rows = once.join(F.broadcast(known), "system", "left").withColumn("os", F.coalesce("runner_override", "labels"))
    dotted = F.col("attr") if not prefix else F.concat(F.lit(prefix.rstrip(".") + "."), F.col("attr"))
    if skip_unmapped:
        rows = rows.filter("os is not null")
    return rows.select(
        "line_no", dotted.alias("attr"), "drv_path", "system", "os", "grp", F.col("os").isNull().alias("unmapped")
    )


def checked_rows(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`plan_rows` if each can be built; else raises with the first that
    cannot: a system without labels, or a group of several systems or label lists."""
    lost = rows.filter("unmapped").orderBy("line_no").limit(1).collect()
    if lost:
        raise MatrixError(f"no runner for system {lost[0]['system']!r}")
    first = F.min_by(F.struct("system", "os"), "line_no")
    lead = rows.filter("grp is not null").groupBy("grp").agg(first.alias("f"))
    odd = (F.col("system") != F.col("f.system")) | (F.col("os") != F.col("f.os"))
    mixed = rows.join(lead, "grp").filter(odd).orderBy("line_no").limit(1).collect()
    if mixed:
        r = mixed[0]
        what = ("systems", r["f"]["system"], r["system"]) if r["system"] != r["f"]["system"] else ("runners", r["f"]["os"], r["os"])
        raise MatrixError(f"group {r['grp']!r} mixes {what[0]} {what[1]!r} and {what[2]!r}")
    return rows


def emit_outputs(values: DataFrame, path: str) -> None:
    """Appends ``values`` (name, value) as ``name=value`` lines, in order of name."""
    lines = values.orderBy("name").select(F.concat("name", F.lit("="), "value").alias("value"))
    lines.coalesce(1).write.mode("append").text(path)


def collapse_groups(rows: DataFrame) -> DataFrame:
    """Matrix rows: a group is one row in the place of its first member.

    ``mixed`` flags groups of several systems or label lists.
    """
    key = F.coalesce(F.concat(F.lit("g:"), F.col("grp")), F.concat(F.lit("j:"), F.col("line_no").cast("string")))
    lead = F.struct("attr", "drv_path", "system", "os", "grp")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "drv_path")))
    return (
        rows.groupBy(key.alias("_k"))
        .agg(
            F.min("line_no").alias("line_no"), F.min_by(lead, "line_no").alias("f"),
            F.array_join(F.transform(parts, lambda x: F.concat(x["drv_path"], F.lit("^*"))), " ").alias("installables"),
            ((F.count_distinct("system") > 1) | (F.count_distinct(F.array_join("os", ",")) > 1)).alias("mixed"),
        )
        .select("line_no", F.coalesce("f.grp", "f.attr").alias("name"), "f.attr", "f.drv_path", "f.system", "f.os", "installables", "mixed")
    )


def outputs(rows: DataFrame, version: int) -> DataFrame:
    """(name, value) of the three outputs; the matrix is JSON with rows in line order."""
    item = F.struct(
        "line_no",
        F.to_json(F.struct("attr", F.col("drv_path").alias("drvPath"), "installables", "name", "os", "system")).alias("j"),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]), ",")
    one = rows.agg(F.concat(F.lit('{"include":['), listed, F.lit("]}")).alias("m"), (F.count(F.lit(1)) > 0).cast("string").alias("a"))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    return one.select(
        F.explode(F.array(pair("matrix", F.col("m")), pair("any-jobs", F.col("a")), pair("manifest-version", F.lit(str(version))))).alias("o")
    ).select("o.*")


def registered_drvs(jobs: DataFrame) -> DataFrame:
    """Every recipe once, cached ones included."""
    return jobs.select("drv_path").distinct()
