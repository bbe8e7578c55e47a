"""Version-aware order of release tags as a sortable expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_key(tag: Column) -> Column:
    """A sort key: numeric segments compare as numbers, and a release outranks its
    prereleases. Array ordering is element by element, so the key sorts natively."""
    bare = F.regexp_replace(tag, r"^v", "")
    core = F.split_part(bare, F.lit("-"), F.lit(1))
    pre = F.regexp_extract(bare, r"^[^-]*-(.*)$", 1)

    def segment(x: Column) -> Column:
        number = F.when(x.rlike(r"^\d+$"), x.try_cast("bigint"))
        return F.struct(
            F.when(number.isNull(), 1).otherwise(0).alias("is_text"),
            F.coalesce(number, F.lit(0)).alias("number"),
            F.when(number.isNull(), x).otherwise("").alias("text"),
        )

    none = F.array().cast("array<struct<is_text:int,number:bigint,text:string>>")
    return F.struct(
        F.transform(F.split(core, r"\."), segment).alias("core"),
        (pre == "").alias("release"),
        F.when(pre == "", none).otherwise(F.transform(F.split(pre, r"\."), segment)).alias("pre"),
    )
