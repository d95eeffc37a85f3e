"""Object operators: filter specifications, disk use, pack geometry."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def object_filter(spec: str) -> Column:
    """A condition over (type, size, depth): blob:none, blob:limit=n[kmg], tree:depth, object:type=t, combine:a+b."""
    if spec.startswith("combine:"):
        out = F.lit(True)
        for part in spec[len("combine:") :].split("+"):
            out = out & object_filter(urllib.parse.unquote(part))
        return out
    if spec == "blob:none":
        return F.col("type") != "blob"
    if m := re.fullmatch(r"blob:limit=(\d+)([kmg]?)", spec):
        return (F.col("type") != "blob") | (F.col("size") < int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2]])
    if m := re.fullmatch(r"tree:(\d+)", spec):
        return (~F.col("type").isin("tree", "blob")) | (F.col("depth") < int(m[1]))
    if m := re.fullmatch(r"object:type=(blob|tree|commit|tag)", spec):
        return F.col("type") == m[1]
    raise ValueError(f"unknown filter: {spec}")


def disk_usage(tips: DataFrame, reach: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tip, n, bytes): each object that a tip reaches, once."""
    return tips.join(reach, "tip").join(sizes, "oid").groupBy("tip").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def geometry_split(packs: DataFrame, by: list[str], factor: int = 2) -> DataFrame:
    """(by…, n_rolled, weight): how many of the lightest packs are rolled up so that the rest grow by `factor`.

    packs has (by…, pack, weight).  From light to heavy, the last pack that is lighter than factor times all before it, and all before it, roll up.
    """
    order = Window.partitionBy(*by).orderBy("weight", "pack")
    rows = packs.withColumn("k", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bad = rows.withColumn("last", F.max(F.when(F.col("weight") < factor * F.col("before"), F.col("k"))).over(Window.partitionBy(*by)))
    rolled = F.col("k") <= F.coalesce("last", F.lit(0))
    return bad.groupBy(*by).agg(F.count_if(rolled).alias("n_rolled"), F.coalesce(F.sum(F.when(rolled, F.col("weight"))), F.lit(0)).alias("weight"))
