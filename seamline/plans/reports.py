"""The data behind report pages: result tables of differing headers as one table, best rows, comparisons, marked cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import signed

#: What a table may call its settings, in order of preference; how far a cell may lie from the best. Fixed values.
SETTING_NAMES = ["Setting", "Model", "Method", "Representation", "Rule", "Window Size", "Min-distance"]
EQUAL = 1e-12
#: A result file's name: experiment family, what it holds, and the truth's protocol, if it names one.
_NAME = r"exp([A-Z]\d?)_(.+?)(?:_(coarse|fine))?\.csv$"


def read_tables(spark: SparkSession, *paths: str, most_columns: int = 64) -> DataFrame:
    """Rows of CSV files with headers of their own: file, family, table, protocol (null if the name has none), row (from
    0), header (names in order), cells (by name; a short row lacks its last ones, which are null).

    One scan whatever the headers. Of files of one name the one that lies least deep counts, so a folder of snapshots
    stands in only for what is missing above it. Cells stay text. A file of only a header, or none, gives no rows.
    """
    names = [f"c{i}" for i in range(most_columns)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in names)).option("recursiveFileLookup", True).option("multiLine", True).option("escape", '"').csv(list(paths))
    path = F.regexp_replace("_metadata.file_path", r"/part-[^/]*$", "")
    # a multi-line file is one task's, which numbers its rows in order
    rows = raw.select(path.alias("path"), F.monotonically_increasing_id().alias("_id"), F.array(*names).alias("_cells"))
    order = Window.partitionBy("path").orderBy("_id")
    rows = rows.select("path", (F.row_number().over(order) - 2).cast("int").alias("row"), F.first("_cells").over(order).alias("_head"), "_cells").where("row >= 0")
    head = F.filter("_head", lambda h: h.isNotNull())
    rows = rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.size(F.split("path", "/")).alias("_depth"), "row", head.alias("header"), F.slice("_cells", F.lit(1), F.size(head)).alias("_cells"))
    least = Window.partitionBy("file")
    rows = rows.withColumn("_least", F.min(F.struct("_depth", "path")).over(least)["path"]).where(F.col("path") == F.col("_least"))
    part = lambda k: F.nullif(F.regexp_extract("file", _NAME, k), F.lit(""))
    return rows.select("file", part(1).alias("family"), part(2).alias("table"), part(3).alias("protocol"), "row", "header", F.map_from_arrays("header", "_cells").alias("cells"))


def number(cell: Column) -> Column:
    """A cell as a number; null if it isn't one, or not a number at all."""
    v = F.trim(cell).try_cast("double")
    return F.when(~F.isnan(v), v)


def best_rows(tables: DataFrame, key: str = "F1") -> DataFrame:
    """family, table, protocol, setting, best: the row of each table with the greatest key, the first of equals; cells
    that are no numbers are passed over. A table without a number has no row."""
    value = number(F.try_element_at("cells", F.lit(key)))
    setting = F.coalesce(*(F.try_element_at("cells", F.lit(n)) for n in SETTING_NAMES), F.lit("-"))
    rows = tables.select("family", "table", "protocol", value.alias("best"), F.struct(value, -F.col("row")).alias("_by"), setting.alias("setting")).where("best is not null")
    found = rows.groupBy("family", "table", "protocol").agg(F.max_by(F.struct("setting", "best"), "_by").alias("_b"))
    return found.select("family", "table", "protocol", "_b.setting", "_b.best")


def compare_protocols(best: DataFrame, one: str = "coarse", other: str = "fine") -> DataFrame:
    """family, table, and each protocol's best setting and value side by side, with the difference (other - one): as a
    number, and to four digits with its sign (``-`` where a side is missing), and whether it is a gain."""
    side = lambda p: best.where(F.col("protocol") == p).select("family", "table", F.col("setting").alias(f"{p}_setting"), F.col("best").alias(f"{p}_best"))
    both = side(one).join(side(other), ["family", "table"], "full")
    delta = F.col(f"{other}_best") - F.col(f"{one}_best")
    shown = F.when(delta.isNull(), "-").otherwise(signed(delta))
    return both.select("*", delta.alias("delta"), shown.alias("shown"), F.coalesce(delta > 0, F.lit(False)).alias("gain"))


def marked_cells(tables: DataFrame, key: str = "F1") -> DataFrame:
    """A row for each cell: file, family, table, protocol, row, position, column, value, best (whether it is in the
    key's column and within EQUAL of the table's greatest)."""
    cell = F.posexplode("header").alias("position", "column")
    cells = tables.select("file", "family", "table", "protocol", "row", "cells", cell)
    cells = cells.select("file", "family", "table", "protocol", "row", "position", "column", F.element_at("cells", F.col("column")).alias("value"))
    mine = F.when(F.col("column") == key, number(F.col("value")))
    top = F.max(mine).over(Window.partitionBy("file"))
    return cells.withColumn("best", F.coalesce(F.abs(mine - top) < EQUAL, F.lit(False)))


def headlines(best: DataFrame, families: list[str]) -> DataFrame:
    """place, family, line: the best of each family in the order given, or that there is no data."""
    every = best.sparkSession.createDataFrame(list(enumerate(families)), "place int, family string")
    line = F.when(F.col("best").isNull(), F.concat("family", F.lit(": no data"))).otherwise(F.concat("family", F.lit(" best: "), "setting", F.lit(" (F1="), F.col("best").cast("string"), F.lit(")")))
    return every.join(best.select("family", "setting", "best"), "family", "left").select("place", "family", line.alias("line"))


def reference_deltas(rows: DataFrame, reference: float, seq: str = "lecture_id") -> DataFrame:
    """setting, seq, f1, reference, delta: each sequence's f1 over a reference, to four digits."""
    return rows.select("setting", seq, "f1", F.lit(reference).alias("reference"), F.round(F.col("f1") - F.lit(reference), 4).alias("delta"))
