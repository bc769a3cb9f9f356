"""CSV entities: cleaning scan, load stamp, cleaned copy, report export."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk import model
from souk.functions.scalar import clean
from souk.model import Entity
from souk.session import work_folder


MARK = "\ufeff"  # byte-order mark
# A field after its comma: quoted, quotes inside doubled, or up to the next comma. Nothing is given back, so a long
# field costs no stack.
FIELD = r',(?:[ \t]*"[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with the byte range of the file they begin in, numbered in it. A large file has many ranges."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("value"))


def _odd(value: Column) -> Column:
    """Has the line an odd number of quotes: it ends inside a quoted field if it began outside, and the other way."""
    return (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1


def fields_of(record: Column) -> Column:
    """Cleaned fields of a record, without their quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.ltrim(record, F.lit(MARK))), F.lit(FIELD), F.lit(0))

    def plain(field: Column) -> Column:
        bare = clean(F.substr(field, F.lit(2)))
        quoted = (F.length(bare) > 1) & bare.startswith('"') & bare.endswith('"')
        inner = F.replace(F.substr(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
        return F.when(quoted, clean(inner)).otherwise(bare)
    return F.transform(found, plain)


def _ranges(lines: DataFrame) -> DataFrame:
    """A row per byte range: does it begin inside quotes, do records cross its lines, the file's header.

    The numbers of odd lines before a range tell how it begins. `opener` is the range in which the record began that
    is open at its begin. The header is the first line of the file that holds anything.
    """
    spark = lines.sparkSession
    holds = F.when(F.regexp_like("value", F.lit(r"[^\s,\x{FEFF}]")), F.col("line"))
    counted = lines.groupBy("file", "start").agg(
        F.count(F.when(_odd(F.col("value")), 1)).alias("odd"), F.min_by("value", holds).alias("head"))
    place = f"{work_folder(spark)}/csv/{uuid4().hex}"  # as many rows as there are ranges
    counted.write.parquet(place)
    counted = spark.read.schema(counted.schema).parquet(place)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begun = counted.select("*", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"),
                           (F.sum("odd").over(whole) % 2 == 1).alias("open_at_end"),
                           F.first("head", True).over(whole).alias("header"))
    ends_inside = F.col("inside") != (F.col("odd") % 2 == 1)
    opens = F.when(ends_inside & (F.col("odd") > 0), F.col("start"))
    return begun.select(
        "file", "start", "inside", ends_inside.alias("ends_inside"), (~F.col("inside") & (F.col("odd") == 0)).alias("simple"),
        "open_at_end", F.last(opens, True).over(before).alias("opener"), fields_of(F.col("header")).alias("names"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files: file, names (of its header), fields. Empty records are left out.

    Ranges whose lines are records are read as they are. In the others a running count of odd lines finds where
    records begin, each range by itself; lines of one record are put together, across ranges too.
    """
    lines = _lines(spark, path)
    met = lines.join(_ranges(lines), ["file", "start"])
    unbalanced = F.raise_error(F.concat(F.lit("a quoted field does not end in "), F.col("file"))).cast("string")
    met = met.withColumn("value", F.when(F.col("open_at_end"), unbalanced).otherwise(F.col("value")))
    simple = met.filter("simple").select("file", "names", "value")
    so_far = Window.partitionBy("file", "start").orderBy("line")
    odd = _odd(F.col("value")).cast("int")
    begins = (F.sum(odd).over(so_far) - odd + F.col("inside").cast("int")) % 2 == 0
    met = met.filter(~F.col("simple")).withColumn("begins", begins)
    alone = F.col("begins") & ~_odd(F.col("value"))
    number = F.sum(F.col("begins").cast("int")).over(so_far)
    of_all = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file", "start"))
    met = met.withColumns({"alone": alone, "number": number, "of_all": of_all})
    crosses = F.col("ends_inside") & (F.col("number") == F.col("of_all"))
    parts = met.filter(~F.col("alone")).select(
        "file", "names", "start", "line", "value",
        F.when(F.col("number") == 0, F.col("opener")).otherwise(F.col("start")).alias("began"),
        F.when((F.col("number") == 0) | crosses, -1).otherwise(F.col("number")).alias("number"))
    in_order = F.array_sort(F.collect_list(F.struct("start", "line", "value")))
    joined = parts.groupBy("file", "began", "number").agg(
        F.first("names").alias("names"), F.array_join(F.transform(in_order, lambda x: x["value"]), "\n").alias("value"))
    records = (simple.unionByName(met.filter("alone").select("file", "names", "value"))
               .unionByName(joined.select("file", "names", "value")))
    records = records.select("file", "names", fields_of(F.col("value")).alias("fields"))
    return records.filter(F.exists("fields", lambda c: c != ""))


def _is_header(entity: Entity) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains("fields", n) for n in entity.columns])


def read_entity(spark: SparkSession, path: str, entity: Entity) -> DataFrame:
    """A CSV entity as cleaned text columns, taken by the names in each file's own header.

    Columns may come in any order, any number of further ones is left out, and a row in a file whose header
    lacks a column raises an error. Byte-order mark, padding around headers and fields and
    all-empty rows (also before the header) are removed; quoted fields may hold line ends. A
    row with fewer fields than its header has NULL for the others, and of one with more the surplus
    is left out; `ragged_rows` counts both. A large file is read by many tasks, wherever its quoted fields
    lie: one pass finds how each byte range begins, a second reads the records. Quotes belong around
    fields; a file in which one does not end raises an error.
    """
    rows = _records(spark, path).filter(~_is_header(entity))
    lacking = F.raise_error(F.concat(F.lit(f"no header with all columns of {entity.name} in "), F.col("file")))
    read = {}
    for n in entity.columns:
        at = F.array_position("names", n).cast("int")
        read[n] = F.when(F.coalesce(at, F.lit(0)) == 0, lacking.cast("string")).otherwise(
            F.nullif(F.get("fields", at - 1), F.lit("")))
    named = rows.select(*(read[n].alias(n) for n in entity.columns))
    present = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in entity.columns])
    return named.filter(present)


def ragged_rows(spark: SparkSession, path: str, entity: Entity) -> DataFrame:
    """(file, rows, ragged): how many rows have fewer or more fields than their file's header."""
    rows = _records(spark, path).filter(~_is_header(entity))
    ragged = F.size("fields") != F.size("names")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(ragged, 1)).alias("ragged"))


def with_load_stamp(df: DataFrame, loaded_at: datetime) -> DataFrame:
    """The same load time on every row (a literal, so a recomputed plan keeps it)."""
    return df.withColumn(model.LOAD_STAMP, F.lit(loaded_at).cast("timestamp_ntz").cast("timestamp"))


def write_cleaned(df: DataFrame, path: str) -> None:
    """Cleaned CSV copy, one part file per partition, each with a header."""
    (df.write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").csv(path))


def export_report(report: DataFrame, path: str) -> None:
    """A finished report (already aggregated) as a single CSV file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
