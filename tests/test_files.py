from __future__ import annotations

import random
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shop import rows, shop
from souk import model
from souk.model import MARTS
from souk.operators import profile
from souk.plans import reports
from souk.sources import tables, text
from souk.sources.seeds import read_seed


def test_messy_csv_is_cleaned(spark, tmp_path):
    lines = ['', ',,', ' product_category_name , product_category_name_english ',
             ' beleza_saude ,\thealth_beauty ', ' , ', '', 'cama,"bed, bath"', ',only_english']
    (tmp_path / "t.csv").write_bytes("﻿".encode() + "\r\n".join(lines).encode())
    got = rows(text.read_entity(spark, str(tmp_path / "t.csv"),
                                model.ENTITIES["product_category_name_translation"]))
    assert [tuple(r.values()) for r in got] == [
        ("beleza_saude", "health_beauty"), ("cama", "bed, bath"), (None, "only_english")]


def test_header_after_byte_order_mark_is_no_row(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿product_category_name,product_category_name_english\r\nx,y\r\n".encode())
    (tmp_path / "b.csv").write_bytes(b"product_category_name,product_category_name_english\nu,v\n")
    got = rows(text.read_entity(spark, str(tmp_path), model.ENTITIES["product_category_name_translation"]))
    assert [r["product_category_name"] for r in got] == ["u", "x"]


def test_review_text_keeps_quotes_and_line_ends(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('review_id,order_id,review_score,review_comment_title,review_comment_message,'
                    'review_creation_date,review_answer_timestamp\n'
                    'r1,o1,5,,"said ""good""\nand, again ",2018-01-01 00:00:00,\n', encoding="utf-8")
    (r,) = rows(text.read_entity(spark, str(path), model.ENTITIES["order_reviews"]))
    assert r["review_comment_message"] == 'said "good"\nand, again'
    assert r["review_comment_title"] is None and r["review_score"] == "5"


def test_columns_are_taken_by_name(spark, tmp_path):
    sellers = model.ENTITIES["sellers"]
    (tmp_path / "a.csv").write_text(
        "seller_id,seller_city,extra,seller_state,seller_zip_code_prefix\ns1,\"two\nlines\",x,SP,01\n")
    (tmp_path / "b.csv").write_text(
        "seller_state , seller_zip_code_prefix,seller_id,seller_city\nRJ,02,s2,town\nBA,03,s3\nRS,04,s4,a,b,c\n")
    got = {r["seller_id"]: tuple(r.values()) for r in rows(text.read_entity(spark, str(tmp_path), sellers))}
    assert got == {"s1": ("s1", "01", "two\nlines", "SP"), "s2": ("s2", "02", "town", "RJ"),
                   "s3": ("s3", "03", None, "BA"), "s4": ("s4", "04", "a", "RS")}
    counted = {r["file"][-5:]: (r["rows"], r["ragged"])
               for r in text.ragged_rows(spark, str(tmp_path), sellers).collect()}
    assert counted == {"a.csv": (1, 0), "b.csv": (3, 2)}
    (tmp_path / "c.csv").write_text("seller_id,seller_city\ns9,x\n")
    with pytest.raises(Exception, match="no header with all columns"):
        text.read_entity(spark, str(tmp_path), sellers).collect()


def _csv_line(fields):
    quoted = ['"' + f.replace('"', '""') + '"' if any(c in f for c in '",\n') else f for f in fields]
    return ",".join(quoted)


@pytest.mark.parametrize("split", [64, 257, 1 << 20])
def test_quoted_line_ends_across_byte_ranges(spark, tmp_path, split):
    """One file in many ranges: records and quoted fields lie across the cuts, some longer than several ranges."""
    rng = random.Random(split)
    words = ["a", "line\nend", 'said ""', ",", "\n\n", '"', "é", "x" * 30, "long\n" * 60]
    data = [[f"s{i}", "".join(rng.choice(words[:-1] if i % 25 else words) for _ in range(rng.randint(0, 4))), "SP", str(i)]
            for i in range(150)]
    lines = [_csv_line(["seller_id", "seller_city", "seller_state", "seller_zip_code_prefix", *(f"more{i}" for i in range(40))])]
    lines += [_csv_line([*r, *["y"] * 40]) for r in data]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "small.csv").write_text("seller_state,seller_city,seller_id,seller_zip_code_prefix\nRJ,plain,t1,1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        sellers = model.ENTITIES["sellers"]
        ranges = text._lines(spark, str(tmp_path)).select("file", "start").distinct().count()
        assert ranges > (20 if split < 1000 else 1)
        got = {r["seller_id"]: (r["seller_city"], r["seller_state"], r["seller_zip_code_prefix"])
               for r in text.read_entity(spark, str(tmp_path), sellers).collect()}
        counted = {r["file"].rpartition("/")[2]: (r["rows"], r["ragged"]) for r in text.ragged_rows(spark, str(tmp_path), sellers).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {r[0]: (r[1].strip() or None, r[2], r[3]) for r in data} | {"t1": ("plain", "RJ", "1")}
    assert counted == {"big.csv": (150, 0), "small.csv": (1, 0)}


def test_a_quoted_field_without_end_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('seller_id,seller_city,seller_state,seller_zip_code_prefix\ns1,"town,SP,1\ns2,x,SP,1\n')
    with pytest.raises(Exception, match="a quoted field does not end in"):
        text.read_entity(spark, str(tmp_path), model.ENTITIES["sellers"]).collect()


def test_very_long_fields(spark, tmp_path):
    long = 'text with "quotes", commas\n' * 20_000
    (tmp_path / "a.csv").write_text("product_category_name,product_category_name_english\n" + _csv_line([long, "x"]) + "\n" + "y" * 300_000 + ",z\n")
    got = rows(text.read_entity(spark, str(tmp_path), model.ENTITIES["product_category_name_translation"]))
    assert [r["product_category_name"] for r in got] == [long.strip(), "y" * 300_000]


def test_cleaned_copy_reads_back(spark, tmp_path):
    entity = model.ENTITIES["sellers"]
    source = spark.createDataFrame([("s1", "01", 'x "y", z', "SP"), ("s2", None, "", "RJ")], entity.schema)
    text.write_cleaned(source, str(tmp_path / "out"))
    got = rows(text.read_entity(spark, str(tmp_path / "out"), entity))
    assert [r["seller_city"] for r in got] == ['x "y", z', None]


def test_load_stamp_is_one_literal(spark):
    at = datetime(2024, 5, 1, 6, 30)
    df = text.with_load_stamp(spark.range(5).repartition(3), at)
    assert {r[model.LOAD_STAMP] for r in df.collect()} == {at}


def test_seed_from_file_and_built_in(spark, tmp_path):
    text.export_report(read_seed(spark), str(tmp_path / "seed"))
    assert rows(read_seed(spark, str(tmp_path / "seed"))) == rows(read_seed(spark))
    assert read_seed(spark).count() == 27


def test_binding_takes_paths_and_catalogue_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    spark.range(4).createOrReplaceTempView("bound_view")
    places = {"a": str(tmp_path / "p"), "b": "bound_view"}
    assert tables.bind(spark, places, "a").count() == 3
    assert tables.bind(spark, places, "b").count() == 4
    with pytest.raises(KeyError):
        tables.bind(spark, places, "c")


def test_mart_files_are_partitioned_and_sorted(spark, raw, tmp_path):
    path = tmp_path / "fact"
    tables.write_mart(shop(spark, raw)["fact_sales"], str(path), MARTS["fact_sales"], "day")
    days = sorted(p.name for p in path.glob("_version=*/period=*"))
    assert days[0] == "period=2017-01-10" and len(days) == 6
    for file in path.glob("_version=*/period=*/*.parquet"):
        keys = pq.read_table(file, columns=["order_key"]).column(0).to_pylist()
        assert keys == sorted(keys)
    assert tables.read_mart(spark, str(path)).filter("period = '2017-01-31'").count() == 2


def test_report_export_is_one_file_with_header(spark, raw, tmp_path):
    report = reports.top_products_categories(shop(spark, raw))
    text.export_report(report, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("part-*")
    lines = file.read_text().splitlines()
    assert lines[0].startswith("category,unique_products") and len(lines) == 1 + report.count()


def test_table_info_and_validation(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "dim_a"))
    spark.range(0).write.parquet(str(tmp_path / "fact_b"))
    frames = {n: spark.read.parquet(str(tmp_path / n)) for n in ("fact_b", "dim_a")}
    info = tables.table_info(frames).collect()
    assert [(r["table_id"], r["row_count"]) for r in info] == [("dim_a", 10), ("fact_b", 0)]
    assert info[0]["size_bytes"] == sum(p.stat().st_size for p in (tmp_path / "dim_a").glob("*.parquet"))
    assert info[0]["created"] <= info[0]["last_modified"]
    assert rows(tables.validate_tables(frames)) == [
        {"table_name": "dim_a", "has_rows": True}, {"table_name": "fact_b", "has_rows": False}]


def test_existence_and_name_match(spark):
    spark.range(1).createOrReplaceTempView("dim_x")
    spark.range(1).createOrReplaceTempView("fact_x")
    spark.range(1).createOrReplaceTempView("other")
    assert tables.table_exists(spark, "dim_x") and not tables.table_exists(spark, "dim_missing")
    names = [t.name for t in spark.catalog.listTables()]
    assert tables.count_mart_tables(spark).first()[0] == sum(n.startswith(("dim_", "fact_")) for n in names)
    assert tables.count_mart_tables(spark, ["dimension", "dim_a", "fact"]).first()[0] == 2


def test_profile_of_a_sample(spark):
    df = spark.createDataFrame([(i, i / 2, "ab"[i % 2], str(i)) for i in range(100)], "n int, x double, s string, id string")
    got = {r["column_name"]: r for r in profile.numeric_profile(profile.sample_rows(df, 100, ["n"])).collect()}
    assert (got["n"]["count"], got["n"]["q25"], got["n"]["q50"], got["n"]["max"]) == (100, 24.75, 49.5, 99)
    assert {r["column_name"] for r in profile.value_counts(df).collect()} == {"s"}
    assert {r["column_name"]: r["distinct_values"] for r in profile.distinct_counts(df).collect()} == {"s": 2, "id": 100}
    assert [r["column_name"] for r in profile.distinct_counts(df, first=1).collect()] == ["s"]
    wide = df.select("s", "id", *(F.lit("x").alias(f"t{i}") for i in range(4)))
    assert profile.distinct_counts(wide).count() == 6
    with pytest.raises(ValueError):
        profile.sample_rows(df, 1000)


def test_quantiles_are_exact_with_hot_values_and_nulls(spark):
    values = [5.0] * 400 + [float(i % 97) for i in range(300)] + [None] * 20
    df = spark.createDataFrame([(v, 1) for v in values], "x double, one int").withColumn("none", F.lit(None).cast("int"))
    got = {(r["column_name"], r["q"]): r["quantile"] for r in profile.quantiles(df, ["x", "one", "none"], (0.1, 0.5, 0.9)).collect()}
    numbers = sorted(v for v in values if v is not None)
    for q in (0.1, 0.5, 0.9):
        at = q * (len(numbers) - 1)
        low, high = numbers[int(at)], numbers[min(int(at) + 1, len(numbers) - 1)]
        assert abs(got[("x", q)] - (low + (high - low) * (at - int(at)))) < 1e-9 and got[("one", q)] == 1
    assert not any(c == "none" for c, _ in got)


def test_sizes_follow_the_data():
    from souk.session import settings_for
    small, large = settings_for(10**9, 8), settings_for(100 * 10**12, 4000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert small["spark.sql.files.maxPartitionBytes"] == str(128 * 2**20)
    assert large["spark.sql.shuffle.partitions"] == "50000"
    assert 500 * 10**6 <= int(large["spark.sql.files.maxPartitionBytes"]) <= 2**30


def test_work_folder_is_the_shared_one(spark):
    from souk.session import work_folder
    assert work_folder(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
