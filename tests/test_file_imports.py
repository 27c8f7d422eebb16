from pyspark.sql import functions as F

from quernstone.plans import reports


def test_imports_of_a_file_are_numbered_over_its_orders(spark, tmp_path):
    """Orders of several blocks of keys, repeated rows, negative and null keys: the numbers of one window over a file."""
    keys = [1, 98, 98, 97, 97_001, 97_098, 300_000, -96, -97_096, None, None]
    items = spark.createDataFrame([(k, p % 4, p, p % 2) for k in keys for p in range(5)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").withColumn("l_quantity", F.lit(1.0)).withColumn("l_extendedprice", F.lit(2.0))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    want = items.selectExpr("concat('src/f', l_orderkey % 97, '.tsx') AS path", "concat('src/f', l_partkey % 150, '.tsx') AS source", "CAST(row_number() OVER (PARTITION BY l_orderkey % 97 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS long) AS pos")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(reports._file_imports(spark, str(tmp_path))) == rows(want)


def test_sources_repeat_over_orders_of_a_file(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    first = items.selectExpr("l_orderkey % 97", "l_partkey % 150").distinct().count()
    assert reports.ag16_repeated_imports(spark, sf).count() == items.count() - first
