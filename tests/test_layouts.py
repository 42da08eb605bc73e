"""Clustered and bucketed tables: same results, less read, nothing shuffled by order."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from punctual.catalog import QUERIES
from punctual.operators.sample import PURCHASE
from punctual.plans import lines, quality, sheets, sla
from punctual.sources.bucketed import BY_ORDER, bucket_tables, bucketed_model
from punctual.sources.clustered import cluster_tables, clustered_model, file_ranges, read_clustered, write_clustered
from punctual.sources.star_tables import STAR_CALENDAR, star_model
from tests.conftest import plan_of


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=str)


@pytest.fixture(scope="module")
def star(spark, sf_dir):
    return star_model(spark, sf_dir)


@pytest.fixture(scope="module")
def schemas(star):
    return {table: star[table].schema for table in star.tables}


@pytest.fixture(scope="module")
def clustered(spark, star, schemas, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered"))
    cluster_tables(star, path, files=24)
    return path, clustered_model(spark, path, STAR_CALENDAR, schemas)


@pytest.fixture(scope="module")
def bucketed(spark, star, schemas, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bucketed"))
    bucket_tables(star, path, 6)
    return path, bucketed_model(spark, path, STAR_CALENDAR, schemas)


def scanned(frame):
    """Files and rows that the scans of a plan without an exchange read."""
    frame.write.format("noop").mode("overwrite").save()
    execution = frame._jdf.queryExecution()
    frame._jdf.collectToPython()
    plan, found = execution.executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            metrics = node.metrics()
            found.append((metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


def test_a_month_reads_few_files_and_row_groups(spark, tmp_path):
    """40,000 rows of 200 days in scattered order; a tenth of the days is a tenth of the files and few rows more."""
    frame = spark.range(0, 40_000, 1, 8).selectExpr(
        "id AS order_id", "TIMESTAMP_NTZ '2020-01-01 00:00:00' + INTERVAL '1' HOUR * ((id * 7919) % 4800) AS moment", "repeat('x', 200) AS filler"
    )
    plain, path = str(tmp_path / "plain"), str(tmp_path / "clustered")
    frame.write.option("parquet.block.size", 65536).parquet(plain)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "0")
    write_clustered(frame, path, ["moment", "order_id"], files=20)
    start, end = datetime(2020, 3, 1), datetime(2020, 3, 21)
    found = read_clustered(spark, path, frame.schema, "moment", start, end)
    expected = spark.read.parquet(plain).filter((F.col("moment") >= F.lit(start)) & (F.col("moment") < F.lit(end)))
    assert rows(found) == rows(expected) and found.count() == 4000
    (files, read), = scanned(found)
    (all_files, all_read), = scanned(expected)
    assert files <= 4 < 20 and read <= 8000 and all_read == 40_000
    assert "PushedFilters: [IsNotNull(moment), GreaterThanOrEqual" in plan_of(found)
    assert file_ranges(spark, path).agg(F.sum("rows")).first()[0] == 40_000


def test_row_groups_within_a_file_are_skipped(spark, tmp_path):
    frame = spark.range(0, 200_000, 1, 4).selectExpr("(id * 7919) % 200000 AS n", "uuid() AS filler")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(1 << 20))
    try:
        write_clustered(frame, str(tmp_path / "t"), ["n"], files=1)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    (files, read), = scanned(read_clustered(spark, str(tmp_path / "t"), frame.schema, "n", 1000, 2000))
    assert files == 1 and 1000 <= read < 100_000


def test_rows_without_a_value_and_empty_tables(spark, tmp_path):
    frame = spark.createDataFrame([(None, 1), (5, 2), (7, 3), (None, 4), (7, 5)], "at int, id int")
    write_clustered(frame, str(tmp_path / "t"), ["at", "id"], files=3)

    def read(*bounds):
        return sorted(row.id for row in read_clustered(spark, str(tmp_path / "t"), frame.schema, "at", *bounds).collect())

    assert read() == [1, 2, 3, 4, 5] and read(6) == [3, 5] and read(None, 7) == [2] and read(5, 8) == [2, 3, 5] and read(8, 9) == []
    write_clustered(frame.limit(0), str(tmp_path / "t"), ["at", "id"])
    assert read() == [] and read(1, 9) == []


def test_clustered_orders_open_only_their_months(clustered, star):
    path, model = clustered
    near = model.orders_near(date(1998, 1, 1), date(1998, 2, 1))
    assert len(near.inputFiles()) <= 3 < len(model["orders"].inputFiles())
    month = (F.col(PURCHASE) >= F.lit(datetime(1998, 1, 1))) & (F.col(PURCHASE) < F.lit(datetime(1998, 2, 1)))
    assert rows(near) == rows(star["orders"].filter(month).select(*near.columns))


NAMES = ["q00c_status_share", "q01h_orders_by_month", "q01i_tail_orders", "q01k_shipped_in_period", "q02b_overview", "q03_stage_p90",
         "q05b_month_sheet", "q05d_reconciliation", "x1_order_freight", "x2_seller_handover", "x7_order_payments"]


@pytest.mark.parametrize("name", NAMES)
def test_results_do_not_depend_on_the_layout(name, star, clustered, bucketed):
    expected = rows(QUERIES[name](star))
    assert rows(QUERIES[name](clustered[1])) == expected
    assert rows(QUERIES[name](bucketed[1])) == expected


@pytest.mark.parametrize("query", [sheets.month_sheet, sheets.state_sheet, lines.seller_handover, lines.order_freight,
                                   lines.order_payments, lines.late_by_handover, lines.handover_by_payment])
def test_nothing_is_shuffled_by_order(query, spark, star, bucketed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(order_id" in plan_of(query(star))
        plan = plan_of(query(bucketed[1]))
        assert "hashpartitioning(order_id" not in plan and "Bucketed: true" in plan
        assert rows(query(bucketed[1])) == rows(query(star))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_session_opens_the_buckets(spark, bucketed, schemas, star):
    path, _ = bucketed
    for table in BY_ORDER:
        for found in spark.catalog.listTables():
            if found.name.endswith(f"_{table}"):
                spark.sql(f"DROP TABLE {found.name}")
    model = bucketed_model(spark, path, STAR_CALENDAR, schemas)
    assert "hashpartitioning(order_id" not in plan_of(lines.order_freight(model))
    assert rows(quality.row_counts(model)) == rows(quality.row_counts(star))


def test_orders_without_a_customer_stay_out(spark, tables, tmp_path):
    from punctual.sources.model import Model
    from tests.conftest import order

    held = {"orders": tables["orders"](order("o1"), order("o2", customer="nobody")), "customers": tables["customers"](("c1", "SP")),
            "order_reviews": tables["reviews"](("r1", "o1", 5, "2018-01-06"))}
    plain = Model(held.__getitem__, tables=tuple(held))
    bucket_tables(plain, str(tmp_path / "b"), 2)
    model = bucketed_model(spark, str(tmp_path / "b"))
    assert rows(sla.overview(model)) == rows(sla.overview(plain)) and sla.sample(model).count() == 1
    assert quality.row_counts(model).filter("table_name = 'orders'").first().rows == 2
