from datetime import date

from pathlib import Path

import pytest

from punctual.__main__ import main
from punctual.catalog import QUERIES
from punctual.plans import quality, sheets, sla
from punctual.plans.prepared import prepare
from punctual.session import scratch_folder
from punctual.sources.files import CSV_FILES, csv_model, csv_to_parquet, load_csv, parquet_model, write_sheet
from punctual.sources.schemas import SCHEMAS
from punctual.sources.star_tables import star_model
from tests.conftest import plan_of

REVIEWS = '''anything,at,all,in,the,header,line
r1,o1,5,"two
lines","a ""quoted"" word",2018-01-02 03:04:05,
r2,o2,4,,"",2018-01-02 00:00:00,2018-01-03 00:00:00
'''

TABLES = {
    "customers": "c1,p1,01000,sao paulo,SP\nc2,p1,01000,sao paulo,SP\n",
    "sellers": "s1,01000,campinas,SP\n",
    "products": "p1,beleza,10,20,1,500,10,10,10\n",
    "category_translation": "beleza,beauty\n",
    "orders": (
        "o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,2018-01-02 10:00:00,2018-01-09 10:00:00,2018-01-08 00:00:00\n"
        "o2,c2,delivered,2018-01-03 10:00:00,,2018-01-04 10:00:00,2018-01-06 10:00:00,2018-01-20 00:00:00\n"
    ),
    "order_items": "o1,1,p1,s1,2018-01-03 00:00:00,10.50,2.25\n",
    "order_payments": "o1,1,boleto,1,12.75\n",
}


@pytest.fixture(scope="module")
def csv_dir(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv")
    for table, body in TABLES.items():
        (path / CSV_FILES[table]).write_text(",".join(SCHEMAS[table].names) + "\n" + body)
    (path / CSV_FILES["order_reviews"]).write_text(REVIEWS)
    return str(path)


def test_csv_quoting_and_missing_values(spark, csv_dir):
    frame = load_csv(spark, f"{csv_dir}/order_reviews.csv", "order_reviews").orderBy("review_id")
    one, two = frame.collect()
    assert one.review_comment_title == "two\nlines" and one.review_comment_message == 'a "quoted" word'
    assert one.review_answer_timestamp is None and one.review_creation_date.second == 5
    assert two.review_comment_title is None and two.review_comment_message == ""
    assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in SCHEMAS["order_reviews"]]


def test_malformed_row_fails(spark, tmp_path):
    (tmp_path / "s.csv").write_text("order_id,n,t,i,v\no1,not a number,boleto,1,2.00\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        load_csv(spark, str(tmp_path / "s.csv"), "order_payments").collect()


def test_parquet_copy_gives_the_same_results(spark, csv_dir, tmp_path):
    csv_to_parquet(spark, csv_dir, str(tmp_path))
    from_csv, from_parquet = csv_model(spark, csv_dir), parquet_model(spark, str(tmp_path))
    for query in (quality.row_counts, sla.view, sheets.order_sheet, sheets.month_sheet):
        assert sorted(map(str, query(from_csv).collect())) == sorted(map(str, query(from_parquet).collect()))
    row = sla.overview(from_parquet).first()
    assert (row.orders_count, row.late_orders_count) == (2, 1)


def test_status_and_period_reach_the_scan(spark, csv_dir, tmp_path):
    csv_to_parquet(spark, csv_dir, str(tmp_path))
    plan = plan_of(sla.overview(parquet_model(spark, str(tmp_path))))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line and "order_status" in line)
    for part in ("EqualTo(order_status,delivered)", "GreaterThanOrEqual(order_purchase_timestamp",
                 "LessThan(order_purchase_timestamp", "IsNotNull(order_delivered_customer_date)"):
        assert part in pushed
    assert "order_approved_at" not in plan and "customer_city" not in plan


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export_reconciles(spark, sf_dir, tmp_path, fmt):
    rows = sheets.export(star_model(spark, sf_dir), str(tmp_path), fmt).collect()
    assert len(rows) == 4 and all(r.agree for r in rows)
    assert len({(r.orders_count, r.late_orders_count, r.late_orders_pct) for r in rows}) == 1
    assert len(list((tmp_path / "months").glob("part-*"))) == 1


def test_partial_months_are_marked_on_request(spark, sf_dir):
    model = star_model(spark, sf_dir)
    assert "is_partial_month" not in sheets.month_sheet(model).columns
    marked = sheets.month_sheet(model, partial_from=date(2001, 7, 1)).filter("is_partial_month").collect()
    assert [row.purchase_month for row in marked] == [date(2001, 7, 1)]


def test_prepared_sample_has_a_default_folder(spark, csv_dir):
    ready = prepare(csv_model(spark, csv_dir))
    assert scratch_folder(spark) in ready.prepared().inputFiles()[0]


def test_malformed_row_fails_whatever_is_read(spark, csv_dir, tmp_path):
    """A bad date and a short row fail a count and queries that never read the bad column."""
    for name, line in (("date", "o9,c1,delivered,NOT_A_DATE,,,,\n"), ("short", "o9,c1\n")):
        folder = tmp_path / name
        folder.mkdir()
        for path in Path(csv_dir).iterdir():
            text = path.read_text()
            (folder / path.name).write_text(text + line if path.name == "orders.csv" else text)
        model = csv_model(spark, str(folder))
        for read in (model["orders"], quality.status_shares(model), quality.shipped_total(model)):
            with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
                read.collect()


def test_every_result_is_written_whole(spark, csv_dir, tmp_path):
    main([csv_dir, str(tmp_path), "--rows", "1"])
    model = parquet_model(spark, str(tmp_path / "tables"))
    for name, query in QUERIES.items():
        assert spark.read.parquet(str(tmp_path / "results" / name)).count() == query(model).count(), name


def test_whole_analysis_from_csv(spark, csv_dir, tmp_path, capsys):
    main([csv_dir, str(tmp_path), "--rows", "5"])
    printed = capsys.readouterr().out
    assert all(name in printed for name in QUERIES)
    assert {path.name for path in (tmp_path / "sheets").iterdir()} == {"orders", "months", "states"}


def test_unknown_sheet_format(spark, tmp_path):
    with pytest.raises(ValueError):
        write_sheet(spark.range(1), str(tmp_path / "x"), "xlsx")


def test_prepared_sample_gives_the_same_results(spark, sf_dir, tmp_path):
    direct = star_model(spark, sf_dir)
    prepared = prepare(direct, str(tmp_path / "facts"))
    for name in ("v_delivered_orders", "q02b_overview", "q02d_lateness_histogram", "q03_stage_p90",
                 "q04a_score_distribution", "q04b_score_by_lateness", "q05b_month_sheet", "q05d_reconciliation"):
        ours = sorted(map(str, QUERIES[name](prepared).collect()))
        assert ours == sorted(map(str, QUERIES[name](direct).collect())), name
    plan = plan_of(QUERIES["q03_stage_p90"](prepared))
    assert "PartitionFilters: [isnotnull(purchase_month" in plan
