"""The report of rows that cannot be loaded."""

import pytest

from punctual.sources.files import load_csv
from punctual.sources.rejects import RUN, bad_rows, bad_rows_of_all
from punctual.sources.schemas import SCHEMAS

HEADER = "a,b,c,d,e\n"


def found(frame):
    return sorted(((row.file.rsplit("/", 1)[-1], row.line, row.column_name, row.value, row.reason) for row in frame.collect()), key=str)


def test_every_fault_has_its_place(spark, tmp_path):
    """Types, empty values, missing and surplus fields, blank lines, a header that is no row, and two files."""
    (tmp_path / "one.csv").write_text(
        "not,checked,at,all\n"          # 1
        "o1,1,boleto,1,12.75\n"         # 2
        "o1,x,boleto,1,1.2.3\n"         # 3: two faults
        "\n"                            # 4
        "o2,1,boleto\n"                 # 5: too few
        "o3,1,boleto,1,2.00,more\n"     # 6: too many
        "o4,,,,\n"                      # 7: empty fields are NULL
        'o5,"",boleto,1,2.00\n'         # 8: a quoted empty text is no number
        'o6,1,"a, ""quoted"" type",99999999999,2.00\n'  # 9: too large
        "o7,1,boleto,1,2.00"            # 10: no line break at the end
    )
    (tmp_path / "two.csv").write_text(HEADER + "o8,1,boleto,1,2.00\n" * 3 + "o9,1,boleto,one,2.00\n")
    rows = found(bad_rows(spark, str(tmp_path), "order_payments"))
    expected = [
        ("one.csv", 3, "payment_sequential", "x", "not int"), ("one.csv", 3, "payment_value", "1.2.3", "not decimal(10,2)"),
        ("one.csv", 5, None, "o2,1,boleto", "not 5 fields"), ("one.csv", 6, None, "o3,1,boleto,1,2.00,more", "not 5 fields"),
        ("one.csv", 8, "payment_sequential", "", "not int"), ("one.csv", 9, "payment_installments", "99999999999", "not int"),
        ("two.csv", 5, "payment_installments", "one", "not int"),
    ]
    assert rows == sorted(expected, key=str)


def test_lines_are_counted_over_splits(spark, tmp_path):
    """A file that is read in many splits by several tasks."""
    lines = [f"o{i},{'x' if i % 977 == 0 else i},boleto,1,2.00\n" for i in range(1, 20_001)]
    (tmp_path / "p.csv").write_text(HEADER + "".join(lines))
    for name, value in (("spark.sql.files.maxPartitionBytes", "20k"), ("spark.sql.files.openCostInBytes", "1k")):
        spark.conf.set(name, value)
    try:
        frame = bad_rows(spark, str(tmp_path / "p.csv"), "order_payments")
        assert spark.read.text(str(tmp_path / "p.csv")).rdd.getNumPartitions() > 10
        assert sorted(row.line for row in frame.collect()) == [i + 1 for i in range(1, 20_001) if i % 977 == 0]
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)


def test_records_over_several_lines(spark, tmp_path):
    """Comments with line breaks: the line is where the record starts, beyond one run of records, too."""
    text, line, expected = "h\n", 2, []
    for i in range(RUN + 300):
        score = "five" if i in (0, 7, RUN - 1, RUN, RUN + 299) else str(1 + i % 5)
        comment = "\n".join(["text"] * (1 + i % 4))
        if score == "five":
            expected.append(("r.csv", line, "review_score", "five", "not int"))
        text += f'r{i},o{i},{score},"{comment}","a ""quote""",2018-01-02 03:04:05,\n'
        line += 1 + i % 4
    (tmp_path / "r.csv").write_text(text + "short,row\n")
    rows = found(bad_rows(spark, str(tmp_path / "r.csv"), "order_reviews"))
    assert rows == sorted([*expected, ("r.csv", line, None, "short,row", "not 7 fields")], key=str)


def test_a_clean_folder_has_no_bad_rows(spark, tmp_path):
    bodies = {"customers": "c1,p1,01000,sao paulo,SP\n", "order_reviews": 'r1,o1,5,"two\nlines",,2018-01-02 03:04:05,\n', "sellers": ""}
    for table, body in bodies.items():
        (tmp_path / f"{table}.csv").write_text(",".join(SCHEMAS[table].names) + "\n" + body)
    frame = bad_rows_of_all(spark, str(tmp_path), {table: f"{table}.csv" for table in bodies})
    assert frame.collect() == [] and frame.columns[0] == "table_name"


def test_what_is_reported_is_what_the_load_stops_at(spark, tmp_path):
    rows = ["o1,1,boleto,1,2.00", "o1,1.0,boleto,1,2.00", "o1, 1,boleto,1,2.00", "o1,1,boleto,1,2.005", "o1,1,boleto,1,123456789.00",
            "o1,1,boleto,+1,2", "o1,1,boleto,1,1e3", 'o1,1,"bol"eto,1,2.00', "o1,1,boleto,1,", "o1,1,boleto,-0,-2.00"]
    for i, row in enumerate(rows):
        path = str(tmp_path / f"{i}.csv")
        (tmp_path / f"{i}.csv").write_text(HEADER + row + "\n")
        try:
            load_csv(spark, path, "order_payments").collect()
            loads = True
        except Exception:
            loads = False
        assert (bad_rows(spark, path, "order_payments").count() == 0) == loads, row


def test_reading_a_csv_leaves_the_session_alone(spark, tmp_path):
    (tmp_path / "p.csv").write_text(HEADER + "o1,1,boleto,1,2.00\n")
    before = spark.conf.get("spark.sql.csv.filterPushdown.enabled")
    frame = load_csv(spark, str(tmp_path / "p.csv"), "order_payments")
    assert frame.filter("payment_type = 'boleto'").count() == 1 and spark.conf.get("spark.sql.csv.filterPushdown.enabled") == before == "true"


@pytest.mark.parametrize("bad", ["o2,x,voucher,1,2.00", "o2,1"])
def test_a_filter_does_not_hide_a_bad_row(spark, tmp_path, bad):
    (tmp_path / "p.csv").write_text(HEADER + "o1,1,boleto,1,2.00\n" + bad + "\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        load_csv(spark, str(tmp_path / "p.csv"), "order_payments").filter("payment_type = 'boleto'").select("order_id").collect()
