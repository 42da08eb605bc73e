"""A sample kept up to date equals one made anew, and files of other months stay."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from punctual.plans import publish, sheets, sla
from punctual.plans.prepared import prepare, refresh
from punctual.sources.model import Model
from punctual.sources.star_tables import star_model
from tests.conftest import order


def rows(frame):
    return sorted((tuple(row) for row in frame.select(*sorted(frame.columns)).collect()), key=str)


def files(path):
    return {
        os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")
    }


class Shop:
    """Tables that change between runs."""

    def __init__(self, tables):
        self.tables = tables
        self.orders, self.scores = {}, []
        self.model = Model(self.open, tables=("orders", "customers", "order_reviews"))

    def open(self, table):
        if table == "orders":
            return self.tables["orders"](*(order(key, **own) for key, own in self.orders.items()))
        if table == "customers":
            return self.tables["customers"](("c1", "SP"), ("c2", "RJ"))
        return self.tables["reviews"](*self.scores)


def bought(month, **more):
    return {"purchase": f"2018-{month:02d}-01 10:00", "approved": f"2018-{month:02d}-01 11:00", "carrier": f"2018-{month:02d}-02 11:00",
            "received": f"2018-{month:02d}-05 12:00", "estimate": f"2018-{month:02d}-20", **more}


@pytest.fixture
def shop(tables):
    shop = Shop(tables)
    shop.orders = {f"o{i}": bought(1 + i % 6, customer=f"c{1 + i % 2}") for i in range(24)}
    shop.orders["alone"] = bought(7)
    shop.scores = [(f"r{i}", f"o{i}", 1 + i % 5, "2018-08-01") for i in range(0, 24, 3)]
    return shop


def test_refresh_equals_a_rebuild(spark, shop, tmp_path):
    path = str(tmp_path / "sample")
    prepare(shop.model, path)
    before = files(path)
    shop.orders["new"] = bought(2)                                   # a new order
    shop.orders["o1"] = bought(3, customer="c2")                     # moves from February to March
    shop.orders["o3"]["received"] = None                             # leaves the sample
    shop.orders["alone"] = bought(3)                                 # its month has no order left
    del shop.orders["o7"]                                            # gone altogether
    shop.orders["undelivered"] = bought(5, received=None)            # not in the sample, before or after
    shop.scores += [("late", "o2", 1, "2018-09-01"), ("more", "o1", 2, "2018-09-01")]
    changed = spark.createDataFrame([(x,) for x in ("new", "o1", "o3", "alone", "o7", "undelivered", "o2", "o1", None, "unknown")], "order_id string")
    ready = refresh(shop.model, path, changed)
    assert rows(ready.prepared()) == rows(prepare(shop.model, str(tmp_path / "anew")).prepared())
    after = files(path)
    untouched = [name for name in before if any(f"2018-{month:02d}" in name for month in (1, 5, 6))]
    assert untouched and all(after[name] == before[name] for name in untouched)
    assert not any("2018-07" in name for name in after)
    assert rows(sheets.month_sheet(ready)) == rows(sheets.month_sheet(shop.model))


def test_refresh_twice_and_of_nothing(spark, shop, tmp_path):
    path = str(tmp_path / "sample")
    prepare(shop.model, path)
    nothing = spark.createDataFrame([], "order_id string")
    before = files(path)
    assert rows(refresh(shop.model, path, nothing).prepared()) == rows(sheets.with_review(shop.model, "left").withColumn(
        "has_review", F.col("order_id").isin([x[1] for x in shop.scores]))) and files(path) == before
    shop.orders["o2"] = bought(4)
    one = spark.createDataFrame([("o2",)], "order_id string")
    first = rows(refresh(shop.model, path, one).prepared())
    assert first == rows(refresh(shop.model, path, one).prepared()) == rows(prepare(shop.model, str(tmp_path / "anew")).prepared())


def test_an_appended_batch_of_the_star_tables(spark, sf_dir, tmp_path):
    """The last two months of orders arrive after the sample was written."""
    whole = star_model(spark, sf_dir)
    cut = F.col("order_purchase_timestamp") < F.lit(datetime(2001, 6, 1))
    early = Model(lambda table: whole[table].filter(cut) if table == "orders" else whole[table], calendar=whole.calendar)
    path = str(tmp_path / "sample")
    prepare(early, path)
    before = files(path)
    ready = refresh(whole, path, whole["orders"].filter(~cut))
    assert rows(ready.prepared()) == rows(prepare(whole, str(tmp_path / "anew")).prepared())
    kept = [name for name in before if files(path).get(name) == before[name]]
    assert len(kept) == len(before) and len(files(path)) > len(before)
    assert rows(sla.by_month(ready)) == rows(sla.by_month(whole))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_sheets_are_published_as_one(spark, shop, tmp_path, fmt):
    path = str(tmp_path / "sheets")
    with pytest.raises(ValueError, match="no published sheets"):
        publish.published(shop.model, path)
    assert all(row.agree for row in publish.publish(shop.model, path, fmt).collect())
    first = {name: rows(sheet) for name, sheet in publish.published(shop.model, path).items()}
    assert len(first["orders"]) == 25 and len(first["months"]) == 7 and len(first["states"]) == 2
    shop.orders["new"] = bought(2)
    publish.publish(shop.model, path, fmt)
    second = publish.published(shop.model, path)
    assert second["orders"].count() == 26 and {name: rows(x) for name, x in publish.published(shop.model, path, 1).items()} == first
    assert [row.number for row in publish.versions(spark, path).orderBy("number").collect()] == [1, 2]
    assert len(publish.forget(spark, path, keep=1)) == 1 and publish.published(shop.model, path)["orders"].count() == 26


def test_a_failed_job_leaves_the_former_sheets(spark, shop, tmp_path, monkeypatch):
    path = str(tmp_path / "sheets")
    publish.publish(shop.model, path)
    shop.orders["new"] = bought(2)
    written = sheets.write_sheet

    def breaks(sheet, place, *more, **named):
        if place.endswith("/states"):
            raise OSError("disk full")
        written(sheet, place, *more, **named)

    monkeypatch.setattr(sheets, "write_sheet", breaks)
    with pytest.raises(OSError):
        publish.publish(shop.model, path)

    def loses(sheet, place, *more, **named):
        written(sheet.limit(3) if place.endswith("/months") else sheet, place, *more, **named)

    monkeypatch.setattr(sheets, "write_sheet", loses)
    with pytest.raises(publish.NotReconciled, match="total by month"):
        publish.publish(shop.model, path)
    assert publish.published(shop.model, path)["orders"].count() == 25 and publish.versions(spark, path).count() == 1
    # Besides the version and the list nothing is left.
    assert len([name for name in os.listdir(path) if not name.startswith(".")]) == 2
