from __future__ import annotations

import os
from datetime import datetime

import pytest

from punctual.session import local_session
from punctual.sources.schemas import SCHEMAS

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
"spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


def plan_of(frame) -> str:
    """The physical plan, untruncated."""
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def moment(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def order(key, purchase="2018-01-01 10:00", approved="2018-01-01 11:00", carrier="2018-01-02 11:00",
          received="2018-01-05 12:00", estimate="2018-01-20", status="delivered", customer="c1"):
    return (key, customer, status, *map(moment, (purchase, approved, carrier, received, estimate)))


@pytest.fixture(scope="session")
def tables(spark):
    """Builders of small model tables."""

    def orders(*rows):
        return spark.createDataFrame(list(rows), SCHEMAS["orders"])

    def customers(*rows):
        full = [(key, f"person of {key}", None, "city", state) for key, state in rows or [("c1", "SP")]]
        return spark.createDataFrame(full, SCHEMAS["customers"])

    def reviews(*rows):
        full = [(rid, oid, score, None, None, moment(at), None) for rid, oid, score, at in rows]
        return spark.createDataFrame(full, SCHEMAS["order_reviews"])

    return {"orders": orders, "customers": customers, "reviews": reviews}
