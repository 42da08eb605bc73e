"""Pseudonyms against a plain Feistel network, and as permutations of whole notations."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from punctual.llm.pii import KEY_SETTING, ROUNDS, pseudonymised

KEY = "a key"


def renamed(spark, texts, key=KEY):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [row.text for row in pseudonymised(frame, key).orderBy("doc_id").collect()]


def feistel(left, right, modulo, kind, key=KEY):
    for turn in range(1, ROUNDS + 1):
        def mixed(value):
            return int(hashlib.sha256(f"{key}|{kind}|{turn}|{value}".encode()).hexdigest()[:15], 16)
        if turn % 2:
            left = (left + mixed(right)) % modulo[0]
        else:
            right = (right + mixed(left)) % modulo[1]
    return left, right


def digits(value, kind):
    half = len(value) // 2
    a, b = feistel(int(value[:half]), int(value[half:]), (10**half, 10 ** (len(value) - half)), kind)
    return f"{a:0{half}}{b:0{len(value) - half}}"


def social(text):
    area, group, serial = map(int, text.split("-"))
    a, b = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), "social")
    return f"{a + 1 + (a >= 665):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


def exists(y, m, d):
    try:
        return datetime.date(y, m, d)
    except ValueError:
        return None


def date(text):
    """Year first, else day first, else month first; walked until the date exists."""
    mark = re.search(r"[-/.]", text)[0]
    a, b, c = text.split(mark)
    order = "ymd" if len(a) == 4 else "dmy" if exists(int(c), int(b), int(a)) else "mdy"
    own = dict(zip(order, (a, b, c)))
    if not exists(int(own["y"]), int(own["m"]), int(own["d"])) or not "1900" <= own["y"] <= "2099":
        return text
    def values(part, other, most):
        if len(own[part]) == 1:
            return range(1, 10)
        if len(own[other]) > 1:
            return range(1, most + 1)
        return range(1, 10) if own[part][0] == "0" else range(10, most + 1)

    days, months = values("d", "m", 31), values("m", "d", 12)
    if order == "mdy":
        days, months = range(13, 32), range(1, 13 if len(own["m"]) == 2 else 10)
    x = int(own["y"]) - 1900, months.index(int(own["m"])) * len(days) + days.index(int(own["d"]))
    while True:
        x = feistel(*x, (200, len(months) * len(days)), "date")
        y, m, d = x[0] + 1900, months[x[1] // len(days)], days[x[1] % len(days)]
        if exists(y, m, d):
            new = {"y": str(y), "m": f"{m:0{len(own['m'])}}", "d": f"{d:0{len(own['d'])}}"}
            return mark.join(new[part] for part in order)


def notations(seed, count):
    draw = random.Random(seed)
    for _ in range(count):
        y, m, d, mark = draw.randint(1890, 2110), draw.randint(1, 13), draw.randint(1, 32), draw.choice("-/.")
        wide = draw.choice(["02", "01"]), draw.choice(["02", "01"])
        day, month = (f"{v:{w}}" for v, w in zip((d, m), wide))
        yield draw.choice([f"{y}{mark}{m:02}{mark}{d:02}", f"{day}{mark}{month}{mark}{y}", f"{month}{mark}{day}{mark}{y}"])


def test_dates_equal_a_plain_walk(spark):
    texts = list(notations(1, 1500)) + ["29.02.1900", "29.02.2000", "1/2/1999", "12/25/1999", "31/12/2099", "2100-01-01"]
    assert renamed(spark, texts) == [date(text) for text in texts]


@pytest.mark.parametrize("form", ["%Y-%m-%d", "%d/%m/%Y", "%-d.%-m.%Y", "%m/%d/%Y"])
def test_every_date_has_its_own_image_in_its_notation(spark, form):
    """All dates of 200 years: no two become one, and each stays in the order and width it had."""
    first = datetime.date(1900, 1, 1)
    days = [first + datetime.timedelta(n) for n in range((datetime.date(2100, 1, 1) - first).days)]
    # Strings of two readings belong to the day-first form, those of two digits each to the padded one.
    own = [day for day in days if not (form == "%m/%d/%Y" and day.day < 13 or form == "%-d.%-m.%Y" and day.day > 9 and day.month > 9)]
    texts = sorted(day.strftime(form) for day in own)
    new = renamed(spark, texts)
    assert sorted(new) == texts and [len(a) for a in new] == [len(b) for b in texts]
    assert sum(a == b for a, b in zip(texts, new)) < 20


def test_social_security_numbers_equal_a_plain_network(spark):
    draw = random.Random(2)
    texts = [f"{draw.choice([1, 665, 667, 899, draw.randint(1, 899)]):03}-{draw.randint(1, 99):02}-{draw.randint(1, 9999):04}" for _ in range(4000)]
    texts = sorted({text for text in texts if not text.startswith("666")})
    new = renamed(spark, texts)
    assert new == [social(text) for text in texts] and len(set(new)) == len(texts)
    assert not any(re.match("000|666|9", text) or "-00-" in text or text.endswith("-0000") for text in new)
    invalid = ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000"]
    assert renamed(spark, invalid) == invalid


def test_phones_are_linked_over_notations(spark):
    forms = ["+17845559263", "+1 784 555 9263", "+1 (784) 555-9263", "+1-784-555-9263", "(784) 555-9263", "784-555-9263", "784.555.9263"]
    new = renamed(spark, forms)
    moved = digits("7845559263", "phone")
    assert [re.sub(r"\D", "", text)[-10:] for text in new] == [moved] * len(forms)
    assert [re.sub(r"\d", "0", text) for text in new] == [re.sub(r"\d", "0", text) for text in forms]
    codes = ["+442079460018", "+44 20 7946 0018", "+351 21 123 4567", "+351211234567", "+7 495 123 4567", "+49 30 123 4567"]
    assert [text[: len(code)] for text, code in zip(renamed(spark, codes), ("+44", "+44", "+351", "+351", "+7", "+49"))] == ["+44", "+44", "+351", "+351", "+7", "+49"]
    uk, us = renamed(spark, codes)[:2]
    assert re.sub(r"\D", "", uk) == re.sub(r"\D", "", us)


def test_keys(spark):
    """One key gives the same pseudonyms again; without one, two calls cannot be linked."""
    frame = spark.createDataFrame([(i, f"call +1 784 555 {i:04}") for i in range(60)], "doc_id long, text string")
    assert renamed(spark, ["1/2/1999 x@y.org"]) == renamed(spark, ["1/2/1999 x@y.org"])
    free = [{row.text for row in pseudonymised(frame).collect()} for _ in range(2)]
    assert len(free[0] & free[1]) < 5
    spark.conf.set(KEY_SETTING, "set")
    try:
        assert pseudonymised(frame).collect() == pseudonymised(frame, "set").collect()
    finally:
        spark.conf.unset(KEY_SETTING)


def test_empty_table_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "on 2001-02-03"), (1, "on 2001-02-03"), (None, None), (2, "")], "doc_id long, text string")
    rows = pseudonymised(frame, KEY).collect()
    assert rows[0] == rows[1] and rows[0].text == "on " + date("2001-02-03") and {row.text for row in rows[2:]} == {None, ""}
    assert pseudonymised(frame.limit(0), KEY).count() == 0
    assert pseudonymised(frame.withColumn("new", F.lit(1)), KEY).columns == ["doc_id", "text", "new"]
