"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in column expressions.

Validated numbers (payment cards, phones, social security numbers, IPv4 addresses), valid dates
and the local part of e-mail addresses are permuted within their own format. The permutation
depends on the key and the value only, so equal values stay equal across documents, and it can
be undone with the key. Each round adds a keyed hash of one half to the other half, modulo what
that half may be, which is a permutation whatever the halves' sizes.
"""

from __future__ import annotations

import re
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm.native import bound, pieces

ROUNDS = 8
#: Session setting that holds the key.
KEY_SETTING = "spark.punctual.pseudonymKey"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+(?<=\.[A-Za-z]{2,24})"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d/.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d]|[/.-]\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (
    r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}([-.])\d{3}\3\d{4}(?![\d-])"
)
OTHERS = "|".join((EMAIL, ADDRESS, DATE, SOCIAL, PHONE))
#: Numbers side by side, 13 digits of them or more, up to one that begins something else. Cards are looked for inside.
NUMBERS = (
    r"(?<![\w+])(?=\d(?:[ -]?\d){12})\d++(?!\w)(?:[ -](?!" + re.sub(r"\\([123])", lambda m: f"\\{int(m[1]) + 3}", OTHERS) + r")\d++(?!\w))*+"
)
ANY = f"{OTHERS}|{NUMBERS}"
#: How cards are written, and the numbers that each form has, the likelier first.
FORMS = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}|\d{4}([ -])\d{6}\2\d{4,5}|\d{4}([ -])\d{3}\3\d{3}\3\d{3}|\d{4}([ -])\d{4}\4\d{4}\4\d{4}\4\d{1,3})$"
PARTS = (1, 4, 3, 5)
#: Cards in other groups: one separator throughout, no group of fewer than three digits.
LOOSE, LOOSE_PARTS = r"^\d{3,}(?:([ -])\d{3,}(?:\1\d{3,})*)$", (2, 3, 4, 5, 6)
#: Years that dates are permuted among.
FIRST_YEAR, YEARS = 1900, 200
#: Turns in which a date of the grid of years, months and days that isn't in the calendar is permuted again. Under 1 in 20 isn't.
WALK = 14
# International calling codes of one and two digits; all others have three.
CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d{1,3}(?=[ .(-]))"


def _mixed(key: str, kind: str, turn: Column, value: Column) -> Column:
    """60 bits of a keyed hash of one half in one round."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(left: Column, right: Column, modulo: tuple[Column, Column], key: str, kind: str) -> Column:
    """Struct ``l``, ``r``: the permuted halves, each below its modulus."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(halves: Column, number: Column) -> Column:
        l, r = halves["l"], halves["r"]
        return F.when(
            number % 2 == 1, F.struct(F.pmod(l + _mixed(key, kind, number, r) % modulo[0], modulo[0]).cast("long").alias("l"), r.alias("r"))
        ).otherwise(F.struct(l.alias("l"), F.pmod(r + _mixed(key, kind, number, l) % modulo[1], modulo[1]).cast("long").alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits permuted among the strings of its length."""

    def permuted(value: Column) -> Column:
        size = F.length(value)
        half = F.floor(size / 2).cast("int")
        scale = [F.pow(F.lit(10.0), n).cast("long") for n in (half, size - half)]
        halves = _feistel(value.substr(F.lit(1), half), value.substr(half + 1, size), (scale[0], scale[1]), key, kind)
        return bound(halves, lambda x: F.concat(
            F.lpad(x["l"].cast("string"), half, F.lit("0")), F.lpad(x["r"].cast("string"), size - half, F.lit("0"))
        ))

    return bound(digits, permuted)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _dealt(shape: Column, digits: Column) -> Column:
    """The digits put in place of those of ``shape``, in order, with its other characters kept."""
    parts = F.regexp_extract_all(shape, F.lit(r"\d|\D+"), F.lit(0))

    def put(state: Column, part: Column) -> Column:
        return F.when(
            part.rlike(r"^\d$"),
            F.struct(F.concat(state["text"], digits.substr(state["at"], F.lit(1))).alias("text"), (state["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(state["text"], part).alias("text"), state["at"].alias("at")))

    return F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), put)["text"]


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of the digits with every second one doubled, from the given place (0: the last)."""
    values = F.reverse(F.transform(_characters(digits), lambda c: c.cast("int")))
    terms = F.transform(values, lambda d, i: F.when(i % 2 == doubled_from_right, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(terms, F.lit(0), lambda total, x: total + x)


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _valid(number: Column) -> Column:
    """Whether a number, separators aside, has a card's length and passes the Luhn check."""
    return bound(_only_digits(number), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), _luhn_sum(d, 1) % 10 == 0).otherwise(False))


def _renewed(card: Column, key: str) -> Column:
    """All but the check digit permuted, and the check digit that makes the card valid again."""

    def renewed(digits: Column) -> Column:
        body = _digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
        whole = bound(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))
        return bound(whole, lambda w: _dealt(card, w))

    return bound(_only_digits(card), renewed)


def _cards(match: Column, key: str) -> Column:
    """Valid cards among numbers side by side: in a usual form first, then in other groups, then all numbers as one."""

    def joined(numbers: Column, at: Column, parts: Column) -> Column:
        return F.regexp_replace(F.array_join(F.slice(numbers, at, parts), ""), "^[ -]", "")

    def first(parts: tuple[int, ...], numbers: Column, at: Column, fits) -> Column:
        """The first count of numbers from a place on that fit and are a valid card, or 0."""
        enough = F.filter(F.array(*map(F.lit, parts)), lambda n: at + n - 1 <= F.size(numbers))
        found = F.filter(enough, lambda n: bound(joined(numbers, at, n), lambda x: F.when(fits(x, n), _valid(x)).otherwise(False)))
        return F.coalesce(F.get(found, F.lit(0)), F.lit(0))

    def usual(numbers: Column) -> Column:
        return F.transform(numbers, lambda _, i: first(PARTS, numbers, i + 1, lambda x, n: x.rlike(FORMS)))

    def loose(numbers: Column, usuals: Column) -> Column:
        """The same with the other groups, which must not reach into a usual form."""
        free = lambda at, n: F.forall(F.slice(usuals, at, n), lambda u: u == 0)
        one = F.forall(usuals, lambda u: u == 0) & _valid(match)

        def at(u: Column, i: Column) -> Column:
            own = first(LOOSE_PARTS, numbers, i + 1, lambda x, n: free(i + 1, n) & x.rlike(LOOSE))
            return F.when(u > 0, u).when(one, F.when(i == 0, F.size(numbers)).otherwise(0)).otherwise(own)

        return F.transform(usuals, at)

    def written(numbers: Column, spans: Column) -> Column:
        def put(state: Column, each: Column) -> Column:
            at, until = state["at"], state["until"]
            card = bound(joined(numbers, at, each["span"]), lambda x: _renewed(x, key))
            lead = F.regexp_extract(each["number"], "^[ -]", 0)
            following = (at + 1).cast("int").alias("at")
            return F.when(at < until, F.struct(state["text"].alias("text"), following, until.alias("until"))).when(
                each["span"] > 0, F.struct(F.concat(state["text"], F.array(lead, card)).alias("text"), following, (at + each["span"]).cast("int").alias("until"))
            ).otherwise(F.struct(F.concat(state["text"], F.array(each["number"])).alias("text"), following, until.alias("until")))

        start = F.struct(F.array().cast("array<string>").alias("text"), F.lit(1).alias("at"), F.lit(0).alias("until"))
        each = F.arrays_zip(numbers.alias("number"), spans.alias("span"))
        return F.array_join(F.aggregate(each, start, put, lambda state: state["text"]), "")

    numbers = F.regexp_extract_all(match, F.lit(r"[ -]?\d+"), F.lit(0))
    return bound(numbers, lambda n: bound(usual(n), lambda u: bound(loose(n, u), lambda spans: F.when(
        F.exists(spans, lambda span: span > 0), written(n, spans)
    ).otherwise(match))))


def _phone(match: Column, key: str) -> Column:
    """The country code stays, the other digits are permuted, so a number is the same however it is grouped."""
    code = F.regexp_extract(match, CODE, 0)
    rest = match.substr(F.length(code) + 1, F.length(match))
    return F.concat(code, bound(_digits(_only_digits(rest), key, "phone"), lambda d: _dealt(rest, d)))


def _social(match: Column, key: str) -> Column:
    """Assignable numbers are permuted among themselves: areas but 000, 666 and 9xx, no group 00, no serial 0000."""
    valid = ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    area, group, serial = (F.try_to_number(match.substr(at, n), F.lit("9" * n)).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    left = area - F.when(area > 666, 2).otherwise(1)
    halves = _feistel(left, (group - 1) * 9999 + serial - 1, (F.lit(898).cast("long"), F.lit(99 * 9999).cast("long")), key, "social")

    def written(x: Column) -> Column:
        parts = ((x["l"] + F.when(x["l"] >= 665, 2).otherwise(1), 3), (F.floor(x["r"] / 9999) + 1, 2), (x["r"] % 9999 + 1, 4))
        return F.concat_ws("-", *(F.lpad(value.cast("string"), width, "0") for value, width in parts))

    return F.when(valid, bound(halves, written)).otherwise(match)


def _address(match: Column, key: str) -> Column:
    def moved(parts: Column) -> Column:
        valid = F.forall(parts, lambda p: p <= 255)
        size = F.lit(65536).cast("long")
        halves = _feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], (size, size), key, "address")
        return F.when(valid, bound(halves, lambda x: F.concat_ws(
            ".", *[y.cast("string") for half in (x["l"], x["r"]) for y in (F.shiftright(half, 8), half.bitwiseAND(255))]
        ))).otherwise(match)

    return bound(F.transform(F.split(match, r"\."), lambda p: p.cast("int")), moved)


def _date(match: Column, key: str) -> Column:
    """Valid dates of the two centuries move to another date of the same notation: order, widths and reading.

    A notation is a grid of years, months and days: day and month of one digit stay below ten, one of two digits
    beside one of a single digit keeps its leading zero or has none, and days of dates that can only be
    read month first stay above twelve, so that they are read so again. The grid is permuted, and
    again from where that led, until the date exists: on valid dates that is a permutation.
    """

    def moved(parts: Column) -> Column:
        year_first = F.length(parts[0]) == 4
        # Of two possible readings of the ambiguous form, day first is tried before month first.
        forms = [(parts[0], parts[1], parts[2]), (parts[2], parts[1], parts[0]), (parts[2], parts[0], parts[1])]
        mark = F.regexp_extract(match, "[-/.]", 0)
        month_first = ~year_first & _day(*forms[1]).isNull()
        form = F.when(year_first, _triple(*forms[0])).when(month_first, _triple(*forms[2])).otherwise(_triple(*forms[1]))

        def read(own: Column) -> Column:
            day_from, day_to = _range(own["d"], own["m"], 31)
            month_from, month_to = _range(own["m"], own["d"], 12)
            least = F.when(month_first, 13).otherwise(day_from)
            days = day_to - least + 1
            least_month = F.when(month_first, 1).otherwise(month_from)
            months = F.when(month_first & (F.length(own["m"]) == 2), 12).otherwise(month_to) - least_month + 1
            sizes = (F.lit(YEARS).cast("long"), (months * days).cast("long"))

            def date_of(x: Column) -> tuple[Column, Column, Column]:
                month, day = F.floor(x["r"] / days) + least_month, x["r"] % days + least
                return (x["l"] + FIRST_YEAR).cast("string"), month.cast("string"), day.cast("string")

            def again(x: Column, _: Column) -> Column:
                return F.when(_day(*date_of(x)).isNotNull(), x).otherwise(_feistel(x["l"], x["r"], sizes, key, "date"))

            def written(x: Column) -> Column:
                year, month, day = date_of(x)
                month, day = F.lpad(month, F.length(own["m"]), F.lit("0")), F.lpad(day, F.length(own["d"]), F.lit("0"))
                return F.when(year_first, F.concat(year, mark, month, mark, day)).when(month_first, F.concat(month, mark, day, mark, year)).otherwise(
                    F.concat(day, mark, month, mark, year)
                )

            number = (own["m"].cast("int") - least_month) * days + own["d"].cast("int") - least
            first = _feistel(own["y"].cast("int") - FIRST_YEAR, number, sizes, key, "date")
            # A walk that is still outside the calendar has not been seen and would leave the date as it is.
            walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, again)
            return bound(walked, lambda x: F.when(_day(*date_of(x)).isNotNull(), written(x)).otherwise(match))

        valid = bound(form, lambda own: F.when(
            _day(own["y"], own["m"], own["d"]).isNotNull() & own["y"].between(str(FIRST_YEAR), str(FIRST_YEAR + YEARS - 1)), read(own)
        ).otherwise(match))
        return valid

    return bound(F.split(match, "[-/.]"), moved)


def _range(part: Column, other: Column, most: int) -> tuple[Column, Column]:
    """Least and greatest value that a day or month can take in its notation."""
    short, zero, mixed = F.length(part) == 1, part.startswith("0"), F.length(other) == 1
    return F.when(mixed & ~short & ~zero, 10).otherwise(1), F.when(short | (mixed & zero), 9).otherwise(most)


def _triple(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))


def _day(y: Column, m: Column, d: Column) -> Column:
    """The date, or NULL if there is none."""
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _email(match: Column, key: str) -> Column:
    """Letters and digits of the local part become others of their kind; the domain stays."""

    def shifted(own: Column, other: Column, turn: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), turn.cast("string"), F.lower(other)), 512)

        return bound(stream, lambda s: F.array_join(F.transform(_characters(own), lambda c, i: moved(s, c, i)), ""))

    def moved(stream: Column, c: Column, i: Column) -> Column:
        shift = F.conv(stream.substr(i % 40 * 3 + 1, F.lit(3)), 16, 10).cast("int")
        return (
            F.when(c.rlike("^[a-z]$"), F.chr(F.pmod(F.ascii(c) - 97 + shift, F.lit(26)) + 97))
            .when(c.rlike("^[A-Z]$"), F.chr(F.pmod(F.ascii(c) - 65 + shift, F.lit(26)) + 65))
            .when(c.rlike("^[0-9]$"), F.chr(F.pmod(F.ascii(c) - 48 + shift, F.lit(10)) + 48))
            .otherwise(c)
        )

    def permuted(local: Column) -> Column:
        half = F.ceil(F.length(local) / 2).cast("int")
        start = F.struct(local.substr(F.lit(1), half).alias("l"), local.substr(half + 1, F.length(local)).alias("r"))

        def turn(halves: Column, number: Column) -> Column:
            l, r = halves["l"], halves["r"]
            return F.when(number % 2 == 1, F.struct(shifted(l, r, number).alias("l"), r.alias("r"))).otherwise(
                F.struct(l.alias("l"), shifted(r, l, number).alias("r"))
            )

        return bound(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda x: F.concat(x["l"], x["r"]))

    return F.concat(bound(F.substring_index(match, "@", 1), permuted), F.lit("@"), F.substring_index(match, "@", -1))


def _renamed(match: Column, key: str) -> Column:
    whole = lambda pattern: match.rlike(f"^(?:{pattern})$")
    return (
        F.when(match.contains("@"), _email(match, key))
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), _address(match, key))
        .when(whole(r"\d{4}([-/.])\d{2}\1\d{2}|\d{1,2}([-/.])\d{1,2}\2\d{4}"), _date(match, key))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), _social(match, key))
        .when(match.rlike(r"^[+(]|^\d{3}([-.])\d{3}\1\d{4}$"), _phone(match, key))
        .otherwise(_cards(match, key))
    )


def key_of(spark: SparkSession) -> str:
    """The session's key, ``spark.punctual.pseudonymKey``, or else a new one drawn at random."""
    return spark.conf.get(KEY_SETTING, None) or token_hex(16)


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by pseudonyms, all columns as they were.

    Only expressions of the JVM, on one row at a time: no shuffle. Cards must pass the Luhn
    check (their pseudonyms do too), and are told from numbers beside them by it, addresses have parts up to 255, dates exist and lie in
    1900-2099, social security numbers be assignable (their pseudonyms are too); what is not valid stays. Null and empty
    texts stay; repeated rows are replaced alike; an empty table gives no rows. Texts are read
    whole. Equal values have equal pseudonyms under one key. Without the key a pseudonym can't be led
    back; where none is given it is that of ``key_of``, so set one to link results of several runs.
    """
    key = key_of(docs.sparkSession) if key is None else key

    def replaced(text: Column) -> Column:
        matches, gaps = pieces(text, ANY)
        new = F.concat(F.transform(matches, lambda m: _renamed(m, key)), F.array(F.lit("")))
        return F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), new.alias("new")), lambda x: F.concat(x["gap"], x["new"])), "")

    text = F.col("text")
    # Personal data has a digit or an at sign, which is quickly seen.
    return docs.withColumn("text", F.when(text.rlike(r"[@\d]") & text.rlike(ANY), replaced(text)).otherwise(text))
