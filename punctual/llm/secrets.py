"""Secrets in texts, and weak parts of credentials that stand near their complements.

Strong findings (an assigned secret, an access identifier, a long hexadecimal run) are reported
wherever they are. Identifiers, keys and endpoints that mean nothing alone are reported only if
the parts that complete them end or start within the scope, found by an interval join over the
positions in a text: a running window, so a text's candidates are sorted once and never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.native import pieces

#: Code points between the starts of parts of one credential.
SCOPE = 300

#: The three strong kinds, in the order in which spans at one place are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# A run that is long enough is found whole, so the least length may be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Weak kinds: an identifier, a key-like run of mixed characters, an endpoint.
IDENTIFIER = r"""(?i:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"(?:(?i:https?|s3|jdbc:[a-z]+|postgres|mysql|mongodb|amqp|ftp)://[^\x20\x09-\x0D\"'<>]+|(?i:endpoint|host)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::\d+)?)"

KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")


def _found(text: Column, kind: int, pattern: str, first_look: Column, size_of: int = 0) -> Column:
    """Array of structs: kind, number, gap before, length, whether it counts (from the gaps between matches)."""
    matches, gaps = pieces(text, pattern)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(size_of)) if size_of else matches

    def entry(x: Column, i: Column) -> Column:
        good = {
            0: F.length(x["value"]) >= ASSIGN_LEAST,
            4: x["match"].rlike("[A-Z]") & x["match"].rlike("[a-z]") & x["match"].rlike("[0-9]"),
        }.get(kind, F.lit(True))
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("number"), F.length(x["gap"]).alias("gap"),
            F.length(x["match"]).alias("size"), F.coalesce(good, F.lit(False)).alias("good"),
        )

    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value"))
    none = F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,good:boolean>>")
    # The last gap has no match after it.
    return F.when(first_look, F.filter(F.transform(zipped, entry), lambda e: e["size"].isNotNull())).otherwise(none)


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts and spans of each text's secrets, from expressions and windows of the JVM only.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256 (of the strong spans), spans (all),
    n_linked (weak spans). A span is ``kind:start:end`` in code points, end exclusive; spans are
    listed by start, then kind, and joined by commas. A weak identifier needs an assigned
    secret, a hexadecimal run or a key within ``scope``; a weak key needs an access identifier
    or identifier; an endpoint needs one of each side. Null and empty texts have no spans and
    the hash of the empty string. Each row has its own result, repeated rows and null ids
    included; an empty table gives no rows. Only numbers leave the rows' partitions, not texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = text.contains("=") | text.contains(":")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(
        _found(text, 0, ASSIGN, assigned & text.rlike(ASSIGN), 1),
        _found(text, 1, ACCESS, text.contains("AKIA")),
        _found(text, 2, HEX, text.rlike(HEX)),
        _found(text, 3, IDENTIFIER, assigned & text.rlike(IDENTIFIER)),
        _found(text, 4, KEY, text.rlike(KEY)),
        _found(text, 5, ENDPOINT, assigned & text.rlike(ENDPOINT)),
    ).alias("found"))
    spans = rows.select("row", "doc_id", F.explode_outer("found").alias("x")).select("row", "doc_id", "x.*")
    before = Window.partitionBy("row", "kind").orderBy("number")
    spans = spans.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    earlier, later = (Window.partitionBy("row").orderBy(order).rangeBetween(Window.unboundedPreceding, 0) for order in (F.asc("start"), F.desc("start")))

    def has(*kinds: int) -> Column:
        """A part of these kinds ends at most ``scope`` before the span starts, or starts at most so far after it ends."""
        part = F.col("good") & F.col("kind").isin(*kinds)
        before = F.max(F.when(part, F.col("end"))).over(earlier) >= F.col("start") - scope
        after = F.min(F.when(part, F.col("start"))).over(later) <= F.col("end") + scope
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    spans = spans.select("*", has(0, 2, 4).alias("secret"), has(1, 3).alias("name"))
    reported = F.col("good") & (
        (F.col("kind") <= 2) | ((F.col("kind") == 3) & F.col("secret")) | ((F.col("kind") == 4) & F.col("name"))
        | ((F.col("kind") == 5) & F.col("secret") & F.col("name"))
    )
    entry = F.when(reported, F.struct("start", "kind", "end"))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda entries: F.array_join(
        F.transform(F.array_sort(entries), lambda e: F.concat_ws(":", names[e["kind"]], e["start"].cast("string"), e["end"].cast("string"))), ","
    )
    count = lambda kind: F.count(F.when(reported & (F.col("kind") == kind), 1))
    found = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.count(F.when(reported & (F.col("kind") > 2), 1)).alias("n_linked"), F.collect_list(entry).alias("entries"),
    )
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(listed(F.filter("entries", lambda e: e["kind"] <= 2)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("entries")).alias("spans"), "n_linked",
    )
