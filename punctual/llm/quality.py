"""Quality rules: statistics of texts, and a decision list learnt from labels over them.

Sequential covering: a conjunction of thresholds grows, condition by condition, towards the rows
labelled bad, is pruned on rows it never saw, and takes the rows it covers out of the search
for the next. The list becomes one conditional expression, tried in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.native import bound
from punctual.llm.store import stored

#: Words of a window that may repeat, least words, and the greatest share of repeated words in hundredths.
WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
#: Thresholds tried for each statistic, conditions of a rule, rules of a list.
CUTS, CONDITIONS, RULES = 12, 3, 8
#: Share of bad rows that a rule must reach where it never learnt, and the rows it must cover there.
PRECISION, SUPPORT = 0.9, 5

#: Statistics that rules may test, by the counts they come from.
RATIOS = {
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "same_lines": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _repeated(words: Column) -> Column:
    """Words inside windows found twice or more, each word once."""

    def covered(codes: Column) -> Column:
        pairs = F.sort_array(F.transform(codes, lambda code, i: F.struct(code.alias("code"), i.alias("at"))))

        def twice(sorted_pairs: Column) -> Column:
            last = F.size(sorted_pairs) - 1
            return F.filter(sorted_pairs, lambda p, i: (
                F.when(i > 0, F.get(sorted_pairs, i - 1)["code"] == p["code"]).otherwise(False)
                | F.when(i < last, F.get(sorted_pairs, i + 1)["code"] == p["code"]).otherwise(False)
            ))

        places = bound(pairs, lambda p: F.sort_array(F.transform(twice(p), lambda x: x["at"])))
        steps = bound(places, lambda p: F.transform(p, lambda at, i: F.least(F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.when(
            F.size(F.array_distinct(codes)) < F.size(codes), F.aggregate(steps, F.lit(0), lambda total, step: total + step)
        ).otherwise(0)

    codes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, bound(codes, covered)).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each text.

    A null text counts as empty: all zero. Windows are told apart by 64-bit codes within a text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Condition:
    """A statistic at least (or at most) a threshold."""

    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value >= self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    """All conditions of the rule."""
    found = F.lit(True)
    for condition in rule:
        found = found & condition.column()
    return found


def _counts(rows: DataFrame, conditions: dict[int, Column]) -> dict[int, tuple[int, int]]:
    """Bad and good rows that meet each condition, in one pass."""
    one = lambda test, bad: F.count(F.when(test & (F.col("bad") == bad), 1))
    columns = [one(test, bad).alias(f"{'bad' if bad else 'good'}{i}") for i, test in conditions.items() for bad in (True, False)]
    found = rows.agg(*columns).first()
    return {i: (found[f"bad{i}"], found[f"good{i}"]) for i in conditions}


def _gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """Bad rows kept times the information that each gains."""
    if not bad:
        return 0.0
    return bad * (log2(bad / (bad + good)) - log2(all_bad / (all_bad + all_good)))


def learnt(labelled: DataFrame) -> list[Rule]:
    """Ordered rules for bad rows, from counts and a boolean ``bad``; deterministic for a table.

    Two thirds of the rows grow rules, the others prune and accept them. Every step is one
    aggregate over all labelled rows; without bad rows, or without any row, there are no rules.
    """
    rows = labelled.withColumn("grows", F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(3)) != 0)
    grow, prune = rows.where("grows"), rows.where("not grows")
    cuts: dict[str, list[float]] = {}
    shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    bad_rows = grow.where("bad")
    quantiles = bad_rows.agg(*[F.percentile_approx(F.expr(RATIOS[name]), shares, 10000).alias(name) for name in RATIOS]).first()
    for name in RATIOS:
        cuts[name] = sorted(set(quantiles[name] or []))
    tests = [Condition(name, above, cut) for name, values in cuts.items() for cut in values for above in (True, False)]
    rules: list[Rule] = []
    left = F.lit(True)
    while tests and len(rules) < RULES:
        rule: Rule = ()
        bad, good = _counts(grow.where(left), {0: F.lit(True)})[0]
        while bad and good and len(rule) < CONDITIONS:
            found = _counts(grow.where(left & holds(rule)), {i: test.column() for i, test in enumerate(tests)})
            best = max(found, key=lambda i: (_gain(*found[i], bad, good), -i))
            if _gain(*found[best], bad, good) <= 0:
                break
            rule, (bad, good) = (*rule, tests[best]), found[best]
        if not rule:
            break
        # Pruning: the shortest beginning that is worth as much on rows the rule never saw.
        found = _counts(prune.where(left), {n: holds(rule[:n]) for n in range(1, len(rule) + 1)})
        worth = {n: (bad - good) / (bad + good) if bad + good else -1.0 for n, (bad, good) in found.items()}
        size = max(worth, key=lambda n: (worth[n], -n))
        bad, good = found[size]
        if bad + good < SUPPORT or bad < PRECISION * (bad + good):
            break
        rules.append(rule[:size])
        left = left & ~holds(rules[-1])
    return rules


def judged(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """The counts with ``base_failed``, ``kept`` and ``verdict`` (the rule that spoke).

    The first that holds decides: too few words, too many repeated words, then each rule.
    """
    verdict = F.when(F.col("n_words") < LEAST_WORDS, F.lit(f"n_words < {LEAST_WORDS}"))
    verdict = verdict.when(100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"), F.lit("repeated words"))
    for rule in rules:
        verdict = verdict.when(holds(rule), F.lit(" and ".join(map(str, rule))))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counts.withColumn("base_failed", base).withColumn("verdict", verdict).withColumn("kept", F.col("verdict").isNull())


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every text; the rules learn from all rows of ``labels`` with a quality.

    Null and empty texts have counts of zero and fail; each row has its verdict, repeated rows
    and null ids included; an empty table gives no rows, empty labels leave the base rules only.
    Columns other than doc_id, text and quality are not read. Runs in the JVM only.
    """
    counts = stored(statistics(docs), "statistics")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") <= 0).alias("bad"))
    base = f"n_words >= {LEAST_WORDS} and 100 * n_repeat_words <= {MOST_REPEATED} * n_words"
    labelled = stored(counts.where(base).join(marks, "doc_id"), "labelled")
    return judged(counts, learnt(labelled))
