"""Quality rules: statistics of a text, and a decision list learned from labelled ones.

Everything is a DataFrame or SQL expression. Learning is sequential covering: a
rule (a conjunction of thresholds on statistics) is grown on two thirds of the
labelled rows by information gain, pruned on the other third, and the rows it
covers are taken away before the next rule. Growing looks at counts per statistic
and quantile bin, so a step gathers some hundred numbers however many rows are
labelled. The result is an ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import words
from lapse.sources.session import pin

WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: shares, and the number of words.
FEATURES = ("symbol_share", "upper_share", "repeat_share", "dup_line_share", "word_length", "distinct_share", "n_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _next(values: Column) -> Column:
    """The values without the first; beside the values themselves, each one's successor."""
    return F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))


def _windows(hashes: Column) -> Column:
    """A hash of each run of eight: pairs, pairs of pairs, and pairs of those."""

    def paired(values: Column, step: int) -> Column:
        shifted = F.slice(values, 1 + step, F.greatest(F.size(values), F.lit(1)))
        return F.zip_with(values, shifted, lambda a, b: F.xxhash64(a, b))

    eight = _let(paired(hashes, 1), lambda two: _let(paired(two, 2), lambda four: paired(four, 4)))
    return F.slice(eight, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def starts(order: Column) -> Column:
        both = F.zip_with(
            order, _next(order), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
        )
        return F.array_sort(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

    def total(at: Column) -> Column:
        run = F.zip_with(at, _next(at), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(run, F.lit(0), lambda x, y: x + y)

    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(order, starts), total)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without `text`, with the columns of `BASE` (long) and `FEATURES` (double); clashing columns are replaced.

    Null text: as empty, all counts zero. Shares of nothing are zero."""
    added = {*BASE, *FEATURES} - {text}
    docs = docs.drop(*added).withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    docs = docs.withColumn("_w", words(F.col("_t")))
    docs = docs.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("_x", _windows(F.col("_h")))
    spoken = F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumn("_l", spoken)
    repeated = F.size(F.array_distinct("_x")) < F.size("_x")
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.char_length(F.array_join("_w", "")),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.when(repeated, _covered(F.col("_x"))).otherwise(0),
        "_lines": F.size("_l"),
        "_upper": F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"\p{Lu}+", "")),
        "_kinds": F.size(F.array_distinct("_h")),
    }
    kept = [c for c in docs.columns if c not in ("_t", "_w", "_h", "_x", "_l")]
    docs = docs.select(*kept, *[c.cast("long").alias(name) for name, c in counts.items()])

    def share(part: str, whole: str) -> Column:
        return (F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("double")

    features = {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("_upper", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "_lines"),
        "word_length": share("word_chars", "n_words"),
        "distinct_share": share("_kinds", "n_words"),
    }
    return docs.withColumns(features).drop("_lines", "_upper", "_kinds")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value, limit = F.col(self.feature), F.lit(self.threshold)
        return value > limit if self.above else value <= limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    column = rule[0].column()
    for c in rule[1:]:
        column &= c.column()
    return column


def verdict(rules: list[Rule]) -> Column:
    """False for the first rule that matches, true if none does."""
    column = F.lit(True)
    for rule in reversed(rules):
        column = F.when(matches(rule), False).otherwise(column)
    return column


def learn(
    stats: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    good: str = "quality",
    bins: int = 32,
    most_rules: int = 8,
    most_conditions: int = 3,
    least_precision: float = 0.95,
    least_covered: int = 10,
) -> list[Rule]:
    """Rules that tell rows labelled 0 from those labelled 1.

    A rule is kept if, on the pruning third, `least_precision` of what it newly covers is labelled 0
    and `least_covered` such rows are; the first rule that fails ends the list. Rows without a label
    or with another one teach nothing; a row labelled twice counts twice. No labelled rows: no rules.
    """
    own = labels.where(F.col(good).isin(0, 1)).select(F.col(key).alias("_key"), (F.col(good) == 0).alias("_bad"))
    rows = stats.select(key, *FEATURES).join(own, F.col(key) == F.col("_key"))
    rows = pin(rows.withColumn("_prune", F.pmod(F.xxhash64(key), F.lit(3)) == 0).select("_bad", "_prune", *FEATURES))
    probabilities = [i / bins for i in range(bins)] + [1.0]
    cuts = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), probabilities, 10_000).alias(f) for f in FEATURES])
    cuts = {f: sorted(set(v or [])) for f, v in cuts.first().asDict().items()}
    for f in FEATURES:
        rows = rows.withColumn(f"_{f}", sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)))
    rules: list[Rule] = []
    left = rows = pin(rows)
    while len(rules) < most_rules:
        rule = _grow(left.where("not _prune"), cuts, most_conditions)
        rule = _prune(left.where("_prune"), rule, least_precision, least_covered)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~matches(rule))
    return rules


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most:
        seen = rows.where(matches(rule)) if rule else rows
        cells = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_{f}").alias("bin")) for f in cuts])
        cells = seen.select("_bad", F.explode(cells).alias("c")).groupBy("c.f", "c.bin")
        counts = cells.agg(F.sum(F.col("_bad").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).collect()
        best = _best(counts, cuts)
        if not best:
            break
        rule += (best[0],)
        if best[1] == 0:
            break
    return rule


def _best(counts: list, cuts: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition of most information gain, and the good rows it would cover; None if none gains."""
    found, best = None, 1e-9
    for f, limits in cuts.items():
        own = {r["bin"]: (r["bad"], r["n"]) for r in counts if r["f"] == f}
        bad, n = sum(b for b, _ in own.values()), sum(n for _, n in own.values())
        if not bad or bad == n:
            continue
        below_bad = below = 0
        for i, limit in enumerate(limits):
            b, m = own.get(i, (0, 0))
            below_bad, below = below_bad + b, below + m
            for above, p, q in ((False, below_bad, below), (True, bad - below_bad, n - below)):
                if p and q < n:
                    gain = p * (math.log2(p / q) - math.log2(bad / n))
                    if gain > best:
                        found, best = (Condition(f, above, float(limit)), q - p), gain
    return found


def _prune(rows: DataFrame, rule: Rule, precision: float, least: int) -> Rule:
    """The prefix of the rule that is best on rows it was not grown on, or nothing."""
    if not rule:
        return ()
    sums = []
    for i in range(1, len(rule) + 1):
        hit = matches(rule[:i])
        sums += [F.count_if(hit & F.col("_bad")).alias(f"p{i}"), F.count_if(hit).alias(f"n{i}")]
    row = rows.agg(*sums).first()
    fit = [
        ((2 * row[f"p{i}"] - row[f"n{i}"]) / row[f"n{i}"], row[f"p{i}"], rule[:i])
        for i in range(1, len(rule) + 1)
        if row[f"p{i}"] >= least and row[f"p{i}"] >= precision * row[f"n{i}"]
    ]
    return max(fit, key=lambda x: (x[0], x[1]))[2] if fit else ()
