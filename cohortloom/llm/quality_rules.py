"""Quality rules: decision lists learned from labelled text statistics.

Statistics are DataFrame expressions over whole texts. A list of rules is learned by sequential
covering: a rule is a conjunction of thresholds that grows by the condition with the most
information gain on one part of the labelled rows and is pruned back on the other part; the rows it
covers are then set aside and the next rule is learned. The list becomes one ordered conditional
expression. Everything is DataFrame functions; the driver sees counts per threshold only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .common import SPACE_CLASS, stage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30  # base limits: words, per cent of words in repeated windows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, even where the body uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column, n: Column) -> Column:
    """Words inside a window of eight that is found twice or more, the first one included."""

    def spread(order: Column) -> Column:
        last = F.size(order) - 1

        def same(j: Column) -> Column:
            before = (j > 0) & (order[F.greatest(j - 1, F.lit(0))]["h"] == order[j]["h"])
            return before | ((j < last) & (order[F.least(j + 1, last)]["h"] == order[j]["h"]))

        found = F.filter(F.sequence(F.lit(0), last), same)
        return let(F.array_sort(F.transform(found, lambda j: order[j]["p"])), cover)

    def cover(places: Column) -> Column:
        last = F.size(places) - 1
        gaps = F.transform(
            F.sequence(F.lit(0), last),
            lambda j: F.when(j == last, WINDOW).otherwise(
                F.least(F.lit(WINDOW), places[F.least(j + 1, last)] - places[j])
            ),
        )
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def count(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ordered, spread))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])
    )
    return F.when(n >= WINDOW, let(let(hashes, windows), count)).otherwise(0)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Statistics of each whole text (null: empty) in columns s_*; other columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, SPACE_CLASS + "+", "")
    trimmed = F.regexp_replace(text, rf"^{SPACE_CLASS}+", "")
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(trimmed, rf"{SPACE_CLASS}+\z", ""), SPACE_CLASS + "+")
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("bigint").alias("n_words"), _repeated_words(w, n).cast("bigint").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct_words"),
        )

    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("bigint")
    found = F.struct(
        let(words, of_words).alias("w"), F.length(bare).cast("bigint").alias("word_chars"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"), kept("[^!?]+").alias("n_shouts"), kept("[^A-Z]+").alias("n_capitals"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("x"),
    )
    names = docs.columns
    # Generated, not projected: a filter on the outcome is then not pushed below, which would compute
    # the statistics once for every use in it.
    staged = docs.select("*", F.explode(F.array(found)).alias("_s"))
    return staged.select(
        *names, F.col("_s.w.n_words").alias("s_n_words"), F.col("_s.word_chars").alias("s_word_chars"),
        F.col("_s.n_symbols").alias("s_n_symbols"), F.col("_s.x.dup").cast("bigint").alias("s_n_dup_lines"),
        F.col("_s.w.n_repeat_words").alias("s_n_repeat_words"),
        F.col("_s.w.n_distinct_words").alias("s_n_distinct_words"), F.col("_s.n_shouts").alias("s_n_shouts"),
        F.col("_s.n_capitals").alias("s_n_capitals"), F.col("_s.x.n").cast("bigint").alias("s_n_lines"),
    )


def base_failed() -> Column:
    n = F.col("s_n_words")
    return (n < MIN_WORDS) | (100 * F.col("s_n_repeat_words") > MAX_REPEATED * n)


#: What rules may look at: rates, so that a threshold means the same for short and long texts.
FEATURES: dict[str, tuple[str, str]] = {
    "word_length": ("s_word_chars", "s_n_words"),
    "symbol_rate": ("s_n_symbols", "s_word_chars"),
    "shout_rate": ("s_n_shouts", "s_n_words"),
    "capital_rate": ("s_n_capitals", "s_word_chars"),
    "dup_line_rate": ("s_n_dup_lines", "s_n_lines"),
    "repeat_rate": ("s_n_repeat_words", "s_n_words"),
    "distinct_rate": ("s_n_distinct_words", "s_n_words"),
    "n_words": ("s_n_words", ""),
}


def feature(name: str) -> Column:
    top, below = FEATURES[name]
    value = F.col(top).cast("double")
    return F.coalesce(value / F.nullif(F.col(below), F.lit(0)), F.lit(0.0)) if below else value


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self, value: Column | None = None) -> Column:
        value = feature(self.feature) if value is None else value
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Settings:
    """`max_rows` bounds the labelled rows that rules are learned from (a sample by hash of the id)."""

    max_rows: int = 40_000
    cuts: int = 40
    max_rules: int = 12
    max_conditions: int = 4
    min_covered: int = 8
    min_precision: float = 0.9
    grow_tenths: int = 7


Rule = tuple[Condition, ...]


def _all(conditions: Rule, value: Callable[[str], Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.column(value(c.feature)) for c in conditions), F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained on the covered positives by one more condition."""
    if not p:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _between(values: list[float]) -> list[float]:
    """Thresholds halfway between neighbouring values, so that neither side is cut close."""
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _interval(name: str, cuts: list[float]) -> Column:
    below = F.filter(F.lit(cuts), lambda c: c < F.col(name))
    return F.struct(F.lit(name).alias("f"), F.size(below).alias("i"))


def _grow(rows: DataFrame, cuts: dict[str, list[float]], s: Settings) -> Rule:
    """Add the condition of most gain until no negative is covered, or none helps."""
    rule: Rule = ()
    while len(rule) < s.max_conditions:
        held = rows.where(_all(rule, F.col))
        # A row falls between two cuts of each feature: counts per interval give every threshold.
        places = [_interval(name, at) for name, at in cuts.items()]
        counts = held.select("bad", F.explode(F.array(*places)).alias("x")).groupBy("x.f", "x.i").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
        ).collect()  # at most features x (cuts + 1) rows
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r.f, {})[r.i] = (r.p, r.n)
        if not by:
            return rule
        p0, n0 = (sum(v[k] for v in next(iter(by.values())).values()) for k in (0, 1))
        if not p0 or not n0:
            return rule
        best: tuple[float, Condition] | None = None
        for name in sorted(by):
            p = n = 0
            for i, cut in enumerate(cuts[name]):
                dp, dn = by[name].get(i, (0, 0))
                p, n = p + dp, n + dn
                for above, cp, cn in ((False, p, n), (True, p0 - p, n0 - n)):
                    gain = _gain(cp, cn, p0, n0)
                    if cp + cn < p0 + n0 and (best is None or gain > best[0] + 1e-9):
                        best = gain, Condition(name, above, cut)
        if best is None or best[0] <= 1e-9:
            return rule
        rule += (best[1],)
    return rule


def _prune(rows: DataFrame, rule: Rule, s: Settings) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best worth on rows it has not grown on; its positives and negatives."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _all(rule[:k], F.col).cast("int")
        sums += [F.sum(hit * F.col("bad")).alias(f"p{k}"), F.sum(hit * (1 - F.col("bad"))).alias(f"n{k}")]
    got = rows.agg(*sums).first()
    best = (-math.inf, 0, 0, 0)
    for k in range(1, len(rule) + 1):
        p, n = got[f"p{k}"] or 0, got[f"n{k}"] or 0
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0] + 1e-9:
            best = worth, k, p, n
    return rule[: best[1]], best[2], best[3]


def learn_rules(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules that mark low quality (label 0), in order.

    Learned from labelled texts that pass the base limits, at most about `max_rows` of them, chosen
    by a hash of the id. Labels that repeat for an id count once, as the lowest; rows with a null id
    or label are left out. Without rows of both kinds there are no rules.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    total = marks.count()
    if not total:
        return []
    share = min(1.0, settings.max_rows / total)
    spot = F.pmod(F.xxhash64(F.lit("rules"), F.col("_id").cast("string")), F.lit(1_000_000))
    # Bounded: about max_rows pairs of an id and a label, whatever the number of labels.
    sample = F.broadcast(marks.where(spot < share * 1_000_000))
    seen = with_statistics(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id"), "_text"
    )
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("_id").cast("string")), F.lit(10))
    rows = stage(
        seen.where(~base_failed()).select(
            (F.col("_label") == 0).cast("int").alias("bad"), (part < settings.grow_tenths).alias("grow"),
            *[feature(f).alias(f) for f in FEATURES],
        ),
        scratch(spark, "rules"),
    ).coalesce(1)  # a bounded table of numbers: counting it needs no shuffle
    levels = [i / (settings.cuts + 1) for i in range(settings.cuts + 2)]
    got = rows.agg(*[F.percentile_approx(f, levels, 10_000).alias(f) for f in FEATURES],
                   *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), levels, 10_000).alias(f"{f}_bad")
                     for f in FEATURES]).first()
    cuts = {f: _between(sorted({*(got[f] or []), *(got[f"{f}_bad"] or [])})) for f in FEATURES}
    rules: list[Rule] = []
    rest = rows
    for _ in range(settings.max_rules):
        grown = _grow(rest.where("grow"), cuts, settings)
        if not grown:
            break
        rule, p, n = _prune(rest.where("not grow"), grown, settings)
        if not rule or p < settings.min_covered * (10 - settings.grow_tenths) / 10 or p < settings.min_precision * (p + n):
            break
        rules.append(rule)
        rest = rest.where(~_all(rule, F.col))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), null if none does: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        out = F.when(_all(rules[k], feature), k + 1).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of `docs` with statistics s_*, base_failed, rule and kept added.

    A null text is empty and fails the base limits. Rows that repeat are judged alike; an empty table
    stays empty; columns of `docs` with the added names are replaced.
    """
    taken = {"base_failed", "rule", "kept"}
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in taken and not c.startswith("s_")])
    seen = with_statistics(own, text_col).withColumn("base_failed", base_failed())
    seen = seen.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return seen.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
