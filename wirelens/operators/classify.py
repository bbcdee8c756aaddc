"""Admission, scores and ranks of items by a rule pack.

Nothing is dropped here: flags and reasons become columns, so that rejected rows can be looked at, and a filter is a
condition on a flag.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from wirelens.functions.rulepacks import RulePack
from wirelens.functions.text import extract_all, fold, matches, once, replace


def item_text(title: str = "title", description: str = "description") -> Column:
    return F.concat(fold(F.col(title)), F.lit(" "), fold(F.col(description)))


def without_requested(text: Column, pack: RulePack) -> Column:
    """The text without verbs that only tell what was asked for."""
    return replace(text, f"(?i){pack.requested}", "$1 ") if pack.requested else text


def stem_pattern(stem: str, pack: RulePack) -> str:
    """A stem at the start of a word."""
    return rf"(?<!\w){re.escape(stem)}{pack.guards.get(stem, '')}"


def with_mentions(items: DataFrame, pack: RulePack) -> DataFrame:
    """Items with _text (folded title and description) and _mentions: all of the pack's stems that are in it from the
    start of a word on. Both are computed once; a stem's pattern is only tried where its letters are there."""
    text, factual = F.col("_text"), F.col("_factual")
    read = once(items, _text=item_text())
    read = once(read, _factual=without_requested(text, pack)) if pack.requested else read.withColumn("_factual", text)
    stems = list(dict.fromkeys([*pack.topics, *pack.outcomes, *pack.scores]))
    looked_at = {s: factual if s in pack.requested_stems else text for s in stems}
    found = F.array(*[F.when(F.contains(looked_at[s], F.lit(s)) & matches(looked_at[s], stem_pattern(s, pack)), F.lit(s)) for s in stems])
    return once(read, _mentions=F.array_compact(found)).drop("_factual")


def mentioned(stems: tuple[str, ...]) -> Column:
    """Of these stems those that are in the text, in their order."""
    if not stems:
        return F.array().cast("array<string>")
    return F.array_intersect(F.array(*map(F.lit, stems)), F.col("_mentions"))


def score(pack: RulePack) -> Column:
    """The greatest severity mentioned and the sum of the slight bonuses, up to the pack's limit."""
    points = {s: F.when(F.array_contains("_mentions", s), F.lit(p)).otherwise(F.lit(0)) for s, p in pack.scores.items()}
    heavy = [c for s, c in points.items() if pack.scores[s] > 1]
    slight = [c for s, c in points.items() if pack.scores[s] <= 1]
    bonus = F.least(sum(slight[1:], slight[0]), F.lit(pack.bonus_limit)) if slight else F.lit(0)
    severity = F.greatest(*heavy) if len(heavy) > 1 else heavy[0] if heavy else F.lit(0)
    return severity + bonus


def _joined(words: Column) -> Column:
    return F.array_join(words, ", ")


def classify(items: DataFrame, pack: RulePack, vetoes: list[tuple[str, Column]] = (), scored: bool = False) -> DataFrame:
    """Items (title, description) with matched_topics, strong_topics, contextual_topics, ignored_fragments,
    admission_reason, rejection_reason, effective_rejection_reason and admitted; if scored, also score.

    vetoes: reasons and conditions that reject an item whatever it is about, in order. rejection_reason may also stand
    on admitted items (as background); effective_rejection_reason is there for the others only.
    """
    text = F.col("_text")
    none = F.array().cast("array<string>")
    seen = once(
        with_mentions(items, pack),
        matched_topics=mentioned(pack.topics),
        _outcomes=mentioned(pack.outcomes),
        ignored_fragments=extract_all(text, f"(?i){pack.requested}") if pack.requested else none,
        _excluded=any_of([F.contains(text, F.lit(w)) for w in pack.excluded]),
        _figurative=matches(text, *pack.figurative) if pack.figurative else F.lit(False),
        **({"score": score(pack)} if scored else {}),
        **{f"_veto_{k}": condition for k, (_, condition) in enumerate(vetoes)},
    )
    vetoes = [(reason, F.col(f"_veto_{k}")) for k, (reason, _) in enumerate(vetoes)]
    of = lambda stems: F.filter("matched_topics", lambda t: t.isin(*stems)) if stems else none
    parts = seen.withColumns({"_strong": of(pack.strong), "contextual_topics": of(pack.contextual)}).withColumn("_conditional", F.filter("contextual_topics", lambda t: t.isin(*pack.conditional)) if pack.conditional else none)
    severe = (F.size("_conditional") > 0) & (F.size("_outcomes") > 0)
    derived = F.concat(F.try_element_at("_conditional", F.lit(1)), F.lit(" + "), F.try_element_at("_outcomes", F.lit(1)))
    supported = (F.size("_strong") > 0) | severe
    admission = F.when(F.size("_strong") > 0, F.concat(F.lit('hard serious topic "'), F.try_element_at("_strong", F.lit(1)), F.lit('"'))).when(
        severe, F.concat(F.lit('conditional "'), F.try_element_at("_conditional", F.lit(1)), F.lit('" + severe outcome "'), F.try_element_at("_outcomes", F.lit(1)), F.lit('"'))
    )
    cascade = [
        *vetoes,
        ("requested killing is not a completed homicide", ~supported & (F.size("ignored_fragments") > 0)),
        ("figurative homicide language", F.col("_figurative")),
        ("excluded keyword", F.col("_excluded")),
        (F.concat(F.lit("violent context without severe outcome: "), _joined(F.col("_conditional"))), (F.size("_conditional") > 0) & (F.size("_outcomes") == 0)),
        (F.concat(F.lit("only contextual topics: "), _joined(F.col("contextual_topics"))), F.size("contextual_topics") > 0),
        ("no crime topics", F.size("matched_topics") == 0),
        ("no supporting crime context", ~supported),
    ]
    reason = first_reason(cascade)
    admitted = (F.size("matched_topics") > 0) & supported & ~F.col("_excluded") & ~F.col("_figurative")
    for _, veto in vetoes:
        admitted = admitted & ~veto
    done = parts.withColumns({"strong_topics": F.when(severe, F.array_append("_strong", derived)).otherwise(F.col("_strong")), "admission_reason": admission, "rejection_reason": reason, "admitted": admitted})
    return done.withColumn("effective_rejection_reason", F.when(~F.col("admitted"), F.col("rejection_reason"))).drop("_text", "_mentions", "_outcomes", "_excluded", "_figurative", "_strong", "_conditional", *[f"_veto_{k}" for k in range(len(vetoes))])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_reason(cascade: list[tuple[str | Column, Column]]) -> Column:
    """The reason of the first condition that holds, else null."""
    pick = lambda r: F.lit(r) if isinstance(r, str) else r
    found = F.when(cascade[0][1], pick(cascade[0][0]))
    for reason, condition in cascade[1:]:
        found = found.when(condition, pick(reason))
    return found


def add_score(items: DataFrame, pack: RulePack) -> DataFrame:
    return with_mentions(items, pack).withColumn("score", score(pack)).drop("_text", "_mentions")


def minimum_score(items: DataFrame, least: int) -> DataFrame:
    """A flag, and the reason of those under the minimum."""
    ok = F.col("score") >= least
    why = F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(f" below minimum {least}"))
    return items.withColumns({"score_passed": ok, "score_rejection": F.when(~ok, why)})


def rank(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Best score first, then input order (column ordinal)."""
    ordered = items.orderBy(F.desc("score"), F.asc("ordinal"))
    return ordered.limit(limit) if limit is not None else ordered


def fresh(items: DataFrame, now: Column, days: int, at: str = "published_at") -> DataFrame:
    """Items published no longer than so many days ago; those to come pass, those without a date don't."""
    return items.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def limit_per_key(items: DataFrame, key: str, order: list[Column], limit: int = 40) -> DataFrame:
    """The first rows of each key. A limit under zero is zero."""
    w = Window.partitionBy(key).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(0, limit)).drop("_n")


def stage_counts(items: DataFrame, flags: list[str]) -> DataFrame:
    """How many rows pass each flag and all before it, in one pass."""
    passing, columns = F.lit(True), [F.count(F.lit(1)).alias("collected")]
    for flag in flags:
        passing = passing & F.coalesce(F.col(flag), F.lit(False))
        columns.append(F.count_if(passing).alias(flag))
    return items.agg(*columns)


def selected_report(items: DataFrame, key: str) -> DataFrame:
    """Why each selected item came so far."""
    return items.select(key, "title", "matched_topics", "strong_topics", "contextual_topics", "score", "admission_reason", "rejection_reason")


def ranked_report(items: DataFrame, n: int = 10) -> DataFrame:
    """The first n of the ranked items with their numbers from 1."""
    return rank(items, n).withColumn("number", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("ordinal"))))  # n rows


def rejected_report(items: DataFrame, n: int = 5) -> DataFrame:
    """The rejected items with a topic that scored best."""
    return rank(items.where(~F.col("admitted") & (F.size("matched_topics") > 0))).limit(n)


def write_with_counts(items: DataFrame, stages: dict[str, Column], path: str) -> dict[str, int]:
    """Write items below path, those that pass all stages as `passed=true` and all others, quarantined with the first stage
    that stops them (`stopped`), as `passed=false`; and give the counts, taken in the pass that writes.

    Counts: collected; for each stage those that pass it and all before it; for each stage those that it stops first
    (`stopped_<stage>`). A null condition doesn't hold. One scan, no second pass.
    """
    stopped = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in stages.items()])
    marked = items.withColumn("stopped", stopped).withColumn("passed", F.col("stopped").isNull())
    names, seen = list(stages), Observation()
    passing = [(F.col("passed") | F.col("stopped").isin(*names[k + 1 :]) if names[k + 1 :] else F.col("passed")).alias(n) for k, n in enumerate(names)]
    first = [(F.col("stopped") == n).alias(f"stopped_{n}") for n in names]
    counted = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for c, n in zip([*passing, *first], [*names, *[f"stopped_{n}" for n in names]], strict=True)]
    marked.observe(seen, F.count(F.lit(1)).alias("collected"), *counted).write.mode("overwrite").partitionBy("passed").parquet(path)
    return seen.get
