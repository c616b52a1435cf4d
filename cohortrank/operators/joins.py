"""Joins that Spark has no single operator for, each as a plan without nested loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S
from cohortrank.storage import written_once

#: Rows of counts up to a day that are broadcast, of some 300 bytes each.
FEW_STRETCHES = 50_000


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value_cols: list[str], tie: list[str] = (), span: Callable[[Column], Column] | None = None) -> DataFrame:
    """left plus, of the right rows of its key with right_ts <= left_ts, the value columns of the latest (null if none).

    Union and one window instead of a range join: rows of both sides are sorted once by key and time. Among right
    rows of one time the largest by `tie` counts. Null times on the left find nothing. With `span`, which cuts time
    into stretches (a month, say), rows are sorted by key and stretch, and the last value before a stretch is carried
    into it: one key's rows then lie in as many groups as it has stretches, not in one.
    """
    names, ties = left.columns, [f"_t{i}" for i, _ in enumerate(tie)]
    kind = right.select(F.struct(*value_cols).alias("v")).schema["v"].dataType
    at = (lambda ts: span(F.col(ts))) if span else (lambda ts: F.lit(0))
    tagged = left.select(*keys, at(left_ts).alias("_span"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), *(F.lit(None).alias(t) for t in ties), F.lit(None).cast(kind).alias("_value"))
    dated = right.where(F.col(right_ts).isNotNull()).select(*keys, at(right_ts).alias("_span"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), *(F.col(t).alias(x) for t, x in zip(tie, ties, strict=True)), F.struct(*value_cols).alias("_value"))
    both = tagged.unionByName(dated)
    if span:  # a row for each stretch of a key that has any, with the last value before it
        last = F.max_by("_value", F.struct("_ts", *ties)).alias("_last")
        stretches = dated.groupBy(*keys, "_span").agg(last).unionByName(tagged.groupBy(*keys, "_span").agg(F.lit(None).cast(kind).alias("_last")))
        stretches = stretches.groupBy(*keys, "_span").agg(F.first("_last", ignorenulls=True).alias("_last"))
        before = F.last("_last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
        carried = stretches.withColumn("_value", before).where(F.col("_value").isNotNull() & F.col("_span").isNotNull())
        both = both.unionByName(carried.select(*keys, "_span", "_value", F.lit(-1).alias("_side")), allowMissingColumns=True)
    order = W.partitionBy(*keys, "_span").orderBy("_ts", "_side", *ties).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(order)).where("_side = 1")
    found = (lambda c: F.when(F.col("_ts").isNotNull(), F.col(f"_seen.{c}"))) if span else (lambda c: F.col(f"_seen.{c}"))
    return seen.select("_row.*", *(found(c).alias(c) for c in value_cols))


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join by sorted shuffles, whatever the sizes of files say: names and terms take many times the room in memory that
    they take in Parquet, so a table that looks small enough to be broadcast may not fit into the driver."""
    return left.join(right.hint("merge"), on, how)


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def either_side_join(left: DataFrame, sides: list[str], right: DataFrame, key: str) -> DataFrame:
    """Rows of left for which any of its columns `sides` is in right's key, once each, with the sides that matched.

    Exploding the sides keeps this an equi join, where an OR would compare all pairs.
    """
    names = left.columns
    long = left.withColumn("_id", F.monotonically_increasing_id()).select("*", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).cast("string").alias("key")) for s in sides))).alias("_s"))
    hits = long.join(right.select(F.col(key).cast("string").alias("_k")).distinct(), F.col("_s.key") == F.col("_k"), "left_semi")
    return hits.groupBy("_id", *names).agg(F.count("*").alias("matched_sides")).drop("_id")


def nearest_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, days: int, left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row of its key nearest in time, at most `days` away; ties to the smaller id.

    Both sides are cut into stretches of `days` days, so a row meets only those of its own and the two next to it.
    """
    stretch = lambda ts: F.floor(F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")) / max(days, 1))
    gap = F.abs(F.datediff(F.col(left_ts), F.col(right_ts)))
    own = left.withColumn("_stretch", F.explode(F.array(*(stretch(left_ts) + k for k in (-1, 0, 1)))))
    pairs = own.join(right.withColumn("_stretch", stretch(right_ts)), [key, "_stretch"]).drop("_stretch")
    pairs = pairs.where((F.col(left_id) != F.col(right_id)) & (gap <= days)).withColumn("gap_days", gap)
    return latest_per_key(pairs, [left_id], ["gap_days", right_id])


def period_transition(df: DataFrame, entity: str, order: list, cols: list[str]) -> DataFrame:
    """Each row with the next one of its entity: next_<col> for each of cols."""
    over = W.partitionBy(entity).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(over) for c in cols}).where(F.col(f"next_{cols[0]}").isNotNull())


def tiered_match(candidates: DataFrame, key: str, rules: list, order: list) -> DataFrame:
    """Best candidate of each key by the first rule that holds; candidates that meet none are left out.

    rules: (condition, score) from the strongest down.
    """
    tier, score = F.lit(None).cast("int"), F.lit(None).cast("double")
    for k, (condition, value) in reversed(list(enumerate(rules, 1))):
        tier, score = F.when(condition, k).otherwise(tier), F.when(condition, value).otherwise(score)
    rated = candidates.withColumns({"tier": tier, "match_score": score}).where(F.col("tier").isNotNull())
    return latest_per_key(rated, [key], ["tier", F.desc("match_score"), *order])


def top2_gap(df: DataFrame, key: str, choice: str, score: str, least: float, sure: float, gap: float) -> DataFrame:
    """Best choice of each key, accepted if it scores at least `sure`, or at least `least` and `gap` above the
    second (the lead to nine digits, so that .97 leads .92 by .05)."""
    over = W.partitionBy(key).orderBy(F.desc(score), choice)
    best = df.withColumns({"_n": F.row_number().over(over), "second_score": F.lead(score).over(over)}).where("_n = 1").drop("_n")
    clear = F.col("second_score").isNull() | (S.settled(F.col(score) - F.col("second_score")) >= gap)
    return best.withColumn("accepted", (F.col(score) >= sure) | ((F.col(score) >= least) & clear))


def resolve_in_stages(records: DataFrame, record_id: str, stages: list) -> DataFrame:
    """Entity resolution with fall-through. Each stage gets the records that none before resolved and returns
    candidates (record_id, entity_id, score); the best by (score, entity_id) counts. Adds the stage's number. Each stage is
    written once, so no stage plans those before it again."""
    left, found = records, None
    for k, stage in enumerate(stages, 1):
        best = latest_per_key(stage(left), [record_id], [F.desc("score"), "entity_id"]).select(record_id, "entity_id", "score", F.lit(k).alias("stage"))
        best = written_once(best, "resolved")
        found = best if found is None else found.unionByName(best)
        left = written_once(merged(left, best, record_id, "left_anti"), "unresolved")
    return found


def prefer_then_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of first, and what second has of keys that first lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def count_within(spans: DataFrame, points: DataFrame, span_id: list[str], keys: list[str], start: str, end: str, day: str, out: str, width: int = 32) -> DataFrame:
    """Per span the number of points of its key whose day lies in it, both ends included; 0 where there are none.

    Spans are cut at the borders of stretches of `width` days. A stretch that a span covers meets one total, one at its
    border meets the counts of its days, so all joins are by key and stretch, and a span of years takes one row a stretch
    however many points lie in it. A span with a null end or one before its start holds nothing. `span_id` is distinct.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    days = points.where(F.col(day).isNotNull()).groupBy(*keys, number(day).alias("_day")).agg(F.count("*").alias("_n")).withColumn("_stretch", F.floor(F.col("_day") / width))
    totals = days.groupBy(*keys, "_stretch").agg(F.sum("_n").alias("_n"))
    sound = spans.where(F.col(start) <= F.col(end)).select(*span_id, *(k for k in keys if k not in span_id), number(start).alias("_a"), number(end).alias("_b"))
    cut = sound.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    whole = (F.col("_a") <= F.col("_stretch") * width) & (F.col("_b") >= F.col("_stretch") * width + width - 1)
    on = [*keys, "_stretch"]
    covered = cut.where(whole).join(totals, on).groupBy(*span_id).agg(F.sum("_n").alias("_n"))
    border = cut.where(~whole).join(days, on).where(F.col("_day").between(F.col("_a"), F.col("_b"))).groupBy(*span_id).agg(F.sum("_n").alias("_n"))
    found = covered.unionByName(border).groupBy(*span_id).agg(F.sum("_n").alias(out))
    return spans.join(found, span_id, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def count_within_held(spans: DataFrame, owner: str, held: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, day: str, out: str, width: int = 32) -> DataFrame:
    """spans with the number of points whose day lies in the span, both ends included, and whose key is one of those that the
    span's owner holds (held: owner and keys, each once); 0 where there are none.

    A span is one row throughout. An owner's keys come to it as an array with the first and last day and the number of points
    of each: a key that the span covers adds its number, one that it misses nothing, and of one that a border cuts the number
    up to that day is looked up in a row a key and stretch of `width` days. Stretches are broadcast while there are no more
    than FEW_STRETCHES, and met by a shuffle beyond that. A span with a null end or one before its start holds nothing. An
    owner's keys lie in one row, and its spans in one task.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    days = written_once(points.where(F.col(day).isNotNull()).groupBy(*keys, number(day).alias("_day")).agg(F.count("*").alias("_n")), "days")
    groups = days.groupBy(*keys).agg(F.min("_day").alias("lo"), F.max("_day").alias("hi"), F.sum("_n").alias("n"))
    groups = written_once(groups.withColumn("key", F.monotonically_increasing_id()), "groups")
    place = F.struct(F.pmod("_day", F.lit(width)).alias("at"), F.col("_n").alias("n"))
    counted = days.join(groups, keys).groupBy("key", F.floor(F.col("_day") / width).alias("_stretch")).agg(F.collect_list(place).alias("_points"), F.sum("_n").alias("_sum"))  # width entries
    dense = groups.select("key", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("_stretch")).join(counted, ["key", "_stretch"], "left")
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("key").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    inside = lambda i: F.aggregate(F.filter("_points", lambda p: p["at"] <= i), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    upto = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.col("_before") + F.coalesce(inside(i), F.lit(0)))
    stretches = written_once(dense.withColumn("_before", before).select(F.col("key").alias("_key"), "_stretch", upto.alias("_upto")), "stretches")

    theirs = held.join(groups, keys).groupBy(owner).agg(F.collect_list(F.struct("key", "lo", "hi", "n")).alias("_held"))
    a, b = F.col("_a"), F.col("_b")
    row = spans.join(theirs.hint("merge"), owner, "left").withColumns({"_row": F.monotonically_increasing_id(), "_a": number(start), "_b": number(end)})
    row = row.withColumn("_met", F.filter("_held", lambda g: (a <= b) & (g["lo"] <= b) & (g["hi"] >= a)))
    border = lambda g, at, sign: F.struct(g["key"].alias("key"), at.alias("at"), F.lit(sign).cast("long").alias("sign"))
    row = row.withColumns({
        "_whole": F.aggregate(F.filter("_met", lambda g: g["hi"] <= b), F.lit(0).cast("long"), lambda s, g: s + g["n"]),
        "_cut": F.concat(F.transform(F.filter("_met", lambda g: g["hi"] > b), lambda g: border(g, b, 1)), F.transform(F.filter("_met", lambda g: g["lo"] < a), lambda g: border(g, a - 1, -1))),
    })
    asked = row.select(*spans.columns, "_row", "_whole", F.explode_outer("_cut").alias("_at"))
    known = F.broadcast(stretches) if stretches.limit(FEW_STRETCHES + 1).count() <= FEW_STRETCHES else stretches
    looked = asked.join(known, (F.col("_at.key") == F.col("_key")) & (F.floor(F.col("_at.at") / width) == F.col("_stretch")), "left")
    part = F.col("_at.sign") * F.element_at("_upto", F.pmod(F.col("_at.at"), F.lit(width)) + 1)
    sums = looked.groupBy(owner, "_row").agg(*(F.first(c).alias(c) for c in spans.columns if c != owner), (F.coalesce(F.first("_whole"), F.lit(0)) + F.coalesce(F.sum(part), F.lit(0))).alias(out))
    return sums.select(*spans.columns, out)


def asof_many(left: DataFrame, row_id: list[str], ts: str, sources: dict[str, tuple[DataFrame, list[str], list[str], str]]) -> DataFrame:
    """left plus, for each source, a struct of its columns as of the row's time: the latest source row of the key not after it.

    sources: name -> (rows, left's key columns, the source's, its time column). All sources go through one union and one
    window, however many there are; a key's rows of a source form a group of their own. Null keys and times find nothing;
    of source rows of one time the last in the order of all their columns counts. `row_id` is distinct in left.
    """
    key = lambda cols: F.to_json(F.array(*(F.col(c).cast("string") for c in cols)))
    whole = lambda cols: F.lit(True) if not cols else ~F.exists(F.array(*(F.col(c).isNull() for c in cols)), lambda x: x)
    parts = []
    for name, (rows, own, theirs, at) in sources.items():
        asked = left.where(whole(own) & F.col(ts).isNotNull())
        parts.append(asked.select(*row_id, F.lit(name).alias("_src"), key(own).alias("_key"), F.col(ts).cast("timestamp").alias("_ts"), F.lit(1).alias("_side")))
        cols = [c for c in rows.columns if c not in theirs]
        dated = rows.where(whole(theirs) & F.col(at).isNotNull())
        parts.append(dated.select(F.lit(name).alias("_src"), key(theirs).alias("_key"), F.col(at).cast("timestamp").alias("_ts"), F.lit(0).alias("_side"), F.struct(*cols).alias(name), F.to_json(F.struct(*cols)).alias("_tie")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    order = W.partitionBy("_src", "_key").orderBy("_ts", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumns({name: F.last(name, ignorenulls=True).over(order) for name in sources}).where("_side = 1")
    found = seen.groupBy(*row_id).agg(*(F.first(name, ignorenulls=True).alias(name) for name in sources))
    return left.join(found, row_id, "left")
