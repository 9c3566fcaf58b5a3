"""Filter audits: what each filter removes in every order of application, and its fair share."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial, lcm
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import written

BLANK = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions under which the filters that look at one text alone remove it; none is null for a text."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    total, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": total < 200,
        "B": 100 * different < 50 * total,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def bits(failures: list[Column]) -> Column:
    """The failed filters as bits of one integer, the first the lowest."""
    return reduce(add, [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures)])


def repeats(keyed: DataFrame) -> DataFrame:
    """Add ``repeated``: whether a smaller doc_id has the same ``key``.

    The smallest id of each key is found by partial minima; a row is then looked up by key and id
    together, so a key that a third of all rows share is spread by its ids.  A row without an id is
    neither smaller nor larger than others.
    """
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("key", "first_key")
    same = (F.col("key") == F.col("first_key")) & (F.col("doc_id") == F.col("first_id"))
    found = keyed.join(first, same, "left")
    return found.withColumn("repeated", F.col("doc_id").isNotNull() & F.col("first_id").isNull()).drop("first_key", "first_id")


def fail_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, documents, good, toxic): the documents of each language by the set of filters they fail.

    ``fails`` has bit i for the i-th letter of ABCDE.  A document is good or toxic if any of its rows
    in ``labels`` says so.  Whole texts are read once; what is shuffled is a key of 32 bytes, an id and
    a few bits per row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = written(
        docs.select(
            "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"),
            bits(list(text_failures(text).values())).alias("fails"),
        ),
        "keyed",
    )
    told = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    found = repeats(keyed).join(told, F.col("doc_id") == F.col("labelled"), "left")
    fails = (F.col("fails") + F.when(F.col("repeated"), 16).otherwise(0)).alias("fails")
    sums = {"documents": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}
    return found.groupBy("part", fails).agg(*[F.sum(c).cast("long").alias(name) for name, c in sums.items()])


def summed(values: Column, places: Column) -> Column:
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, i: total + F.get(values, i))


def removed_by(counts: Column, filters: int) -> Column:
    """The removal game: for each coalition of filters, in order of its bits, how much it removes together."""
    sets = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    return F.transform(sets, lambda s: summed(counts, F.filter(sets, lambda fails: fails.bitwiseAND(s) > 0)))


def potential(game: Column, filters: int, scale: int) -> Column:
    """``scale`` times the Hart-Mas-Colell potential of each coalition: P(S) = (v(S) + sum of P(S - i)) / |S|.

    Coalitions come in order of their bits, so all smaller ones are there.  ``scale`` is a multiple of
    1..filters, so every division is exact.
    """

    def grow(found: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(1 << i) > 0, F.get(found, s - (1 << i))).otherwise(0) for i in range(filters)]
        total = F.lit(scale).cast("long") * F.get(game, s) + reduce(add, without)
        return F.array_append(found, F.call_function("div", total, F.bit_count(s).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), grow)


def audit_orders(fails: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of ``fail_sets``.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley: the filter's removals summed over all orders.  With n filters it is n! times the grand
    potential minus the potential without the filter; differences of coalitions give the steps.
    No part, no rows; every part has all orders and steps, zeros included.
    """
    n, sets = len(filters), range(1 << len(filters))
    scale, orders = lcm(*range(1, n + 1)), ["".join(p) for p in permutations(filters)]
    by_set = lambda value: F.array(*[F.sum(F.when(F.col("fails") == s, F.col(value)).otherwise(0)).cast("long") for s in sets])
    values = ("documents", "good", "toxic")
    parts = (
        fails.groupBy("part").agg(*[by_set(v).alias(v) for v in values])
        .withColumns({f"{v}_game": removed_by(F.col(v), n) for v in values})
        .withColumn("potential", potential(F.col("documents_game"), n, scale))
    )
    steps = (
        parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("own", F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
        .withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("own")))
        .withColumn(
            "before",
            F.aggregate(
                F.sequence(F.lit(1), F.lit(n)), F.lit(0),
                lambda s, i: s + F.when(
                    i < F.col("step"), F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.substring("filter_order", i, F.lit(1))) - 1)
                ).otherwise(0),
            ),
        )
        .withColumn("after", F.col("before") + F.col("bit"))
    )
    lost = lambda v: F.get(f"{v}_game", F.col("after")) - F.get(f"{v}_game", F.col("before"))
    whole = len(sets) - 1
    everything = summed(F.col("documents"), F.sequence(F.lit(0), F.lit(whole)))
    share = F.element_at("potential", -1) - F.get("potential", F.lit(whole) - F.col("bit"))
    return steps.select(
        "part", "filter_order", "step",
        (everything - F.get("documents_game", F.col("after"))).alias("kept"),
        lost("documents").alias("removed"),
        (F.get("documents_game", F.col("bit")) - lost("documents")).alias("redundant"),
        F.get("documents", F.col("bit")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        (share * (factorial(n) // scale)).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction audit of the five filters of ``fail_sets`` over whole texts, by language.

    A null text is empty, a null language the part "".  Rows may repeat: rows with one id do not repeat
    each other.  An empty table gives no rows.
    """
    return audit_orders(fail_sets(docs, labels))


ORACLE_SQL = r"""
WITH told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM texts),
counted AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failing LEFT JOIN told USING (doc_id) GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own,
    substr(filter_order, 1, step - 1) AS before, substr(filter_order, 1, step) AS after
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
judged AS (
  SELECT part, filter_order, step, own, fails = own AS alone, n, good, toxic, contains(fails, own) AS failed,
    translate(fails, before, '') <> fails AS earlier, translate(fails, after, '') <> fails AS gone
  FROM counted, steps),
audited AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN gone THEN 0 ELSE n END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN failed AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN failed AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN failed AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN failed AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audited"""
