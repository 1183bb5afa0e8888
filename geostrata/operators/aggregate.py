"""Counts and top-k words by groupings, and the way from finer aggregates to coarser ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions import times
from geostrata.schema import GROUPS, NONE, SPACE, TIME, is_ancestor, levels_of


def count(objects: DataFrame, group: str) -> DataFrame:
    """(levels …, cnt); without levels one row with grouping `none`, or none at all if there are no objects."""
    levels = levels_of(group)
    if levels:
        return objects.groupBy(*levels).agg(F.count("*").alias("cnt"))
    return objects.agg(F.count("*").alias("cnt")).where("cnt > 0").select(F.lit(NONE).alias("grouping"), "cnt")


def word_counts(objects: DataFrame, group: str) -> DataFrame:
    """(levels …, term, freq): each occurrence of a tag counts, in the case it has."""
    levels = levels_of(group)
    return objects.select(*levels, F.explode("tags").alias("term")).groupBy(*levels, "term").agg(F.count("*").alias("freq"))


def ranked(freqs: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """The k most frequent terms of each key; of equal frequencies the first in the alphabet.

    A filter on row_number lets Spark cut each partition's groups to k rows before they are shuffled. Without keys the
    best of each partition are merged instead, as a window over everything would gather all terms in one task.
    """
    by = [F.desc("freq"), F.asc("term")]
    if keys:
        return freqs.withColumn("rnk", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rnk") <= k)
    best = freqs.orderBy(*by).limit(k)
    return best.withColumn("rnk", F.row_number().over(Window.orderBy(*by)))


def topk(objects: DataFrame, group: str, k: int) -> DataFrame:
    """(levels …, term, freq, rnk)."""
    return ranked(word_counts(objects, group), levels_of(group), k)


def approximate_topk(objects: DataFrame, group: str, k: int, counters: int = 10_000) -> DataFrame:
    """As `topk`, from a sketch of bounded size for each group: exact while a group has no more terms than counters."""
    levels = levels_of(group)
    rows = objects.select(*levels, F.explode("tags").alias("term"))
    sketch = F.expr(f"approx_top_k(term, {int(k)}, {int(counters)})").alias("top")
    found = rows.groupBy(*levels).agg(sketch) if levels else rows.agg(sketch)
    flat = found.select(*levels, F.explode("top").alias("t")).select(*levels, F.col("t.item").alias("term"), F.col("t.count").alias("freq"))
    return ranked(flat, levels, k)


def topk_sketch(objects: DataFrame, group: str, counters: int = 10_000) -> DataFrame:
    """(levels …, sketch): the state of a top-k of bounded size for each group, to be stored and merged with others."""
    levels = levels_of(group)
    rows = objects.select(*levels, F.explode("tags").alias("term"))
    sketch = F.expr(f"approx_top_k_accumulate(term, {int(counters)})").alias("sketch")
    return rows.groupBy(*levels).agg(sketch) if levels else rows.agg(sketch)


def merged_topk(sketches: list[DataFrame], group: str, k: int, counters: int = 10_000) -> DataFrame:
    """As `topk`, from the sketches of parts of the objects: exact while a group has no more terms than counters."""
    levels = levels_of(group)
    rows = reduce(DataFrame.unionByName, sketches)
    sketch = F.expr(f"approx_top_k_combine(sketch, {int(counters)})").alias("sketch")
    found = rows.groupBy(*levels).agg(sketch) if levels else rows.agg(sketch)
    terms = found.select(*levels, F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(counters)})")).alias("t"))
    return ranked(terms.select(*levels, F.col("t.item").alias("term"), F.col("t.count").alias("freq")), levels, k)


def top_lists(best: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The ranked terms of each key as one list of `term:freq`."""
    items = F.sort_array(F.collect_list(F.struct("rnk", F.concat_ws(":", "term", "freq").alias("item"))))
    return best.groupBy(*keys).agg(F.transform(items, lambda x: x["item"]).alias("terms"))


def merged_counts(parts: DataFrame, keys: tuple[str, ...], value: str = "cnt") -> DataFrame:
    """Partial aggregates of the same keys summed up."""
    return parts.groupBy(*keys).agg(F.sum(value).alias(value)) if keys else parts.agg(F.sum(value).alias(value)).where(F.col(value).isNotNull())


def roll_up(fine: DataFrame, fine_group: str, coarse_group: str, countries: DataFrame | None = None, value: str = "cnt", extra: tuple[str, ...] = ()) -> DataFrame:
    """An aggregate by a coarser grouping from a finer one; `extra` are further key columns, such as a cell or a term.

    A country is looked up in `countries` (city, country) unless the finer aggregate has it.
    """
    if fine_group != coarse_group and not is_ancestor(fine_group, coarse_group):
        raise ValueError(f"{coarse_group} doesn't follow from {fine_group}")
    have = levels_of(fine_group)
    rows = fine
    if "country" in levels_of(coarse_group) and "country" not in fine.columns:
        if countries is None:
            raise ValueError("a roll-up from cities needs their countries")
        rows = rows.join(countries, "city")
    own_time = next((x for x in have if x in TIME), None)
    keys: list[Column] = [times.rolled_up(F.col(own_time), own_time, x).alias(x) if x in TIME else F.col(x) for x in levels_of(coarse_group)]
    rows = rows.select(*extra, *keys, value)
    out = merged_counts(rows, (*extra, *levels_of(coarse_group)), value)
    return out.select(F.lit(NONE).alias("grouping"), value) if coarse_group == NONE and not extra else out


def countries_of(objects: DataFrame) -> DataFrame:
    """(city, country): of several countries of one city, that of its latest object."""
    return objects.groupBy("city").agg(F.max_by("country", F.struct("ts", "id")).alias("country"))


def group_id(columns: dict[str, Column]) -> Column:
    """A number for a grouping: one bit for each level that is not in it, country the highest, topic the lowest."""
    return sum((c.cast("int") * (1 << (6 - i)) for i, c in enumerate(columns.values())), F.lit(0))


def lattice(objects: DataFrame, extra: tuple[str, ...] = (), groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """Counts by all groupings in one scan: (extra …, seven levels, grp, cnt), levels outside of a grouping being null.

    Objects are first aggregated by the finest levels; only that result is multiplied by the number of groupings.
    """
    names = [*SPACE, *TIME, "topic"]
    return grouped(objects.groupBy(*extra, *names).agg(F.count("*").alias("n")), extra, groups)


def grouped(base: DataFrame, extra: tuple[str, ...], groups: tuple[str, ...]) -> DataFrame:
    """The same from counts `n` by the finest levels that the groupings have."""
    names = [*SPACE, *TIME, "topic"]
    sets = [[*(F.col(x) for x in extra), *(F.col(x) for x in levels_of(g))] for g in groups]
    marks = {x: F.grouping(x) for x in names}
    if set(groups) != set(GROUPS):  # every level needs to be in some set
        used = {x for g in groups for x in levels_of(g)}
        marks = {x: F.grouping(x) if x in used else F.lit(1) for x in names}
        return base.groupingSets(sets, *extra, *(x for x in names if x in used)).agg(group_id(marks).alias("grp"), F.sum("n").alias("cnt"))
    return base.groupingSets(sets, *extra, *names).agg(group_id(marks).alias("grp"), F.sum("n").alias("cnt"))


def id_of(group: str) -> int:
    """The number that `lattice` gives a grouping."""
    have = levels_of(group)
    return sum(1 << (6 - i) for i, x in enumerate([*SPACE, *TIME, "topic"]) if x not in have)


def raised(leaves: DataFrame, depth: int, value: str, *keys: str) -> DataFrame:
    """An aggregate by leaf node carried up to the nodes of all levels."""
    down = F.col("__down")
    row, col = F.shiftright("node", 20).bitwiseAND(F.lit((1 << 20) - 1)), F.col("node").bitwiseAND(F.lit((1 << 20) - 1))
    scale = F.pow(F.lit(2), down).cast("bigint")
    node = F.shiftleft((F.lit(depth) - down).cast("bigint"), 40) + F.shiftleft(F.floor(row / scale).cast("bigint"), 20) + F.floor(col / scale).cast("bigint")
    rows = leaves.withColumn("__down", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    return rows.select(node.alias("node"), *keys, value).groupBy("node", *keys).agg(F.sum(value).alias(value))
