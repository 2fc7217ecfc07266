"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import pair_lists
from lectern.operators.lineage import cut_lineage, let_workers_import


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row of every key.

    ``row_number() = 1`` is planned with a group limit below the shuffle, so a task sends at
    most one row per key and a hot key costs no more than a rare one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_rows_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Keep the first ``n`` rows of every key (same group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_rows_per_key(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Keep the ``n`` rows with the highest ``order`` of every key (same group limit)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def ordered_ids(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number the rows so that the numbers follow ``order``; they are not consecutive.

    A distributed sort puts the partitions in order, and the numbers of a later partition are
    higher.  The result is written out, which fixes the numbers once and for all.
    """
    return cut_lineage(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))


def pairs_sharing(
    members: DataFrame, group: str, member: str, carry: Sequence[str] = (), block: int = 256
) -> DataFrame:
    """Unordered pairs of members of one group, as (group, a, b) with ``a < b``.

    ``members`` must hold each (group, member) once.  A group of more than ``block`` members is
    cut into blocks and each pair of blocks is a join key of its own, so no task ever sees the
    whole of a hot group.  ``carry`` columns come back as ``<name>_a`` and ``<name>_b``.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_n"))
    heavy = sizes.filter(F.col("_n") > block).select(
        F.col(group), F.ceil(F.col("_n") / block).cast("int").alias("_blocks")
    )
    # heavy groups are at most rows/block, usually none: the planner broadcasts them only if
    # their measured size allows it
    placed = (
        members.join(heavy, group, "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        .withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    )
    payload = F.struct(F.col(member).alias("m"), *[F.col(c) for c in carry])
    left = placed.select(
        F.col(group), F.col("_own").alias("_i"), payload.alias("l"),
        F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1)).alias("_j"),
    )
    right = placed.select(
        F.col(group), F.col("_own").alias("_j"), payload.alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"),
    )
    joined = left.join(right, [group, "_i", "_j"]).filter(
        (F.col("l.m") < F.col("r.m")) | ((F.col("_i") < F.col("_j")) & (F.col("l.m") > F.col("r.m")))
    )
    low = F.when(F.col("l.m") < F.col("r.m"), F.col("l")).otherwise(F.col("r"))
    high = F.when(F.col("l.m") < F.col("r.m"), F.col("r")).otherwise(F.col("l"))
    return joined.select(group, low.alias("_low"), high.alias("_high")).select(
        group,
        F.col("_low.m").alias("a"),
        F.col("_high.m").alias("b"),
        *[F.col(f"_low.{c}").alias(f"{c}_a") for c in carry],
        *[F.col(f"_high.{c}").alias(f"{c}_b") for c in carry],
    )


def consecutive_ids(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order``; what the driver sees is one count for each task of the sort."""
    numbered = ordered_ids(df, order, name)
    counts = dict(numbered.groupBy(F.shiftright(name, 33).alias("task")).count().collect())
    starts = [0, *itertools.accumulate(counts.get(task, 0) for task in range(max(counts, default=0)))]
    start = F.element_at(F.array(*map(F.lit, starts)).cast("array<long>"), (F.shiftright(name, 33) + 1).cast("int"))
    return numbered.withColumn(name, start + F.col(name).bitwiseAND((1 << 33) - 1))


def least_shared_group(members: DataFrame, group: str, member: str, block: int = 256, most: int = 1 << 23) -> DataFrame:
    """(a, b, group) for every pair of members with ``a < b`` that share a group: the least group they share.

    ``members`` must hold each (group, member) once, both numbers.  A group of more than ``block`` members is
    collected in several lists.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_n"))
    # written, so that their size is known when the members are joined with them
    heavy = cut_lineage(sizes.filter(F.col("_n") > block).select(group, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    placed = members.join(heavy, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    lists = cut_lineage(
        placed.repartition(group, "_own").groupBy(group, "_own", "_blocks").agg(F.sort_array(F.collect_list(member)).alias("_of"))
    )
    return least_group_of_lists(lists, group, most)


def cut_lists(lists: DataFrame, of: str, block: int = 256) -> DataFrame:
    """The sorted lists ``of`` as ``least_group_of_lists`` takes them: at most ``block`` members in one."""
    blocks = F.ceil(F.size(of) / block).cast("int")
    others = [c for c in lists.columns if c != of]
    cut = lists.select(*others, of, blocks.alias("_blocks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_own"))
    return cut.select(*others, "_own", "_blocks", F.slice(of, F.col("_own") * block + 1, F.lit(block)).alias("_of"))


def least_group_of_lists(lists: DataFrame, group: str, most: int = 1 << 23, label: str | None = None) -> DataFrame:
    """(a, b, group) for every pair ``a < b`` that share a group, from its members in sorted lists; with ``label`` also that column of the group.

    ``lists``: group, _own, _blocks, _of: the list number _own of the _blocks lists of a group.  Lists travel instead
    of pairs: a range of members is sent, once a list, with the members after it to the task that holds all
    pairs of the range; there they are unpacked, reduced a few million at a time and come back as one row a
    member.  Lists of one group meet two by two.  Ranges are cut by counted pairs, about ``most`` a task, and
    the pairs of a range that has more are dealt over several tasks by the other member.
    """
    spark, kinds = lists.sparkSession, dict(lists.dtypes)
    member_kind, labels = kinds["_of"].removeprefix("array<").removesuffix(">"), [label] if label else []
    many = lists.filter("_blocks > 1")
    left = many.filter("_own < _blocks - 1").select(
        group, *labels, F.col("_of").alias("_l"), F.explode(F.sequence(F.col("_own") + 1, F.col("_blocks") - 1)).alias("_j")
    )
    met = left.join(many.select(group, F.col("_own").alias("_j"), F.col("_of").alias("_r")), [group, "_j"])
    rows = lists.filter(F.size("_of") > 1).select(group, *labels, F.col("_of").alias("_l"), F.lit(None).cast(kinds["_of"]).alias("_r"))
    rows = rows.unionByName(met.select(group, *labels, "_l", "_r"))

    ends = lists.agg(F.min(group), F.max(group), F.min(F.element_at("_of", 1)), F.max(F.element_at("_of", -1))).first()
    least_group, last_group, least, last = (x or 0 for x in ends)
    width = (last - least) // (1 << 16) + 1
    # an upper bound of a member's pairs: those after it in its own list, all of the other lists
    pairs_of = lists.select((F.size("_of").cast("long") * F.col("_blocks")).alias("_n"), F.posexplode("_of").alias("_at", "a"))
    counted = pairs_of.groupBy(F.expr(f"(a - {least}L) div {width}L").alias("_range")).agg(F.sum(F.expr("_n - _at - 1")).alias("_n")).collect()
    first, pieces, lows = _tasks_of_ranges({r[0]: r[1] for r in counted}, most)
    bounds = {"least": least, "width": width, "first": first, "pieces": pieces}
    sent = "_task int, _g binary, _nl binary, _l binary, _nr binary, _r binary" + (f", {label} array<string>" if label else "")
    let_workers_import(spark)
    parts = rows.mapInArrow(partial(pair_lists.deal, group=group, label=label, **bounds), sent).repartitionById(len(lows), "_task")
    found = f"a {member_kind}, _after array<struct<b: {member_kind}, {group}: {kinds[group]}" + (f", {label}: string" if label else "") + ">>"
    reduced = parts.mapInArrow(partial(
        pair_lists.reduce, group=group, label=label, member_kind=member_kind, group_kind=kinds[group], least=least, last=last, least_group=least_group,
        last_group=last_group, lows=[least + low * width for low in lows],
    ), found)
    return reduced.select("a", F.explode("_after").alias("_x")).select("a", "_x.b", *[f"_x.{c}" for c in (group, *labels)])


def _tasks_of_ranges(pairs: dict[int, int], most: int) -> tuple[list[int], list[int], list[int]]:
    """For each range of members its first task and over how many tasks it is dealt; for each task the first range it holds."""
    first, pieces, lows, held = [], [], [], 0
    for k in range(max(pairs, default=0) + 1):
        n = pairs.get(k, 0)
        if n > most or not lows or held + n > most:
            lows.append(k)
            held = 0
        first.append(len(lows) - 1)
        pieces.append(max(1, -(-n // most)))
        lows.extend([k] * (pieces[-1] - 1))
        held = most + 1 if pieces[-1] > 1 else held + n
    return first, pieces, lows


def next_event(probes: DataFrame, events: DataFrame, key: str, at: str) -> DataFrame:
    """For each (key, at) of ``probes`` the smallest ``at`` of ``events`` that is greater.

    Both sides are sorted together over all partitions by (key, at), so a frequent key lies in as many
    ranges as its rows need and no probe is copied.  Within a range the next event is a window; a probe behind the
    last event of its range takes the first event of the ranges after it, which one row a key and range tells.
    Rows without a later event are dropped.
    """
    both = events.select(key, at, F.lit(True).alias("_event")).unionByName(probes.select(key, at, F.lit(False).alias("_event"))).distinct()
    # equal (key, at) fall into one range
    ranged = cut_lineage(both.repartitionByRange(key, at).withColumn("_range", F.spark_partition_id()))
    firsts = ranged.groupBy(key, "_range").agg(F.min(F.when(F.col("_event"), F.col(at))).alias("_first"))
    after = Window.partitionBy(key).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select(key, "_range", F.min("_first").over(after).alias("_carried")).filter("_carried IS NOT NULL")
    later = Window.partitionBy(key, "_range").orderBy(F.col(at).desc(), F.col("_event")).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("_next", F.last(F.when(F.col("_event"), F.col(at)), ignorenulls=True).over(later)).filter(~F.col("_event"))
    found = found.join(carried, [key, "_range"], "left").select(key, at, F.coalesce("_next", "_carried").alias("next_at"))
    return found.filter("next_at IS NOT NULL")


def products_within(left: DataFrame, right: DataFrame, group: str, block: int = 256) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` of the same group.

    Each side of a group is cut into blocks by its counted size and each pair of blocks is a join key of its
    own, so no task sees the whole of a large group.
    """
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    blocks = sizes(left, "_n").join(sizes(right, "_m"), group)

    def dealt(df: DataFrame, mine: str, of_mine: str, other: str, of_other: str) -> DataFrame:
        placed = df.join(blocks, group).withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.col(of_mine)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(of_other) - 1))).drop("_n", "_m")

    return dealt(left, "_i", "_n", "_j", "_m").join(dealt(right, "_j", "_m", "_i", "_n"), [group, "_i", "_j"]).drop("_i", "_j")
