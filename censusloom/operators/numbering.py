"""Running totals, row numbers and random ranks inside groups of any size.

A plain ``row_number() over (partition by key)`` puts a whole group in one task. Rows of a
group are ordered by a hash of the order columns, then by these. A group above ``hot_rows``
is split into ranges of that hash, as many as its own size asks for; each range is numbered
on its own and its start is added. As ranges follow the order, the answer is the same
whether and how far a group is split. Sizes are counted once, and say whether anything has to
be split at all; lists of split groups and their ranges are broadcast only if they are small.

Rows with equal order columns have equal hashes and can't be told apart by ranges. A run of
more than ``hot_rows`` of them is numbered as one row that counts many times, and its rows by
themselves, by their other columns; rows equal in all columns are one row with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from censusloom.functions.hashing import round_keys, stable_hash, with_permuted
from censusloom.runtime import broadcast_if, shuffle_width, written

#: Groups with more rows than this are split.
HOT_ROWS = 1_000_000
#: Width of ``stable_hash``.
HASHES = 1 << 60
#: Rows one task makes from one count; larger counts are spread over tasks.
CHUNK = 100_000


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def hash_range(column: str, parts: Column) -> Column:
    """Which of ``parts`` equal ranges of ``stable_hash`` a hash lies in; grows with the hash."""
    return F.floor(F.col(column) / F.ceil(F.lit(HASHES) / parts)).cast("long")


def group_sizes(df: DataFrame, keys: Sequence[str], out: str = "__rows") -> DataFrame:
    """Rows per group, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


class HotGroups(NamedTuple):
    """Groups to split: ``rows`` has their keys as ``__hot_<key>`` and the number of ``__parts``, or is None."""

    rows: DataFrame | None
    parts: int = 0
    key_bytes: int = 0

    @property
    def list_bytes(self) -> int:
        """Size of a list with one entry a part."""
        return self.parts * 64 + self.key_bytes


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> HotGroups:
    """Groups of more than ``hot_rows`` rows: one aggregation, one row back if there are none."""
    hot = group_sizes(df, keys).where(F.col("__rows") > hot_rows).select(
        *[F.col(k).alias("__hot_" + k) for k in keys],
        F.ceil(F.col("__rows") / F.lit(hot_rows)).alias("__parts"),
    )
    hot = written(hot, "hot-groups")
    wide = sum([F.coalesce(F.octet_length(F.col("__hot_" + k).cast("string")), F.lit(0)) for k in keys], F.lit(0))
    parts, size = hot.agg(F.sum("__parts"), F.sum(wide * F.col("__parts"))).first()
    return HotGroups(hot, parts, size) if parts else HotGroups(None)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    hot_rows: int = HOT_ROWS,
    with_totals: bool = True,
    hashed: Sequence[str] | None = None,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Add ``<name>_before`` and, if asked for, ``<name>_total`` for every named value.

    ``_before`` is the sum of the value over the rows of the group that come earlier in a
    fixed order, ``_total`` the sum over the whole group. Null keys form a group. Rows come in
    the order of ``stable_hash(*hashed)``, then of ``order``; ``hashed`` is ``order`` if not given.
    ``hot`` says which groups to split if that is known already.
    """
    hot = hot_groups(df, keys, hot_rows) if hot is None else hot
    split = df.withColumns(
        {f"__v_{name}": value for name, value in values.items()} | {"__hash": stable_hash(*(hashed or order))}
    )
    parted = [*keys]
    if hot.rows is not None:
        parted.append("__part")
        listed = broadcast_if(hot.rows, hot.list_bytes)
        split = split.join(listed, _same(keys, "__hot_"), "left").withColumn(
            "__part", F.coalesce(hash_range("__hash", F.col("__parts")), F.lit(0).cast("long"))
        ).drop(*["__hot_" + k for k in keys])
    in_part = Window.partitionBy(*parted)
    so_far = in_part.orderBy("__hash", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = split.withColumns(
        {f"{name}_before": F.sum(f"__v_{name}").over(so_far) - F.col(f"__v_{name}") for name in values}
        | {f"{name}_total": F.sum(f"__v_{name}").over(in_part) for name in values if with_totals}
    )
    added = [f"{name}_before" for name in values] + [f"{name}_total" for name in values if with_totals]
    if hot.rows is None:
        return numbered.select(*df.columns, *added)

    starts = split.where(F.col("__parts").isNotNull()).groupBy(*parted).agg(
        *[F.sum(f"__v_{name}").alias(f"__s_{name}") for name in values]
    )
    up_to_part, all_parts = Window.partitionBy(*keys).orderBy("__part"), Window.partitionBy(*keys)
    starts = starts.select(
        *[F.col(c).alias("__at_" + c) for c in parted],
        *[
            (F.sum(f"__s_{name}").over(up_to_part) - F.col(f"__s_{name}")).alias(f"__b_{name}")
            for name in values
        ],
        *[F.sum(f"__s_{name}").over(all_parts).alias(f"__t_{name}") for name in values],
    )
    starts = broadcast_if(starts, hot.list_bytes + 16 * len(values) * hot.parts)
    joined = numbered.join(starts, _same(parted, "__at_"), "left")
    moved = {f"{name}_before": F.col(f"{name}_before") + F.coalesce(f"__b_{name}", F.lit(0)) for name in values}
    moved |= {f"{name}_total": F.coalesce(f"__t_{name}", f"{name}_total") for name in values if with_totals}
    return joined.select(*df.columns, *[moved[c].alias(c) for c in added])


def repeat_rows(
    df: DataFrame,
    count: str | Column,
    out: str = "copy",
    chunk: int = CHUNK,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Repeat each row ``count`` times, numbering the copies ``0 .. count-1`` in ``out``.

    Rows whose count is null, zero or negative vanish. A large count is cut into chunks
    that are shuffled before they are unrolled, so one row never fills one task. ``keys``
    are the columns the shuffle hashes, by default all.
    """
    count = F.col(count) if isinstance(count, str) else count
    chunks = (
        df.withColumn("__count", count.cast("long"))
        .where(F.col("__count") > 0)
        .withColumn("__from", F.explode(F.expr(f"sequence(0L, __count - 1, {chunk}L)")))
    )
    spread = chunks.repartition(
        shuffle_width(df.sparkSession), F.xxhash64(*(keys or _hashable(df)), "__from")
    )
    unrolled = F.expr(f"sequence(__from, least(__from + {chunk}L, __count) - 1)")
    return spread.select(*df.columns, F.explode(unrolled).alias(out))


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    size: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of each group ``0 .. K-1``; ``size`` names a column for K itself.

    Rows with equal order columns get the numbers of their run in any order. A run of more than
    ``hot_rows`` such rows is split by its other columns, which then must not hold maps.
    """
    size_col = [F.col("__row_total").alias(size)] if size else []
    hot = hot_groups(df, keys, hot_rows)
    places = [*dict.fromkeys([*keys, *order])]
    runs = None
    if hot.rows is not None:
        inside = df.join(broadcast_if(hot.rows, hot.list_bytes), _same(keys, "__hot_"), "left_semi")
        runs = hot_groups(inside, places, hot_rows)
    if runs is None or runs.rows is None:
        totals = running_totals(df, keys, order, {"__row": F.lit(1).cast("long")}, hot_rows, size is not None, hot=hot)
        return totals.select(*df.columns, F.col("__row_before").alias(out), *size_col)

    listed = broadcast_if(runs.rows, runs.list_bytes)
    among = _same(places, "__hot_")
    # a row equal in all columns to others stands for them
    equal = df.join(listed, among, "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__times"))
    equal = written(equal, "equal-rows")
    leads = equal.groupBy(*places).agg(F.sum("__times").alias("__times")).withColumn("__lead", F.lit(True))
    rest = df.join(listed, among, "left_anti").withColumns({"__times": F.lit(1).cast("long"), "__lead": F.lit(False)})
    mixed = rest.unionByName(leads, allowMissingColumns=True)
    totals = running_totals(mixed, keys, order, {"__row": F.col("__times")}, hot_rows, size is not None, hot=hot)
    totals = totals.select(*df.columns, "__lead", F.col("__row_before").alias(out), *size_col)
    starts = totals.where("__lead").select(
        *[F.col(c).alias("__hot_" + c) for c in places], F.col(out).alias("__start"), *([size] if size else [])
    )
    others = [c for c in df.columns if c not in places] or places
    own = running_totals(equal, places, others, {"__in": F.col("__times")}, hot_rows, with_totals=False)
    own = own.join(broadcast_if(starts, runs.list_bytes), among).drop(*["__hot_" + c for c in places])
    own = repeat_rows(own, "__times", "__copy", min(CHUNK, hot_rows), others)
    number = F.col("__start") + F.col("__in_before") + F.col("__copy")
    own = own.select(*df.columns, number.alias(out), *([size] if size else []))
    return totals.where("not __lead").drop("__lead").unionByName(own)


def shuffled_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """A random permutation of ``0 .. K-1`` over the rows of each group.

    ``order`` fixes which row is which, so that the same seed gives the same ranks.
    """
    numbered = number_rows(df, keys, order, "__row", "__size", hot_rows).withColumn(
        "__keys", round_keys(seed, *keys)
    )
    return with_permuted(numbered, "__row", "__size", "__keys", out).select(*df.columns, out)


def ordered_totals(
    df: DataFrame, buckets: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows earlier in ``(buckets, order)`` order.

    No global sort: rows are summed inside their bucket and the bucket's start is added.
    The caller picks bucket columns with a bounded number of values, since one row per
    bucket goes through a single window and a broadcast.
    """
    in_bucket = Window.partitionBy(*buckets).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*buckets)
        .agg(F.sum(value).alias("__sum"))
        .select(
            *[F.col(b).alias("__at_" + b) for b in buckets],
            F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"),
        )
    )
    inside = df.withColumn("__inside", F.sum(value).over(in_bucket) - F.col(value))
    joined = inside.join(F.broadcast(starts), _same(buckets, "__at_"), "left")
    return joined.select(*df.columns, (F.col("__start") + F.col("__inside")).alias(out))
