"""Census count tables: joining, renaming, stacking and turning them long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from censusloom.operators.addresses import rename_clashes
from censusloom.operators.allocate import repeat_rows
from censusloom.operators.areas import own_columns
from censusloom.operators.numbering import number_rows
from censusloom.runtime import broadcast_if, written


def cast_like(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Cast a column to the type of a column of another frame. Unreadable text is an error."""
    wanted = other.schema[other_column].dataType
    if df.schema[column].dataType == wanted:
        return df
    return df.withColumn(column, F.col(column).cast(wanted))


def join_census_with_coords(
    census: DataFrame,
    coords: DataFrame,
    left_code_col: str = "SA1_CODE_2021",
    right_code_col: str = "SA1_CODE21",
) -> DataFrame:
    """Inner join of counts and addresses on the area code, which keeps its left name."""
    left = cast_like(census, left_code_col, coords, right_code_col)
    right = coords
    if left_code_col != right_code_col:
        right = rename_clashes(left, right, [right_code_col])
        right = right.withColumnRenamed(right_code_col, left_code_col)
    else:
        right = rename_clashes(left, right, [left_code_col])
    return left.join(right, left_code_col, "inner")


#: Rows of the product of one key that one group of rows makes at most, and rows a table has in a group.
PRODUCT, GROUP = 1_000_000, 1_000


def _multiplicities(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Rows of each table for each key, ``(key, __m array<long>)``. Counted before the shuffle; null keys are left out."""
    keys = reduce(
        DataFrame.unionByName,
        [df.select(key, F.lit(i).alias("__table")) for i, df in enumerate(frames.values())],
    ).where(F.col(key).isNotNull())
    return keys.groupBy(key).agg(F.array(*[F.count_if(F.col("__table") == i) for i in range(len(frames))]).alias("__m"))


def _repeats_a_key(frames: Mapping[str, DataFrame], key: str) -> bool:
    """Whether some table has a key twice. One job over the key columns, one row back."""
    return not _multiplicities(frames, key).where("array_max(__m) > 1").limit(1).isEmpty()


def _hot_products(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Keys whose rows make too large a product, with the number of blocks ``__b`` each table is cut into for them.

    What a group of one block from each table makes is at most ``PRODUCT`` rows.
    """
    many = "size(filter(__m, m -> m > 1))"
    rows = f"greatest(least(floor(power({PRODUCT}D, 1D / greatest({many}, 1)) + 1e-9), {GROUP}), 2)"
    blocks = F.expr(f"transform(__m, m -> greatest(cast(ceil(m / {rows}) as bigint), 1L))")
    return _multiplicities(frames, key).select(key, blocks.alias("__b")).where("array_max(__b) > 1")


def _joined_products(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of tables that repeat keys, without a chain of joins.

    The rows of all tables are stacked and meet in one shuffle, as one list a table, and the lists are
    multiplied out. A key with many rows is cut: each table's rows of it are numbered and put in blocks, and a
    group has one block of every table, so that the groups make all pairs once and none is large.
    """
    names = list(frames)
    hot = written(_hot_products(frames, key), "hot-keys")
    n_hot = hot.count()
    listed = broadcast_if(hot, n_hot * 16 * (len(names) + 4))
    parts = []
    for i, df in enumerate(frames.values()):
        own = [c for c in df.columns if c != key]
        row = F.struct(*[F.col(f"`{c}`") for c in own]).alias(f"__t{i}")
        known = df.where(F.col(key).isNotNull())
        if not n_hot:
            parts.append(known.select(key, F.lit(0).cast("long").alias("__cell"), row))
            continue
        parts.append(known.join(listed, key, "left_anti").select(key, F.lit(0).cast("long").alias("__cell"), row))
        placed = number_rows(known.join(listed, key, "left_semi"), [key], own or [key], "__at").join(listed, key)
        # all groups that have this row's block of this table
        step = f"aggregate(slice(__b, 1, {i}), 1L, (a, b) -> a * b)"
        above = f"aggregate(slice(__b, {i + 2}, {len(names)}), 1L, (a, b) -> a * b)"
        cells = f"flatten(transform(sequence(0L, {above} - 1), h -> transform(sequence(0L, {step} - 1), l -> (h * __b[{i}] + __at % __b[{i}]) * {step} + l)))"
        parts.append(placed.select(key, F.explode(F.expr(cells)).alias("__cell"), row))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lists = stacked.groupBy(key, "__cell").agg(*[F.collect_list(f"__t{i}").alias(f"__t{i}") for i in range(len(names))])
    for i in range(len(names)):
        lists = lists.withColumn(f"__t{i}", F.explode_outer(f"__t{i}"))
    features = [F.col(f"__t{i}")[c].alias(c) for i, df in enumerate(frames.values()) for c in df.columns if c != key]
    joined = lists.select(key, *features)
    alone = [df.where(F.col(key).isNull()) for df in frames.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [joined, *alone])


def _told_apart(frames: Mapping[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Give a feature a later table repeats the name ``<feature>__<table>``."""
    seen: set[str] = set()
    result = {}
    for name, df in frames.items():
        again = {c: f"{c}__{name}" for c in df.columns if c != key and c in seen}
        result[name] = df.withColumnsRenamed(again)
        seen.update(result[name].columns)
    return result


def join_census_frames(
    frames: Mapping[str, DataFrame],
    join_col: str = "SA1_CODE_2021",
    unique_keys: bool | None = None,
) -> DataFrame:
    """Full outer join of count tables on their code.

    Tables that have each code once are stacked and grouped: one shuffle for any number of
    tables. Where a table repeats a code the rows of a code are multiplied, with one shuffle too.
    ``unique_keys=None`` looks this up. A null code never matches.
    """
    tables = _told_apart(frames, join_col)
    if len(tables) == 1:
        return next(iter(tables.values()))
    if unique_keys is None:
        unique_keys = not _repeats_a_key(tables, join_col)
    if not unique_keys:
        kind = next(iter(tables.values())).schema[join_col].dataType
        same = {n: df.withColumn(join_col, F.col(join_col).cast(kind)) for n, df in tables.items()}
        return _joined_products(same, join_col)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables.values())
    features = [c for c in stacked.columns if c != join_col]
    grouped = (
        stacked.where(F.col(join_col).isNotNull())
        .groupBy(join_col)
        .agg(*[F.max(f"`{c}`").alias(c) for c in features])
    )
    return grouped.unionByName(stacked.where(F.col(join_col).isNull()))


def census_long(
    frames: Mapping[str, DataFrame], features: Sequence[str], join_col: str = "SA1_CODE_2021"
) -> DataFrame:
    """Counts as ``(table, code, feature, n)`` for the wanted features only.

    Each feature is read from the first table that has it, as in the wide join, and no table
    is joined or shuffled. Null, zero and negative counts are left out.
    """
    tables = _told_apart(frames, join_col)
    missing = [f for f in features if not any(f in df.columns for df in tables.values())]
    if missing:
        raise ValueError(f"no table has the features {missing}")
    parts = []
    for name, df in tables.items():
        own = [f for f in features if f in df.columns]
        if own:
            picked = df.select(join_col, *[F.col(f"`{f}`").cast("long").alias(f) for f in own])
            parts.append(
                picked.unpivot([join_col], [F.col(f"`{f}`") for f in own], "feature", "n").withColumn("table", F.lit(name))
            )
    stacked = reduce(DataFrame.unionByName, parts).where("n > 0")
    return stacked.select("table", join_col, "feature", "n")


def standardize_names(
    frames: Mapping[str, DataFrame],
    census_metadata: DataFrame,
    census_code_col: str = "DataPackfile",
    abbreviation_column_name: str = "Short",
    long_column_name: str = "Long",
) -> dict[str, DataFrame]:
    """Rename abbreviated columns of each table to long snake-case names.

    Tables and columns the dictionary does not name stay as they are, and so does a column
    whose long name is null. Only entries for the given tables' own columns reach the
    driver, so their number is bounded by the schemas.
    """
    spark = census_metadata.sparkSession
    present = spark.createDataFrame(
        [(name, c) for name, df in frames.items() for c in df.columns],
        f"`{census_code_col}` string, `{abbreviation_column_name}` string",
    )
    entries = (
        census_metadata.select(census_code_col, abbreviation_column_name, long_column_name)
        .where(F.col(long_column_name).isNotNull())
        .join(present, [census_code_col, abbreviation_column_name], "left_semi")
        .groupBy(census_code_col, abbreviation_column_name)
        .agg(F.max(long_column_name).alias("long"))
        .withColumn("long", F.replace(F.lower("long"), F.lit(" "), F.lit("_")))
    )
    renames: dict[str, dict[str, str]] = {}
    for table, short, long in entries.toLocalIterator():
        renames.setdefault(table, {})[short] = long
    return {name: df.withColumnsRenamed(renames.get(name, {})) for name, df in frames.items()}


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames of one schema, keeping duplicates."""
    return reduce(DataFrame.unionByName, frames)


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two frames over the union of their columns, filling with null.

    Numbers widen to a common type; text against another type becomes text.
    """
    as_text = [
        c
        for c in a.columns
        if c in b.columns
        and isinstance(a.schema[c].dataType, T.StringType)
        != isinstance(b.schema[c].dataType, T.StringType)
    ]
    casts = {c: F.col(c).cast("string") for c in as_text}
    if casts:
        a, b = a.withColumns(casts), b.withColumns(casts)
    return a.unionByName(b, allowMissingColumns=True)


def fill_false(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in columns})


def stack_sampled_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two sampled feature tables; a feature only one of them has is false in the other."""
    own, _ = own_columns(a, b)
    return fill_false(union_columns(a, b), own)


def join_sampled_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two sampled feature tables on their shared columns.

    Equal rows are counted before the join and unrolled after it, so an address drawn very
    often is one row on either side of the shuffle.
    """
    own, shared = own_columns(a, b)
    left = a.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("__left"))
    right = b.groupBy(*b.columns).agg(F.count(F.lit(1)).alias("__right"))
    joined = left.join(right, shared, "full").withColumn(
        "__rows", F.coalesce("__left", F.lit(1)) * F.coalesce("__right", F.lit(1))
    )
    plain = fill_false(joined, own).select(*shared, *own, "__rows")
    return repeat_rows(plain, "__rows").select(*shared, *own)
