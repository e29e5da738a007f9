"""Draw addresses for census counts and build the person table.

A code with K addresses and a count n has K*n slots, n per address. A draw picks n of them
without replacement, so exactly n persons are placed and no address is used more than n
times. Slot number ``i``'s image under a permutation of the slots is the i-th draw, hence
work grows with the persons placed, not with the slots.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from censusloom.functions.hashing import round_keys, stable_hash, with_permuted
from censusloom.operators.numbering import HOT_ROWS, hash_range, ordered_totals, repeat_rows, running_totals
from censusloom.runtime import shuffle_width, written

__all__ = ["draw_addresses", "randomly_assign_census_features", "reconcile", "repeat_rows", "sample_census_feature"]

#: Buckets of codes per feature when person ids are laid out.
ID_BUCKETS = 64
#: Longest block of slots by which the owner of a slot is found.
LONGEST_BLOCK = 1024


def _runs(rows: DataFrame) -> DataFrame:
    """Equal rows as one with a multiplicity ``__times``, written once: everything else is read from there.

    Combined before the shuffle, so a place that holds most rows of a code costs one row a task.
    """
    names = [F.col(f"`{c}`") for c in rows.columns]
    return written(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__times")), "places")


def _block(total: str, runs: str) -> Column:
    """Length of the blocks of a code: as long as its mean run, so that runs cover few and blocks hold few."""
    return F.greatest(F.least(F.ceil(F.col(total) / F.col(runs)).cast("long"), F.lit(LONGEST_BLOCK)), F.lit(1)).cast("long")


def _in_blocks(runs: DataFrame, start: str, length: str, block: str, out: str) -> DataFrame:
    """Each run once for every block it covers; a long run is cut up and dealt over tasks."""
    first = f"{start} div {block}"
    covered = repeat_rows(runs, F.expr(f"({start} + {length} - 1) div {block} - {first} + 1"), "__nth", keys=["__run_code", start])
    return covered.withColumn(out, F.expr(f"{first} + __nth")).drop("__nth")


def _feature_rank(features: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int")


def draw_addresses(
    addresses: DataFrame,
    counts: DataFrame,
    code_col: str,
    long_col: str,
    lat_col: str,
    features: Sequence[str],
    index_col: str = "person_id",
    seed: int = 0,
    order: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Place ``counts`` on ``addresses``: ``[index, code, long, lat, feature]``, one row a person.

    ``counts`` is long, ``(code, feature, n)`` with one row per code and feature, and only
    the named features are used. Ids run ``0 .. N-1`` without gaps, in feature order. Codes
    without an address, and null codes, place nobody. ``order`` names the columns that tell
    the addresses of a code apart (default: the coordinates).
    """
    order = list(order or [long_col, lat_col])
    places = addresses.select(
        *dict.fromkeys([code_col, long_col, lat_col, *order])
    ).where(F.col(code_col).isNotNull())
    drawn = _draw_even(_runs(places), counts, code_col, long_col, lat_col, features, index_col, seed, order, hot_rows)
    return drawn.select(index_col, code_col, long_col, lat_col, "feature")


def _draw_even(
    runs: DataFrame,
    counts: DataFrame,
    code_col: str,
    long_col: str,
    lat_col: str,
    features: Sequence[str],
    index_col: str,
    seed: int,
    order: Sequence[str],
    hot_rows: int,
) -> DataFrame:
    """``draw_addresses`` from places with multiplicities ``__times``.

    The addresses of a code have numbers, a place those from its start on. A drawn number finds its place by an
    equi-join on blocks of numbers.
    """
    wanted = counts.select(code_col, "feature", F.col("n").cast("long").alias("n")).where(
        (F.col("n") > 0) & F.col("feature").isin(list(features))
    )
    sizes = runs.groupBy(code_col).agg(F.sum("__times").alias("__places"), F.count(F.lit(1)).alias("__runs"))
    quota = (
        wanted.join(sizes, code_col)
        .withColumns({"__rank": _feature_rank(features), "__hash": stable_hash(code_col)})
        .withColumn("__bucket", hash_range("__hash", F.lit(ID_BUCKETS)))
    )
    quota = ordered_totals(quota, ["__rank", "__bucket"], ["__hash", code_col], "n", "__base")
    quota = quota.select(
        F.col(code_col).alias("__code"),
        "feature",
        "n",
        "__base",
        _block("__places", "__runs").alias("__block"),
        (F.col("__places") * F.col("n")).alias("__slots"),
        round_keys(seed, code_col, "feature").alias("__keys"),
    )
    drawn = repeat_rows(quota, "n", "__draw", keys=["__code", "feature"])
    drawn = with_permuted(drawn, "__draw", "__slots", "__keys", "__slot").select(
        (F.col("__base") + F.col("__draw")).alias(index_col),
        "__code",
        F.coalesce(F.expr("__slot div n"), F.lit(0)).alias("__number"),
        F.coalesce(F.expr("__slot div n div __block"), F.lit(0)).alias("__in_block"),
        "feature",
    )
    # a code's totals give the same blocks as above
    values = {"__row": F.col("__times"), "__run": F.lit(1).cast("long")}
    numbered = running_totals(runs, [code_col], order, values, hot_rows).withColumns(
        {"__run_code": F.col(code_col), "__block": _block("__row_total", "__run_total")}
    )
    found = _in_blocks(numbered, "__row_before", "__times", "__block", "__of_block").drop("__block")
    on = (
        (F.col("__code") == F.col("__run_code"))
        & (F.col("__in_block") == F.col("__of_block"))
        & (F.col("__number") >= F.col("__row_before"))
        & (F.col("__number") < F.col("__row_before") + F.col("__times"))
    )
    return drawn.join(found, on)


def _clean_counts(census: DataFrame, places: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Places and counts alone; a null or negative count is 0. Equal rows become one with ``__times``."""
    count = lambda f: F.greatest(F.coalesce(F.col(f"`{f}`").cast("long"), F.lit(0)), F.lit(0))
    return _runs(census.select(*places, *[count(f).alias(f"n{i}") for i, f in enumerate(features)]))


def _draw_uneven(
    runs: DataFrame,
    code_col: str,
    long_col: str,
    lat_col: str,
    features: Sequence[str],
    seed: int,
    hot_rows: int,
) -> DataFrame:
    """Draws ``[code, long, lat, feature, draw]`` when rows of a code may carry different counts.

    ``runs`` comes from ``_clean_counts``. Each row owns as many slots as its count, equal rows those of all of
    them. The draws of a code are the images of ``0 .. max(n)-1`` and the i-th is kept where i is below the count
    of the row it hits, which is found by blocks of slots.
    """
    names = {f: f"n{i}" for i, f in enumerate(features)}
    flat = runs.select(
        F.col(code_col).alias("__run_code"), F.col(long_col).alias("__long"), F.col(lat_col).alias("__lat"), *names.values(), "__times"
    )
    values = {n: F.col(n) * F.col("__times") for n in names.values()} | {
        f"{n}_runs": (F.col(n) > 0).cast("long") for n in names.values()
    }
    order = ["__long", "__lat", *names.values()]
    placed = running_totals(flat, ["__run_code"], order, values, hot_rows, hashed=["__long", "__lat"])
    owned = placed.select(
        "__run_code",
        "__long",
        "__lat",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("__run_feature"),
                        F.col(n).alias("n"),
                        (F.col(n) * F.col("__times")).alias("length"),
                        F.col(f"{n}_before").alias("start"),
                        F.when(F.col(n) > 0, _block(f"{n}_total", f"{n}_runs_total")).alias("block"),
                    )
                    for f, n in names.items()
                ]
            )
        ).alias("run"),
    ).select("__run_code", "__long", "__lat", "run.*").where(F.col("n") > 0)
    owned = _in_blocks(owned, "start", "length", "block", "__run_block").drop("block")

    per_code = flat.groupBy(F.col("__run_code").alias("__code")).agg(
        *[
            F.struct(
                F.sum(F.col(n) * F.col("__times")).alias("slots"),
                F.sum((F.col(n) > 0).cast("long")).alias("runs"),
                F.max(n).alias("draws"),
            ).alias(n)
            for n in names.values()
        ]
    )
    quota = (
        per_code.select(
            "__code",
            F.explode(
                F.array(
                    *[F.struct(F.lit(f).alias("feature"), F.col(n + ".*")) for f, n in names.items()]
                )
            ).alias("q"),
        )
        .select("__code", "q.*")
        .where(F.col("draws") > 0)
    )
    quota = quota.withColumns({"__keys": round_keys(seed, "__code", "feature"), "__block": _block("slots", "runs")})
    drawn = repeat_rows(quota, "draws", "draw", keys=["__code", "feature"])
    drawn = (
        with_permuted(drawn, "draw", "slots", "__keys", "__slot")
        .withColumn("__in_block", F.coalesce(F.expr("__slot div __block"), F.lit(0)))
        .drop("__keys", "slots", "runs", "draws", "__block")
    )
    hit = (
        F.col("__code").eqNullSafe(F.col("__run_code"))
        & (F.col("feature") == F.col("__run_feature"))
        & (F.col("__in_block") == F.col("__run_block"))
        & (F.col("__slot") >= F.col("start"))
        & (F.col("__slot") < F.col("start") + F.col("length"))
        & (F.col("draw") < F.col("n"))
    )
    return drawn.join(owned, hit).select(
        F.col("__code").alias(code_col),
        F.col("__long").alias(long_col),
        F.col("__lat").alias(lat_col),
        "feature",
        "draw",
    )


def sample_census_feature(
    census: DataFrame,
    code_col: str,
    long_col: str,
    lat_col: str,
    feature_col: str,
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Draw rows of each code as often as ``feature_col`` says: ``[code, long, lat, feature]``.

    Every row can be drawn up to its own count. A code whose rows agree on a count n gets
    exactly n rows; in general a draw is kept where its rank is below its row's count.
    """
    runs = _clean_counts(census, [code_col, long_col, lat_col], [feature_col])
    drawn = _draw_uneven(runs, code_col, long_col, lat_col, [feature_col], seed, hot_rows)
    return drawn.select(code_col, long_col, lat_col, F.lit(True).alias(feature_col))


def one_hot(persons: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Widen ``feature`` into one boolean column per feature, exactly one of them true."""
    return persons.select(*keep, *[(F.col("feature") == F.lit(f)).alias(f) for f in features])


def drop_by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Drop the columns whose name starts with ``prefix``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith(prefix)])


def _uneven(runs: DataFrame, code_col: str, counts: Sequence[str]) -> bool:
    """Whether some code has rows with different counts. One aggregation, one row back."""
    differs = reduce(lambda a, b: a | b, [F.min(n) != F.max(n) for n in counts])
    return bool(runs.groupBy(code_col).agg(differs.alias("differs")).agg(F.max("differs")).first()[0])


def randomly_assign_census_features(
    census: DataFrame,
    code_col: str,
    long_col: str,
    lat_col: str,
    feature_cols: Sequence[str],
    index_col: str = "person_id",
    ignore_total: bool = True,
    total_prefix: str = "Tot_",
    seed: int = 0,
    even_counts: bool | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One-hot person table ``[index, code, long, lat, *features]`` from joined census rows.

    ``census`` has one row per address with its code's counts on it. When they are the same
    on all rows of a code, as after ``join_census_with_coords``, pass ``even_counts=True``;
    ``None`` looks it up with one aggregation. Columns starting with ``total_prefix`` are
    left out, and asking for one of them is an error.
    """
    features = list(feature_cols)
    if ignore_total:
        totals = [f for f in features if f.startswith(total_prefix)]
        if totals:
            raise ValueError(f"features {totals} start with {total_prefix!r}, which is ignored")
        census = drop_by_prefix(census, total_prefix)
    places = [code_col, long_col, lat_col]
    runs = _clean_counts(census, places, features)
    names = {f"n{i}": f for i, f in enumerate(features)}
    if even_counts is None:
        even_counts = not _uneven(runs, code_col, list(names))
    if even_counts:
        largest = runs.groupBy(code_col).agg(*[F.max(n).alias(f) for n, f in names.items()])
        counts = largest.unpivot([code_col], [F.col(f"`{f}`") for f in features], "feature", "n")
        known = runs.where(F.col(code_col).isNotNull()).select(*places, "__times")
        persons = _draw_even(
            known, counts, code_col, long_col, lat_col, features, index_col, seed, [long_col, lat_col], hot_rows
        )
    else:
        drawn = _draw_uneven(runs, code_col, long_col, lat_col, features, seed, hot_rows)
        persons = with_person_ids(drawn, features, [code_col, "draw"], index_col)
    return one_hot(persons, features, [index_col, code_col, long_col, lat_col])


def with_person_ids(
    persons: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    index_col: str,
    buckets: int | None = None,
) -> DataFrame:
    """Gap-free ids ``0 .. N-1`` in feature order for rows that have none yet.

    The rows of a feature are numbered in ``buckets`` ranges of the hash that orders them
    (default: as many as the session has shuffle partitions); their number changes no id.
    """
    buckets = buckets or shuffle_width(persons.sparkSession)
    ready = persons.withColumns(
        {
            "__rank": _feature_rank(features),
            "__hash": stable_hash(*order),
            "__one": F.lit(1).cast("long"),
        }
    )
    ready = ready.withColumn("__bucket", hash_range("__hash", F.lit(buckets)))
    numbered = ordered_totals(ready, ["__rank", "__bucket"], ["__hash", *order], "__one", index_col)
    return numbered.drop("__rank", "__hash", "__bucket", "__one")


def reconcile(
    persons: DataFrame, counts: DataFrame, code_col: str, features: Sequence[str]
) -> DataFrame:
    """``(code, feature, wanted, placed)`` for a one-hot person table and its long counts."""
    placed = (
        persons.groupBy(code_col)
        .agg(*[F.count_if(F.col(f"`{f}`")).alias(f) for f in features])
        .unpivot([code_col], [F.col(f"`{f}`") for f in features], "feature", "placed")
        .where(F.col("placed") > 0)
    )
    wanted = (
        counts.where(F.col("feature").isin(list(features)))
        .groupBy(code_col, "feature")
        .agg(F.sum(F.col("n").cast("long")).alias("wanted"))
    )
    return wanted.join(placed, [code_col, "feature"], "full").select(
        code_col,
        "feature",
        F.coalesce("wanted", F.lit(0)).alias("wanted"),
        F.coalesce("placed", F.lit(0)).alias("placed"),
    )
