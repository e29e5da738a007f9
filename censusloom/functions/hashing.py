"""Hashes and keyed permutations made of built-in column functions.

Both give the same answer on any engine with md5 and 64-bit integers, for any partitioning
and after any task retry. That is what makes a draw repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Modulus of the round functions (a Mersenne prime); products of two residues fit a bigint.
PRIME = 2147483647
#: Feistel rounds of a permutation.
ROUNDS = 8


def stable_hash(*cols: str) -> Column:
    """Non-negative 60-bit integer from the md5 of the columns' text joined by ``|``."""
    text = ", ".join(f"cast(`{c}` as string)" for c in cols)
    return F.expr(f"cast(conv(substring(md5(concat_ws('|', {text})), 1, 15), 16, 10) as bigint)")


def round_keys(seed: int, *cols: str) -> Column:
    """Random coefficients ``a`` and ``b`` of one linear function per round, from md5 words.

    Worth computing once per group, before its rows are made.
    """
    text = ", ".join(["'|'", f"'{int(seed)}'", *[f"cast(`{c}` as string)" for c in cols]])
    pairs = []
    for number in range(ROUNDS // 2):
        digest = f"md5(concat_ws({text}, '{number}'))"
        a1, b1, a2, b2 = (
            f"cast(conv(substring({digest}, {at}, 8), 16, 10) as bigint) % {PRIME}"
            for at in (1, 9, 17, 25)
        )
        pairs += [f"struct({a1} as a, {b1} as b)", f"struct({a2} as a, {b2} as b)"]
    return F.expr(f"array({', '.join(pairs)})")


def with_permuted(df: DataFrame, index: str, size: str, keys: str, out: str) -> DataFrame:
    """Add ``out``: the image of ``index`` under a keyed permutation of ``0 .. size-1``.

    Distinct indexes below ``size`` get distinct images, so the images of ``0 .. n-1`` are n
    draws without replacement. Every row is computed by itself: no sort, no window, no
    shuffle, and nothing of size ``size`` is ever built. ``keys`` comes from ``round_keys``.

    The permutation is a Feistel network on pairs ``(left, right)`` with both halves below
    ``side = ceil(sqrt(size))``. An image that falls in the small rest ``size .. side**2 - 1``
    is sent round again until it is below ``size``. The images met on the way are distinct
    members of that rest, so its length bounds the walk and the two nested loops, each of
    the square root of it, always suffice.
    """
    work = df.withColumn(
        "__side", F.expr(f"cast(ceil(sqrt(`{size}`)) as bigint) + shiftright(`{size}`, 52)")
    ).withColumns(
        {"__left": F.expr(f"`{index}` div __side"), "__right": F.expr(f"`{index}` % __side")}
    )
    for i in range(ROUNDS):
        # refers to the right half once, so a filter pushed through the rounds stays short
        shift = f"(`{keys}`[{i}].a * __right + `{keys}`[{i}].b) % {PRIME}"
        work = work.withColumns(
            {"__left": F.col("__right"), "__right": F.expr(f"(__left + {shift}) % __side")}
        )
    work = work.withColumn("__first", F.expr("__left * __side + __right"))

    once = (
        f"aggregate(`{keys}`, struct(v div __side as l, v % __side as r), (p, k) -> "
        f"struct(p.r as l, (p.l + (k.a * p.r + k.b) % {PRIME}) % __side as r), "
        "p -> p.l * __side + p.r)"
    )
    steps = f"sequence(1, cast(ceil(sqrt(__side * __side - `{size}`)) as int))"
    inner = f"aggregate({steps}, w, (v, i) -> if(v < `{size}`, v, {once}))"
    walked = f"aggregate({steps}, __first, (w, j) -> if(w < `{size}`, w, {inner}))"
    # never null, so that a join on the image adds no null filter below the rounds
    image = f"coalesce(if(__first < `{size}`, __first, {walked}), -1L)"
    return work.withColumn(out, F.expr(image)).drop("__side", "__left", "__right", "__first")
