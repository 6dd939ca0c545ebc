"""Hash functions of the sketches: a 32-bit mix in SQL, Murmur3 over numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = (1 << 32) - 1


def mix32(df: DataFrame, key: str, bits: int, out: str) -> DataFrame:
    """df with out = the 32-bit integer mix of a whole-number column, modulo bits.

    The column's low 32 bits count. Wrapping is written out over longs, as sums that overflow
    raise; a negative result is widened to 64 bits before the remainder is taken.
    """

    def shifted(u: Column, n: int) -> Column:
        return F.floor(u / (1 << n)) + F.when(u >= 1 << 31, _MASK + 1 - (1 << (32 - n))).otherwise(0)

    x = F.col("__x")
    steps = [
        lambda: (_MASK - x + x * 32768).bitwiseAND(_MASK),
        lambda: x.bitwiseXOR(shifted(x, 12)),
        lambda: (x * 5).bitwiseAND(_MASK),
        lambda: x.bitwiseXOR(shifted(x, 4)),
        lambda: (x * 2057).bitwiseAND(_MASK),
        lambda: x.bitwiseXOR(shifted(x, 16)),
    ]
    df = df.withColumn("__x", F.col(key).cast("long").bitwiseAND(_MASK))
    for step in steps:
        df = df.withColumn("__x", step().cast("long"))
    widened = F.when(x >= 1 << 31, x - (1 << 32) + (1 << 64) % bits).otherwise(x)
    return df.withColumn(out, F.pmod(widened, F.lit(bits).cast("long"))).drop("__x")


def mix32_sql(source: str, key: str, bits: int, out: str) -> str:
    """DuckDB SQL of the same: source with the column out."""

    def shifted(n: int) -> str:
        return f"(x // {1 << n} + CASE WHEN x >= {1 << 31} THEN {_MASK + 1 - (1 << (32 - n))} ELSE 0 END)"

    text = f"(SELECT *, ({key})::BIGINT & {_MASK} AS x FROM {source})"
    for step in (f"({_MASK} - x + x * 32768) & {_MASK}", f"xor(x, {shifted(12)})", f"(x * 5) & {_MASK}", f"xor(x, {shifted(4)})", f"(x * 2057) & {_MASK}", f"xor(x, {shifted(16)})"):
        text = f"(SELECT * REPLACE (({step}) AS x) FROM {text})"
    wide = f"CASE WHEN x >= {1 << 31} THEN x - {1 << 32} + {(1 << 64) % bits} ELSE x END"
    return f"(SELECT * EXCLUDE (x), ((({wide}) % {bits}) + {bits}) % {bits} AS {out} FROM {text})"


def murmur3_words(keys: np.ndarray, seed: int = 1) -> np.ndarray:
    """The four 32-bit words of the 128-bit Murmur3 (x64) hash of 8-byte keys, one row a key."""
    u = np.uint64
    rotated = lambda v, r: (v << u(r)) | (v >> u(64 - r))

    def final(v: np.ndarray) -> np.ndarray:
        v = (v ^ (v >> u(33))) * u(0xFF51AFD7ED558CCD)
        v = (v ^ (v >> u(33))) * u(0xC4CEB9FE1A85EC53)
        return v ^ (v >> u(33))

    k = rotated(keys.astype(np.int64).view(u) * u(0x87C37B91114253D5), 31) * u(0x4CF5AD432745937F)
    first, second = (u(seed) ^ k) ^ u(8), np.full(len(keys), u(seed) ^ u(8))
    first = first + second
    second = second + first
    first, second = final(first), final(second)
    first = first + second
    second = second + first
    return np.stack([first & u(_MASK), first >> u(32), second & u(_MASK), second >> u(32)], axis=1).astype(np.int64)


def murmur3(key: str) -> Column:
    """The four words of a whole-number column, as an array."""

    def words(keys: pd.Series) -> pd.Series:
        return pd.Series(list(murmur3_words(keys.to_numpy(dtype=np.int64))))

    return F.pandas_udf(words, T.ArrayType(T.LongType()))(key)


def murmur3_sql(source: str, key: str, bits: int, seed: int = 1) -> str:
    """DuckDB SQL of the same: source with a row for each word (from 0) and bit = the word modulo bits."""
    whole = f"{1 << 64}::UHUGEINT"
    times = lambda x, c: f"({x} * {c}::UHUGEINT) % {whole}"
    shift = lambda x, n: f"({x} // {1 << n}::UHUGEINT)"
    add = lambda x, y: f"({x} + {y}) % {whole}"
    steps = [f"*, {times('u', 0x87C37B91114253D5)} AS k", f"* REPLACE (({times('k', 1 << 31)} + {shift('k', 33)}) AS k)", f"* REPLACE ({times('k', 0x4CF5AD432745937F)} AS k)"]
    steps += [f"*, xor(xor({seed}::UHUGEINT, k), 8::UHUGEINT) AS a, {seed ^ 8}::UHUGEINT AS b", f"* REPLACE ({add('a', 'b')} AS a)", f"* REPLACE ({add('b', 'a')} AS b)"]
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        mixed = [f"xor({v}, {shift(v, 33)})" for v in "ab"]
        steps.append(f"* REPLACE ({times(mixed[0], c)} AS a, {times(mixed[1], c)} AS b)")
    steps += [f"* REPLACE (xor(a, {shift('a', 33)}) AS a, xor(b, {shift('b', 33)}) AS b)", f"* REPLACE ({add('a', 'b')} AS a)", f"* REPLACE ({add('b', 'a')} AS b)"]
    text = f"(SELECT *, ({key}::HUGEINT + CASE WHEN {key} < 0 THEN {1 << 64}::HUGEINT ELSE 0 END)::UHUGEINT AS u FROM {source})"
    for step in steps:
        text = f"(SELECT {step} FROM {text})"
    words = f"[a % {1 << 32}, a // {1 << 32}, b % {1 << 32}, b // {1 << 32}]"
    return f"(SELECT * EXCLUDE (u, k, a, b), unnest(range(0, 4)) AS word, (unnest({words}) % {bits})::BIGINT AS bit FROM {text})"
