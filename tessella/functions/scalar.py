"""Scalar functions as column expressions: numbers, strings, arrays, maps and times."""

from __future__ import annotations

import math
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


# Numbers


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) < tolerance


def square(v: Column) -> Column:
    return v * v


def sign(v: Column) -> Column:
    """1 for zero and above, else -1."""
    return F.when(v >= 0, 1).otherwise(-1)


def _wrap(v: Column, period: float) -> Column:
    return v - period * F.floor(v / period)


def mod2pi_positive(v: Column) -> Column:
    return _wrap(v, TWO_PI)


def mod2pi(v: Column) -> Column:
    """Into [-pi, pi)."""
    return _wrap(v + math.pi, TWO_PI) - math.pi


def mod2pi_ref(ref: Column, v: Column) -> Column:
    """The angle equal to v that lies nearest to ref."""
    return ref + mod2pi(v - ref)


def mod360_positive(v: Column) -> Column:
    return _wrap(v, 360.0)


def mod360(v: Column) -> Column:
    return _wrap(v + 180.0, 360.0) - 180.0


def theta_to_int(theta: Column, n: int) -> Column:
    """Which of n equal sectors an angle lies in."""
    return F.pmod(F.floor(mod2pi_positive(theta) / TWO_PI * n), F.lit(n)).cast("int")


def clamp(v: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(v, F.lit(hi)))


def compare(a: Column, b: Column) -> Column:
    return F.signum(a - b).cast("int")


def ceil_log2(v: Column) -> Column:
    """The least k with 2**k >= v, from the bits of v - 1."""
    return F.when(v <= 1, 0).otherwise(F.length(F.bin(v - 1))).cast("int")


def random_int(seed: int, bound: int) -> Column:
    return F.floor(F.rand(seed) * bound).cast("int")


def signed_random(seed: int) -> Column:
    return F.rand(seed) * 2 - 1


# Strings


def first_difference(a: Column, b: Column) -> Column:
    """The first place (from 0) where two strings differ; the shorter one's length if it is a prefix."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1)))
    return F.coalesce(F.get(at, F.lit(0)), n)


def split_nonempty(s: Column, delimiter: str) -> Column:
    return F.array_remove(F.split(s, re.escape(delimiter)), "")


def split_spaces(s: Column) -> Column:
    return split_nonempty(s, " ")


_WS = "[ \\t\\n\\x0B\\f\\r]+"


def lstrip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_WS}", "")


def rstrip(s: Column) -> Column:
    return F.regexp_replace(s, f"{_WS}$", "")


def strip(s: Column) -> Column:
    return lstrip(rstrip(s))


def index_of(s: Column, needle: str) -> Column:
    return F.instr(s, needle) - 1


def last_index_of(s: Column, needle: str) -> Column:
    at = F.instr(F.reverse(s), needle[::-1])
    return F.when(at == 0, -1).otherwise(F.length(s) - at - len(needle) + 1)


def substring(s: Column, start: int, end: int | None = None) -> Column:
    """Characters start..end, the end exclusive."""
    return F.substring(s, F.lit(start + 1), F.length(s) if end is None else F.lit(max(0, end - start)))


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new)) if old else s


def replace_many(s: Column, *pairs: str) -> Column:
    for old, new in zip(pairs[::2], pairs[1::2]):
        s = replace(s, old, new)
    return s


def starts_with_any(s: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(s, p))


def matches_any(s: Column, values: list[str]) -> Column:
    return s.isin(values)


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def pop_back(s: Column) -> Column:
    return F.left(s, F.greatest(F.length(s) - 1, F.lit(0)))


def expand_env(text: str, env=None) -> str:
    """``$NAME`` by the environment's value, nothing for unknown names; on the driver."""
    env = os.environ if env is None else env
    return re.sub(r"\$([A-Za-z0-9_]+)", lambda m: env.get(m[1], ""), text)


class Scanner:
    """Walks through a text, keeping line and column."""

    def __init__(self, text: str):
        self.text, self.at, self.line, self.column = text, 0, 1, 0

    def has_next(self) -> bool:
        return self.at < len(self.text)

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def next(self, n: int = 1) -> str:
        part = self.peek(n)
        for c in part:
            self.line, self.column = (self.line + 1, 0) if c == "\n" else (self.line, self.column + 1)
        self.at += len(part)
        return part

    def starts_with(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def require(self, s: str) -> None:
        if not self.starts_with(s):
            raise ValueError(f"line {self.line}, column {self.column}: expected {s!r}")
        self.next(len(s))


# Arrays (indices from 0)


def get(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def remove_index(a: Column, i: int) -> Column:
    return F.filter(a, lambda _, k: k != i)


def remove_value(a: Column, v) -> Column:
    """Without the first element equal to v."""
    at = F.array_position(a, v)
    return F.filter(a, lambda _, k: (at == 0) | (k != at - 1))


def insert(a: Column, i: int, v) -> Column:
    return F.array_insert(a, i + 1, F.lit(v))


def put(a: Column, i: int, v) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, F.lit(v)).otherwise(x))


def truncate(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def array_index_of(a: Column, v) -> Column:
    return F.array_position(a, v) - 1


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return magnitude(d)


def normalize(a: Column) -> Column:
    n = magnitude(a)
    return F.transform(a, lambda x: x / n)


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * F.lit(k))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cross(a: Column, b: Column) -> Column:
    x, y = [F.get(a, F.lit(i)) for i in range(3)], [F.get(b, F.lit(i)) for i in range(3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


# Maps


def map_put(m: Column, k, v) -> Column:
    """The map with k set to v, whether it was there or not."""
    return F.map_concat(F.map_filter(m, lambda key, _: key != F.lit(k)), F.create_map(F.lit(k), F.lit(v)))


def map_remove(m: Column, k) -> Column:
    return F.map_filter(m, lambda key, _: key != F.lit(k))


# Times (microseconds since the epoch)


def seconds(utime: Column) -> Column:
    return F.floor(utime / F.lit(1_000_000)).cast("bigint")


def microseconds(utime: Column) -> Column:
    return F.pmod(utime, F.lit(1_000_000))


def timeval(utime: Column) -> Column:
    return F.struct(seconds(utime).alias("sec"), microseconds(utime).alias("usec"))


def timespec(utime: Column) -> Column:
    return F.struct(seconds(utime).alias("sec"), (microseconds(utime) * 1000).alias("nsec"))


def hhmmss_to_utime(v: Column) -> Column:
    """hhmmss.ss as a number, to microseconds of the day; cut to centiseconds."""
    whole = F.floor(v).cast("bigint")
    s = F.floor((v - F.floor(v / 100) * 100) * 100 + 1e-6).cast("bigint")
    m = F.floor((whole % 10_000) / 100).cast("bigint")
    h = F.floor(whole / 10_000).cast("bigint")
    return (s + m * 6_000 + h * 360_000) * 10_000


def ms_to_us(v: Column) -> Column:
    return v * 1000
