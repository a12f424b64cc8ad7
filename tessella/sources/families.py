"""Marker families as a dimension: layout and code words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Code words and layouts of the families, as published.
TAG16H5 = """
27c8 31b6 3859 569c 6c76 7ddb af09 f5a1 fb8b 1cb9 28ca e8dc 1426 5770 9253
b702 063a 8f34 b4c0 51ec e6f0 5fa4 dd43 1aaa e62f 6dbc b6eb de10 154d b57a
"""
TAG25H9 = """
156f1f4 1f28cd5 16ce32c 1ea379c 1390f89 034fad0 07dcdb5 119ba95 1ae9daa 0df02aa 082fc15 0465123
0ceee98 1f17260 14429cd 17248a8 16ad452 09670ad 16f65b2 0b8322b 05d715b 1a1c7e7 0d7890d 1813522
1c9c611 099e4a4 0855234 17b81c0 0c294bb 089fae3 044df5f 1360159 0ec31e8 1bcc0f6 0a64f8d
"""
TAGCIRCLE21H7 = """
157863 047e28 1383ed 00953c 0da68b 1cac50 0bb215 16ceee 05d4b3 1ff751 0efd16 072b3e 163103
106e56 1996b9 0c0234 0624d2 1fa985 0344a5 0762fb 19e92b 043755 01a4f4 10fad8 001b52 17e59f
0e6f70 0ed47a 0c9931 014df2 0a06f1 0e5041 12ec03 16724e 0af1a5 08a8ac 015b39 1ec1e3
"""
# name, bits, least distance, width at border, total width, reversed border, (x, y) of the first quarter of the bits
LAYOUTS = (
    ("tag16h5", 16, 5, 6, 8, False, ((1, 1), (2, 1), (3, 1), (2, 2))),
    ("tag25h9", 25, 9, 7, 9, False, ((1, 1), (2, 1), (3, 1), (4, 1), (2, 2), (3, 2))),
    ("tag36h10", 36, 10, 8, 10, False, ((1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (2, 2), (3, 2), (4, 2), (3, 3))),
    ("tag36h11", 36, 11, 8, 10, False, ((1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (2, 2), (3, 2), (4, 2), (3, 3))),
    ("tagCircle21h7", 21, 7, 5, 9, True, ((1, -2), (2, -2), (3, -2), (1, 1), (2, 1))),
    ("tagStandard41h12", 41, 12, 5, 9, True, ((-2, -2), (-1, -2), (0, -2), (1, -2), (2, -2), (3, -2), (4, -2), (5, -2), (1, 1), (2, 1))),
)
CODES = {"tag16h5": TAG16H5, "tag25h9": TAG25H9, "tagCircle21h7": TAGCIRCLE21H7}
#: Known by name, but without published code words here: their tables must be registered by the user.
UNKNOWN = ("tagCircle49h12", "tagCustom48h12", "tagStandard52h13")


@dataclass(frozen=True)
class Family:
    name: str
    nbits: int
    min_hamming: int
    width_at_border: int
    total_width: int
    reversed_border: bool
    bits: tuple[tuple[int, int], ...]
    codes: tuple[int, ...]


def bit_places(nbits: int, width: int, quarter: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
    """All bit places: each quarter is the one before turned by 90 degrees about the centre; an odd bit is the centre."""
    out, part = [], list(quarter)
    for _ in range(4):
        out += part
        part = [(width - 1 - y, x) for x, y in part]
    return tuple(out + [((width - 1) // 2, (width - 1) // 2)] * (nbits % 4))


_registered: dict[str, tuple[int, ...]] = {}


def register_codes(name: str, path: str) -> None:
    """Take a family's code words from a text file with one hexadecimal word for each id, in id order."""
    if name not in {x[0] for x in LAYOUTS}:
        raise ValueError(f"no layout for family {name}")
    with open(path) as f:
        _registered[name] = tuple(int(x, 16) for x in f.read().split())


def family(name: str) -> Family:
    for n, nbits, h, border, total, rev, quarter in LAYOUTS:
        if n == name:
            codes = _registered.get(name) or tuple(int(x, 16) for x in CODES.get(name, "").split())
            if not codes:
                raise ValueError(f"family {name} has a large code table: give it to register_codes()")
            return Family(n, nbits, h, border, total, rev, bit_places(nbits, border, quarter), codes)
    known = ", ".join(x[0] for x in LAYOUTS)
    if name in UNKNOWN:
        raise ValueError(f"family {name} is not available; known: {known}")
    raise ValueError(f"unrecognized tag family {name}; known: {known}")


def families(spark: SparkSession) -> DataFrame:
    """The catalogue: layout of every family and how many code words are at hand."""
    rows = [(n, nb, h, b, t, r, len(_registered.get(n) or CODES.get(n, "").split())) for n, nb, h, b, t, r, _ in LAYOUTS]
    return spark.createDataFrame(rows, "family string, nbits int, min_hamming int, width_at_border int, total_width int, reversed_border boolean, ncodes int")


def family_codes(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    rows = [(n, i, c) for n in names for i, c in enumerate(family(n).codes)]
    return spark.createDataFrame(rows, "family string, id int, code bigint")


def family_bits(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    rows = [(n, i, x, y) for n in names for i, (x, y) in enumerate(family(n).bits)]
    return spark.createDataFrame(rows, "family string, bit_idx int, bit_x int, bit_y int")
