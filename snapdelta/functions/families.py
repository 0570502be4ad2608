"""Instruction families of the public Dalvik opcode map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each family's opcodes, as inclusive ranges.
FAMILIES = (
    ("NONE", ((0x00, 0x00), (0x1D, 0x1E))),
    ("TEST", ((0x1F, 0x1F), (0x2B, 0x2C), (0x32, 0x3D), (0x0100, 0x0100), (0x0200, 0x0200))),
    ("ENDOFBASICBLOCK", ((0x0E, 0x11), (0x27, 0x2A))),
    ("COMPARISON", ((0x20, 0x20), (0x2D, 0x31))),
    ("CALL", ((0x6E, 0x72), (0x74, 0x78), (0xFA, 0xFD))),
    ("ARITHMETIC", ((0x7B, 0x80), (0x90, 0xE2))),
    ("CAST", ((0x81, 0x8F),)),
    ("STATICFIELDACCESS", ((0x60, 0x6D),)),
    ("INSTANCEFIELDACCESS", ((0x52, 0x5F),)),
    ("ARRAYACCESS", ((0x21, 0x21), (0x23, 0x26), (0x44, 0x51), (0x0300, 0x0300))),
    ("STRING", ((0x1A, 0x1B),)),
    ("MOVE", ((0x01, 0x0D), (0x1C, 0x1C), (0x22, 0x22), (0xFE, 0xFF))),
    ("INTEGER", ((0x12, 0x19),)),
)
NAMES = [name for name, _ in FAMILIES]


def _value(opcode: int) -> int | None:
    return next((k for k, (_, ranges) in enumerate(FAMILIES) if any(a <= opcode <= b for a, b in ranges)), None)


_LOW = [_value(o) for o in range(0x100)]
_HIGH = {o: _value(o) for o in (0x0100, 0x0200, 0x0300)}


def family_value(opcode: Column) -> Column:
    """0 to 12, null for an unmapped opcode: one look into a literal array."""
    wide = F.lit(None).cast("int")
    for o, v in _HIGH.items():
        wide = F.when(opcode == o, v).otherwise(wide)
    low = F.array(*(F.lit(v).cast("int") for v in _LOW))
    return F.when(opcode.between(0, 0xFF), F.get(low, opcode)).otherwise(wide)


def family_name(opcode: Column) -> Column:
    return F.get(F.array(*map(F.lit, NAMES)), family_value(opcode))


def sql_value(column: str) -> str:
    """The same in SQL text."""
    cases = " ".join(f"WHEN {column} BETWEEN {a} AND {b} THEN {k}" for k, (_, ranges) in enumerate(FAMILIES) for a, b in ranges)
    return f"CASE {cases} END"


def sql_name(column: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES))
    return f"CASE {sql_value(column)} {cases} END"
