"""Record ids: page and slot in one integer, 16 bits each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(page: Column, slot: Column) -> Column:
    return F.shiftleft(page.bitwiseAND(0xFFFF).cast("long"), 16).bitwiseOR(slot.bitwiseAND(0xFFFF).cast("long"))


def page_of(rid: Column) -> Column:
    return F.shiftright(rid, 16).bitwiseAND(0xFFFF)


def slot_of(rid: Column) -> Column:
    return rid.bitwiseAND(0xFFFF)
