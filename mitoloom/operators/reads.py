"""What a read's record says of its group and of how its pair lies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mitoloom.operators.filters import MATE_UNMAPPED, UNMAPPED

REVERSE, MATE_REVERSE = 16, 32


def tag(tags: Column, name: str) -> Column:
    """A tag's text; empty where the read lacks it or has no tags."""
    return F.coalesce(F.element_at(tags, F.lit(name)), F.lit(""))


def read_group(tags: Column, qname: Column) -> Column:
    """The tag RG or, without it, the read's name up to its first colon; empty without either."""
    from_name = F.when(F.contains(qname, F.lit(":")), F.split_part(qname, F.lit(":"), F.lit(1))).otherwise("")
    return F.coalesce(F.element_at(tags, F.lit("RG")), from_name, F.lit(""))


def proper_orientation(flag: Column, rname: Column, pos: Column, rnext: Column, pnext: Column) -> Column:
    """Whether a pair on one contig faces inwards: the read in front on the forward strand and its mate on the reverse one; seen from
    the read behind, all but that. False where either has no place."""
    bit = lambda b: flag.bitwiseAND(F.lit(b)) != 0
    placed = ~bit(UNMAPPED) & ~bit(MATE_UNMAPPED) & (rname != "*") & (rname == rnext)
    facing = ~bit(REVERSE) & bit(MATE_REVERSE)
    return F.coalesce(placed & F.when(pos < pnext, facing).otherwise(~facing), F.lit(False))
