"""Cell ids of the nested triangular hierarchy as shift arithmetic on BIGINT columns.

Ids are 1-based; level L holds 20*4^L cells and the children of i are 4i-3 .. 4i.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridspark.contracts import require

BASE_CELLS = 20


def ncells(level: int) -> int:
    return BASE_CELLS * 4**level


def nedges(level: int) -> int:
    return 30 * 4**level


def nvertices(level: int) -> int:
    return 10 * 4**level + 2


def level_for(count: int) -> int:
    """The coarsest level with at least `count` cells."""
    level = 0
    while ncells(level) < count:
        level += 1
    return level


def ancestor(cell: Column, depth: int) -> Column:
    """The cell `depth` levels up."""
    return F.shiftright(cell - 1, 2 * depth) + 1


def parent(cell: Column) -> Column:
    return ancestor(cell, 1)


def first_descendant(cell: Column, depth: int) -> Column:
    return F.shiftleft(cell - 1, 2 * depth) + 1


def last_descendant(cell: Column, depth: int) -> Column:
    return F.shiftleft(cell, 2 * depth)


def descendants(cell: Column, depth: int) -> Column:
    """ARRAY of the 4^depth cells below `cell`; explode it for one row each."""
    return F.sequence(first_descendant(cell, depth), last_descendant(cell, depth))


def children(cell: Column) -> Column:
    return descendants(cell, 1)


def disk_id(cell: Column) -> Column:
    """1-based memory index to 0-based stored id."""
    return cell - 1


def memory_id(cell: Column) -> Column:
    return cell + 1


def in_level(cell: Column, level: int) -> Column:
    """Whether a 1-based id names a cell of `level`."""
    return (cell >= 1) & (cell <= F.lit(ncells(level)))


def at_radius(value: Column, radius: float, power: int) -> Column:
    """A unit-sphere measure at `radius`: lengths take power 1, areas power 2."""
    require(power in (1, 2), "power", "at_radius", f"{power} is neither a length nor an area")
    return value * F.pow(F.lit(float(radius)), F.lit(float(power)))


def hanging_flux(d1: Column, l1: Column, d2: Column, l2: Column) -> Column:
    """Flux through a hanging edge: each fine half carries its own density and length."""
    return d1 * l1 + d2 * l2
