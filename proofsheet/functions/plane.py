"""Plain numbers on boxes (x1, y1, x2, y2), for operators that work through boxes in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np

# What a line of characters is.
LINE_OVERLAP, LINE_GAP, LEAST_UNIT, LINE_GROWTH = 0.30, 2.2, 3, 1.6

Box = tuple  #: x1, y1, x2, y2 and whatever else a rule looks at


def side(a: Box, axis: int) -> float:
    return a[axis + 2] - a[axis]


def shared(a: Box, b: Box, axis: int) -> float:
    """Length of the common part along an axis."""
    return max(0.0, min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis]))


def gap(a: Box, b: Box, axis: int) -> float:
    """Distance along an axis, 0 where the projections meet."""
    return max(0.0, max(a[axis], b[axis]) - min(a[axis + 2], b[axis + 2]))


def area(a: Box) -> float:
    return side(a, 0) * side(a, 1)


def iou(a: Box, b: Box) -> float:
    both = shared(a, b, 0) * shared(a, b, 1)
    return both / max(area(a) + area(b) - both, 1)


def containment(a: Box, b: Box) -> float:
    """Share of a that lies in b."""
    return shared(a, b, 0) * shared(a, b, 1) / max(area(a), 1)


@dataclass(frozen=True)
class Neighbours:
    """Boxes next to each other along an axis: sides alike, enough of the other axis in common, a small distance.

    The distance is measured in the lesser or greater of the two boxes' sides along the measured axis.
    """

    axis: int
    share: float
    reach: float
    measured: int
    pick: Callable
    alike: float = float("inf")

    def __call__(self, a: Box, b: Box) -> bool:
        other = 1 - self.axis
        if shared(a, b, other) / max(min(side(a, other), side(b, other)), 1.0) < self.share:
            return False
        sides = side(a, self.axis), side(b, self.axis)
        return max(sides) / max(min(sides), 1.0) <= self.alike and gap(a, b, self.axis) <= self.reach * self.pick(side(a, self.measured), side(b, self.measured))


class Kept:
    """Boxes that were kept, by the cells of a grid they touch; boxes over many cells stand in a list of their own."""

    CELL, MANY = 64, 64

    def __init__(self, clash: Callable[[Box, Box], bool], limit: int | None = None):
        self.clash, self.limit = clash, limit
        self.every: list[Box] = []
        self.wide: list[Box] = []
        self.cells: dict[tuple[int, int], list[Box]] = {}

    def _cells(self, a: Box) -> list[tuple[int, int]] | None:
        x1, y1, x2, y2 = (int(v // self.CELL) for v in a[:4])
        if (x2 - x1 + 1) * (y2 - y1 + 1) > self.MANY:
            return None
        return [(x, y) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1)]

    def take(self, box: Box) -> bool:
        """Keep a box unless it clashes with a kept one, which it must overlap, or the limit is reached."""
        if self.limit is not None and len(self.every) >= self.limit:
            return False
        cells = self._cells(box)
        near = self.every if cells is None else chain(self.wide, *(self.cells.get(c, ()) for c in cells))
        if any(self.clash(box, k) for k in near):
            return False
        self.every.append(box)
        if cells is None:
            self.wide.append(box)
        for c in cells or ():
            self.cells.setdefault(c, []).append(box)
        return True


def lines(boxes: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """(corners, members) of groups of character boxes (corners, one a row) along an axis, in the order they begin.

    In order, each box joins the nearest group it fits (the first of equals) and widens it: a group has enough of the other
    axis in common with the box, is near, and does not grow thick. All groups are tried at once.
    """
    order = boxes[np.lexsort((boxes[:, 1 - axis], boxes[:, axis]))]
    groups, members, n, across = np.empty((len(boxes), 4)), np.zeros(len(boxes), np.int64), 0, 1 - axis
    for b in order:
        g = groups[:n]
        low, high = np.minimum(g, b), np.maximum(g, b)
        thick, own = g[:, across + 2] - g[:, across], b[across + 2] - b[across]
        thin = np.minimum(thick, own)
        apart = np.maximum(0, high[:, axis] - low[:, axis + 2])
        fits = np.maximum(0, low[:, across + 2] - high[:, across]) / np.maximum(thin, 1) >= LINE_OVERLAP
        fits &= (apart <= np.maximum(LEAST_UNIT, thin) * LINE_GAP) & (high[:, across + 2] - low[:, across] <= np.maximum(thick, own) * LINE_GROWTH)
        if fits.any():
            k = int(np.argmin(np.where(fits, apart, np.inf)))
            groups[k] = np.concatenate((low[k, :2], high[k, 2:]))
            members[k] += 1
        else:
            groups[n], members[n], n = b, 1, n + 1
    return groups[:n], members[:n]
