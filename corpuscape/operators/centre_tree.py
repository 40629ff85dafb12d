"""Nearest of many centres, exactly, without comparing with all of them.

Centres are gathered in balls around some of them, balls in balls, until a level is small. A query goes down from the
top: by the triangle inequality no centre of a ball is nearer than the distance to its middle minus its radius,
so balls that lie beyond the best distance known are left out with all they hold. Rows are taken in batches: a
level costs a few matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Centres that are compared one by one; from here on balls pay.
FLAT = 64
# Bounds and distances come from different sums; this much may lie between them.
SLACK = 1e-7


def gaps_between(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    cross = rows @ points.T
    norms = (rows**2).sum(1)[:, None] + (points**2).sum(1)[None, :]
    return np.sqrt(np.maximum(norms - 2.0 * cross, 0.0))


@dataclass
class Balls:
    """A level: middles, radii, and for each ball the places of what it holds in the level below."""

    middles: np.ndarray
    radii: np.ndarray
    held: list[np.ndarray]


@dataclass
class CentreTree:
    ids: np.ndarray
    points: np.ndarray
    levels: list[Balls]
    """From the top down; the last one holds centres."""


def _spread_places(points: np.ndarray, n: int) -> np.ndarray:
    """Places of n points far from each other: each next one is the farthest from those before."""
    chosen = [int(((points - points.mean(0)) ** 2).sum(1).argmax())]
    away = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def build_tree(ids: np.ndarray, points: np.ndarray) -> CentreTree:
    """Balls of about sqrt(n) centres, then balls of balls."""
    levels, below, reach = [], points, np.zeros(len(points))
    while len(below) > FLAT:
        middles = below[_spread_places(below, int(np.sqrt(len(below))))]
        own = gaps_between(below, middles).argmin(axis=1)
        used = np.unique(own)
        held = [np.flatnonzero(own == i) for i in used]
        # Middles move to the mean of what they hold: balls get smaller.
        middles = np.stack([below[h].mean(0) for h in held])
        radii = np.array([(gaps_between(m[None], below[h])[0] + reach[h]).max() for m, h in zip(middles, held)])
        if len(middles) >= len(below):
            break
        levels.append(Balls(middles, radii, held))
        below, reach = middles, radii
    return CentreTree(ids, points, levels[::-1])


def nearest(tree: CentreTree, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Place of the nearest centre of each row, its distance to nine decimals, and how many distances were computed. Equal
    distances go to the lowest id; centres are ordered by id."""
    best, place = np.full(len(rows), np.inf), np.full(len(rows), len(tree.points))
    if not tree.levels:
        gaps = gaps_between(rows, tree.points).round(9)
        place = gaps.argmin(axis=1)
        return place, gaps[np.arange(len(rows)), place], gaps.size
    work = 0

    def visit(level: int, at: np.ndarray, inside: np.ndarray) -> None:
        """Look for better centres of the rows ``at`` among the entries ``inside`` of a level."""
        nonlocal work
        work += len(at) * len(inside)
        if level == len(tree.levels):
            gaps = gaps_between(rows[at], tree.points[inside]).round(9)
            pick = gaps.argmin(axis=1)
            found, where = gaps[np.arange(len(at)), pick], inside[pick]
            better = (found < best[at]) | ((found == best[at]) & (where < place[at]))
            best[at[better]], place[at[better]] = found[better], where[better]
            return
        balls = tree.levels[level]
        least = gaps_between(rows[at], balls.middles[inside]) - balls.radii[inside]
        order = least.argsort(axis=1)
        # Each row's most promising ball first: that gives a distance to leave others out by.
        for turn in range(len(inside)):
            ball = order[:, turn]
            open_ = least[np.arange(len(at)), ball] <= best[at] + SLACK
            if not open_.any():
                break
            some, own = np.flatnonzero(open_), ball[open_]
            by = own.argsort(kind="stable")
            cuts = np.flatnonzero(np.diff(own[by])) + 1
            for group in np.split(some[by], cuts):
                visit(level + 1, at[group], balls.held[inside[ball[group[0]]]])

    top = tree.levels[0]
    visit(0, np.arange(len(rows)), np.arange(len(top.middles)))
    return place, best, work
