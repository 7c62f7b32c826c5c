"""Metric trees over integer points, built middle-out from anchors.

A set of n points gets about sqrt(n) anchors.  Each new anchor is the point
farthest from the anchor that owns it, among all anchors' farthest points;
it takes from the others the points that are nearer to it, looking only at
those farther from their anchor than half the distance of the two anchors
(the triangle inequality rules the rest out).  The anchors' balls are then
merged, each time the two whose ball is smallest, up to one root; and each
anchor's own points are divided in the same way, down to leaves.

Every ball caches the number and the sum of its points, so whoever finds
that a ball belongs to one entry as a whole takes both from the cache.
Points of one ball are next to each other in ``order``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Points below which a ball is not divided.
LEAF = 64


@dataclass
class MetricTree:
    """Balls in the order root first; ball i holds the points
    ``order[lo[i]:hi[i]]`` and its children are the balls
    ``child[first[i]:first[i + 1]]`` (none: a leaf)."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    sums: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    child: np.ndarray


def anchors(points: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Indices of the points of each anchor, farthest first; fewer than
    ``wanted`` anchors if there are fewer distinct points."""
    start = points[0]
    gap = np.sqrt(((points - start) ** 2).sum(axis=1))
    by_distance = np.argsort(-gap, kind="stable")
    owned, gaps, places = [by_distance], [gap[by_distance]], [start]
    while len(owned) < wanted:
        widest = max(range(len(owned)), key=lambda a: gaps[a][0])
        if gaps[widest][0] == 0:
            break  # every point lies on its anchor
        new = points[owned[widest][0]]
        apart = np.sqrt(((np.array(places) - new) ** 2).sum(axis=1))
        taken, taken_gaps = [], []
        for a in np.flatnonzero([apart[a] < 2 * gaps[a][0] for a in range(len(owned))]).tolist():
            far = int(np.searchsorted(-gaps[a], -apart[a] / 2))  # gaps fall
            to_new = np.sqrt(((points[owned[a][:far]] - new) ** 2).sum(axis=1))
            moves = to_new < gaps[a][:far]
            if moves.any():
                taken.append(owned[a][:far][moves])
                taken_gaps.append(to_new[moves])
                stays = np.concatenate([~moves, np.ones(len(owned[a]) - far, bool)])
                owned[a], gaps[a] = owned[a][stays], gaps[a][stays]
        mine, my_gaps = np.concatenate(taken), np.concatenate(taken_gaps)
        by_distance = np.argsort(-my_gaps, kind="stable")
        owned.append(mine[by_distance])
        gaps.append(my_gaps[by_distance])
        places.append(new)
    return owned


def merged(groups: list, centres: np.ndarray, radii: np.ndarray, counts: np.ndarray):
    """Join the two balls with the smallest common ball until one is left;
    a ball is a point group or a pair of balls."""
    balls = list(groups)
    centres, radii, counts = centres.copy(), radii.copy(), counts.astype(np.float64)

    def common(i: int) -> np.ndarray:
        share = counts[i] / (counts[i] + counts)
        apart = np.sqrt(((centres - centres[i]) ** 2).sum(axis=1))
        # the common centre lies between the two, nearer to the larger
        return np.maximum(apart * (1 - share) + radii[i], apart * share + radii)

    size = np.full((len(balls), len(balls)), np.inf)
    for i in range(len(balls)):
        size[i] = common(i)
        size[i, i] = np.inf
    live = len(balls)
    while live > 1:
        i, j = divmod(int(np.argmin(size)), len(balls))
        i, j = min(i, j), max(i, j)
        radius = size[i, j]
        total = counts[i] + counts[j]
        centres[i] = (centres[i] * counts[i] + centres[j] * counts[j]) / total
        counts[i], radii[i], balls[i] = total, radius, (balls[i], balls[j])
        gone = ~np.isfinite(size[i]) & (np.arange(len(balls)) != i)
        size[i] = common(i)
        size[i, gone] = np.inf
        size[i, i] = np.inf
        size[j], size[:, j] = np.inf, np.inf
        size[i, j] = np.inf
        size[:, i] = size[i]
        live -= 1
    return balls[0]


def divided(points: np.ndarray, chosen: np.ndarray):
    """Nested pairs of index arrays (leaves) over ``points[chosen]``."""
    own = points[chosen]
    if len(chosen) <= LEAF or (own == own[0]).all():
        return chosen
    groups = anchors(own, math.ceil(math.sqrt(len(chosen))))
    centres = np.array([own[g].mean(axis=0) for g in groups])
    radii = np.array([math.sqrt(((own[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centres, strict=True)])
    parts = [divided(points, chosen[g]) for g in groups]
    return merged(parts, centres, radii, np.array([len(g) for g in groups]))


def build_tree(points: np.ndarray) -> MetricTree:
    """Tree of the rows of ``points`` (integers); at least one row."""
    real = points.astype(np.float64)
    root = divided(real, np.arange(len(points)))
    order, lo, hi, children = [], [], [], []
    at = 0
    stack: list = [(root, None)]
    # depth first, so that a ball's points are next to each other
    while stack:
        ball, parent = stack.pop()
        if isinstance(ball, int):  # all below ball number `ball` is placed
            hi[ball] = at
            continue
        number = len(lo)
        lo.append(at)
        hi.append(at)
        children.append([])
        if parent is not None:
            children[parent].append(number)
        if isinstance(ball, tuple):
            stack += [(number, None), (ball[1], number), (ball[0], number)]
        else:
            order.append(ball)
            at += len(ball)
            hi[number] = at
    order, lo, hi = np.concatenate(order), np.array(lo), np.array(hi)
    placed = real[order]
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
    sums = running[hi] - running[lo]
    centre = sums / (hi - lo)[:, None]
    radius = np.array([math.sqrt(((placed[a:b] - c) ** 2).sum(axis=1).max(initial=0.0)) for a, b, c in zip(lo, hi, centre, strict=True)])
    first = np.concatenate([[0], np.cumsum([len(c) for c in children])])
    child = np.array([x for c in children for x in c], np.int64)
    return MetricTree(order.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), sums, centre, radius, first.astype(np.int32), child.astype(np.int32))


def owners(tree: MetricTree, points: np.ndarray, entries: np.ndarray):
    """Nearest entry of every point (ties to the lower index).

    Goes down the tree a level at a time.  A ball starts with the entries its
    parent kept; it drops those whose half space, against the entry nearest
    to its centre, the ball does not reach.  With one entry left the ball is
    owned by it as a whole.  Leaves that keep several compare these exactly.

    Returns (entry of each point, sums and counts of points by entry).
    """
    k = len(entries)
    real = entries.astype(np.float64)
    between = np.sqrt(((real[:, None, :] - real[None, :, :]) ** 2).sum(axis=2))
    # of equal entries, only the first can win
    alive = np.array([not (entries[:i] == entries[i]).all(axis=1).any() for i in range(k)])
    nearest = np.empty(len(points), np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(k, np.int64)
    balls, kept = np.array([0]), alive[None, :]
    loose: list[tuple[np.ndarray, np.ndarray]] = []
    while len(balls):
        square = ((tree.centre[balls][:, None, :] - real[None, :, :]) ** 2).sum(axis=2)
        square[~kept] = np.inf
        best = np.argmin(square, axis=1)
        rows = np.arange(len(balls))
        with np.errstate(invalid="ignore", divide="ignore"):
            reach = (square - square[rows, best][:, None]) / (2 * between[best])  # of the half space from the centre
            doubt = 1e-6 + 1e-14 * square / between[best]  # of the rounding
            far = reach - doubt > tree.radius[balls][:, None] * (1 + 1e-9)
        far[rows, best] = False
        kept = kept & ~far
        whole = kept.sum(axis=1) == 1
        for ball, entry in zip(balls[whole].tolist(), best[whole].tolist(), strict=True):
            nearest[tree.order[tree.lo[ball] : tree.hi[ball]]] = entry
        np.add.at(sums, best[whole], tree.sums[balls[whole]])
        np.add.at(counts, best[whole], (tree.hi - tree.lo)[balls[whole]])
        balls, kept = balls[~whole], kept[~whole]
        n_children = tree.first[balls + 1] - tree.first[balls]
        leaf = n_children == 0
        if leaf.any():
            loose.append((balls[leaf], kept[leaf]))
        inner = balls[~leaf]
        kept = np.repeat(kept[~leaf], n_children[~leaf], axis=0)
        balls = np.concatenate([tree.child[tree.first[b] : tree.first[b + 1]] for b in inner] or [np.zeros(0, np.int64)]).astype(np.int64)
    for leaves, masks in loose:
        of = np.repeat(np.arange(len(leaves)), tree.hi[leaves] - tree.lo[leaves])
        own = np.concatenate([tree.order[tree.lo[b] : tree.hi[b]] for b in leaves])
        for a in range(0, len(own), 4096):
            part, mask = own[a : a + 4096], masks[of[a : a + 4096]]
            which, entry = np.nonzero(mask)
            square = np.full(mask.shape, np.iinfo(np.int64).max)
            square[which, entry] = ((points[part[which]] - entries[entry]) ** 2).sum(axis=1)
            nearest[part] = np.argmin(square, axis=1)
        np.add.at(sums, nearest[own], points[own])
        np.add.at(counts, nearest[own], 1)
    return nearest, sums, counts
