"""Points by density: cores, the clusters they make and the borders, tile by tile. No pair of points leaves a task.

A cell's diagonal is shorter than eps, so points of one cell are all close, a cell of `least` points has only core points, and
core points of a cell are of one cluster. Points further than REACH cells apart are never close. A tile is a cube of
SIDE cells; its task also gets the cells within twice the reach around it (the halo): it needs the core points up to REACH away,
and their neighbours. What two tiles both see, the name of a cell, joins their clusters afterwards."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 16  # cells of a tile on each axis
BLOCK = 400_000  # points that are taken together, in whole tiles
TILE = 1 << 21  # pairs that are made at a time
SMALL = 1 << 12  # pairs of two cells' points that are made at once; larger cells are halved instead
FAR = 1 << 50  # cells from the origin, up to which a double tells them apart


def close(p: np.ndarray, q: np.ndarray, eps: float) -> np.ndarray:
    """Whether points are closer than eps; squares are added axis by axis, as SQL does."""
    d2 = 0.0
    for i in range(p.shape[-1]):
        d = p[..., i] - q[..., i]
        d2 = d2 + d * d
    return d2 < eps * eps


def meets(p: np.ndarray, q: np.ndarray, eps: float) -> bool:
    """Whether any two points of p and q are close. Boxes that are too far apart are left, those that are close as a whole
    decide, and others are halved until their pairs are few. The bounds are rounded as distances are, so none is lost."""
    zero = np.zeros(p.shape[1])
    left = [(p, q)]
    while left:
        p, q = left.pop()
        (p0, p1), (q0, q1) = ((x.min(axis=0), x.max(axis=0)) for x in (p, q))
        if not close(np.maximum(np.maximum(q0 - p1, p0 - q1), 0), zero, eps):
            continue
        if close(np.maximum(q1 - p0, p1 - q0), zero, eps):
            return True
        if len(p) * len(q) <= SMALL:
            if close(p[:, None], q[None], eps).any():
                return True
            continue
        if (q1 - q0).max() > (p1 - p0).max() and len(q) > 1 or len(p) == 1:
            p, q, p0, p1 = q, p, q0, q1
        axis, half = int(np.argmax(p1 - p0)), len(p) // 2
        order = np.argpartition(p[:, axis], half)
        left += [(p[order[:half]], q), (p[order[half:]], q)]
    return False


def _settle(root: np.ndarray) -> None:
    """Each entry becomes the end of its chain."""
    while (root != (far := root[root])).any():
        root[:] = far


def _link(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of x and y pair by pair; a set's root is its smallest entry."""
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        _settle(root)


def tile_clusters(tile: np.ndarray, at: np.ndarray, base: np.ndarray, eps: float, least: int, size: float, reach: int) -> tuple[np.ndarray, ...]:
    """(core, its cluster), (border, a cluster it touches), (a cell's name, its cluster) of some tiles' own points, as
    rows of `at`, which are in the order of their keys; a cluster is named by its smallest core point in the tile's sight, a cell
    by its smallest core point. The cells' names are of those that other tiles see, too."""
    n, axes = at.shape
    cell = np.floor(at / size).astype(np.int64) - SIDE * base
    wide = SIDE + 6 * reach
    step = wide ** np.arange(axes)[::-1]
    code = tile * wide**axes + ((cell + 3 * reach) * step).sum(axis=1)
    order = np.argsort(code, kind="stable")
    codes, first, count = np.unique(code[order], return_index=True, return_counts=True)
    at, of, where = at[order], np.repeat(np.arange(len(codes)), count), cell[order[first]]
    own = ((where >= 0) & (where < SIDE)).all(axis=1)
    seen = ((where >= -reach) & (where < SIDE + reach)).all(axis=1)
    rim = seen & ~((where >= reach) & (where < SIDE - reach)).all(axis=1)
    moves = sorted((m for m in itertools.product(range(-reach, reach + 1), repeat=axes) if any(m)), key=lambda m: (sum(i * i for i in m), m))
    moves = [(int((np.array(m) * step).sum()), m > (0,) * axes) for m in moves]

    def beside(some, move):
        """Of cells, those whose cell at a move is there, and that cell."""
        to = np.minimum(np.searchsorted(codes, codes[some] + move), len(codes) - 1)
        ok = codes[to] == codes[some] + move
        return some[ok], to[ok]

    def close_pairs(some, move):
        """Close pairs of some points and those of the cell at a move, some at a time; a point's pairs can be cut."""
        place = of[some]
        to = np.minimum(np.searchsorted(codes, codes[place] + move), len(codes) - 1)
        ok = codes[to] == codes[place] + move
        some, to = some[ok], to[ok]
        ends = np.cumsum(count[to])
        for lo in range(0, int(ends[-1]) if len(ends) else 0, TILE):
            k = np.arange(lo, min(lo + TILE, int(ends[-1])))
            i = np.searchsorted(ends, k, side="right")
            p, q = some[i], first[to[i]] + k - (ends[i] - count[to[i]])
            ok = close(at[p], at[q], eps)
            yield p[ok], q[ok]

    core = (count >= least)[of]
    near = np.where(core, least, count[of])
    loose = np.flatnonzero(~core & seen[of])
    for move, _ in moves:
        for p, _ in close_pairs(loose[near[loose] < least], move):
            np.add.at(near, p, 1)
    core[loose] = near[loose] >= least

    place = np.minimum.reduceat(np.where(core, np.arange(n), n), first)
    has, heart = place < n, order[np.minimum(place, n - 1)]  # a cell's rows are in the order of keys
    root = np.arange(n)
    for move, forward in moves:
        if not forward:
            continue
        a, b = beside(np.flatnonzero(has & seen), move)
        ask = has[b] & seen[b] & (own[a] | own[b]) & (root[heart[a]] != root[heart[b]])
        a, b = a[ask], b[ask]
        few = count[a] * count[b] <= SMALL
        some = np.zeros(len(codes), bool)
        some[a[few]] = True
        for p, q in close_pairs(np.flatnonzero(some[of] & core), move):
            _link(root, heart[of[p[core[q]]]], heart[of[q[core[q]]]])
        for i, j in zip(a[~few].tolist(), b[~few].tolist(), strict=True):
            if root[heart[i]] != root[heart[j]]:
                p, q = (slice(first[c], first[c] + count[c]) for c in (i, j))
                if meets(at[p][core[p]], at[q][core[q]], eps):
                    _link(root, heart[[i]], heart[[j]])

    cores = np.flatnonzero(core & own[of])
    border = np.flatnonzero(~core & own[of])
    inside = border[has[of[border]]]
    points, names = [inside], [root[heart[of[inside]]]]
    for move, _ in moves:
        for p, q in close_pairs(border, move):
            points.append(p[core[q]])
            names.append(root[heart[of[q[core[q]]]]])
    touched = np.unique(np.stack([np.concatenate(points), np.concatenate(names)]), axis=1)
    names = heart[has & rim]
    return order[cores], root[heart[of[cores]]], order[touched[0]], touched[1], names, root[names]


def dense_parts(points: DataFrame, key: str, axes: list[str], eps: float, least: int, within: tuple = ()) -> DataFrame:
    """(a, core, name) of points with finite axes and `within` that isn't null: core points and the part of a cluster they are of,
    border points and each part they touch, and, with a core of null, two names of one cluster."""
    reach = int(np.sqrt(len(axes))) + 1
    size = eps / ((np.sqrt(len(axes)) + reach) / 2)
    kind = points.schema[key].dataType.simpleString()
    at = [F.col(x).cast("double") for x in axes]
    there = [(F.abs(x) < float("inf")) & F.when(F.abs(x) >= FAR * size, F.raise_error("a point is too far from the origin for this eps")).otherwise(True) for x in at]
    cell = [F.floor(F.col(f"x{i}") / size) for i in range(len(axes))]
    rows = points.filter(F.col(key).isNotNull())
    for w in within:
        rows = rows.filter(F.col(w).isNotNull())
    for x in there:
        rows = rows.filter(x)
    rows = rows.select(F.col(key).alias("a"), (F.to_json(F.struct(*within)) if within else F.lit("")).alias("g"), *[x.alias(f"x{i}") for i, x in enumerate(at)])
    tiles = [f"t{i}" for i in range(len(axes))]
    for t, c in zip(tiles, cell, strict=True):
        rows = rows.withColumn(t, F.explode(F.sequence(*[F.floor((c + h) / SIDE).cast("long") for h in (-2 * reach, 2 * reach)])))
    dealt = rows.select("g", *tiles, "a", *[f"x{i}" for i in range(len(axes))]).repartition("g", *tiles).sortWithinPartitions("g", *tiles)
    width = len(axes)

    def block(held):
        t = pa.Table.from_batches([b for b, _ in held])
        tile = np.concatenate([x for _, x in held])
        by_key = pc.sort_indices(t["a"])
        t, tile = t.take(by_key), tile[by_key.to_numpy()]
        base, at = (np.stack([t.column(i).to_numpy() for i in range(lo, lo + width)], axis=1) for lo in (1, 2 + width))
        own, own_name, border, border_name, cell, cell_name = tile_clusters(tile - tile.min(), at, base, eps, least, size, reach)
        keys = t["a"].combine_chunks()
        twin = cell != cell_name
        for rows, names, flag in ((own, own_name, True), (border, border_name, False), (cell[twin], cell_name[twin], None)):
            for lo in range(0, len(rows), BLOCK):
                some = rows[lo : lo + BLOCK]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), pa.array([flag] * len(some), pa.bool_()), keys.take(pa.array(names[lo : lo + BLOCK]))], names=["a", "core", "name"])

    def run(batches):
        held, rows, tile, last = [], 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(0).dictionary_encode().indices.to_numpy(), *[b.column(1 + i).to_numpy() for i in range(width)]])
            new = np.append(tuple(b.column(i)[0].as_py() for i in range(1 + width)) != last, (ids[:, 1:] != ids[:, :-1]).any(axis=0))
            last = tuple(b.column(i)[b.num_rows - 1].as_py() for i in range(1 + width))
            which = tile + np.cumsum(new)
            tile = int(which[-1])
            heads = np.flatnonzero(new)
            if rows + b.num_rows >= BLOCK and len(heads):  # all but the last tile, which may go on
                end = int(heads[-1])
                held.append((b.slice(0, end), which[:end]))
                if rows + end:
                    yield from block(held)
                held, rows, b, which = [], 0, b.slice(end), which[end:]
            held.append((b, which))
            rows += b.num_rows
        if rows:
            yield from block(held)

    return dealt.mapInArrow(run, f"a {kind}, core boolean, name {kind}")
