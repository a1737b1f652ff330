"""Orientation of a template by point-to-plane alignment with an object's points.

Each object tries eight angles 45 degrees apart, then eight within 20 degrees of the best. An object is one group, shuffled
once: its grid, spacing and normals serve all of its trials. An object's points must fit one task. The fitness of a trial is the
share of template samples with an object point within the threshold, or three times the object's spacing if that is more, after
alignment. Samples and points are centred by their means. A later trial wins only by a higher fitness, or by the same where
alignment, which can turn a template itself, had to turn it less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COARSE = [45.0 * k for k in range(8)]
FINE = [-20.0, -15.0, -10.0, -5.0, 5.0, 10.0, 15.0, 20.0]


def sample_surface(vertices: np.ndarray, faces: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """n points spread over a surface by area (fixed seed)."""
    rng = np.random.default_rng(seed)
    a, b, c = (vertices[faces[:, k]] for k in range(3))
    area = np.linalg.norm(np.cross(b - a, c - a), axis=1)
    f = rng.choice(len(faces), n, p=area / area.sum())
    u, v = rng.random((2, n, 1))
    flip = u + v > 1
    u, v = np.where(flip, 1 - u, u), np.where(flip, 1 - v, v)
    return a[f] + u * (b - a)[f] + v * (c - a)[f]


class Grid:
    """Points by cells of a radius, cells by one number in order. Cells of equal numbers only add candidates, which their distance
    rules out."""

    #: Candidates that are held at a time, or those of one query if they are more.
    MOST = 1 << 20

    def __init__(self, points: np.ndarray, radius: float):
        self.points, self.radius = points, radius
        cells = self._cells(points)
        self.low = cells.min(axis=0, initial=0)
        span = cells.max(axis=0, initial=0) - self.low + 3
        self.weight = np.array([span[1] * span[2], span[2], 1])
        self.around = np.array([a * self.weight[0] + b * self.weight[1] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        number = (cells - self.low) @ self.weight
        self.order = np.argsort(number, kind="stable")
        self.number = number[self.order]

    def _cells(self, p: np.ndarray) -> np.ndarray:
        return np.floor(p / self.radius).astype(np.int64)

    def near(self, q: np.ndarray):
        """Blocks of (query, point, squared distance) of all pairs within the radius, in order of queries."""
        number = ((self._cells(q) - self.low) @ self.weight)[:, None] + self.around
        first = np.searchsorted(self.number, number - 1)  # three cells in a row have numbers in a row
        count = np.searchsorted(self.number, number + 1, side="right") - first
        total = np.cumsum(count.sum(axis=1))
        at = 0
        while at < len(q):
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + self.MOST, side="right")))
            n = count[at:end].ravel()
            run = np.repeat(first[at:end].ravel() - np.cumsum(n) + n, n)
            point = self.order[run + np.arange(len(run))]
            query = np.repeat(np.arange(at, end), count[at:end].sum(axis=1))
            far = ((self.points[point] - q[query]) ** 2).sum(axis=1)
            inside = far <= self.radius**2
            yield query[inside], point[inside], far[inside]
            at = end

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (-1: none within the radius) and squared distance of each query's nearest point; the first of equals."""
        at, least = np.full(len(q), -1), np.full(len(q), np.inf)
        for query, point, far in self.near(q):
            first = np.flatnonzero(np.diff(query, prepend=-1))
            if len(first):
                low = np.minimum.reduceat(far, first)
                tied = far == np.repeat(low, np.diff(np.append(first, len(query))))
                at[query[first]] = np.minimum.reduceat(np.where(tied, point, len(self.points)), first)
                least[query[first]] = low
        return at, least


def spacing(points: np.ndarray, k: int = 5) -> float:
    """Median distance from every n-th point (200 to 399 probes) to its k nearest others; 0.01 where there are none."""
    step = max(1, len(points) // min(200, len(points)))
    found = [np.sort(np.delete(((points - points[n]) ** 2).sum(axis=1), n))[:k] for n in range(0, len(points), step)]
    return float(np.median(np.sqrt(np.concatenate(found)))) if len(points) > 1 else 0.01


def normals(points: np.ndarray, radius: float, most: int = 30) -> np.ndarray:
    """Of each point the direction in which its neighbours (the nearest ``most``) vary least, upward; straight up for fewer than
    three."""
    out = np.tile([0.0, 0.0, 1.0], (len(points), 1))
    for query, point, far in Grid(points, radius).near(points):
        order = np.lexsort((point, far, query))
        query, p = query[order], points[point[order]]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        size = np.diff(np.append(first, len(query)))
        chosen = np.arange(len(query)) - np.repeat(first, size) < most
        query, p = query[chosen], p[chosen]
        size = np.minimum(size, most)
        first = np.cumsum(size) - size
        off = p - np.repeat(np.add.reduceat(p, first) / size[:, None], size, axis=0)
        spread = np.add.reduceat(off[:, :, None] * off[:, None, :], first)
        flat = np.linalg.eigh(spread)[1][:, :, 0]
        some = size >= 3
        out[query[first[some]]] = np.where(flat[some, 2:] >= 0, flat[some], -flat[some])
    return out


def align(source: np.ndarray, grid: Grid, target_normals: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Point-to-plane alignment (4x4) of source with the grid's points, partners within its radius, and its fitness."""
    target, pose = grid.points, np.eye(4)
    fitness = 0.0
    for k in range(rounds + 1):
        moved = source @ pose[:3, :3].T + pose[:3, 3]
        at, _ = grid.nearest(moved)
        hit = at >= 0
        last, fitness = fitness, float(hit.mean())
        if hit.sum() < 6 or k == rounds or k > 3 and abs(fitness - last) < 1e-6:
            break
        p, q, n = moved[hit], target[at[hit]], target_normals[at[hit]]
        a = np.hstack([np.cross(p, n), n])
        x = np.linalg.lstsq(a, ((q - p) * n).sum(axis=1), rcond=None)[0]
        angle = np.linalg.norm(x[:3])
        step = np.eye(4)
        if angle > 0:
            u = x[:3] / angle
            skew = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
            step[:3, :3] = np.eye(3) + np.sin(angle) * skew + (1 - np.cos(angle)) * skew @ skew
        step[:3, 3] = x[3:]
        pose = step @ pose
    return pose, fitness


def best_orientation(points: DataFrame, vertices: DataFrame, faces: DataFrame, key: str, threshold: float = 0.02, rounds: int = 30, base: float = 0.0, scale: float = 1.0, at_least: int = 30) -> DataFrame:
    """key, angle (degrees) and fitness of each object with enough points: coarse, then fine angles; the first of the best
    (G06, T04). vertices and faces: one template, scaled first; it is bounded by what the driver holds."""
    v = np.array([tuple(r) for r in vertices.orderBy("vid").select(*"xyz").collect()], float)
    f = np.array([tuple(r) for r in faces.select(*"abc").collect()], int)
    v = v * scale
    kind = points.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        own = np.column_stack([t.column(c).to_numpy() for c in "xyz"])
        angle = fitness = 0.0
        if len(own) >= at_least:
            own = own[np.lexsort(own.T)]  # the probes of spacing are the same however rows arrive
            own = own - own.mean(axis=0)
            template = sample_surface(v, f, min(5000, max(3000, 3 * len(own))))
            template = template - template.mean(axis=0)
            gap = spacing(own)
            reach = max(threshold, 3 * gap)
            grid, upright = Grid(own, reach), normals(own, max(5 * gap, reach))

            def trial(angle: float) -> tuple[float, float, float]:
                """Fitness, how little alignment turned, and the angle."""
                r = np.radians(base + angle)
                turned = template @ np.array([[np.cos(r), -np.sin(r), 0], [np.sin(r), np.cos(r), 0], [0, 0, 1]]).T
                pose, fit = align(turned, grid, upright, rounds)
                return fit, -abs(float(np.degrees(np.arctan2(pose[1, 0], pose[0, 0])))), angle

            def best(trials) -> tuple[float, float, float]:
                return max(trials, key=lambda x: x[:2])  # the first of equals

            coarse = best(map(trial, COARSE))
            fitness, _, angle = best([coarse, *(trial(coarse[2] + step) for step in FINE)])
        return pa.table([t.column(key).slice(0, 1), pa.array([angle]), pa.array([fitness])], names=[key, "angle", "fitness"])

    rows = points.filter(F.col(key).isNotNull()).select(key, *[F.col(c).cast("double").alias(c) for c in "xyz"])
    # Objects are few bytes and much work: adaptive execution would join their partitions by bytes, but leaves a given number.
    rows = rows.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    found = rows.groupBy(key).applyInArrow(run, f"{key} {kind}, angle double, fitness double")
    return found.select(key, F.pmod(F.col("angle") + F.lit(base), F.lit(360.0)).alias("angle"), "fitness")


def accepted_angle(fitness, angle, configured: float, threshold: float):
    """The found angle, or the configured one where a match was found but a poor one."""
    return F.when((fitness > 0) & (fitness < threshold), F.lit(configured)).otherwise(angle)
