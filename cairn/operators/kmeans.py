"""K-Means by Lloyd steps: rows stay distributed, k * d centroid numbers go to and fro.

Initial centroids are the rows with the smallest md5 of (seed, id), so any engine can repeat a fit.
A step is one pass: every task sends a sum and a count for each cluster. Several fits (k, seed,
resample) advance together in one pass over the rows, so a grid costs as many jobs as its longest fit.
The distances to the centroids of all fits are one matrix product, and so are their sums. What the tasks
send comes to the driver in one array each, if it is small (``SENT_BYTES``), and else is added up before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.functions.vectors import distances, matrix
from cairn.operators.cleaning import hash_order
from cairn.operators.pairs import held
from cairn.runtime import materialize


#: Sums that all tasks of a step may send to the driver.
SENT_BYTES = 64_000_000


@dataclass
class Fit:
    run_id: str
    k: int
    seed: int
    centers: np.ndarray
    inertia: list[float]
    done: bool = False
    draw: int = 0

    @property
    def n_iter(self) -> int:
        return len(self.inertia)


def seed_rows(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    got = rows.orderBy(hash_order(F.col("id"), seed), "id").limit(k).select("v").collect()
    return np.array([r["v"] for r in got], np.float64)


def start(rows: DataFrame, grid: Sequence[tuple[int, int]]) -> list[Fit]:
    """A fit for each (k, seed); one read for each seed."""
    most = {seed: max(k for k, s in grid if s == seed) for _, seed in grid}
    first = {seed: seed_rows(rows, k, seed) for seed, k in most.items()}
    return [Fit(f"k{k}s{seed}", k, seed, first[seed][:k].copy(), []) for k, seed in grid]


def start_apart(rows: DataFrame, grid: Sequence[tuple[int, int]]) -> list[Fit]:
    """A fit for each (k, seed) with starting centroids drawn one after another in proportion to the squared
    distance to those drawn before.

    A draw is a race: a row's time is -ln(u) / squared distance with u from the md5 of (seed, step, id), and
    the first row wins. Each task sends its first row for each seed, so a step is one pass for all seeds and
    fits of one seed share their draws.
    """
    most = {seed: max(k for k, s in grid if s == seed) for _, seed in grid}
    drawn = {seed: seed_rows(rows, 1, seed) for seed in most}
    for step in range(1, max(most.values())):
        live = [(seed, drawn[seed]) for seed, k in most.items() if k > step]

        def run(batches, live=live, step=step):
            best: dict[int, tuple] = {}
            for batch in batches:
                if not len(batch):
                    continue
                ids, x = batch.column(0).to_pylist(), matrix(batch.column(1))
                for seed, centers in live:
                    d = distances(x, centers).min(axis=1) ** 2
                    u = np.array([(int(md5(f"{seed}:{step}:{i}".encode()).hexdigest()[:12], 16) + 1) / (16**12 + 1) for i in ids])
                    with np.errstate(divide="ignore"):
                        time = np.where(d > 0, -np.log(u) / d, np.inf)
                    at = int(np.lexsort((ids, time))[0])
                    own = (float(time[at]), int(ids[at]), x[at].tolist())
                    best[seed] = min(best.get(seed, own), own)
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([b[0] for b in best.values()], pa.float64()), pa.array([b[1] for b in best.values()], pa.int64()), pa.array([b[2] for b in best.values()], pa.list_(pa.float64()))], ["seed", "time", "id", "v"])

        raced = rows.select("id", "v").mapInArrow(run, "seed long, time double, id long, v array<double>")
        for r in raced.groupBy("seed").agg(F.min(F.struct("time", "id", "v")).alias("m")).collect():  # a row for each seed
            drawn[r["seed"]] = np.vstack([drawn[r["seed"]], r["m"]["v"]])
    return [Fit(f"k{k}s{seed}", k, seed, drawn[seed][:k].copy(), []) for k, seed in grid]


def lloyd(rows: DataFrame, fits: list[Fit], steps: int = 300, tolerance: float = 0.0, weights: str | None = None, part: str | None = None) -> list[Fit]:
    """Advance all fits together. An empty cluster keeps its centroid. With ``weights``, an array column of which
    a fit takes the entry ``draw`` as the row's weight (a bootstrap). With ``part``, a fit takes only the rows that
    have its ``draw`` there, so fits of several tables advance together. The rows are written once if they aren't yet."""
    columns = ["v"] + [c for c in (weights, part) if c]
    rows = held(rows.select(*columns)) if not getattr(rows, "_cairn_path", None) else rows
    own = rows.select(*columns)
    tasks, cores = own.rdd.getNumPartitions() if fits else 0, rows.sparkSession.sparkContext.defaultParallelism
    if cores < tasks <= 4 * cores:  # a small table is one wave of tasks
        own, tasks = own.coalesce(cores), cores
    for _ in range(steps):
        live = [f for f in fits if not f.done]
        if not live:
            break
        run = _step(live, weights, part)
        cells = sum(f.centers.size + 2 * len(f.centers) for f in live)
        if cells * 8 * tasks <= SENT_BYTES:
            sums = np.zeros(cells)
            for batch in own.mapInArrow(run, "sums array<double>").toArrow().to_batches():  # an array for each task
                for one in batch.column(0):
                    sums += one.values.to_numpy()
        else:
            long = own.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"))
            got = long.toArrow()  # centroid numbers of the live fits
            sums = np.zeros(cells)
            sums[got.column("p").to_numpy()] = got.column("x").to_numpy()
        at = 0
        for f in live:
            k, d = f.centers.shape
            s = sums[at : at + k * (d + 2)].reshape(k, d + 2)
            at += s.size
            full = s[:, -2] > 0
            moved = f.centers.copy()
            moved[full] = s[full, :-2] / s[full, -2:-1]
            f.inertia.append(float(s[:, -1].sum()))
            f.done = bool(np.sqrt(((moved - f.centers) ** 2).sum(axis=1)).max(initial=0) <= tolerance)
            f.centers = moved
    return fits


def _step(live: list[Fit], weights: str | None, part: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part of a step: for each fit and cluster the sum of its rows, their weight and their squared distances."""
    groups: dict[int, list[tuple[np.ndarray, int]]] = {}
    order: dict[int, list[int]] = {}
    for x, f in enumerate(live):
        own = f.draw if part else 0
        groups.setdefault(own, []).append((f.centers, f.draw))
        order.setdefault(own, []).append(x)
    cells = [f.centers.size + 2 * len(f.centers) for f in live]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: np.zeros((sum(len(c) for c, _ in own), own[0][0].shape[1] + 2)) for g, own in groups.items()}
        every = {g: np.concatenate([c for c, _ in own]) for g, own in groups.items()}
        for batch in batches:
            if not len(batch):
                continue
            whole = matrix(batch.column(0))
            drawn = matrix(batch.column(1)) if weights else None
            seat = batch.column(1).to_numpy() if part else None
            for g, own in groups.items():
                x = whole if seat is None else whole[seat == g]
                if not len(x):
                    continue
                d, total = distances(x, every[g]), sums[g]
                hot, low, n = np.zeros(d.shape), 0, np.arange(len(x))
                for centers, draw in own:
                    at = d[:, low : low + len(centers)].argmin(axis=1) + low
                    hot[n, at] = drawn[:, draw] if weights else 1.0
                    low += len(centers)
                total[:, :-2] += hot.T @ x
                total[:, -2] += hot.sum(axis=0)
                total[:, -1] += (hot * d * d).sum(axis=0)
        flat: list[np.ndarray] = [np.zeros(c) for c in cells]
        for g, own in groups.items():
            low = 0
            for x, (centers, _) in zip(order[g], own):
                flat[x] = sums[g][low : low + len(centers)].ravel()
                low += len(centers)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(flat)], pa.list_(pa.float64()))], ["sums"])

    return run


def assign(rows: DataFrame, fits: list[Fit]) -> DataFrame:
    """(id, run_id, cluster) of every row under every fit, one pass."""
    state = [(f.run_id, f.centers) for f in fits]

    def run(batches):
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(1))
                at = [distances(x, c).argmin(axis=1) for _, c in state]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0)] * len(state)), pa.array([n for n, _ in state for _ in range(len(x))]), pa.array(np.concatenate(at).astype(np.int64))], ["id", "run_id", "cluster"])

    return rows.select("id", "v").mapInArrow(run, "id long, run_id string, cluster long")


def search_table(spark, fits: list[Fit]) -> DataFrame:
    """(run_id, k, seed, n_iter, inertia): inertia of the step that ended a fit."""
    return spark.createDataFrame([(f.run_id, f.k, f.seed, f.n_iter, f.inertia[-1]) for f in fits], "run_id string, k long, seed long, n_iter long, inertia double")


def search(rows: DataFrame, ks: Sequence[int], seeds: Sequence[int] = (42,), steps: int = 300, apart: bool = False) -> tuple[list[Fit], list[Fit]]:
    """All fits, and for each k the one with the least inertia; with ``apart`` from starting centroids drawn apart."""
    fits = lloyd(rows, (start_apart if apart else start)(rows, [(k, s) for k in ks for s in seeds]), steps)
    return fits, best_of(fits, ks)


def best_of(fits: Sequence[Fit], ks: Sequence[int]) -> list[Fit]:
    return [min((f for f in fits if f.k == k), key=lambda f: (f.inertia[-1], f.seed)) for k in ks]


def convergence(rows: DataFrame, k: int, budgets: Sequence[int], seed: int = 42) -> DataFrame:
    """(iteration_budget, actual_iterations, inertia): one fit read off at each budget."""
    fit = lloyd(rows, start(rows, [(k, seed)]), max(budgets))[0]
    read = [(b, min(b, fit.n_iter), fit.inertia[min(b, fit.n_iter) - 1]) for b in budgets]
    return rows.sparkSession.createDataFrame(read, "iteration_budget long, actual_iterations long, inertia double")


def gap_statistic(rows: DataFrame, ks: Sequence[int], references: int = 5, seed: int = 42, steps: int = 50) -> DataFrame:
    """(k, log_w, mean_ref, gap, s): references are uniform boxes as large as the data, made by hash."""
    from cairn.operators.tendency import TINY, uniform_box

    n = rows.count()
    boxes = [rows.select("id", "v")] + [uniform_box(rows, n, seed + 1 + b) for b in range(references)]
    every = materialize(reduce(DataFrame.unionByName, [box.withColumn("part", F.lit(p)) for p, box in enumerate(boxes)]), "boxes")
    fits = []
    for p in range(len(boxes)):
        for f in start(every.where(F.col("part") == p), [(k, seed) for k in ks]):
            f.draw = p
            fits.append(f)
    refs: dict[int, list[float]] = {k: [] for k in ks}
    own = {}
    for f in lloyd(every, fits, steps, part="part"):  # the data and its references advance together
        if f.draw:
            refs[f.k].append(float(np.log(max(f.inertia[-1], TINY))))
        else:
            own[f.k] = f.inertia[-1]
    out = []
    for k in ks:
        w, r = float(np.log(max(own[k], TINY))), np.array(refs[k])
        out.append((k, w, float(r.mean()), float(r.mean() - w), float(r.std(ddof=1) * np.sqrt(1 + 1 / len(r))) if len(r) > 1 else 0.0))
    return rows.sparkSession.createDataFrame(out, "k long, log_w double, mean_ref double, gap double, s double")


def bootstrap_grid(rows: DataFrame, draws: DataFrame, grid: Sequence[tuple[int, int]], seed: int = 42, steps: int = 300, whole: Sequence[Fit] = ()) -> list[Fit]:
    """A fit for each (k, run) of ``grid`` on that run's resample of ``draws`` (run, id, weight), named ``k<k>b<run>``; all advance
    together, one pass over the rows a step, and with them the fits ``whole`` on all rows. A fit starts from the drawn rows with
    the smallest md5 of (its seed, id)."""
    runs = sorted({run for _, run in grid})
    place = {run: x for x, run in enumerate(runs)}
    own = draws.where(F.col("run").isin(runs)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("run", "weight"))).alias("m"))  # a value for each run
    zero = F.lit(0).cast("long")
    weight = F.array(*(F.coalesce(F.element_at("m", F.lit(r).cast("long")), zero).cast("double") for r in runs), F.lit(1.0))
    longs = own.select("id", F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].cast("long"), e["value"].cast("long")))).alias("m"))
    weighted = materialize(rows.join(longs, "id", "left").select("id", "v", weight.alias("w")), "weighted")
    fits = []
    most = {run: max(k for k, r in grid if r == run) for run in runs}
    asked = [weighted.where(F.get("w", F.lit(place[run])) > 0).orderBy(hash_order(F.col("id"), seed + 1000 + run), "id").limit(most[run]).select(F.lit(run).cast("long").alias("run"), hash_order(F.col("id"), seed + 1000 + run).alias("h"), "id", "v") for run in runs]
    first = {run: [] for run in runs}
    for r in sorted(reduce(DataFrame.unionByName, asked).collect(), key=lambda r: (r["run"], r["h"], r["id"])) if runs else []:  # the starts of each run
        first[r["run"]].append(r["v"])
    first = {run: np.array(own, np.float64) for run, own in first.items()}
    for k, run in grid:
        fits.append(Fit(f"k{k}b{run}", k, seed + 1000 + run, first[run][:k].copy(), [], draw=place[run]))
    for f in whole:
        f.draw = len(runs)
    lloyd(weighted, [*fits, *whole], steps, weights="w")
    return fits


def bootstrap_fits(rows: DataFrame, draws: DataFrame, k: int, seed: int = 42, steps: int = 100) -> list[Fit]:
    """A fit of each resample (run, id, weight), named ``b<run>``."""
    runs = [r["run"] for r in draws.select("run").distinct().orderBy("run").collect()]
    fits = bootstrap_grid(rows, draws, [(k, run) for run in runs], seed, steps)
    for fit, run in zip(fits, runs):
        fit.run_id = f"b{run}"
    return fits
