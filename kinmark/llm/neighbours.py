"""Problem 7: the most similar vectors of every vector, by cross-polytope hashing with multiprobe tables and exact reranking.

A unit vector is pseudo-rotated (three rounds of random signs and a fast Hadamard transform) and hashed to the nearest of the
signed axes. Buckets that hold more than a task should are parted again by further cross-polytopes around their own mean, so
bucket sizes stay even whatever the number of vectors and however dense a cluster. Each vector looks into its own bucket and
into the next nearest ones; cosines there are exact, and the best of all tables are kept. Tables are added until the recall that
is measured on a sample of vectors, against all others, is as asked for.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.skew import join_unique
from ..plans.storage import Scratch

DIM, TARGET, LIMIT, GAP, LEVELS, BASE = 64, 1500, 4096, 0.1, 7, 131
#: At most so many buckets of a table are parted by all tasks alike; with more vectors tasks hold larger ones and part them by themselves.
PARTED, DEPTH = 20_000, 16
#: Tables at least and at most, recall asked for, and vectors it is measured on.
TABLES, MOST_TABLES, RECALL, SAMPLE = 3, 64, 0.95, 256
Plan = dict[int, tuple[int, "np.ndarray | None"]]


def axes(n: int, target: int = TARGET) -> int:
    """A power of two of axes that part n vectors into buckets of about `target`."""
    return max(1, min(DIM, 2 ** round(np.log2(max(n / (2 * target), 1)))))


def most_of(total: int) -> int:
    """Vectors of a bucket that isn't parted for all tasks."""
    return max(LIMIT, total // PARTED)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, of a length that is a power of two, scaled to keep lengths."""
    n, step = x.shape[1], 1
    x = x.astype(np.float32, copy=True)
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        step *= 2
    return x / np.float32(np.sqrt(n))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1, 1], np.float32), x.shape[1]))
    return x


def nearest_axes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest and the second signed axis of each row, and how much farther the second is."""
    rows = np.arange(len(y))
    size = np.abs(y)
    one = size.argmax(1)
    top = size[rows, one]
    first = 2 * one + (y[rows, one] < 0)
    if y.shape[1] == 1:
        return first, 1 - first, 2 * top
    size[rows, one] = -1
    two = size.argmax(1)
    return first, 2 * two + (y[rows, two] < 0), top - size[rows, two]


def codes(u: np.ndarray, table: int, plan: Plan) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, bucket codes): first each row's own bucket, then the probes. plan says which codes are parted into how many axes."""
    at = np.zeros(len(u), np.int64)
    probes: list[list[np.ndarray]] = []
    for level in range(LEVELS):
        order = np.argsort(at, kind="stable")
        values, starts = np.unique(at[order], return_index=True)
        new = at.copy()
        turned: list[tuple[np.ndarray, np.ndarray]] = []
        for code, part in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
            if code not in plan:
                continue
            d, mean = plan[code]
            x = u[part] if mean is None else u[part] - mean
            first, second, gap = nearest_axes(rotate(x, 1000 * table + level)[:, :d])
            new[part] = code * BASE + 1 + first
            near = gap < GAP
            if near.any():
                turned.append((part[near], code * BASE + 1 + second[near]))
        for rows, code in turned:
            probes.append([rows, code, np.full(len(rows), level + 1)])
        if (new == at).all():
            break
        at = new
    out = [(np.arange(len(u)), at)]
    if probes:
        rows, code, level = (np.concatenate(x) for x in zip(*probes, strict=True))
        for depth in range(1, LEVELS):  # below the turn a probe goes to the nearest axes
            for c in np.unique(code[level == depth]).tolist():
                if c in plan:
                    here = np.flatnonzero((code == c) & (level == depth))
                    d, mean = plan[c]
                    x = u[rows[here]] if mean is None else u[rows[here]] - mean
                    code[here] = c * BASE + 1 + nearest_axes(rotate(x, 1000 * table + depth)[:, :d])[0]
                    level[here] += 1
        out.append((rows, code))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM), dtype=np.float32)


def units(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, u, key): usable vectors at unit length; key is a hash of the direction to six decimals."""

    def run(batches):
        for b in batches:
            ids, v = b.column(0), b.column(1)
            if not len(v):
                continue
            x = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, DIM)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            x, ids = x[ok], ids.filter(pa.array(ok))
            x = x / np.abs(x).max(1, keepdims=True)  # so that tiny and huge numbers have a length
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            rounded = np.round(x * 1e6).astype(np.int32)
            key = pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in rounded], pa.binary())
            flat = pa.array(x.astype(np.float32).ravel())
            u = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, DIM, dtype=np.int32), flat)
            yield pa.record_batch([ids, u, key], names=["id", "u", "key"])

    whole = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    whole = whole.where(F.col("v").isNotNull() & (F.size("v") == DIM) & ~F.exists("v", lambda x: x.isNull()))
    return whole.mapInArrow(run, "id long, u array<float>, key binary")


def bucket_plan(vectors: DataFrame, table: int, total: int) -> tuple[Plan, dict[int, int]]:
    """How the table's buckets are parted, and the sizes of those that stay larger than a task should hold.

    A level sends to the driver only buckets above most_of(total), with their means: at most PARTED of them, 6 MB.
    """
    most = most_of(total)
    target = TARGET * most // LIMIT
    big: dict[int, int] = {}
    if total <= most:
        return {}, big
    plan: Plan = {0: (axes(total, target), None)}
    for _ in range(LEVELS - 1):
        shared = vectors.sparkSession.sparkContext.broadcast(plan)

        def count(batches, shared=shared):
            sums: dict[int, list] = {}
            for b in batches:
                u = _matrix(b.column("u"))
                own = codes(u, table, shared.value)[0][1]
                order = np.argsort(own, kind="stable")
                values, starts, counts = np.unique(own[order], return_index=True, return_counts=True)
                means = np.add.reduceat(u[order].astype(np.float64), starts, axis=0)
                for c, n, s in zip(values.tolist(), counts.tolist(), means, strict=True):
                    of = sums.setdefault(c, [0, np.zeros(DIM)])
                    of[0] += n
                    of[1] += s
            yield pa.RecordBatch.from_pydict(
                {"code": list(sums), "n": [v[0] for v in sums.values()], "s": [v[1].tolist() for v in sums.values()]}, pa.schema([("code", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))])
            )

        found = vectors.select("u").mapInArrow(count, "code long, n long, s array<double>")
        parts = found.select("code", "n", F.posexplode("s").alias("i", "x")).groupBy("code", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        rows = parts.where(F.col("n") > most).groupBy("code").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).collect()
        big = {r["code"]: r["n"] for r in rows}
        fresh = {r["code"]: (axes(r["n"], target), np.array([x["x"] for x in r["s"]], np.float32) / r["n"]) for r in rows}
        if not fresh:
            break
        plan = plan | fresh
    return plan, {c: n for c, n in big.items() if c not in plan}


def best_in(u: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, n, cos): of each row of u its k nearest among the base rows, which are parted further where they are more than LIMIT.

    Rows look into their part and, near a turn, into the second one. Parts that can't be made smaller are searched whole.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def whole(own: np.ndarray, asked: np.ndarray) -> None:
        for a in range(0, len(asked), 512):
            for b in range(0, len(own), 1 << 14):
                q, o = asked[a : a + 512], own[b : b + (1 << 14)]
                s = u[q] @ u[o].T
                s[q[:, None] == o[None, :]] = -2
                m = min(k, len(o))
                top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(o) else np.broadcast_to(np.arange(m), (len(q), m))
                cos = np.take_along_axis(s, top, 1)
                keep = cos > -2
                out.append((np.repeat(q, m)[keep.ravel()], o[top][keep], cos[keep]))

    stack = [(np.flatnonzero(base), np.arange(len(u)), 0)]
    while stack:
        own, asked, depth = stack.pop()
        if not len(own) or not len(asked):
            continue
        if len(own) <= LIMIT or depth == DEPTH:
            whole(own, asked)
            continue
        d, mean = axes(len(own)), u[own].mean(0)
        first, second, gap = nearest_axes(rotate(u[asked] - mean, seed + depth)[:, :d])
        mine = np.full(len(u), -1)
        mine[asked] = first  # every base row asks as well
        for c in np.unique(mine[own]).tolist():
            stack.append((own[mine[own] == c], np.concatenate((asked[first == c], asked[(second == c) & (gap < GAP)])), depth + 1))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    q, n, cos = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((ids[n], -cos, q))
    q, n, cos = q[order], n[order], cos[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate((start, [len(q)]))))
    return ids[q[place < k]], ids[n[place < k]], cos[place < k].astype(np.float32)


def table_neighbours(vectors: DataFrame, table: int, total: int, k: int) -> DataFrame:
    """(q, n, cos): of each vector its k nearest in each bucket that it looks into."""
    plan, big = bucket_plan(vectors, table, total)
    most = most_of(total)
    shared = vectors.sparkSession.sparkContext.broadcast((plan, {c: -(-n // most) for c, n in big.items()}))

    def place(batches):
        plan, blocks = shared.value
        for b in batches:
            u = _matrix(b.column("u"))
            if not len(u):
                continue
            ids = b.column("id").to_numpy(zero_copy_only=False)
            own, *others = codes(u, table, plan)
            rows, code, block, base = [own[0]], [own[1]], [np.array([ids[i] % blocks.get(c, 1) for i, c in enumerate(own[1].tolist())], np.int32)], [np.ones(len(u), bool)]
            # a bucket that hashing can't part is split into blocks; every query of it visits every block, so nothing is lost
            visits = [(own[0], own[1], block[0], True), *((r, c, None, False) for r, c in others)]
            for r, c, at, is_own in visits:
                many = np.array([blocks.get(x, 1) for x in c.tolist()])
                for j in range(int(many.max(initial=0))):
                    take = (many > j) & (at != j if is_own else True)
                    if take.any():
                        rows.append(r[take])
                        code.append(c[take])
                        block.append(np.full(int(take.sum()), j, np.int32))
                        base.append(np.zeros(int(take.sum()), bool))
            rows, code, block, base = map(np.concatenate, (rows, code, block, base))
            yield pa.record_batch([pa.array(code), pa.array(block), pa.array(base), b.column("id").take(pa.array(rows)), b.column("u").take(pa.array(rows))], names=["code", "block", "base", "id", "u"])

    def near(group: pa.Table) -> pa.Table:
        found = best_in(_matrix(group.column("u").combine_chunks()), group.column("id").to_numpy(), group.column("base").to_numpy(), k, 1000 * table + 500)
        return pa.table(dict(zip(("q", "n", "cos"), found, strict=True)))

    placed = vectors.mapInArrow(place, "code long, block int, base boolean, id long, u array<float>")
    return placed.groupBy("code", "block").applyInArrow(near, "q long, n long, cos float")


class Sample:
    """The recall of what is found so far, on SAMPLE vectors that are compared with all others."""

    def __init__(self, vectors: DataFrame, k: int):
        rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        self.k, self.ids = k, [r["id"] for r in rows]
        self.found: dict[int, dict[int, float]] = {i: {} for i in self.ids}
        own, u = np.array(self.ids, np.int64), np.array([r["u"] for r in rows], np.float32).reshape(-1, DIM)

        def exact(batches):
            best = np.full((len(own), k), -2, np.float32)
            for b in batches:
                s = u @ _matrix(b.column("u")).T
                s[own[:, None] == b.column("id").to_numpy(zero_copy_only=False)[None, :]] = -2
                best = -np.sort(-np.concatenate((best, s), axis=1), axis=1)[:, :k]
            yield pa.RecordBatch.from_pydict({"q": np.repeat(own, k), "cos": best.ravel()})

        each = vectors.mapInArrow(exact, "q long, cos float").where("cos > -2")
        top = each.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cos")))).where(F.col("r") <= k)
        self.least = {r["q"]: (r["least"], r["n"]) for r in top.groupBy("q").agg(F.min("cos").alias("least"), F.count("*").alias("n")).collect()}

    def add(self, table: DataFrame) -> float:
        """The share of the sample's k nearest that are found with this table."""
        for r in table.where(F.col("q").isin(self.ids)).collect():
            self.found[r["q"]][r["n"]] = r["cos"]
        hits = sum(min(n, sum(c >= least - 1e-6 for c in self.found[q].values())) for q, (least, n) in self.least.items())
        return hits / max(1, sum(n for _, n in self.least.values()))


def nearest_vectors(df: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "v", recall: float = RECALL, tables: int = TABLES) -> DataFrame:
    """(id, near): of every usable vector the ids of its k most similar others, best first, ties to the smaller id.

    Usable are vectors of 64 finite numbers that are not all zero; others give no row and are nobody's neighbour. Vectors of
    one direction are searched once: each of them gets the k smallest others of its kind before anything else. There are
    `tables` tables (one where a bucket holds all vectors, which is exact), and more while the recall on a sample is below `recall`; what is reached is logged. Where MOST_TABLES
    aren't enough for that, a warning says so: such data has no near neighbours to speak of, and operators.vectors is exact.
    """
    scratch = Scratch(df.sparkSession)
    every = scratch.write(units(df, id_col, vec_col))
    kinds = scratch.write(every.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    copies = scratch.write(join_unique(every.select("id", "key"), kinds, ["key"], "copies").select("id", "rep", "copies"))
    vectors = every.select("id", "u").join(copies.where("id != rep").select("id"), "id", "left_anti")
    vectors = scratch.write(vectors)
    scratch.drop(every, kinds)
    total = vectors.count()
    found, reached, sample = [], 0.0, Sample(vectors, k) if total else None
    tables = tables if total > most_of(total) else 1  # one bucket holds them all
    while sample and (len(found) < tables or reached < recall) and len(found) < MOST_TABLES:
        found.append(scratch.write(table_neighbours(vectors, len(found), total, k)))
        reached = sample.add(found[-1])
    log = logging.getLogger(__name__)
    if found and reached < recall:
        log.warning("recall %.3f after %d tables, asked for %.3f", reached, len(found), recall)
    log.info("recall %.3f on a sample of %d with %d tables", reached, len(sample.ids) if sample else 0, len(found))
    if not found:
        return vectors.select(F.col("id").alias(id_col), F.array("id").alias("near")).where("false")
    scratch.drop(vectors)
    best = W.partitionBy("q").orderBy(F.desc("cos"), "n")
    every = reduce(DataFrame.unionByName, found)
    top = every.repartition("q").dropDuplicates(["q", "n"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    top = scratch.write(top)
    scratch.drop(*found)
    # a neighbour stands for all vectors of its direction; of them the k + 1 smallest ids can matter
    first = copies.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", "id")
    stands = first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    spread = top.join(stands.withColumnRenamed("rep", "n"), "n", "left").select("q", F.explode(F.coalesce("ids", F.array("n"))).alias("n"), "cos")
    spread = spread.unionByName(first.select(F.col("rep").alias("q"), F.col("id").alias("n"), F.lit(2.0).cast("float").alias("cos")))
    near = spread.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("far"), "n"))).alias("l"))
    near = scratch.write(near.select("q", F.transform(F.slice("l", 1, 2 * k + 2), lambda x: x["n"]).alias("l")))
    alone = near.join(copies.select(F.col("rep").alias("q")).distinct(), "q", "left_anti").select(F.col("q").alias("id"), "l")
    sizes = copies.select(F.col("rep").alias("q"), "copies").distinct()
    doubled = join_unique(copies.select("id", F.col("rep").alias("q")), near.join(sizes, "q"), ["q"], "copies").select("id", "l")
    each = alone.unionByName(doubled)
    return each.select(F.col("id").alias(id_col), F.slice(F.filter("l", lambda x: x != F.col("id")), 1, k).alias("near"))


def neighbour_pairs(df: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "v") -> DataFrame:
    """(id0, id1) with id0 < id1: pairs of which at least one is among the k nearest of the other."""
    pairs = nearest_vectors(df, k, id_col, vec_col).select(F.col(id_col).alias("a"), F.explode("near").alias("b"))
    return pairs.select(F.least("a", "b").alias(f"{id_col}0"), F.greatest("a", "b").alias(f"{id_col}1")).distinct()
