"""Vectors of strings: exact threshold pairs and nearest targets over block grids, scored pairs, hard pairs.

A vector table is (string, v ARRAY<FLOAT>) and may have count. Vectors are taken at unit length by the caller (l2_normalize).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scores import dot, l2_normalize, pair_loss, score, score_to_cos, weight
from ..plans.skew import join_unique
from ..plans.storage import Scratch
from .groups import listed

BLOCK = 2048
#: Vectors of a packed block, directions that sort them, and rows that are compared at once.
ROWS, CELLS, SLICE, STEP = 8192, 1024, 1024, 256
#: Products of single precision decide above this distance only; what is nearer is decided in double.
SLACK = 1e-5


def unit_vectors(df: DataFrame, string_column: str, vector_column: str, count_column: str | None = None) -> DataFrame:
    """(string, count, v) at unit length; strings and vectors that are null, and vectors of length zero, are left out."""
    n = F.lit(1).cast("long") if count_column is None else F.col(count_column).cast("long")
    rows = df.select(F.col(string_column).cast("string").alias("string"), n.alias("count"), l2_normalize(F.col(vector_column)).alias("v"))
    return rows.where("string is not null and v is not null")


def with_counts(vectors: DataFrame, matches: DataFrame, exponent: float = 0.5) -> DataFrame:
    """The vectors of the strings in matches, with the counts and weights they have there."""
    rows = vectors.select("string", "v").join(matches.select("string", "count"), "string")
    return rows.select("string", "count", weight(F.col("count"), exponent).alias("w"), "v")


def first_rows(vectors: DataFrame, start: int, stop: int) -> DataFrame:
    """The vectors from place start to stop in the order of strings; a slice is what a caller looks at, so it is short."""
    return vectors.orderBy("string").offset(start).limit(stop - start)


def pick(vectors: DataFrame, strings: list[str]) -> DataFrame:
    """(place, string, ...) of a list of strings, in its order and with its repetitions; an unknown one fails when it is run."""
    found = listed(vectors.sparkSession, strings).join(vectors.withColumn("_there", F.lit(True)), "string", "left")
    error = F.raise_error(F.concat(F.lit("unknown string: "), F.col("string"))).cast("string")
    named = found.withColumn("string", F.when(F.col("_there"), F.col("string")).otherwise(error)).drop("_there")
    return named.select("place", "string", *(c for c in vectors.columns if c != "string")).orderBy("place")


def _matrix(column) -> np.ndarray:
    arrays = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arrays), -1) if len(arrays) else flat.reshape(0, 0)


def _blocks(n: int) -> int:
    return max(1, -(-n // BLOCK))


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _heads(u: np.ndarray, min_cos: float) -> np.ndarray:
    """Of each row the place of its head: a row of at least min_cos to it, or itself."""
    head = np.arange(len(u))
    for start in range(0, len(u), SLICE):
        near = u[start : start + SLICE] @ u[start : start + SLICE].T >= min_cos
        free = np.ones(len(near), bool)
        for r in range(len(near)):
            if free[r]:
                free[r] = False
                mine = near[r] & free
                head[start : start + SLICE][mine] = start + r
                free &= ~mine
    return head


def _packed(vectors: DataFrame, min_cos: float, unit: bool) -> DataFrame:
    """(block, strings, v, at, wide): up to ROWS vectors in one row, their numbers as bytes, sorted by heads; at is where each
    head stands, its rows after it, and wide the angle that these keep within.

    The nearest of CELLS random directions sorts the vectors first, so that like ones come into one block more often than not;
    which do decides the time that is taken, never the pairs.
    """
    kind = np.float32 if vectors.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    number = "float" if kind == np.float32 else "double"

    def raw(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)

    def celled(batches):
        directions = None
        for b in batches:
            if b.num_rows:
                rows = raw(b)
                if directions is None:
                    directions = np.random.default_rng(17).standard_normal((rows.shape[1], CELLS)).astype(np.float32)
                    directions /= np.linalg.norm(directions, axis=0)
                cell = np.concatenate([(_units(rows[k : k + SLICE]).astype(np.float32) @ directions).argmax(1) for k in range(0, len(rows), SLICE)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))], names=["string", "v", "cell"])

    def block(held: list[tuple[pa.Array, np.ndarray]], k: int) -> pa.RecordBatch:
        strings, rows = pa.concat_arrays([s for s, _ in held]), np.concatenate([r for _, r in held])
        u = _units(rows) if unit else rows.astype(np.float64)
        head = _heads(u, min_cos)
        order = np.lexsort([head != np.arange(len(head)), head])
        at = np.flatnonzero(head[order] == order)
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", u[order], u[head[order]]), -1, 1))
        angle[at] = 0
        wide = np.maximum.reduceat(angle, at)
        place = TaskContext.get().partitionId() << 32 | k
        return pa.RecordBatch.from_arrays(
            [pa.array([place], pa.int64()), pa.array([strings.take(pa.array(order))], pa.list_(pa.string())), pa.array([rows[order].tobytes()], pa.binary()), pa.array([at], pa.list_(pa.int32())), pa.array([wide], pa.list_(pa.float64()))],
            names=["block", "strings", "v", "at", "wide"],
        )

    def pack(batches):
        held, n, k = [], 0, 0
        for b in batches:
            start = 0
            while start < b.num_rows:
                part = b.slice(start, ROWS - n)
                held.append((part.column(0), raw(part)))
                start, n = start + part.num_rows, n + part.num_rows
                if n == ROWS:
                    yield block(held, k)
                    held, n, k = [], 0, k + 1
        if n:
            yield block(held, k)

    rows = vectors.select(F.col("string").cast("string").alias("string"), "v").mapInArrow(celled, f"string string, v array<{number}>, cell int")
    rows = rows.repartition("cell").sortWithinPartitions("cell").select("string", "v")
    return rows.mapInArrow(pack, "block long, strings array<string>, v binary, at array<int>, wide array<double>")


def _meetings(vectors: DataFrame, min_cos: float, unit: bool, heads: bool) -> DataFrame:
    """(string0, string1, cos) of all pairs with at least that cosine; heads: instead pairs of
    heads with such rows, and of a row and its head, which join the same strings, directly or over others."""
    kind = np.float32 if vectors.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    packed = Scratch(vectors.sparkSession).write(_packed(vectors, min_cos, unit))
    far = float(np.arccos(np.clip(min_cos, -1, 1)))

    def side(b: pa.RecordBatch, k: int, r: int) -> tuple:
        strings, v, at, wide = (b.column(k + c) for c in range(4))
        strings, at = strings[r].values, at[r].values.to_numpy()
        rows = np.frombuffer(v[r].as_buffer(), kind).reshape(len(strings), -1)
        u = _units(rows) if unit else rows.astype(np.float64)
        return strings, u, u.astype(np.float32), at, np.append(at[1:], len(u)), wide[r].values.to_numpy()

    def found(x: pa.Array, y: pa.Array, cos: np.ndarray) -> pa.RecordBatch:
        less = pc.less(x, y)
        return pa.RecordBatch.from_arrays([pc.if_else(less, x, y), pc.if_else(less, y, x), pa.array(cos, pa.float64())], names=["string0", "string1", "cos"]).filter(pc.not_equal(x, y))

    def near(batches):
        for b in batches:
            for r in range(b.num_rows):
                one = b.column(0)[r].as_py() == b.column(5)[r].as_py()
                s, u, f, at, to, wide = side(b, 1, r)
                t, w, g, at_t, to_t, wide_t = side(b, 6, r) if not one else (s, u, f, at, to, wide)
                group, group_t = np.repeat(np.arange(len(at)), to - at), np.repeat(np.arange(len(at_t)), to_t - at_t)
                if one and heads:
                    rest = np.setdiff1d(np.arange(len(u)), at)
                    yield found(s.take(pa.array(rest)), s.take(pa.array(at[group[rest]])), np.einsum("ij,ij->i", u[rest], u[at[group[rest]]]))
                # two rows of at least min_cos have heads within far and both their widths: cos(a + b) as two more numbers of the product
                mine = np.column_stack([f[at], -np.cos(far + wide), np.sin(far + wide)]).astype(np.float32)
                theirs = np.column_stack([g[at_t], np.cos(wide_t), np.sin(wide_t)]).astype(np.float32)
                all_ = far + wide + wide_t.max() >= np.pi
                a = 0
                while a < len(at):
                    z = max(a + 1, int(np.searchsorted(to, at[a] + STEP, "right")))
                    hit = np.flatnonzero(((mine[a:z] @ theirs.T >= -SLACK) | all_[a:z, None]).any(0))
                    q = np.flatnonzero(np.isin(group_t, hit))
                    q = q[q > at[a]] if one else q
                    i, j = np.nonzero(f[at[a] : to[z - 1]] @ g[q].T >= min_cos - SLACK)
                    i, j = i + at[a], q[j]
                    keep = (i < j) if one else np.ones(len(i), bool)
                    if heads and one:
                        keep &= group[i] != group[j]
                    i, j = i[keep], j[keep]
                    cos = np.einsum("ij,ij->i", u[i], w[j])
                    i, j, cos = i[cos >= min_cos], j[cos >= min_cos], cos[cos >= min_cos]
                    if heads and len(i):
                        first = np.unique(group[i] * len(at_t) + group_t[j], return_index=True)[1]
                        i, j, cos = at[group[i[first]]], at_t[group_t[j[first]]], cos[first]
                    if len(i):
                        yield found(s.take(pa.array(i)), t.take(pa.array(j)), cos)
                    a = z

    other = packed.select(*(F.col(c).alias(f"{c}_") for c in packed.columns)).hint("shuffle_replicate_nl")
    return packed.join(other, F.col("block") <= F.col("block_")).mapInArrow(near, "string0 string, string1 string, cos double")


def similar_pairs(vectors: DataFrame, min_cos: float, unit: bool = False) -> DataFrame:
    """(string0, string1, cos), string0 < string1: every pair with at least that cosine. Exact.

    Vectors are packed into blocks, a row each, and each two blocks are one product of two bounded matrices. Tasks read the
    blocks from the shared folder, so disk holds each vector once; nothing is broadcast and no block grows with the data. In a
    block, vectors of at least min_cos to one of them stand under it as their head; rows are compared where the angles of their
    heads leave it open. unit: vectors aren't at length one yet, here they are taken so.
    """
    return _meetings(vectors, min_cos, unit, False)


def joining_pairs(vectors: DataFrame, min_cos: float, unit: bool = False) -> DataFrame:
    """(string0, string1): pairs that join the same strings, directly or over others, as those of similar_pairs, and are fewer.
    Heads of which any rows are near enough make a pair here, near enough themselves or not."""
    return _meetings(vectors, min_cos, unit, True).select("string0", "string1")


def nearest_target(vectors: DataFrame, targets: DataFrame, min_cos: float | None = None) -> DataFrame:
    """(string, target, cos): of each vector the target of greatest cosine, ties to the first; above min_cos where one is given.

    Targets are cut into blocks as well, so they may be of any number; each block gives its best, the best of these stays.
    """
    scratch = Scratch(vectors.sparkSession)
    vectors, targets = (scratch.write(x.select("string", "v")) for x in (vectors, targets))
    n, m = _blocks(vectors.count()), _blocks(targets.count())
    left = vectors.select("string", "v", F.lit(False).alias("t"), F.pmod(F.xxhash64("string"), F.lit(n)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    right = targets.select("string", "v", F.lit(True).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.pmod(F.xxhash64("string"), F.lit(m)).cast("int").alias("j"))

    def best(group: pa.Table) -> pa.Table:
        s, t = np.array(group.column("string").to_pylist(), dtype=object), group.column("t").to_numpy(zero_copy_only=False).astype(bool)
        u = _matrix(group.column("v"))
        if not t.any() or t.all():
            return pa.table({"string": pa.array([], pa.string()), "target": pa.array([], pa.string()), "cos": pa.array([], pa.float64())})
        order = np.argsort(s[t])
        cos = np.round(u[~t] @ u[t][order].T, 12)
        at = cos.argmax(1)
        return pa.table({"string": pa.array(s[~t], pa.string()), "target": pa.array(s[t][order][at], pa.string()), "cos": pa.array(cos[np.arange(len(at)), at], pa.float64())})

    each = left.unionByName(right).groupBy("i", "j").applyInArrow(best, "string string, target string, cos double")
    top = each.groupBy("string").agg(F.min_by(F.struct("target", "cos"), F.struct(-F.col("cos"), F.col("target"))).alias("b")).select("string", "b.target", "b.cos")
    return top if min_cos is None else top.where(F.col("cos") > min_cos)


def score_pairs(pairs: DataFrame, vectors: DataFrame, alpha: float) -> DataFrame:
    """pairs (string0, string1) with cos and score; pairs of unknown strings are left out."""
    a, b = vectors.select(F.col("string").alias("string0"), F.col("v").alias("_a")), vectors.select(F.col("string").alias("string1"), F.col("v").alias("_b"))
    rows = pairs.join(a, "string0").join(b, "string1").withColumn("cos", dot(F.col("_a"), F.col("_b")))
    return rows.withColumn("score", score(F.col("cos"), alpha)).drop("_a", "_b")


def scored_pairs(
    vectors: DataFrame, matches: DataFrame, alpha: float, min_score: float = 0.0, max_score: float | None = None, min_loss: float | None = None,
    max_loss: float | None = None, is_match: bool | None = None,
) -> DataFrame:
    """(string0, string1, group0, group1, score, loss) of all pairs of the vectors within the inclusive bounds.

    The lowest score is turned into a cosine first, so pairs below it never come about. loss is unweighted. Strings that
    matches doesn't know are left out.
    """
    known = vectors.join(matches.select("string"), "string", "left_semi")
    pairs = similar_pairs(known, score_to_cos(min_score, alpha))
    g = lambda k: matches.select(F.col("string").alias(f"string{k}"), F.col("group").alias(f"group{k}"))
    same = F.col("group0") == F.col("group1")
    rows = pairs.join(g(0), "string0").join(g(1), "string1").withColumn("score", score(F.col("cos"), alpha)).withColumn("loss", pair_loss(F.col("cos"), same, alpha))
    tests = [F.col("score") >= min_score]
    tests += [F.col("score") <= max_score] if max_score is not None else []
    tests += [F.col("loss") >= min_loss] if min_loss is not None else []
    tests += [F.col("loss") <= max_loss] if max_loss is not None else []
    tests += [same if is_match else ~same] if is_match is not None else []
    for t in tests:
        rows = rows.where(t)
    return rows.select("string0", "string1", "group0", "group1", "score", "loss")


def hardest_pairs(scored: DataFrame) -> DataFrame:
    """(string, other, loss): of each string the partner of greatest loss, ties to the first; either end of a pair counts."""
    ends = scored.select(F.explode(F.array(F.struct(F.col("string0").alias("string"), F.col("string1").alias("other"), "loss"), F.struct(F.col("string1").alias("string"), F.col("string0").alias("other"), "loss"))).alias("e")).select("e.*")
    top = ends.groupBy("string").agg(F.min_by(F.struct("other", "loss"), F.struct(-F.round("loss", 9), F.col("other"))).alias("b"))
    return top.select("string", "b.other", "b.loss")


# --- over all pairs, without a table of them ----------------------------------------------------------------------------


def _labelled(vectors: DataFrame, matches: DataFrame, *more: str) -> DataFrame:
    """(string, v, group, more..., b, i, j): the vectors of the strings in matches, once for each pair of blocks they are in."""
    rows = vectors.select("string", "v").join(matches.select("string", "group", *more), "string")
    rows = Scratch(vectors.sparkSession).write(rows)
    n = _blocks(rows.count())
    rows = rows.withColumn("b", F.pmod(F.xxhash64("string"), F.lit(n)).cast("int"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(F.least(F.col("b"), j).alias("i"), F.greatest(F.col("b"), j).alias("j")))
    return rows.withColumn("g", F.explode(grid)).select("string", "v", "group", *more, "b", "g.i", "g.j")


def _square(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A pair of blocks, sorted by string: the table, its strings, the rows of either side, their cosines, whether labels agree."""
    s = np.array(group.column("string").to_pylist(), dtype=object)
    order = np.argsort(s, kind="stable")
    group, s = group.take(pa.array(order)), s[order]
    at_i, i, j = group.column("b").to_numpy() == group.column("i")[0].as_py(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    one, two = np.flatnonzero(at_i), np.flatnonzero(at_i if i == j else ~at_i)
    u = _matrix(group.column("v"))
    label = np.unique(np.array(group.column("group").to_pylist(), dtype=object), return_inverse=True)[1]
    return group, s, one, two, u[one] @ u[two].T if len(one) and len(two) else np.zeros((len(one), len(two))), label[one][:, None] == label[two]


def _losses(cos: np.ndarray, same: np.ndarray, alpha: float) -> np.ndarray:
    z = np.maximum(alpha * (1 - cos), 1e-6)
    return np.where(same, z, -np.log(-np.expm1(-z)))


def hardest_of_all(vectors: DataFrame, matches: DataFrame, alpha: float) -> DataFrame:
    """(string, other, loss): as hardest_pairs, over all pairs of the vectors whatever their score. Each pair of blocks gives the
    hardest partner it has for each of its strings, the hardest of these stays. A string without any partner has no row."""

    def hard(group: pa.Table) -> pa.Table:
        _, s, one, two, cos, same = _square(group)
        loss = _losses(cos, same, alpha)
        loss[one[:, None] == two] = -np.inf
        sides = [(one, two, loss)] + ([(two, one, loss.T)] if group.column("i")[0].as_py() != group.column("j")[0].as_py() else [])
        out = []
        for mine, others, x in sides:
            if len(mine) and len(others):
                at = np.round(x, 9).argmax(1)
                top = x[np.arange(len(at)), at]
                out += [(s[r], s[others[k]], f) for r, k, f in zip(mine, at, top.tolist(), strict=True) if f > -np.inf]
        return pa.table({"string": pa.array([o[0] for o in out], pa.string()), "other": pa.array([o[1] for o in out], pa.string()), "loss": pa.array([o[2] for o in out], pa.float64())})

    each = _labelled(vectors, matches).groupBy("i", "j").applyInArrow(hard, "string string, other string, loss double")
    top = each.groupBy("string").agg(F.min_by(F.struct("other", "loss"), F.struct(-F.round("loss", 9), F.col("other"))).alias("b"))
    return top.select("string", "b.other", "b.loss")


def mean_losses_of_all(vectors: DataFrame, matches: DataFrame, alphas: list[float]) -> DataFrame:
    """(alpha, loss): mean loss at each alpha over all pairs of the vectors; each pair of blocks gives its sums."""

    def sums(group: pa.Table) -> pa.Table:
        _, _, one, two, cos, same = _square(group)
        if group.column("i")[0].as_py() == group.column("j")[0].as_py():
            upper = np.triu_indices(len(one), 1)
            cos, same = cos[upper], same[upper]
        total = [float(_losses(cos, same, a).sum()) for a in alphas]
        return pa.table({"alpha": pa.array(alphas, pa.float64()), "total": pa.array(total, pa.float64()), "n": pa.array([cos.size] * len(alphas), pa.int64())})

    each = _labelled(vectors, matches).groupBy("i", "j").applyInArrow(sums, "alpha double, total double, n long")
    return each.groupBy("alpha").agg((F.sum("total") / F.sum("n")).alias("loss"))


def top_of_all(vectors: DataFrame, matches: DataFrame, alpha: float, n: int = 10_000, by_group: bool = True, sort_by: tuple[str, ...] = ("impact", "score"), ascending: bool = False, skip: DataFrame | None = None) -> DataFrame:
    """As review.top_scored_pairs, over all pairs of the vectors whatever their score.

    Each pair of blocks gives its first n (by_group: of the best pair of each two groups), of which the first n of all stay:
    a pair with n better ones in its own blocks has as many among all. A row brings the partners it must not have.
    """
    bad = [c for c in sort_by if c not in ("impact", "score", "loss")]
    if bad:
        raise ValueError(f"pairs can't be sorted by {bad}")
    sizes = matches.groupBy("group").agg(F.count("*").alias("k"))
    known = join_unique(matches.select("string", "group"), sizes, ["group"], "k")
    key = "group" if by_group else "string"
    if skip is not None:
        pairs = skip.select("string0", "string1")
        if by_group:
            g = lambda i: matches.select(F.col("string").alias(f"string{i}"), F.col("group").alias(f"g{i}"))
            pairs = pairs.join(g(0), "string0").join(g(1), "string1").select(F.col("g0").alias("string0"), F.col("g1").alias("string1"))
        both = pairs.unionByName(pairs.select(F.col("string1").alias("string0"), F.col("string0").alias("string1")))
        known = known.join(both.groupBy(F.col("string0").alias(key)).agg(F.collect_set("string1").alias("out")), key, "left")
    else:
        known = known.withColumn("out", F.lit(None).cast("array<string>"))

    def best(group: pa.Table) -> pa.Table:
        group, s, one, two, cos, same = _square(group)
        g, k = np.array(group.column("group").to_pylist(), dtype=object), group.column("k").to_numpy()
        keep = ~same
        if group.column("i")[0].as_py() == group.column("j")[0].as_py():
            keep &= one[:, None] < two
        names, out = g if by_group else s, group.column("out").to_pylist()
        for r, row in enumerate(one):
            if out[row]:
                keep[r] &= ~np.isin(names[two].astype(str), np.array(out[row], dtype=str))
        p, q = np.nonzero(keep)
        loss = _losses(cos, same, alpha)[p, q]
        value = {"score": np.minimum(1.0, np.exp(-alpha * (1 - cos[p, q]))), "loss": loss, "impact": k[one[p]] * k[two[q]]}
        first, second = np.minimum(one[p], two[q]), np.maximum(one[p], two[q])
        keys = [np.round(value[c], 9) * (1 if ascending else -1) for c in sort_by]
        order = np.lexsort([second, first, *reversed(keys)])
        if by_group:
            label = np.unique(g, return_inverse=True)[1]
            a, b = label[first[order]], label[second[order]]
            order = order[np.sort(np.unique(np.minimum(a, b) * len(g) + np.maximum(a, b), return_index=True)[1])]
        order = order[:n]
        x, y = first[order], second[order]
        return pa.table({
            "string0": pa.array(s[x], pa.string()), "string1": pa.array(s[y], pa.string()), "group0": pa.array(g[x], pa.string()), "group1": pa.array(g[y], pa.string()),
            "score": pa.array(value["score"][order], pa.float64()), "loss": pa.array(loss[order], pa.float64()), "impact": pa.array(value["impact"][order], pa.int64()),
        })

    rows = _labelled(vectors, known, "k", "out").groupBy("i", "j").applyInArrow(best, "string0 string, string1 string, group0 string, group1 string, score double, loss double, impact long")
    rounded = {"score": F.round("score", 9), "loss": F.round("loss", 9), "impact": F.col("impact")}
    by = [rounded[c].asc() if ascending else rounded[c].desc() for c in sort_by] + [F.col("string0"), F.col("string1")]
    if by_group:
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(F.least("group0", "group1"), F.greatest("group0", "group1")).orderBy(*by))).where(F.col("_r") == 1)
    return rows.orderBy(*by).limit(n).select("string0", "string1", "group0", "group1", "score", "loss", "impact")
