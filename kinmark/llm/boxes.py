"""Problem 8: filling fixed-capacity containers, by Martello-Toth dominance reduction and best-fit on size multiplicities.

Items of one size are alike, so packing is planned over the number of items of each size, of which there are at most as many
as the capacity has units. A plan is a list of runs of equal boxes; items then find their box by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import ranks
from ..plans.storage import Scratch
from .tokens import VOCABULARY, token_count

#: Rows of a plan that are broadcast, 50 MB of them; a longer plan is shuffled.
SENT = 500_000


def pack(sizes: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Runs (number of boxes, {size: items of it in each}) that hold all items of sizes {size: number}, none above capacity.

    Reduction: for the largest items on, a set of an item and one or two others is fixed where it dominates any other set with
    that item (see dominating). What is left is packed best-fit, largest first.
    """
    left = {s: n for s, n in sizes.items() if s > 0 and n > 0}
    runs: list[tuple[int, dict[int, int]]] = []
    for s in sorted(left, reverse=True):
        while left.get(s):
            room = capacity - s
            mates = sorted(x for x, n in left.items() if x <= room and n > (x == s))
            if not mates:
                runs.append((left.pop(s), {s: 1}))
                break
            fixed = dominating(mates, {x: left[x] - (x == s) for x in mates}, room)
            if fixed is None:
                break
            content = dict(Counter([s, *fixed]))
            n = min(left[x] // k for x, k in content.items())
            runs.append((n, content))
            for x, k in content.items():
                left[x] -= n * k
            left = {x: k for x, k in left.items() if k}
    return runs + _best_fit(left, capacity)


def dominating(mates: list[int], there: dict[int, int], room: int) -> list[int] | None:
    """One or two of the sizes `mates` (sorted, `there` of each) that fit into room and dominate all that fit: each other set can be
    parted so that every part is at most one of them. Such a set may be fixed. None where three may fit, which isn't looked at.

    One item does where it fills the room, or no two together take more than it. Two do, the largest and what still fits beside
    it, where any two items are at most these one by one, or together at most the largest.
    """
    largest = mates[-1]
    if largest == room or mates[0] + (mates[0] if there[mates[0]] > 1 else mates[1] if len(mates) > 1 else room) > room:
        return [largest]
    if mates[0] * 3 <= room:
        return None

    def beside(x: int, most: int) -> int | None:
        """The largest size up to `most` that fits beside x."""
        i = bisect_right(mates, min(room - x, most)) - 1
        if i >= 0 and mates[i] == x and there[x] < 2:
            i -= 1
        return mates[i] if i >= 0 else None

    second = beside(largest, largest)
    for x in mates:
        if 2 * x > room:
            break
        other = beside(x, largest)
        if other is None or other < x or x + other <= largest:
            continue
        if second is None or x > second:
            return None
    return [largest] if second is None or all((y := beside(x, largest)) is None or x + y <= largest for x in mates if 2 * x <= room) else [largest, second]


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit over multiplicities: the fullest box that has room takes as many of the size as fit, as one by one it would."""
    at: dict[int, list[list]] = {}  # free room -> runs [boxes, content]
    rooms: list[int] = []

    def put(room: int, n: int, content: dict[int, int]) -> None:
        if room not in at:
            at[room] = []
            insort(rooms, room)
        at[room].append([n, content])

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = min(capacity // s, n)
                boxes = n // each
                put(capacity - each * s, boxes, {s: each})
                n -= boxes * each
                continue
            room = rooms[i]
            run = at[room][-1]
            each = min(room // s, n)
            boxes = min(run[0], n // each)
            run[0] -= boxes
            if not run[0]:
                at[room].pop()
                if not at[room]:
                    del at[room]
                    rooms.pop(i)
            put(room - each * s, boxes, run[1] | {s: each})
            n -= boxes * each
    return [(n, content) for room in sorted(at) for n, content in at[room]]


def segments(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(size, first rank, after, first box, items a box) for the items of each size, and the number of boxes."""
    out, taken, box = [], dict.fromkeys(sizes, 0), 0
    for n, content in pack(sizes, capacity):
        for s, each in content.items():
            out.append((s, taken[s], taken[s] + n * each, box, each))
            taken[s] += n * each
        box += n
    return out, box


def filled_boxes(documents: DataFrame, boxes: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(box, bin, id, part, start_token, tokens): where each text goes in boxes of each capacity.

    A text above the capacity is cut into parts of just the capacity, which fill boxes of their own, and a rest; no other is
    cut. Empty texts take no room and go to box 0; null texts aren't there. Boxes without a positive capacity take nothing.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    sized = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), token_count(F.col(text_col), vocabulary).alias("n"))
    sized = scratch.write(sized)
    kinds = [(r["box"], r["capacity_tokens"]) for r in boxes.where("capacity_tokens > 0").orderBy("box").collect()]
    cuts = spark.createDataFrame(kinds, "box string, capacity long")
    each = sized.join(F.broadcast(cuts)).select("box", "capacity", "_id", "n", F.floor(F.col("n") / F.col("capacity")).alias("whole"), F.expr("n % capacity").alias("rest"))
    # sizes below the capacity: the driver gets at most that many numbers a capacity
    counted = each.where("rest > 0").groupBy("box", "rest").agg(F.count("*").alias("k")).collect()
    rows, used = [], []
    for box, capacity in kinds:
        found, n = segments({r["rest"]: r["k"] for r in counted if r["box"] == box}, capacity)
        rows += [(box, *x) for x in found]
        used.append((box, n))
    plan = spark.createDataFrame(rows, "box string, rest long, first long, after long, at long, each long")
    plan = F.broadcast(plan) if len(rows) <= SENT else plan
    first_whole = F.broadcast(spark.createDataFrame(used, "box string, packed long"))
    most = max((r["k"] for r in counted), default=0)
    rests = ranks(each.where("rest > 0").select("box", "capacity", "_id", "n", "whole", "rest"), ["box", "rest"], F.col("_id"), most=most)
    placed = rests.join(plan.withColumnsRenamed({"box": "b", "rest": "r"}), F.expr("b = box AND r = rest AND rank >= first AND rank < after")).select(
        "box", F.expr("at + (rank - first) DIV each").alias("bin"), "_id", F.col("whole").alias("part"), F.expr("whole * capacity").alias("start_token"), F.col("rest").alias("tokens")
    )
    long_texts = each.where("whole > 0")
    wholes = ranks(long_texts, ["box"], F.col("_id"), F.col("whole"), most=sum(r["k"] for r in counted)).join(first_whole, "box")
    wholes = wholes.select("*", F.explode(F.expr("sequence(0L, whole - 1)")).alias("part")).select(
        "box", F.expr("packed + rank + part").alias("bin"), "_id", "part", F.expr("part * capacity").alias("start_token"), F.col("capacity").alias("tokens")
    )
    zero = F.lit(0).cast("long")
    empty = each.where("n = 0").select("box", zero.alias("bin"), "_id", zero.alias("part"), zero.alias("start_token"), zero.alias("tokens"))
    return placed.unionByName(wholes).unionByName(empty).withColumnRenamed("_id", id_col)


def box_report(filled: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box, capacity, boxes, at_least, tokens, unused_share): at_least is the tokens' lower bound on the number of boxes."""
    sums = filled.groupBy("box").agg(F.countDistinct("bin").alias("boxes"), F.sum("tokens").alias("tokens"))
    sums = sums.join(F.broadcast(boxes.select("box", F.col("capacity_tokens").alias("capacity"))), "box")
    return sums.select("box", "capacity", "boxes", F.expr("CAST(ceil(tokens / capacity) AS BIGINT)").alias("at_least"), "tokens", F.round(1 - F.col("tokens") / (F.col("boxes") * F.col("capacity")), 6).alias("unused_share"))
