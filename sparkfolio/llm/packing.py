"""Best-fit packing by bin completion on the histogram of piece lengths.

Sequences are planned for lengths, not for rows: a pattern says which lengths share a sequence and how many
sequences it makes. The plan depends on at most `capacity` distinct lengths, so it is small whatever the
corpus; rows then find their place by their rank among the pieces of equal length.
"""

import itertools
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, slices, stored, strings
from .tokens import encoder, vocabulary

#: Search effort of one plan: fillings looked at; None for all of them. It bounds time only; every piece is placed.
NODES = 200_000
#: Fillings of a node that are put in order of their waste; what is left of the enumeration follows in its own order.
ORDERED = 32
#: Slots (24 bytes each) that are broadcast; a larger plan is joined instead.
MOST_SLOTS = 2_000_000

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first
Plan = list[tuple[Pattern, int]]  # a pattern and how many sequences it makes


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for each threshold k, pieces over capacity-k stand alone, those over half need
    one each, and the volume of what is at least k must fit into what they leave."""
    size = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in size.tolist()], np.int64)
    rows, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size * n)])
    half = np.searchsorted(size, capacity // 2, side="right")
    k = np.concatenate([[0], size[:half]])
    upto, least = np.searchsorted(size, capacity - k, side="right"), np.searchsorted(size, k)
    pairs = rows[upto] - rows[half]
    room = pairs * capacity - (volume[upto] - volume[half])
    over = volume[half] - volume[least] - room
    return int((rows[-1] - rows[upto] + pairs + np.maximum(0, -(-over // capacity))).max())


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, many equal pieces at a time: each goes to the fullest sequences that have room."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by free room
    for size in sorted(counts, reverse=True):
        n = counts[size]
        for room in sorted(r for r in open_ if r >= size):
            if not n:
                break
            k, groups = room // size, open_.pop(room)
            while groups:
                pattern, bins = groups.pop()
                full = min(bins, n // k)
                if full:
                    open_[room - k * size].append(((*pattern, (size, k)), full))
                    n -= full * k
                bins -= full
                if bins and 0 < n < k:
                    open_[room - n * size].append(((*pattern, (size, n)), 1))
                    bins, n = bins - 1, 0
                if bins:
                    open_[room].append((pattern, bins))
                if not n:
                    break
            open_[room].extend(groups)
        if n:
            k = capacity // size
            if n // k:
                open_[capacity - k * size].append((((size, k),), n // k))
            if n % k:
                open_[capacity - n % k * size].append((((size, n % k),), 1))
    return [g for groups in open_.values() for g in groups]


def fillings(counts: list[int], there: int, room: int, steps: list[int]) -> Iterator[list[int]]:
    """Every undominated way to fill room, one at a time, the largest pieces first. counts: pieces by length;
    there: a bit for each length of which any are left; steps: how many fillings may still be looked at. A filling is dominated if a piece of it, or two of its
    pieces together, can be exchanged for one larger available piece that still fits."""

    def dominated(f: list[int], slack: int) -> bool:
        used = Counter(f)
        free = there
        for s, n in used.items():
            if counts[s] <= n:
                free &= ~(1 << s)
        sums = {*used, *(x + y for x in used for y in used if x < y or x == y and used[x] > 1)}
        return any(free >> x + 1 & (1 << slack) - 1 or x not in used and free >> x & 1 for x in sums)

    f: list[int] = []
    used: Counter = Counter()
    left, top, spare = room, room, there  # spare: lengths of which some are still left beside f
    while True:
        while (s := (spare & (1 << min(left, top) + 1) - 1).bit_length() - 1) > 0:
            f.append(s)
            used[s] += 1
            left, top = left - s, s
            if used[s] == counts[s]:
                spare &= ~(1 << s)
        steps[0] -= 1
        if steps[0] < 0:
            return
        if not (spare & (1 << left + 1) - 1) >> 1 and not dominated(f, left):
            yield list(f)
        # the next smaller piece in place of the last one that has one
        while f:
            s = f.pop()
            used[s] -= 1
            left, spare = left + s, spare | 1 << s
            if (spare & (1 << s) - 1) >> 1:
                top = s - 1
                break
        else:
            return


def fullest(counts: list[int], there: int, room: int) -> list[int]:
    """A filling of least waste, by the sums that the pieces reach, the largest lengths first; it ends as soon as the room
    can be filled whole. counts and there: as in fillings."""
    within, reach, stages = (1 << room + 1) - 1, 1, []
    spare = there & within & ~1
    while spare and not reach >> room & 1:
        s = spare.bit_length() - 1
        spare &= ~(1 << s)
        most, step, before = min(counts[s], room // s), 1, reach
        left = most
        while left:  # 1, 2, 4, ... copies and the rest
            step = min(step, left)
            reach |= reach << step * s & within
            left, step = left - step, 2 * step
        if reach != before:
            stages.append((s, before))
    at, out = reach.bit_length() - 1, []
    for s, before in reversed(stages):
        while not before >> at & 1:
            out.append(s)
            at -= s
    return out[::-1]


def plan(counts: dict[int, int], capacity: int, nodes: int | None = NODES) -> Plan:
    """Bin completion, searched by limited discrepancy. The incumbent starts as best-fit. A node takes the
    largest remaining length and fills its sequences, as many as it can or one only: first with a filling of least
    waste, then with the undominated ones, the first of them in order of waste. The nth alternative costs n, and paths of
    cost 0, 1, 2, ... are followed until the bound is met, nothing is left to try, or `nodes` fillings were looked
    at. What the waste so far, or L2, rules out is left."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    used, goal, steps = sum(n for _, n in best), lower_bound(counts, capacity), [sys.maxsize if nodes is None else nodes]
    rest = [0] * (capacity + 1)
    for s, n in counts.items():
        rest[s] = n
    few = len(counts) <= 64

    def children(there: int) -> Iterator[tuple[dict[int, int], int]]:
        largest = there.bit_length() - 1
        rest[largest] -= 1
        own = there if rest[largest] else there & ~(1 << largest)
        now = rest.copy()
        rest[largest] += 1
        first = fullest(now, own, capacity - largest)
        steps[0] -= 1

        def ordered() -> Iterator[list[int]]:
            yield first
            others = fillings(now, own, capacity - largest, steps)
            yield from sorted(itertools.islice(others, ORDERED), key=sum, reverse=True)
            yield from others

        seen = sorted(first)
        for k, f in enumerate(ordered()):
            if k and sorted(f) == seen:
                continue
            need = Counter([largest, *f])
            times = min(rest[s] // k for s, k in need.items())
            yield need, times
            if times > 1:
                yield need, 1

    for cost in itertools.count():
        if used <= goal or steps[0] <= 0:
            break
        there = sum(1 << s for s in counts)
        volume, bins, more = sum(s * n for s, n in counts.items()), 0, False
        done: list[tuple[dict[int, int], int]] = []
        stack = [(children(there), cost, 0)]  # the node's alternatives, cost left, alternatives taken
        while stack:
            ways, left, taken = stack.pop()
            if len(done) > len(stack):  # back from an alternative: undo it
                need, times = done.pop()
                for s, k in need.items():
                    rest[s] += times * k
                    there |= 1 << s
                    volume += s * times * k
                bins -= times
            if used <= goal or steps[0] <= 0:
                continue
            if taken > left:
                more = more or next(ways, None) is not None
                continue
            if (way := next(ways, None)) is None:
                continue
            stack.append((ways, left, taken + 1))
            need, times = way
            for s, k in need.items():
                rest[s] -= times * k
                volume -= s * times * k
                if not rest[s]:
                    there &= ~(1 << s)
            bins += times
            done.append(way)
            if not there:
                if bins < used:
                    best, used = [(tuple(sorted(n.items(), reverse=True)), t) for n, t in done], bins
            if there and bins + -(-volume // capacity) < used and not ((few or len(stack) % 64 == 0) and bins + lower_bound({s: n for s, n in enumerate(rest) if n}, capacity) >= used):
                stack.append((children(there), left - taken, 0))
            else:
                stack.append((iter(()), 0, 0))
        if not more:
            break
    return best


def slots(made: Plan) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: the piece of rank r in [rank, ...) lies in sequence base + (r - rank)."""
    rows, taken, base = [], Counter(), 0
    for pattern, n in made:
        offset = 0
        for size, copies in pattern:
            for _ in range(copies):
                rows.append((size, taken[size], n, base, offset))
                taken[size] += n
                offset += size
        base += n
    x = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "n", "base", "offset"), x.T))


def pieces(docs: DataFrame, vocab: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored table of pieces: id, piece, start, length, ids (little-endian u32), part and nth, the rank
    among the pieces of its length in its part. Each whole text is encoded and end_id follows; null and
    empty texts are end_id alone. Only documents over capacity are cut; their first piece takes the remainder."""
    path = vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for piece in slices(batch, 1):
                flat, offsets = encoder(path).encode(strings(piece.column(1)))
                flat = flat.astype("<u4")
                cols: list[list] = [[] for _ in range(6)]
                for row, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    data, n, start, k = flat[a:b].tobytes() + end, b - a + 1, 0, 0
                    while start < n:
                        size = (n - start - 1) % capacity + 1
                        for c, v in zip(cols, (row, k, start, size, data[4 * start : 4 * (start + size)], seen[size])):
                            c.append(v)
                        seen[size] += 1
                        start, k = start + size, k + 1
                row, k, start, size, data, nth = cols
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(row, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary()), pa.array([part] * len(k), pa.int64()), pa.array(nth, pa.int64())],
                    ["id", "piece", "start", "length", "ids", "part", "nth"],
                )

    asked = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text"))
    made = asked.mapInArrow(run, f"id {asked.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids binary, part long, nth long")
    return stored(made, "pieces", "zstd")


def pack(made: DataFrame, capacity: int, nodes: int | None = NODES) -> DataFrame:
    """pieces() and ids_crc32, sequence_id, offset, sequences (how many the plan makes) and at_least (a bound that no
    plan can be under). No sequence is over capacity and none has gaps. A piece's
    rank among those of its length is its rank in its part plus the counts of earlier parts, so no length,
    however common, meets in one task. nodes: the search effort, None until the plan is proven best. An empty table
    gives no rows."""
    spark = made.sparkSession
    by = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    planned = plan(counts, capacity, nodes)
    place, bound = slots(planned), lower_bound(counts, capacity) if counts else 0
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    told = {"ids_crc32": F.crc32("ids"), "sequences": F.lit(sum(n for _, n in planned)).cast("long"), "at_least": F.lit(bound).cast("long")}
    x = made.withColumns(told).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "part")
    if len(place["length"]) > MOST_SLOTS:
        s = spark.createDataFrame(pa.table(place)).toDF("length", "from", "n", "first", "offset")
        x = x.join(s, (x["length"] == s["length"]) & (x["rank"] >= s["from"]) & (x["rank"] < s["from"] + s["n"])).drop(s["length"])
        return x.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("from")).drop("from", "n", "first", "rank")
    shared = spark.sparkContext.broadcast(place)

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        key, rank = p["length"] << 44 | p["rank"], rank.to_numpy()
        at = np.searchsorted(key, length.to_numpy() << 44 | rank, side="right") - 1
        return pd.DataFrame({"sequence_id": p["base"][at] + rank - p["rank"][at], "offset": p["offset"][at]})

    return x.withColumn("at", find("length", "rank")).select("*", "at.sequence_id", "at.offset").drop("at", "rank")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pack(pieces(documents(spark, sf_dir), "byte_bpe_50k.json", 2048), 2048)
    return x.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequences", "at_least")
