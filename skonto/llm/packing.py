"""Variable-capacity best-fit packing of token sequences.

Texts become pieces of at most the largest permitted length. Pieces are dealt to groups of bounded size by a hash of
their row, and each group is packed by best fit in decreasing order: a piece goes to the open bin that it fills best; if
none has room a new bin is opened whose size costs least for each token that it is expected to hold, looking ahead
at the pieces still to come; at the end every bin is cut down to the smallest permitted length that holds its contents.

Defined cases: a null or empty text has no words and takes one place, its end mark; a text longer than the largest
length is cut into pieces of that length and a rest; rows without an id and rows that repeat are packed like any other;
columns other than the named ones are ignored, whatever they are called; no rows give no bins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto.llm.common import materialise

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs besides its places, so that fewer and larger bins win where both are as full.
OVERHEAD = 16
#: About so many pieces are packed together.
GROUP_PIECES = 50_000


def best_fit(lengths: Sequence[int], capacities: Sequence[int], costs: Mapping[int, float]) -> tuple[list[int], list[int]]:
    """Pack ``lengths``, none above the largest capacity: each item's bin, and each bin's final capacity."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    waiting = [0] * (sizes[-1] + 1)
    for x in lengths:
        waiting[x] += 1
    present = sum(1 << x for x, n in enumerate(waiting) if n)
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    roomy = 0  # bit r: some open bin has r places left
    bins: list[int] = [0] * len(lengths)
    opened: list[int] = []
    used: list[int] = []

    def expected(space: int) -> int:
        """Places that the largest waiting items would fill of ``space``, each length as often as it waits."""
        left, mask = space, present
        while below := mask & ((1 << (left + 1)) - 1) & ~1:
            x = below.bit_length() - 1
            left -= min(left // x, waiting[x]) * x
            mask = below ^ (1 << x)
        return space - left

    for i in order:
        x = lengths[i]
        waiting[x] -= 1
        if not waiting[x]:
            present &= ~(1 << x)
        if fitting := roomy >> x:
            r = x + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                roomy &= ~(1 << r)
        else:
            size = min((c for c in sizes if c >= x), key=lambda c: (costs[c] / (x + expected(c - x)), c))
            b, r = len(opened), size
            opened.append(size)
            used.append(0)
        bins[i] = b
        used[b] += x
        if r > x:
            room[r - x].append(b)
            roomy |= 1 << (r - x)
    return bins, [next(c for c in sizes if c >= u) for u in used]


def _pack(capacities: Sequence[int], costs: Mapping[int, float]) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["piece"].to_numpy(), t["row"].to_numpy()))
        t = t.take(pa.array(order))
        lengths = t["length"].to_pylist()
        bins, sizes = best_fit(lengths, capacities, costs)
        inside, offsets = [0] * len(sizes), []
        for b, x in zip(bins, lengths):
            offsets.append(inside[b])
            inside[b] += x
        group = t["grp"][0].as_py()
        return pa.table(
            {
                "doc_id": t["doc_id"],
                "piece": t["piece"],
                "start": t["start"],
                "length": t["length"],
                "bin_id": pa.array([(group << 32) + b for b in bins], pa.int64()),
                "capacity": pa.array([sizes[b] for b in bins], pa.int32()),
                "bin_offset": pa.array(offsets, pa.int32()),
            }
        )

    return run


def pack(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: Column | None = None,
    capacities: Sequence[int] = CAPACITIES,
    costs: Mapping[int, float] | None = None,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start and length in tokens, bin_id, the bin's capacity and the place in it.

    ``length`` counts a text's tokens; without it these are its words between white space and one end mark.
    """
    tokens = length if length is not None else F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"\S+")), F.lit(0)) + 1
    longest = max(capacities)
    # Read back from a table, rows keep their number even if a task runs again.
    sized = materialise(documents.select(F.col(doc_id).cast("long").alias("doc_id"), tokens.cast("long").alias("n")), "lengths")
    pieces = sized.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "row", "n", F.explode(F.expr(f"sequence(0L, greatest(0L, (n - 1) div {longest}))")).alias("piece")
    )
    count = sized.agg(F.sum(F.expr(f"greatest(1L, (n + {longest - 1}) div {longest})")).alias("n")).first().n or 0
    groups = max(1, -(-count // group_pieces))
    placed = pieces.select(
        "doc_id",
        "row",
        "piece",
        (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest), F.greatest(F.col("n"), F.lit(1)) - F.col("piece") * longest).cast("int").alias("length"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("grp"),
    )
    prices = {c: (costs or {}).get(c, c + OVERHEAD) for c in capacities}
    return placed.groupBy("grp").applyInArrow(
        _pack(sorted(capacities), prices),
        "doc_id long, piece long, start long, length int, bin_id long, capacity int, bin_offset int",
    )
