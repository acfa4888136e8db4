"""Filling containers of fixed capacity with texts by the sum-of-squares rule.

Each text goes where, after placing it, the sum over all residual gaps of the squared number of open
containers with that gap is smallest. A text longer than the capacity fills containers of its own and only
its rest is placed. Texts are spread over shares of bounded size at random; each share is packed on its
own, and the containers it leaves open are few against those it fills.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that one task packs, and specs at most. A share's containers are numbered from share << 32.
SHARE, MAX_SPECS = 40_000, 1000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each piece, in the given order; sizes are from 1 to ``capacity``.

    Moving a piece of size s into a container of gap g takes one from N(g) and adds one to N(g - s), so the
    sum of squares changes by 2 (N(g - s) - N(g)) + 2, by -2 N(g) + 1 where it closes the gap and by
    2 N(C - s) + 1 for a new container. Of equal changes the smallest gap is taken.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        gaps = count[s:capacity]  # gaps from s to C - 1
        best, where = 2 * int(count[capacity - s]) + 1 if s < capacity else 1, capacity
        if len(gaps):
            change = 2 * (count[: capacity - s] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = 1 << 40
            j = int(change.argmin())
            if change[j] <= best:
                where = s + j
        if where == capacity:
            box = used
            used += 1
        else:
            box = open_[where].pop()
            count[where] -= 1
        out[i] = box
        if where > s:
            count[where - s] += 1
            open_[where - s].append(box)
    return out


def pack(items: DataFrame, specs: DataFrame, share: int = SHARE) -> DataFrame:
    """``(spec_id, id, piece_no, first_token, tokens, container_id)``: every piece and its container.

    ``items`` has ``id`` (unique) and ``tokens`` (INT), ``specs`` has ``spec_id`` and ``capacity_tokens``,
    of which there are few. Items without tokens and specs without positive capacity are left out; specs
    given twice count once; repeated ids are packed each. ``container_id`` is unique within a spec.
    """
    kinds = specs.where("capacity_tokens > 0").select("spec_id", F.col("capacity_tokens").cast("int").alias("capacity")).distinct().limit(MAX_SPECS + 1).collect()
    if len(kinds) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    items = items.select("id", F.col("tokens").cast("int").alias("tokens")).where("tokens > 0")
    # A large item is cut into full containers and its rest; random shares hold about `share` rests each.
    total = items.count()
    shares = max(1, -(-total // share))
    each = [F.struct(F.lit(k.spec_id).cast("long").alias("spec_id"), F.lit(k.capacity).alias("capacity")) for k in kinds]
    each = F.array(*each) if each else F.expr("cast(array() as array<struct<spec_id:bigint,capacity:int>>)")
    dealt = items.select("id", "tokens", F.explode(each).alias("k")).select("id", "tokens", "k.*").withColumn("share", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shares)).cast("int"))
    schema = "spec_id long, id long, piece_no int, first_token int, tokens int, container_id long"

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        spec, part = (k.as_py() for k in key)
        capacity = t["capacity"][0].as_py()
        ids, tokens = t["id"].to_numpy(), t["tokens"].to_numpy().astype(np.int64)
        order = np.lexsort((ids, -(tokens % capacity)))
        ids, tokens = ids[order], tokens[order]
        full, rest = tokens // capacity, tokens % capacity
        at = np.flatnonzero(rest)
        boxes = sum_of_squares(rest[at], capacity)
        n = int(boxes.max()) + 1 if len(boxes) else 0
        own = np.repeat(np.arange(len(ids)), full)
        no = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
        who = np.concatenate([own, at])
        piece = np.concatenate([no, full[at]])
        size = np.concatenate([np.full(len(own), capacity), rest[at]])
        box = np.concatenate([n + np.arange(len(own)), boxes]) + (part << 32)
        return pa.table({
            "spec_id": pa.array(np.full(len(who), spec), pa.int64()), "id": pa.array(ids[who]), "piece_no": pa.array(piece, pa.int32()),
            "first_token": pa.array(piece * capacity, pa.int32()), "tokens": pa.array(size, pa.int32()), "container_id": pa.array(box, pa.int64()),
        })

    return dealt.groupBy("spec_id", "share").applyInArrow(fill, schema)


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_id, capacity_tokens, pieces, tokens, containers, used_share)`` for each spec."""
    once = specs.select("spec_id", "capacity_tokens").distinct()
    return (
        packed.groupBy("spec_id", "container_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
        .groupBy("spec_id").agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"))
        .join(once, "spec_id")
        .select("spec_id", "capacity_tokens", "pieces", "tokens", "containers", (F.col("tokens") / F.col("containers") / F.col("capacity_tokens")).alias("used_share"))
    )
