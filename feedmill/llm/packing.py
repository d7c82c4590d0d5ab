"""Problem 9: items of varying size into containers of fixed capacity.

Bounded-space online best fit. Within a block of items a fixed number of containers is open; a bitset has
a bit for each amount of free space that an open container has, so the best fit for an item is the lowest
set bit from its size on, found by a shift. Where nothing fits and all may be open are open, the fullest is
closed. Blocks are independent, so the work spreads over the cluster and a block's state stays small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.session import materialise

CAPACITY = 8192
OPEN_CONTAINERS = 256
ROWS_PER_BLOCK = 65536


def best_fit(sizes: np.ndarray, capacity: int, open_containers: int) -> np.ndarray:
    """The container (from 0) of each item, in the order given; every size is from 1 to ``capacity``."""
    free_bits, opened, made = 0, 0, 0
    stacks: dict[int, list[int]] = {}
    placed = np.empty(len(sizes), dtype=np.int64)

    def pop(free: int) -> int:
        nonlocal free_bits
        stack = stacks[free]
        container = stack.pop()
        if not stack:
            free_bits &= ~(1 << free)
        return container

    for k, size in enumerate(sizes.tolist()):
        fitting = free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            container = pop(free)
        else:
            if opened == open_containers:
                pop((free_bits & -free_bits).bit_length() - 1)
                opened -= 1
            container, free = made, capacity
            made += 1
            opened += 1
        placed[k] = container
        left = free - size
        if left:
            stacks.setdefault(left, []).append(container)
            free_bits |= 1 << left
        else:
            opened -= 1
    return placed


def pack(items: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "n_tokens", open_containers: int = OPEN_CONTAINERS, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``id_col, part, size, container``: where each item, or each part of an item larger than ``capacity``, lies.

    A larger item fills whole containers first and only its rest shares one. Items of size 0, null or
    below have one row with part 0 and no container. Repeated rows are items of their own.
    """
    # counted and packed from one written table: what made the sizes runs once
    items = materialise(items.select(id_col, size_col))
    blocks = max(1, math.ceil(items.count() / rows_per_block))
    key_type = items.schema[id_col].dataType.simpleString()
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    keyed = items.select(F.col(id_col).alias("key"), size.alias("size"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"))

    def run(block: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "size"], kind="stable")
        sizes = rows["size"].to_numpy(np.int64)
        whole, rest = sizes // capacity, sizes % capacity
        parts = whole + ((rest > 0) | (sizes == 0))
        item = np.repeat(np.arange(len(rows)), parts)
        part = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
        part_size = np.where(part < whole[item], capacity, rest[item])
        # where all items alike are small the order doesn't matter; else the bounded number of open containers serves all orders alike
        container = np.full(len(item), -1, dtype=np.int64)
        filled = part_size > 0
        container[filled] = best_fit(part_size[filled], capacity, open_containers)
        made = pd.array(container, dtype="Int64") + (int(block[0]) << 40)
        made[~filled] = pd.NA
        return pd.DataFrame({"key": rows["key"].to_numpy()[item], "part": part.astype(np.int32), "size": part_size, "container": made})

    packed = keyed.groupBy("block").applyInPandas(run, f"key {key_type}, part int, size bigint, container bigint")
    return packed.withColumnRenamed("key", id_col)
