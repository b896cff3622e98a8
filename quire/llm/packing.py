"""Texts packed into containers of a fixed number of tokens, neighbours along a space-filling curve together.

Each text's hashed vector, projected to a few dimensions, gives its place on a Hilbert curve. The curve is cut into
cells of neighbouring texts, by the leading bits of their places, so that cells and container ids hang on the data
alone and not on partitions. A cell is packed along the curve: a container opens with the first text that is left and is
filled from the AHEAD texts that follow. The few containers of a cell with most room are opened again in the next larger
cell, up to the whole curve. Only a text longer than a container is cut, into full containers and a rest.

Defined cases: null and empty texts have no tokens and are not packed; repeated rows of a key are packed once;
copies under other keys are items of their own, spread over the curve's neighbours by a hash; specs without a
positive capacity are left out; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import DIMENSIONS, RANKS, sized_texts
from quire.operators.keys import sized as sized_keys
from quire.session import staged

CELL = 16_384  # texts of a cell of the curve, on average; a cell is packed in one call
AHEAD = 384  # neighbours along the curve from which a container is filled
FULL = 0.995  # containers fuller than this are done
PASSED_ON = 8  # containers of a cell, those with most room, that are opened again one level up
ORDER = 8  # bits of the curve in each dimension


def hilbert(cells: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n, dimensions), by the transpose method."""
    x = cells.T.astype(np.uint64).copy()
    n = len(x)
    top = np.uint64(1 << (ORDER - 1))
    q = top
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(ORDER - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
    return key


def curve_keys(sized: DataFrame, key: str) -> DataFrame:
    """(key, n_tokens, curve) of texts that have tokens."""
    kind = dict(sized.dtypes)[key]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = batch[[f"v{d}" for d in range(DIMENSIONS)]].to_numpy()
            cells = np.clip((np.tanh(v / 2) + 1) * (1 << (ORDER - 1)), 0, (1 << ORDER) - 1).astype(np.int64)
            yield pd.DataFrame({key: batch[key], "n_tokens": batch["n_tokens"], "curve": hilbert(cells)})

    return sized.where("n_tokens > 0").mapInPandas(place, f"{key} {kind}, n_tokens bigint, curve bigint")


def fill(sizes: list[int], capacity: int, ahead: int = AHEAD) -> list[int]:
    """Container (from 0) of each item, given in curve order: a container opens with the first item that is left and takes
    the largest ones that fit from the `ahead` items that follow."""
    put = [0] * len(sizes)
    near: list[tuple[int, int]] = []  # (size, place) of the items in view, by size
    gone = [False] * len(sizes)
    head = seen = made = 0
    while head < len(sizes):
        while seen < len(sizes) and len(near) < ahead:
            insort(near, (sizes[seen], seen))
            seen += 1
        space = capacity - sizes[head]
        near.pop(bisect_left(near, (sizes[head], head)))
        put[head], gone[head] = made, True
        while near and near[0][0] <= space:
            k = bisect_left(near, (space + 1, -1)) - 1
            k = bisect_left(near, (near[k][0], -1))  # of equal sizes the first along the curve
            size, i = near.pop(k)
            put[i], gone[i] = made, True
            space -= size
            if seen < len(sizes):
                insort(near, (sizes[seen], seen))
                seen += 1
        made += 1
        while head < len(sizes) and gone[head]:
            head += 1
    return put


def _cells(n: int) -> int:
    """Leading bits of the curve that part n items into cells of about CELL."""
    return max(0, min(ORDER * DIMENSIONS, (max(1, n // CELL)).bit_length() - 1))


def packed(docs: DataFrame, specs: DataFrame, key: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(container_name, container_id, key, piece_no, first_token, n_tokens): where each text or piece of a text lies."""
    sized = sized_texts(docs, key, text, ranks=ranks).dropDuplicates([key])
    placed = staged(curve_keys(sized, key), "curve")
    kind = dict(docs.dtypes)[key]
    wanted = specs.where("container_name is not null and capacity_tokens > 0").select("container_name", "capacity_tokens").dropDuplicates(["container_name"]).collect()  # settings
    columns = ["container_name", "container_id", key, "piece_no", "first_token", "n_tokens"]
    schema = f"container_name string, container_id string, {key} {kind}, piece_no int, first_token bigint, n_tokens bigint"
    if not wanted:
        return docs.sparkSession.createDataFrame([], schema)
    kinds = [F.struct(F.lit(r[0]).alias("container_name"), F.lit(int(r[1])).alias("capacity")) for r in wanted]
    each = placed.select("*", F.inline(F.array(*kinds)))
    full = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    piece = F.posexplode(F.array_repeat(F.col("capacity"), full)).alias("piece", "size")
    whole = each.select("container_name", key, "capacity", piece).select(
        "container_name", F.concat(F.lit("text "), F.col(key).cast("string"), F.lit(" "), F.col("piece") + 1).alias("container_id"), key, (F.col("piece") + 1).alias("piece_no"),
        (F.col("piece") * F.col("capacity")).cast("bigint").alias("first_token"), F.col("size").cast("bigint").alias("n_tokens"),
    )
    rest = F.col("n_tokens") - full * F.col("capacity")
    rests = each.select(
        "container_name", "capacity", key, (full + 1).alias("piece_no"), (full * F.col("capacity")).cast("bigint").alias("first_token"), rest.cast("bigint").alias("n_tokens"), "curve",
        F.xxhash64(key).alias("spot"),
    ).where("n_tokens > 0")
    bits = _cells(placed.count())
    # a cell in which the curve does not part the texts, such as one of many copies, is cut by the hash
    cell = F.shiftright("curve", ORDER * DIMENSIONS - bits)
    crowded = placed.groupBy(cell.alias("cell")).agg(F.ceil(F.count("*") / (4 * CELL)).alias("parts")).where("parts > 1")
    rests = rests.withColumn("cell", cell).join(sized_keys(staged(crowded, "crowded-cells")), "cell", "left").withColumn("part", F.pmod("spot", F.coalesce("parts", F.lit(1))))
    out, level = whole, 0
    while True:
        last = bits == 0
        done = rests.groupBy("container_name", "cell", "part").applyInPandas(_packer(key, columns, level, last), f"{schema}, capacity int, curve bigint, spot bigint, cell bigint")
        if last:
            return out.unionByName(done.select(*columns))
        done = staged(done, "packed-cells")
        out = out.unionByName(done.where("container_id is not null").select(*columns))
        up = min(bits, 4)
        rests = done.where("container_id is null").drop("container_id").withColumn("cell", F.shiftright("cell", up)).withColumn("part", F.lit(0).cast("bigint"))
        bits, level = bits - up, level + 1


def _packer(key: str, columns: list[str], level: int, last: bool):
    """What packs one cell; unless it is the whole curve, the containers with most room are left without a name."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["curve", "spot", key, "piece_no"]).reset_index(drop=True)
        capacity = int(group["capacity"].iloc[0])
        put = np.array(fill(group["n_tokens"].tolist(), capacity))
        if not last:
            filled = np.bincount(put, weights=group["n_tokens"])
            loose = np.argsort(filled, kind="stable")[:PASSED_ON]
            put[np.isin(put, loose[filled[loose] < FULL * capacity])] = -1
        name = f"{level} {group['cell'].iloc[0]} {group['part'].iloc[0]} "
        return group.assign(container_id=[name + str(c) if c >= 0 else None for c in put])[[*columns, "capacity", "curve", "spot", "cell"]]

    return pack


def fill_report(containers: DataFrame, specs: DataFrame) -> DataFrame:
    """(container_name, capacity_tokens, n_containers, n_pieces, n_tokens, fill_share) of a packing."""
    total = containers.groupBy("container_name").agg(F.countDistinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    named = specs.select("container_name", "capacity_tokens").dropDuplicates(["container_name"])
    return named.join(total, "container_name").withColumn("fill_share", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
