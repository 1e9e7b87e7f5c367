"""Exact comparison of all pairs inside groups, as pairs of bounded tiles.

Rows of a group are dealt by hash to tiles of about `tile_rows` rows, each kept as one row with its
payload as an array. Every unordered pair of tiles that can hold a match meets once, as one row of a
join between tile rows; a task takes such pairs one by one, so its memory is two tiles whatever the
size of the group, and a group with a third of all rows becomes many tile pairs. The work is the
number of tile pairs, quadratic in a group, as exact comparison without an index is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Tiles of a group grow with it, up to so many rows, before there are more than FEW_TILES of them: each row is sent once for each tile.
FEW_TILES, LARGEST_TILE = 16, 1 << 17


def make_tiles(rows: DataFrame, group: list[str], key: str, payload: Column, tile_rows: int, few_groups: bool = False) -> DataFrame:
    """(*group, tile, items): items holds the payload of each row dealt to that tile, ordered by key.

    few_groups says that the number of groups has a small bound, so that their sizes may be broadcast.
    """
    n = F.count("*")
    tiles = F.least(F.ceil(n / F.lit(tile_rows)), F.greatest(F.lit(FEW_TILES), F.ceil(n / F.lit(max(tile_rows, LARGEST_TILE)))))
    sizes = rows.groupBy(*group).agg(tiles.alias("_n"))
    sizes = F.broadcast(sizes) if few_groups else sizes
    dealt = rows.select(*group, F.col(key).alias("_k"), payload.alias("_p")).join(sizes, group)
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("_k"), F.col("_n")))
    return dealt.groupBy(*group, "tile").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_p"))), lambda x: x["_p"]).alias("items"))


def pair_tiles(tiles: DataFrame, group: list[str], reach: int = 0) -> DataFrame:
    """(a, b, same): the items of every pair of tiles of a group, once.

    With a reach, the last group column is an integer and tiles whose values differ by up to that
    meet too. Tile names meet by equality, after the left ones are offered at each value in reach.
    """
    ids = [*group, "tile"]
    named = lambda side, *more: tiles.select(*[F.col(c).alias(f"{side}_{c}") for c in ids], *more)
    near = F.explode(F.sequence(F.col(f"a_{group[-1]}"), F.col(f"a_{group[-1]}") + reach))
    left = named("a").withColumn("_near", near) if reach else named("a").withColumn("_near", F.col(f"a_{group[-1]}"))
    on = F.col("_near") == F.col(f"b_{group[-1]}")
    for c in group[:-1]:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    first, second = (F.struct(*[F.col(f"{side}_{c}") for c in ids]) for side in "ab")
    pairs = left.join(named("b"), on).where(first <= second).drop("_near")
    a_ids, b_ids = [f"a_{c}" for c in ids], [f"b_{c}" for c in ids]
    pairs = pairs.join(named("a", F.col("items").alias("a")), a_ids).join(named("b", F.col("items").alias("b")), b_ids)
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.withColumn("same", first == second).repartition(parts, *a_ids, *b_ids).select("a", "b", "same")


class Forest:
    """Union-find over 0..n-1 whose links come as arrays; keeps connectivity, not the links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self, i: np.ndarray) -> np.ndarray:
        at = self.up[i]
        while True:
            up = self.up[at]
            if (up == at).all():
                self.up[i] = at
                return at
            at = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of every node that isn't its own root."""
        every = self.roots(np.arange(len(self.up)))
        nodes = np.flatnonzero(every != np.arange(len(self.up)))
        return nodes, every[nodes]
