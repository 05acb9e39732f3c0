"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

Rows first get a stable place: they are written once with the scan partition and
their position in it, so a lost executor recomputes nothing differently. Only places
are dealt; the rows themselves move once, when they are joined with their slots.

Shards are cut into cells of at most `block` rows, and cells are the leaves of a tree
of fan-out `fan`; the shuffle goes down that tree, one level in a round. In a round
the rows of each node are cut into parts of about `block` rows by a hash of their
place. The matrix M[part, child] is drawn from the multivariate hypergeometric law
whose margins are the exact part counts and the exact child sizes; each part is
permuted and cut by its row of M, and the pieces are exchanged. In the end each cell is
permuted again. Given the counts this is what a uniform permutation of all rows does.

A matrix of many parts is drawn by a tree of parts in the same way: what a group of
`fan` parts sends is drawn first and then split among them, by the same law. So no
task holds more than fan x fan numbers or about `block` places, at any number of rows;
the rounds grow with its logarithm. Only the number of rows comes to the driver.

Null and empty rows, ties and repeated rows are rows like any other. An empty input
gives an empty result. Extra columns are carried along untouched; columns named
shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidspark.runtime import materialize, ship

#: Rows of a part or cell, and children of a node.
BLOCK, FAN = 1000, 1000
#: Populations from here on are beyond the random generator's own hypergeometric draw.
LARGE = 10**9


class Cells:
    """Cells of all shards, the same number in each shard; shard counts differ by at most one."""

    def __init__(self, total: int, shards: int, block: int = BLOCK):
        self.each, self.longer = divmod(total, shards)
        self.per_shard = max(1, -(-(self.each + (self.longer > 0)) // block))
        self.count = shards * self.per_shard

    def shard(self, cell: np.ndarray) -> np.ndarray:
        return cell // self.per_shard

    def slot(self, cell: np.ndarray) -> np.ndarray:
        """First slot of the cell in its shard."""
        rows = self.each + (self.shard(cell) < self.longer)
        return cell % self.per_shard * rows // self.per_shard

    def start(self, cell: np.ndarray) -> np.ndarray:
        """Rows in all cells before this one; cells past the last one are empty."""
        cell = np.minimum(cell, self.count)
        return self.shard(cell) * self.each + np.minimum(self.shard(cell), self.longer) + self.slot(cell)

    def sizes(self, node: int, fan: int, width: int) -> np.ndarray:
        """Rows of a node's children, each of `width` cells."""
        last = min((node + 1) * fan, -(-self.count // width))
        return np.diff(self.start(np.arange(node * fan, last + 1, dtype=np.int64) * width))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, large: int = LARGE) -> int:
    """Good ones among n drawn without replacement.

    In a large population by inversion over the values around the mode, by the ratio of
    neighbouring probabilities; values more than 14 standard deviations away are left out.
    """
    if good + bad < large:
        return int(rng.hypergeometric(good, bad, n))
    share = good / (good + bad)
    far = int(14 * np.sqrt(n * share * (1 - share))) + 40
    mode = (good + 1) * (n + 1) // (good + bad + 2)
    low, high = max(0, n - bad, mode - far), min(good, n, mode + far)
    x = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return low + min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), high - low)


def communication_matrix(parts: np.ndarray, cells: np.ndarray, seed: int | Sequence[int], large: int = LARGE) -> np.ndarray:
    """Exact counts from parts to cells: each row is drawn from what the earlier rows left."""
    rng = np.random.default_rng(seed)
    left = np.asarray(cells, np.int64).copy()
    out = np.zeros((len(parts), len(left)), np.int64)
    for p, rows in enumerate(parts):
        if left.sum() < large:
            out[p] = rng.multivariate_hypergeometric(left, int(rows), method="marginals")
        else:
            rest, need = int(left.sum()), int(rows)
            for c, size in enumerate(left.tolist()):
                rest -= size
                out[p, c] = hypergeometric(rng, size, rest, need, large)
                need -= int(out[p, c])
        left -= out[p]
    return out


def _depth(leaves: int, fan: int) -> int:
    depth = 1
    while fan**depth < leaves:
        depth += 1
    return depth


def _drawers(cells: Cells, fan: int, width: int, key: list[int]) -> tuple[Callable, Callable]:
    """Draws for a group of parts: one whose whole is a node, and one whose whole is a row of the level above."""

    def draw(table: pa.Table, whole: np.ndarray) -> pa.Table:
        table = table.sort_by("part")
        node, group = table.column("node")[0].as_py(), table.column("group")[0].as_py()
        m = communication_matrix(table.column("n").to_numpy(), whole, [*key, node, group])
        offsets = pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32())
        return pa.table([table.column("node"), table.column("part"), pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1)))], names=["node", "part", "sends"])

    def first(table: pa.Table) -> pa.Table:
        return draw(table, cells.sizes(table.column("node")[0].as_py(), fan, width))

    def further(table: pa.Table, above: pa.Table) -> pa.Table:
        return draw(table, above.column("sends")[0].values.to_numpy())

    return first, further


def _matrix(counts: DataFrame, cells: Cells, fan: int, width: int, leaves: int, key: list[int]) -> DataFrame:
    """counts (node, leaf, n) to node, part, sends: the rows that each leaf part sends to each child of its node."""
    depth = _depth(leaves, fan)
    schema = "node bigint, part bigint, sends array<bigint>"
    drawn = None
    for level in range(depth):
        step = fan ** (depth - level - 1)
        tally = counts.groupBy("node", F.expr(f"leaf div {step * fan}").alias("group"), F.expr(f"leaf div {step}").alias("part")).agg(F.sum("n").alias("n"))
        first, further = _drawers(cells, fan, width, [*key, level])
        if drawn is None:
            drawn = tally.groupBy("node", "group").applyInArrow(first, schema)
        else:
            above = drawn.withColumnRenamed("part", "group")
            drawn = tally.groupBy("node", "group").cogroup(above.groupBy("node", "group")).applyInArrow(further, schema)
    return drawn


def _dealer(fan: int, key: list[int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Permutes a part and cuts it by its row of the matrix."""

    def deal(part: pa.Table, sends: pa.Table) -> pa.Table:
        node, leaf = part.column("node")[0].as_py(), part.column("leaf")[0].as_py()
        counts = sends.column("sends")[0].values.to_numpy()
        rng = np.random.default_rng([*key, node, leaf])
        child = np.empty(part.num_rows, np.int64)
        child[rng.permutation(part.num_rows)] = np.repeat(node * fan + np.arange(len(counts)), counts)
        return pa.table([pa.array(np.sort(part.column("place").to_numpy())), pa.array(child)], names=["place", "node"])

    return deal


def _slots(places: DataFrame, total: int, shards: int, seed: int, block: int, fan: int) -> DataFrame:
    """places (place) to place, shard, slot."""
    cells = Cells(total, shards, block)
    rounds = _depth(cells.count, fan)
    rows = places.select("place", F.lit(0).cast("bigint").alias("node"))
    for r in range(rounds):
        width = fan ** (rounds - r - 1)
        leaves = max(1, -(-min(total, fan * width * block) // block))
        if r:
            rows = materialize(rows, "dealt")
        parted = rows.withColumn("leaf", F.pmod(F.xxhash64("place", F.lit(seed), F.lit(r)), F.lit(leaves)).cast("bigint"))
        drawn = _matrix(parted.groupBy("node", "leaf").agg(F.count("*").alias("n")), cells, fan, width, leaves, [seed, 0, r])

        leaf = drawn.withColumnRenamed("part", "leaf").groupBy("node", "leaf")
        rows = parted.groupBy("node", "leaf").cogroup(leaf).applyInArrow(_dealer(fan, [seed, 1, r]), "place bigint, node bigint")

    def settle(cell: pa.Table) -> pa.Table:
        node = np.int64(cell.column("node")[0].as_py())
        rng = np.random.default_rng([seed, 2, int(node)])
        slot = cells.slot(node) + rng.permutation(cell.num_rows)
        shard = np.full(cell.num_rows, cells.shard(node), np.int32)
        return pa.table([pa.array(np.sort(cell.column("place").to_numpy())), pa.array(shard), pa.array(slot.astype(np.int64))], names=["place", "shard", "slot"])

    return rows.groupBy("node").applyInArrow(settle, "place bigint, shard int, slot bigint")


def shuffle_into_shards(df: DataFrame, shards: int = 40, seed: int = 7, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """df plus shard (0 to shards - 1, sizes at most one apart) and slot (gapless from 0)."""
    if shards < 1 or seed < 0 or block < 1 or fan < 2:
        raise ValueError("shards and block must be positive, seed not negative, fan 2 or more")
    ship(df.sparkSession)
    df = df.drop("shard", "slot")
    names = df.columns
    placed = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("place")), "placed")
    slots = _slots(placed.select("place"), placed.count(), shards, seed, block, fan)
    return placed.join(slots, "place").select(*[F.col("row").getField(c).alias(c) for c in names], "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int = 40, seed: int = 7) -> None:
    """Write df as one folder per shard, rows in slot order within each file."""
    out = shuffle_into_shards(df, shards, seed)
    out.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
