"""Sessions by inactivity gaps, from a Cartesian tree over each entity's consecutive gaps.

The tree of an entity has a node for every run of instants that a gap setting can yield: a node
spans ``start_us`` to ``end_us``, its ``gap_us`` is the largest gap inside (null for one instant)
and its ``parent_gap_us`` the largest gap inside its parent (null at the root). Equal gaps share a
node, so ``gap_us < parent_gap_us`` holds. The sessions at any threshold are then a plain filter,
``gap_us <= threshold < parent_gap_us``, with no further shuffle: one tree serves many settings.

Building it never brings an entity into one task at full size:

1. rows are counted by (entity, instant), with Spark's partial aggregation before the shuffle;
2. instants are grouped by (entity, hour). Inside a group, a gap with no smaller gap on either side
   is contracted at once (a stack, one pass over sorted rows). What is left are the group's outer
   spines, whose gaps rise and then fall strictly; gaps that differ by a microsecond at least and
   add up to one hour are fewer than 85,000, in practice a few dozen;
3. the spines are merged by (entity, day), and at last by entity, where the root is closed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import cut_lineage

HOUR_US = 3_600_000_000
#: widths of the chunks of time in which trees are built and merged before the last merge by entity
LEVELS_US = (HOUR_US, 24 * HOUR_US)

_BLOCK = "entity string, start_us bigint, end_us bigint, n bigint, gap_us bigint, parent_gap_us bigint, closed boolean"
_COLUMNS = [c.split()[0] for c in _BLOCK.split(", ")]


class _Run:
    """The stack for one (entity, chunk): blocks in time order, and before each but the first a gap."""

    __slots__ = ("blocks", "gaps")

    def __init__(self, block: tuple) -> None:
        self.blocks = [block]
        self.gaps: list[int] = []

    def push(self, block: tuple, out: list) -> None:
        gap = block[0] - self.blocks[-1][1]
        gaps = self.gaps
        while len(gaps) > 1 and gaps[-1] <= gap and gaps[-1] <= gaps[-2]:
            self._contract(out)
        gaps.append(gap)
        self.blocks.append(block)

    def _contract(self, out: list) -> None:
        gap, right, left = self.gaps.pop(), self.blocks.pop(), self.blocks.pop()
        self.blocks.append(_join(left, right, gap, out))

    def close(self, out: list, last: bool) -> None:
        if not last:
            out.extend((*b, None, False) for b in self.blocks)
            return
        # beyond both ends lies nothing, and the gaps rise and then fall: the smallest is at an end
        gaps, blocks = deque(self.gaps), deque(self.blocks)
        while gaps:
            if gaps[0] < gaps[-1]:
                left, right = blocks.popleft(), blocks.popleft()
                blocks.appendleft(_join(left, right, gaps.popleft(), out))
            else:
                right, left = blocks.pop(), blocks.pop()
                blocks.append(_join(left, right, gaps.pop(), out))
        out.append((*blocks[0], None, True))


def _join(left: tuple, right: tuple, gap: int, out: list) -> tuple:
    """The block of two neighbours; a child with the same gap is part of this node, others are done."""
    for child in (left, right):
        if child[3] is None or child[3] < gap:
            out.append((*child, gap, True))
    return (left[0], right[1], left[2] + right[2], gap)


def _builder(last: bool):
    def build(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, run = None, None
        for pdf in frames:
            out: list[tuple] = []  # (start, end, n, gap, parent, closed)
            names: list[str] = []
            gap = pdf["gap_us"]
            gaps = [None if m else int(v) for v, m in zip(gap, gap.isna())]
            rows = zip(pdf["entity"], pdf["chunk"], pdf["start_us"], pdf["end_us"], pdf["n"], gaps)
            for entity, chunk, start, end, n, g in rows:
                block = (start, end, n, g)
                if (entity, chunk) == key:
                    run.push(block, out)
                else:
                    if run is not None:
                        run.close(out, last)
                        names.extend([key[0]] * (len(out) - len(names)))
                    key, run = (entity, chunk), _Run(block)
                names.extend([entity] * (len(out) - len(names)))
            yield _frame(names, out)
        if run is not None:
            out = []
            run.close(out, last)
            yield _frame([key[0]] * len(out), out)

    return build


def _frame(names: list, rows: list) -> pd.DataFrame:
    cols = list(zip(*rows)) or [()] * 6
    data = {"entity": pd.Series(names, dtype=object)}
    for c, v in zip(_COLUMNS[1:], cols):
        data[c] = pd.array(v, dtype="boolean" if c == "closed" else "Int64")
    return pd.DataFrame(data)


def gap_tree(df: DataFrame, entity: str, instant_us: str, levels_us: tuple[int, ...] = LEVELS_US) -> DataFrame:
    """The gap trees of all entities: (entity, start_us, end_us, n, gap_us, parent_gap_us).

    ``n`` is the number of rows in the node's span. Rows with a null entity or instant are left out;
    rows of the same instant count in ``n`` and make no gap; an empty table gives an empty tree.
    Other columns are ignored, so clashing names do no harm.
    """
    points = (
        df.select(F.col(entity).cast("string").alias("entity"), F.col(instant_us).cast("bigint").alias("start_us"))
        .where("entity is not null and start_us is not null")
        .groupBy("entity", "start_us")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    open_ = points.select(
        "entity", "start_us", F.col("start_us").alias("end_us"), "n", F.lit(None).cast("bigint").alias("gap_us")
    )
    done = []
    for width in (*levels_us, None):
        chunk = F.floor(F.col("start_us") / F.lit(width)).cast("bigint") if width else F.lit(0).cast("bigint")
        built = (
            open_.withColumn("chunk", chunk)
            .repartition("entity", "chunk")
            .sortWithinPartitions("entity", "chunk", "start_us")
            .mapInPandas(_builder(last=width is None), _BLOCK)
        )
        if width is None:
            done.append(built)
        else:
            # both the finished nodes and the open spines are read from it: built once, kept on the shared folder
            built = cut_lineage(built)
            done.append(built.where("closed"))
            open_ = built.where("not closed").select("entity", "start_us", "end_us", "n", "gap_us")
    tree = done[0]
    for d in done[1:]:
        tree = tree.unionByName(d)
    return tree.drop("closed")


def cut(tree: DataFrame, gap_us: int) -> DataFrame:
    """The sessions of a tree for one gap setting: a new one starts after MORE than ``gap_us``."""
    inside = (F.col("gap_us").isNull()) | (F.col("gap_us") <= gap_us)
    return tree.where(inside & (F.col("parent_gap_us").isNull() | (F.col("parent_gap_us") > gap_us))).select(
        "entity", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n"
    )
