"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new ones of given capacities.

Every old shard is cut into blocks by a hash of doc_id; their sizes and row counts are all that the driver sees (at most
old shards * ``blocks`` rows, whatever the input). A flow from old shard sizes to new capacities with least cost (0 for
bytes that stay in a shard of the same number, 1 for others, or a given cost) says how many bytes go where; whole blocks
are then chosen for every transfer, largest first, each where most is still missing, so a shard misses its capacity by
about the smallest blocks. Only shards that gain or lose blocks are rewritten. Slots number a shard's rows by block and,
inside it, by doc_id.

Null texts have no bytes (size 1) and stay null. Null ``doc_id`` is a value like others, null old shards count as shard
0, repeated rows get slots of their own; other columns are carried along (``shard``, ``slot``, ``old_shard`` and names
that begin with ``_reshard`` are replaced); an empty table gives an empty plan and no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

PLAN = "old_shard int, _reshard_block int, shard int, _reshard_first long"


def transfers(supply: list[int], capacity: list[int], cost: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Bytes from every old shard to every new one, with the least cost; ``capacity`` sums up to ``supply`` or more.

    Successive shortest paths: each path found by relaxation ends at spare capacity and fills what it can."""
    price = cost or {}
    flow: dict[tuple[int, int], int] = {}
    left = list(capacity)
    arcs = {(i, j): price.get((i, j), 0 if i == j else 1) for i in range(len(supply)) for j in range(len(capacity))}
    for i, amount in enumerate(supply):
        while amount:
            reach: dict[tuple[str, int], tuple[int, tuple[str, int] | None]] = {("old", i): (0, None)}
            waiting = [("old", i)]
            while waiting:
                kind, a = node = waiting.pop(0)
                so_far = reach[node][0]
                if kind == "old":
                    steps = [(("new", j), arcs[a, j]) for j in range(len(capacity))]
                else:
                    steps = [(("old", k), -arcs[k, a]) for k in range(len(supply)) if flow.get((k, a))]
                for other, extra in steps:
                    if other not in reach or so_far + extra < reach[other][0]:
                        reach[other] = (so_far + extra, node)
                        waiting.append(other)
            ends = [(reach["new", j][0], j) for j in range(len(capacity)) if left[j]]
            if not ends:
                raise ValueError("capacities are smaller than the shards")
            path = [("new", min(ends)[1])]
            while (before := reach[path[-1]][1]) is not None:
                path.append(before)
            path.reverse()
            backs = [(path[k + 1][1], path[k][1]) for k in range(1, len(path) - 1, 2)]
            moved = min([amount, left[path[-1][1]], *[flow[b] for b in backs]])
            for k in range(0, len(path) - 1, 2):
                arc = path[k][1], path[k + 1][1]
                flow[arc] = flow.get(arc, 0) + moved
            for b in backs:
                flow[b] -= moved
            left[path[-1][1]] -= moved
            amount -= moved
    return {arc: n for arc, n in flow.items() if n}


@dataclass(frozen=True)
class Plan:
    table: DataFrame  # PLAN: every block's new shard and the first slot of its rows there
    affected: list[int]
    bytes_moved: int
    total_bytes: int


def _blocks(docs: DataFrame, old_shard: str, blocks: int) -> DataFrame:
    return docs.withColumns({
        "old_shard": F.coalesce(F.col(old_shard).cast("int"), F.lit(0)),
        "_reshard_block": F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"),
        "_reshard_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1,
    })


def plan(docs: DataFrame, old_shard: str, shards: int, blocks: int = 512, capacity: list[int] | None = None) -> Plan:
    """Where the blocks of ``docs`` (doc_id, text and the column ``old_shard``) go; equal capacities by default."""
    rows = (
        _blocks(docs, old_shard, blocks).groupBy("old_shard", "_reshard_block")
        .agg(F.sum("_reshard_size").alias("bytes"), F.count("*").alias("rows")).collect()
    )
    sizes = {(r["old_shard"], r["_reshard_block"]): (r["bytes"], r["rows"]) for r in rows}
    total = sum(n for n, _ in sizes.values())
    room = capacity or [total // shards + (j < total % shards) for j in range(shards)]
    supply = [0] * (max((i for i, _ in sizes), default=-1) + 1)
    for (i, _), (n, _) in sizes.items():
        supply[i] += n
    wanted = transfers(supply, room)
    given = {}
    for i, block in sorted(sizes, key=lambda key: (-sizes[key][0], key)):
        targets = [j for j in range(shards) if (i, j) in wanted]
        j = max(targets, key=lambda j: (wanted[i, j], j == i, -j))
        wanted[i, j] -= sizes[i, block][0]
        given[i, block] = j
    first, table = [0] * shards, []
    for (i, block), j in sorted(given.items()):
        table.append((i, block, j, first[j]))
        first[j] += sizes[i, block][1]
    moved = {key: j for key, j in given.items() if key[0] != j}
    affected = sorted({j for j in moved.values()} | {key[0] for key in moved if key[0] < shards})
    return Plan(
        docs.sparkSession.createDataFrame(table, PLAN), affected, sum(sizes[key][0] for key in moved), total
    )


def assigned(docs: DataFrame, old_shard: str, made: Plan, blocks: int = 512, task_bytes: int = 256 << 20) -> DataFrame:
    """``docs`` with old_shard, shard and slot. Rows of a shard are spread over tasks of about ``task_bytes``."""
    cells = min(blocks, max(16, made.total_bytes // task_bytes))
    # The plan has at most old shards * blocks rows.
    joined = _blocks(docs, old_shard, blocks).drop("shard", "slot").join(F.broadcast(made.table), ["old_shard", "_reshard_block"])
    dealt = joined.withColumn("_reshard_cell", F.pmod("_reshard_block", F.lit(cells)))
    inside = Window.partitionBy("shard", "_reshard_cell", "old_shard", "_reshard_block").orderBy("doc_id", F.xxhash64("text"))
    slots = dealt.repartition("shard", "_reshard_cell").withColumn(
        "slot", F.col("_reshard_first") + F.row_number().over(inside) - 1
    )
    return slots.drop("_reshard_block", "_reshard_size", "_reshard_first", "_reshard_cell")


def rewrite(docs: DataFrame, old_shard: str, made: Plan, folder: str, blocks: int = 512) -> None:
    """Write the files of all affected shards, one folder ``shard=n`` each; the others stay where they are."""
    rows = assigned(docs, old_shard, made, blocks)
    rows.filter(F.col("shard").isin(made.affected)).write.partitionBy("shard").parquet(folder)


def reread(spark: SparkSession, docs: DataFrame, old_shard: str, made: Plan, folder: str, blocks: int = 512) -> DataFrame:
    """All rows after resharding: rewritten shards from their files, the others from ``docs``."""
    parts = []
    if made.affected:
        written = spark.read.parquet(folder)
        parts.append(written.withColumn("shard", F.col("shard").cast("int")))
    numbers = {r[0] for r in made.table.select("shard").distinct().collect()}
    if numbers - set(made.affected) or not parts:
        same = assigned(docs, old_shard, made, blocks).filter(~F.col("shard").isin(made.affected))
        parts.append(same)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
