"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are first dealt into source blocks. How many rows each block sends to each
shard is drawn exactly from the multivariate hypergeometric law, so the matrix is
distributed as in a truly uniform permutation with the given shard sizes. A block
then permutes its rows and cuts them by its row of the matrix, the rows are
exchanged, and each shard permutes what it received. Only block sizes reach the
driver: ``blocks`` numbers, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fourthtick.sources.storage import stage

BLOCKS = 1024
SLICES = 1024


def communication_matrix(
    block_rows: list[int], shard_rows: list[int], seed: int
) -> list[list[int]]:
    """Rows that each block sends to each shard; row sums and column sums are exact.

    One block after the other draws without replacement from the places that are
    still free in the shards. At most 10**9 rows, the bound of the generator.
    """
    draw = np.random.Generator(np.random.PCG64(seed))
    free = np.array(shard_rows, dtype=np.int64)
    matrix = []
    for rows in block_rows:
        sent = draw.multivariate_hypergeometric(free, rows, method="marginals")
        free -= sent
        matrix.append(sent.tolist())
    return matrix


def shard_uniformly(
    rows: DataFrame,
    n_shards: int = 16,
    seed: int = 17,
    columns: list[str] | None = None,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``columns`` of ``rows`` (all by default) with ``shard`` and ``slot``.

    Shards are 0 to ``n_shards`` - 1 and their sizes differ by one row at most;
    slots are 0, 1, 2 ... within a shard. An input column named ``shard`` or
    ``slot`` is replaced. A row's random keys are hashes of the seed and its
    columns, so a repeated task gives the same places; rows equal in every column
    tie, which no result can tell apart, and nulls hash like any value. An empty
    table gives an empty result.
    """
    spark = rows.sparkSession
    kept = [c for c in (columns or rows.columns) if c not in ("shard", "slot")]
    # Numbered names inside, so that no column of the caller can clash with ours.
    names = [f"column_{i}" for i in range(len(kept))]
    rows = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])

    def random(salt: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(f"`{c}`") for c in names])

    keyed = rows.select(*[F.col(f"`{c}`") for c in names]).withColumns(
        {"_block": F.pmod(random(1), F.lit(blocks)), "_local": random(2), "_final": random(3)}
    )
    held = {r["_block"]: r["count"] for r in keyed.groupBy("_block").count().collect()}
    order = sorted(held)
    total = sum(held.values())
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([held[b] for b in order], sizes, seed)
    cuts = spark.createDataFrame(
        [(b, np.cumsum(sent).tolist()) for b, sent in zip(order, matrix, strict=True)],
        "_block long, _cuts array<long>",
    )

    everything = [F.col(f"`{c}`") for c in names]
    local = Window.partitionBy("_block").orderBy("_local", "_final", *everything)
    dealt = (
        keyed.withColumn("_rank", F.row_number().over(local))
        .join(cuts, "_block")
        .withColumn(
            "shard",
            F.size(F.filter("_cuts", lambda cut: cut < F.col("_rank"))),
        )
        # Slices of the random key keep the second permutation of a shard in many tasks.
        .withColumn("_slice", F.pmod(F.shiftrightunsigned("_final", 20), F.lit(SLICES)))
        .select(*everything, "shard", "_slice", "_final")
    )
    dealt = stage(dealt, "sharded")

    before = Window.partitionBy("shard").orderBy("_slice")
    starts = dealt.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(
        "shard", "_slice", (F.sum("_n").over(before) - F.col("_n")).alias("_start")
    )
    within = Window.partitionBy("shard", "_slice").orderBy("_final", *everything)
    return (
        dealt.withColumn("_row", F.row_number().over(within))
        .join(starts, ["shard", "_slice"])
        .select(
            *[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)],
            "shard",
            (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"),
        )
    )
