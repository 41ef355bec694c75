from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DOCS

from fourthtick.llm import sharding


def test_matrix_sums_are_exact():
    blocks, shards = [5, 0, 17, 3, 100], [25, 25, 25, 25, 25]
    m = np.array(sharding.communication_matrix(blocks, shards, 1))
    assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == shards


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1000])
def test_sizes_and_slots(spark, n):
    rows = sharding.shard_uniformly(spark.range(n).repartition(3), 16).collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_repeats_exactly_and_looks_uniform(spark):
    first = sharding.shard_uniformly(spark.range(2000).repartition(7), 4).collect()
    again = sharding.shard_uniformly(spark.range(2000).repartition(2), 4).collect()
    assert sorted(first) == sorted(again)
    low = Counter(r["shard"] for r in first if r["id"] < 1000)
    assert all(200 < low[s] < 300 for s in range(4))
    halves = Counter(r["slot"] < 250 for r in first if r["id"] < 1000)
    assert 430 < halves[True] < 570


def test_edge_cases(docs, no_docs):
    rows = sharding.shard_uniformly(docs, 4).collect()
    assert len(rows) == len(DOCS)
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in DOCS)
    assert sharding.shard_uniformly(no_docs).count() == 0
