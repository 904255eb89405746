"""What the operators leave to the driver: few tasks to keep records of, and no more of the training rows than their index."""

import pickle
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import simhash, toxicity
from tidemark.llm.common import fold_of


def roots_by_force(pairs):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in root}


def random_pairs():
    rng = np.random.default_rng(3)
    return rng.integers(0, 400, (300, 2)).tolist()


GRAPHS = {
    "none": [],
    "loops": [(1, 1), (2, 2)],
    "pair": [(5, 4), (4, 5), (5, 4)],
    "chain": [(k, k + 1) for k in range(60)],
    "falling_chain": [((k * 37) % 61, ((k + 1) * 37) % 61) for k in range(60)],
    "cycle": [(k, (k + 1) % 50) for k in range(50)],
    "star_with_large_centre": [(1000, k) for k in range(200)],
    "random": random_pairs(),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    pairs = GRAPHS[name]
    got = [(r["node"], r["root"]) for r in simhash.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == roots_by_force([p for p in pairs if p[0] != p[1]])


def test_components_run_few_tasks(spark):
    """The driver keeps a record of each task; the search took 950 here, and takes 479."""
    context, before = spark.sparkContext, spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    pairs = spark.createDataFrame(GRAPHS["falling_chain"], "a bigint, b bigint").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("components", "components")
    try:
        simhash.components(pairs)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    status = context.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("components") for s in status.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(status.getStageInfo, stages) if info)
    assert 0 < tasks <= 600


def test_toxicity_trains_outside_the_driver(spark):
    """The driver holds a few times the index, not the terms of all examples."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    tracemalloc.start()
    try:
        index = toxicity.train(docs, labels.where(fold_of("doc_id", 5) != 0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    size = len(pickle.dumps(index))
    assert 0 < peak <= 4.5 * size
