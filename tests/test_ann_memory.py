"""What a task of the approximate search holds does not grow with the cells, rows and queries that meet in it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from korpusflow.operators import ann


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_cells_are_found_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    x, centres = rng.standard_normal((5000, 8)), rng.standard_normal((4096, 8))
    found, mb = peak(lambda: ann.nearest(x, centres))
    assert mb < 60
    monkeypatch.setattr(ann, "SLICE_VALUES", 1 << 30)
    assert np.array_equal(found, ann.nearest(x, centres))


def test_a_part_meets_a_block_of_queries_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8192, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:300])], "chunk_id long, vec array<double>")
    index = ann.build_index(data)
    runs, meet = [], ann.meet
    monkeypatch.setattr(ann, "meet", lambda asked, index, blocks, run, schema: runs.append(run) or meet(asked, index, blocks, run, schema))
    ann.ann_search(data.limit(20).withColumnRenamed("chunk_id", "query_id"), index)
    cell, codes, error = index.model.encode(x)
    vec = pa.array(x.tolist(), pa.list_(pa.float64()))
    ids = np.arange(len(x))
    right = pa.table({"cell": cell, "chunk_id": ids, "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": error, "copy": ids, "vec": vec})
    left = pa.table({"query_id": ids[:1024], "vec": vec[:1024], "floor": np.full(1024, 0.99)})
    for run in runs:  # by estimate, then exactly
        got, mb = peak(lambda run=run: run(left, right))
        assert mb < 120 and got.num_rows >= 1024
        monkeypatch.setattr(ann, "SLICE_VALUES", 1 << 30)
        whole = run(left, right)
        monkeypatch.setattr(ann, "SLICE_VALUES", 1 << 20)
        assert got.drop_columns("score").equals(whole.drop_columns("score")) and np.allclose(got["score"], whole["score"])
