"""The fold in the state store: the same rows whatever the batches, also after a restart."""

import random

import pytest

from haggle.operators.upsert import FIRST, LAST, fold
from haggle.streaming.state import StateFold, use_rocksdb

POLICY = {"a": FIRST, "b": LAST, "n": LAST}
SCHEMA = "key long, seq long, tie string, a string, b string, n long"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    with use_rocksdb(spark):
        yield


def observations(rng, n, keys):
    big = 2**60 + 1
    return [(rng.choice([*keys, None]), rng.choice([None, *range(5)]), f"{k:04}", rng.choice(["x", "y", None]), rng.choice(["p", None]), rng.choice([None, big + k])) for k in range(n)]


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def folded(spark, rows):
    df = fold(spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA), "key", ["seq", "tie"], POLICY)
    return {r.key: (r.a, r.b, r.n, *r.first_seen, *r.last_seen) for r in df.collect()}


def run(spark, source, path, files):
    job = StateFold(spark, spark.createDataFrame([], SCHEMA).schema, "key", ["seq", "tie"], POLICY, path)
    query = job.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source), availableNow=True)
    query.awaitTermination()
    return {r.key: (r.a, r.b, r.n, r.first_seq, r.first_tie, r.last_seq, r.last_tie) for r in job.current().collect()}, query


@pytest.mark.parametrize("files", [1, 3])
def test_same_rows_whatever_the_batches_and_after_a_restart(spark, tmp_path, files):
    rng = random.Random(files)
    rows = observations(rng, 160, range(9))
    rng.shuffle(rows)  # late rows come in later files
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    for k in range(0, 80, 20):
        write(spark, rows[k : k + 20], source)
    assert run(spark, source, path, files)[0] == folded(spark, rows[:80])
    for k in range(80, 160, 40):
        write(spark, rows[k : k + 40], source)
    assert run(spark, source, path, files)[0] == folded(spark, rows)


def test_a_batch_works_on_its_own_keys(spark, tmp_path):
    rows = [(k, 1, "t", "x", "p", k) for k in range(500)]
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    write(spark, rows, source)
    run(spark, source, path, 1)
    write(spark, [(3, 2, "t", "y", "q", 1), (4, 2, "t", "y", "q", 1), (3, 3, "t", "z", "r", 2)], source)
    got, query = run(spark, source, path, 1)
    assert len(got) == 500 and got[3] == ("x", "r", 2, 1, "t", 3, "t")
    state = query.lastProgress.stateOperators[0] if hasattr(query.lastProgress, "stateOperators") else query.lastProgress["stateOperators"][0]
    changed = state.numRowsUpdated if hasattr(state, "numRowsUpdated") else state["numRowsUpdated"]
    assert changed == 2


def test_a_hot_key_is_folded_before_it_is_dealt(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    rows = [(1, k, "t", "x", "p", k) for k in range(3000)] + [(2, 0, "t", "x", "p", 0)]
    write(spark, rows, source)
    got, _ = run(spark, source, path, 1)
    assert got == {1: ("x", "p", 2999, 0, "t", 2999, "t"), 2: ("x", "p", 0, 0, "t", 0, "t")}
