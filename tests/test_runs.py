"""Pages of sorted runs: the rows of a scan of everything, from the files of their range."""

import os
import random
from datetime import datetime, timedelta

import pytest

from haggle.operators import feed
from haggle.sources.runs import SortedRuns, needed

SCHEMA = "id long, at timestamp_ntz"


def test_pages_are_those_of_a_scan_and_open_few_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, datetime(2024, 1, 1) + timedelta(hours=k // 3, microseconds=rng.choice([0, 5]))])) for k in range(240)]
    runs = SortedRuns(spark, f"file://{tmp_path}/feed", spark.createDataFrame([], SCHEMA).schema, "at", "id", file_rows=20)
    for k in range(0, 240, 60):
        runs.add(spark.createDataFrame(rows[k : k + 60], SCHEMA))
    assert len({f[0] for f in runs.files()}) == 4
    every = spark.createDataFrame(rows, SCHEMA)
    for merged in (False, True):
        if merged:
            assert runs.merge(4) == 4 and len({f[0] for f in runs.files()}) == 1
            runs.tidy(1)
            assert len([n for n in os.listdir(tmp_path / "feed") if n.startswith("run-")]) == 1
        assert sorted(map(str, runs.read().collect())) == sorted(map(str, every.collect()))
        cursor, opened = None, []
        for _ in range(5):
            ours, scan = runs.page(cursor, 13), feed.page(every, "at", "id", cursor, 13)
            got = [tuple(r) for r in ours.collect()]
            assert got == [tuple(r) for r in scan.collect()]
            opened.append(len(ours.inputFiles()))
            cursor = (got[-1][1], got[-1][0])
        assert min(opened) * 3 <= len(runs.files())
        back = [tuple(r) for r in runs.page(cursor, 13, backward=True).collect()]
        assert back == [tuple(r) for r in feed.page(every, "at", "id", cursor, 13, backward=True).collect()]


@pytest.mark.parametrize("backward", [False, True])
def test_no_file_of_a_page_is_left_out(backward):
    rng = random.Random(7)
    for _ in range(300):
        runs = [sorted(rng.choices(["", *"bcdefgh"], k=rng.randint(1, 4))) for _ in range(rng.randint(0, 7))]
        files = [["r", str(k), 0, x[0], x[-1], len(x)] for k, x in enumerate(runs)]
        first, time, size = rng.random() < 0.2, rng.choice(["", *"abcdefghi"]), rng.randint(1, 6)
        got = {f[1] for f in needed(files, time or None, size, backward, first)}
        # rows at the time itself may lie on either side of the cursor: both answers must be covered
        for strict in (False, True):
            ahead = sorted((x, str(k)) for k, run in enumerate(runs) for x in run if first or ((x > time or x == time and not strict) if backward else (x < time or x == time and not strict)))
            if not backward:
                ahead.reverse()
            if ahead:
                last = ahead[min(size, len(ahead)) - 1][0]
                must = {k for x, k in ahead if (x < last if backward else x > last)}
                assert must <= got
                assert sum(x == last or k in must for x, k in ahead if k in got) >= min(size, len(ahead)) - sum(k not in got for x, k in ahead if x != last)


def test_a_merge_beside_a_writer(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1)) for k in range(6)]
    runs = SortedRuns(spark, f"file://{tmp_path}/feed", spark.createDataFrame([], SCHEMA).schema, "at", "id")
    for r in rows[:4]:
        runs.add(spark.createDataFrame([r], SCHEMA))
    write = runs._write

    def slow(*args):  # while this one merges, another writes a run
        out = write(*args)
        runs._write = write
        runs.add(spark.createDataFrame([rows[4]], SCHEMA))
        return out

    runs._write = slow
    assert runs.merge(2) == 4
    assert sorted(r.id for r in runs.read().collect()) == [0, 1, 2, 3, 4]
    assert runs.page().count() == 5 and SortedRuns(spark, f"file://{tmp_path}/none", runs.schema, "at", "id").page().count() == 0
