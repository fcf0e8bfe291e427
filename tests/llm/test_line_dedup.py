import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from haggle.llm.line_dedup import first_occurrences, keep_bitmap, kept_text, line_dedup

TRIM = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(TRIM).translate({i: i + 32 for i in range(65, 91)})


def brute(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    top = {k: max(s) for k, s in holders.items() if len(s) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or key(x) not in top or top[key(x)] == i]
        out.append((str(i), len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(1)
    common = ["The same line in a great many documents", "  the SAME line in a great many documents\t", "Éine zweite Zeile", "éine zweite Zeile", "short", "", "   ", "x" * 12, "日本語の長い行です、とても長い"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randint(1, 8)))) for i in range(300)]
    rows += [(1000 + i, common[0]) for i in range(300)]
    return rows + [(None, common[0]), (2000, None), (2001, ""), (2002, "\n\n"), (5, common[0] + "\nmore"), (6, rows[6][1]), (3000, (common[0] + "\n") * 3000)]


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_against_brute_force(spark, partitions):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h1 int, keep string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = kept_text(df, line_dedup(df, min_chars=10)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out)
    assert got == brute(rows, 10, 5)


def test_bitmaps_and_empty_tables(spark):
    assert np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap([1, 3], 5)), np.uint8), count=5).tolist() == [1, 0, 1, 0, 1]
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert line_dedup(df.limit(0)).count() == 0
    assert kept_text(df.limit(0), line_dedup(df.limit(0))).count() == 0
    few = line_dedup(df, min_chars=10).where(F.col("doc_id") == 2002)
    assert few.count() == 0


def test_stream_in_any_batches():
    """Whatever the cuts into batches, each row comes out as a drop, an open row, or not at all, and totals add up."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted(((rng.randrange(12), 0, d) for d in range(400)), key=lambda r: (r[0], r[1], -r[2]))
    rows = sorted({*rows, *((h, 0, d) for h in (0, 11) for d in range(30))}, key=lambda r: (r[0], r[1], -r[2]))
    sizes = Counter(h for h, _, _ in rows)
    for trial in range(20):
        batches, at = [], 0
        while at < len(rows):
            n = rng.randint(1, 40)
            part = rows[at : at + n]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2] for r in part]), pa.array([r[2] for r in part]), pa.array([1] * len(part), pa.int32()), pa.array([0] * len(part), pa.int32()), pa.array([[0]] * len(part), pa.list_(pa.int32()))], names=["h1", "h2", "doc_id", "text_key", "n_lines", "first", "positions"]))
            at += n
        out = [r for b in first_occurrences(5)(iter(batches)) for r in b.to_pylist()]
        drops = Counter(r["h1"] for r in out if r["kind"] == 0)
        assert all(drops[h] == sizes[h] - 1 for h in sizes if h not in (0, 11) and sizes[h] >= 5)
        assert Counter(r["h1"] for r in out if r["kind"] == 1)[0] == sizes[0] and drops[11] == sizes[11] - 1
        assert {(r["h1"], r["n_docs"]) for r in out if r["kind"] == 2} == {(0, sizes[0]), (11, sizes[11])}
