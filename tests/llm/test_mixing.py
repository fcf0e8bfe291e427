import random
from collections import defaultdict
from fractions import Fraction
from math import ceil, floor

import pytest

from haggle.llm import mixing


def deviations(order, blocks, weights):
    """How far any source is from its target at most, slot by slot and exactly; targets are scaled up when a source runs out."""
    w = [Fraction(x) for x in weights]
    left, had, begin, worst = list(blocks), [0] * len(blocks), 0, 0
    active = [s for s in range(len(blocks)) if left[s]]
    total = sum(w[s] for s in active)
    for t, s in enumerate(order, 1):
        assert left[s] > 0
        left[s] -= 1
        had[s] += 1
        if t % 37 == 0 or t < 5000 or not left[s]:
            worst = max(worst, max(abs(had[k] - (t - begin) * w[k] / total) for k in active))
        if not left[s]:
            begin, had = t, [0] * len(blocks)
            active = [k for k in active if left[k]]
            total = sum(w[k] for k in active)
    assert not any(left)
    return worst


@pytest.mark.parametrize("weights", [[1], [3, 5], [1, 1, 1], [700, 200, 100, 23, 1], [0.5, 0.1, 0.4], [1 / 3, 2 / 3], [0.9, 0.0999, 0.0001], [0.3333, 0.1667, 0.5]])
def test_every_prefix_is_less_than_a_block_off_the_given_weights(weights):
    rng = random.Random(1)
    blocks = [max(1, int(4000 * x / sum(weights) * rng.uniform(0.5, 1.5))) for x in weights]
    assert deviations(mixing.schedule(blocks, weights).tolist(), blocks, weights) < 1


def test_many_sources():
    rng = random.Random(2)
    weights = [rng.random() ** 2 + 0.001 for _ in range(120)]
    blocks = [int(20000 * x / sum(weights) * (1 + rng.random())) + 1 for x in weights]
    assert deviations(mixing.schedule(blocks, weights).tolist(), blocks, weights) < 1


def test_a_million_blocks_with_a_small_weight():
    weights = [0.9, 0.0999, 0.0001]
    blocks = [900_000, 99_900, 100]
    order = mixing.schedule(blocks, weights)
    had = [0, 0, 0]
    for t, s in enumerate(order.tolist(), 1):
        had[s] += 1
        if had[s] == blocks[s]:
            break
        assert all(abs(h - t * w) < 1 for h, w in zip(had, weights))
    assert t > 990_000 and len(order) == sum(blocks)


def test_windows_are_kept_slot_by_slot():
    """Each block stands between its own release and deadline."""
    weights = [0.61, 0.2, 0.11, 0.08]
    total = sum(map(Fraction, weights))
    order = mixing.schedule([6100, 2000, 1100, 800], weights).tolist()
    number = [0] * 4
    for t, s in enumerate(order[:9000]):
        w = Fraction(weights[s]) / total
        assert floor(number[s] / w) <= t < ceil((number[s] + 1) / w)
        number[s] += 1


def walk(blocks, weights):
    """A plain schedule: at every slot look at all sources anew."""
    left, out = list(blocks), []
    while any(left):
        active = [s for s in range(len(left)) if left[s]]
        total = sum(Fraction(weights[s]) for s in active)
        share, had, t = {s: Fraction(weights[s]) / total for s in active}, dict.fromkeys(active, 0), 0
        while all(left[s] for s in active):
            ready = [(ceil((had[s] + 1) / share[s]), s) for s in active if floor(had[s] / share[s]) <= t]
            s = min(ready)[1]
            out.append((s, blocks[s] - left[s]))
            left[s], had[s], t = left[s] - 1, had[s] + 1, t + 1
    return out


def test_rows_get_the_slots_of_a_walk(spark):
    rng = random.Random(4)
    sizes = {"a": 400, "b": 7, "c": 90, None: 31, "": 1}
    rows = [(i, s) for s, n in sizes.items() for i in rng.sample(range(10000), n)] + [(None, "a"), (5, "c"), (5, "c")]
    df = spark.createDataFrame([(i, s, 1, "x") for i, s in rows], "doc_id long, source string, slot int, block string").repartition(7)
    for how, size in (({"block_rows": 4}, 4), ({"block_rows": 1, "max_blocks": 110}, 6)):  # 535 rows in 105 blocks at most
        out = mixing.mix(df, carry=["doc_id", "block"], **how).collect()
        by_source = defaultdict(list)
        for i, s in rows:
            by_source[s].append(i)
        names = sorted(by_source, key=lambda s: (s is not None, s or ""))
        counts = [len(by_source[s]) for s in names]
        order = walk([-(-n // size) for n in counts], [n**0.5 for n in counts])
        slot_of = {(names[s], b): t for t, (s, b) in enumerate(order)}
        want = []
        for s in names:
            for k, i in enumerate(sorted(by_source[s], key=lambda i: (i is not None, i or 0))):
                want.append((str(s), k // size, k % size, slot_of[(s, k // size)], str(i)))
        assert sorted((str(r.source), r.block, r.place, r.slot, str(r.doc_id)) for r in out) == sorted(want)
        assert all(r.row.doc_id == r.doc_id and r.row.block == "x" for r in out)


def test_given_weights_and_unnamed_sources(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)], "doc_id long, source string")
    out = mixing.mix(df, weights={"a": 3, "b": 1}, block_rows=1).collect()
    by_slot = [r.source for r in sorted(out, key=lambda r: r.slot)]
    assert sorted(r.slot for r in out) == list(range(300)) and set(by_slot[200:]) == {"c"}
    assert by_slot[:80].count("b") == 20
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"a": -1})
