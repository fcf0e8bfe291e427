import random
import sys
from functools import cache
from hashlib import sha256
from zlib import crc32

import pytest

from haggle.llm import conversations
from haggle.llm.conversations import Survivors, damage, digests, ending, joined, repair

sys.setrecursionlimit(20_000)
BLANKS = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_edits(rows):
    """(cost, letters) from the last row back, rows as (initial, fault)."""

    @cache
    def best(at, state, inserted=0):
        # states: what came last ("" nothing)
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        options = []
        if at == len(rows) and state in ("", "a"):
            options.append((0, ""))
        if inserted < 3:
            cost, letters = best(at, after, inserted + 1)
            options.append((cost + 5, "I" + letters))
        if at < len(rows):
            initial, fault = rows[at]

            def then(letter, price, state):
                cost, letters = best(at + 1, state)
                options.append((cost + price, letter + letters))

            then("D", 2, state)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                then("R", 1 + more, after)
                if initial == after or initial == "s" and state == "":
                    then("K", more, initial)
        return min(options) if options else (10**9, "")

    return best(0, "")


def brute(rows):
    """What digests() gives, for rows (conv, turn, role, text), damaged already."""
    out, by_conv = {}, {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r[1:])
    for conv, turns in by_conv.items():
        turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
        seen, told, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in turns:
            rest = text.rstrip(BLANKS)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            told.append((role[:1], fault))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, letters = brute_edits(tuple(told))
        lines, state, k = [], "", 0
        for letter in letters:
            turn = None
            if letter != "I":
                turn, k = turns[k], k + 1
            if letter == "D":
                continue
            initial = turn[1][:1] if letter == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            lines.append(f"{turn[1] if letter == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{turn[2] if turn else ''}")
            state = initial
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, letters, sha256("\n".join(lines).encode()).hexdigest())
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
EMPTY = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
SCHEMA = "conv_id long, turn long, role string, text string"


def random_turns(rng, n):
    return [(rng.choice("suaax") if rng.random() < 0.9 else "", rng.choice(["", "", "truncated", "truncated", "blank", "duplicate"])) for _ in range(n)]


def edited(turns, entry=0):
    s, out = Survivors(entry), []
    for initial, fault in turns:
        out += s.step(initial, conversations.FAULTS.get(fault, 0))
    return s, out


def test_survivors_give_the_cheapest_and_least_edits():
    rng = random.Random(4)
    for _ in range(600):
        turns = random_turns(rng, rng.randint(0, 14))
        s, out = edited(turns)
        state, inserted = ending(s.cost, s.rank)
        letters = "".join(out + s.rest(state)) + "I" * inserted
        assert (s.total + s.cost[state] + 5 * inserted, letters) == brute_edits(tuple(turns))


def test_parts_of_a_conversation_join_to_the_same_edits():
    rng = random.Random(6)
    for _ in range(200):
        turns = random_turns(rng, rng.randint(1, 20))
        cuts = sorted(rng.sample(range(len(turns) + 1), min(3, len(turns))))
        pieces = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        pieces = [p for p in pieces if p]
        plan = joined([(k, 0, "x", [edited(p, e)[0].summary() for e in range(4)]) for k, p in enumerate(pieces)])
        letters = ""
        for k, _, entry, state, inserted in sorted(plan):
            s, out = edited(pieces[k], entry)
            letters += "".join(out + s.rest(state)) + "I" * inserted
        assert letters == brute_edits(tuple(turns))[1]


def test_memory_is_that_of_unresolved_edits():
    s = Survivors()
    held = 0
    for k in range(20_000):
        s.step("ua"[k % 2], 0)
        held = max(held, len(s.nodes))
    assert held < 60


def conversations_of(rng, n):
    texts = ["Yes.", "Why?", "No end", "Stop!  \n", "", " \t", "An answer.", "x" * 50 + ".", "é…", None]
    roles = ["system", "user", "assistant", "assistant", "user", "other", "", None]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_same_as_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = conversations_of(rng, 60)
    # one conversation over many partitions
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", rng.choice(["A line.", f"Line {t}.", "no end", ""])) for t in range(700)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA + ", place int, fault string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in digests(repair(damage(docs)), docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    want = {conv: EMPTY for conv, *_ in rows} | brute(brute_damage(rows))
    assert got == want


def test_long_stretches_and_empty_tables(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    edits = repair(docs)
    whole = digests(edits, docs).first()
    monkeypatch.setattr(conversations._stretches, "__defaults__", (30,))
    assert digests(edits, docs).first() == whole == digests(edits.orderBy(edits.place.desc()), docs).first()
    assert (whole.cost, whole.audit) == (0, "K" * 60)
    assert digests(repair(docs.limit(0)), docs.limit(0)).collect() == []


def test_edits_carry_rows(spark):
    rows = [(5, 0, "system", "Be kind."), (5, 1, "assistant", "Good day."), (5, 2, "assistant", "Good day."), (5, 3, "user", "cut of")]
    out = [(r.edit, r.role, r.text) for r in repair(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()]
    want = brute(rows)[5]
    assert "".join(e for e, *_ in out) == want[6]
    assert sha256("\n".join(f"{r}:{t}" for e, r, t in out if e != "D").encode()).hexdigest() == want[7]
