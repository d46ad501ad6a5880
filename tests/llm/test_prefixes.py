from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sluice.llm.ordered import carried
from sluice.llm.prefixes import shared_heads

SCHEMA = "conv_id long, turn long, role string, text string, pos int, depth int, n string"


def brute(rows):
    own: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    nodes: dict = {}
    for c, s in paths.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids: dict = {}
    for s in nodes:
        if s:
            kids[s[:-1]] = kids.get(s[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for s, members in nodes.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(members) - 1) * len(s[-1][1].encode()) if s else 0
            leaves[s[:d]] += s not in kids
    out = []
    for s, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(s))
        up = min(nodes[s[:-1]]) if s else None
        out.append((min(members), len(s), up, len(members), kids.get(s, 0), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def run(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, 0, 0, "n") for r in rows], SCHEMA)
    conv = F.col("conv")
    got = shared_heads(table, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, **sizes)
    return sorted(map(tuple, got.collect()), key=lambda r: r[:2])


def talks(seed, n):
    """Conversations that share beginnings of any length, some equal, some beginnings of others, one very long."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(5 * n), n):
        for t in range(rng.choice([1, 2, 5, 9, 12, 20])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.02 else "user", f"é{t % 3}" if rng.random() < 0.97 else f"x{rng.random()}"))
    return rows + [(5 * n + 1, t, "user", f"long {t}") for t in range(300)] + [(5 * n + 7, t, "user", f"long {t}") for t in range(280)]


@pytest.mark.parametrize("sizes", [{}, {"shard_conversations": 9, "band_turns": 4}])
def test_against_plain_trie(spark, sizes):
    rows = talks(3, 120)
    assert run(spark, rows, **sizes) == brute(rows)


def test_nulls_ties_repeated_rows_and_empty_table(spark):
    rows = [(None, 1, "user", "x"), (5, None, "user", None), (5, None, None, ""), (5, 2, "user", ""), (5, 2, "user", ""), (5, 2, "a", "b")]
    rows += [(6, 1, "user", "q"), (7, 3, "a", "b"), (7, 3, "b", "a"), (7, 3, "a", "b"), (23, 1, "u", "alone")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == run(spark, [(None, 1, "user", "x")]) == []


def test_a_chain_of_ever_smaller_conversations(spark):
    """Each conversation is the beginning of the one before: as many paths on top of each other as conversations."""
    rows = [(5 * (40 - i), t, "user", f"t{t}") for i in range(30) for t in range(30 - i)]
    assert run(spark, rows) == brute(rows)


def test_sums_and_numbers_carry_on_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randrange(-(2**62), 2**62)) for i in range(2_000)]
    frame = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    got = {r.o: r for r in carried(frame, ["g"], ["o"], ["v"]).collect()}
    count, total = {"a": 0, "b": 0}, {"a": 0, "b": 0}
    for g, o, v in sorted(rows):
        count[g] += 1
        total[g] = (total[g] + v) % 2**64
        assert (got[o]["nth"], got[o]["rank"], got[o].v % 2**64) == (count[g], "ab".index(g) + 1, total[g])
    assert [r["nth"] for r in carried(frame.select("o"), [], ["o"]).orderBy("o").collect()] == list(range(1, 2_001))
    assert carried(frame.where("o < 0"), ["g"], ["o"], ["v"]).collect() == []
