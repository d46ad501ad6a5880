"""Prefix trie of conversations from vertical bitmaps.

Conversations are cut into shards of bounded size: so many conversations in id order, and of these so many turns (a
band), so one very long conversation is spread over bands. A shard indexes its rows as (position, turn) -> bitset of
conversations. Going down, the bitset of a node meets the posting of a turn at the next position; what both hold is a
child: its popcount says how many conversations share it, its lowest bit is the smallest of them, and its bits under the
bitset of conversations that end there are its end list. A band starts from the classes of conversations that share all
turns before it.

Nodes of all shards meet by the hash of their path (128 bits and the depth), reduced before they are shuffled, so a
node that a third of all conversations share is one row per shard. Subtree sums follow paths: the nodes with the same
smallest conversation form one path down the trie, paths hang on paths, totals of paths go up by pointer doubling, and
one pass in sorted order sums each path from its end.

Defined cases: rows with a null conversation id take no part; a null role or text is empty; turns are ordered by turn
(null first), rows of equal turn by the MD5 of their role and text, and repeated rows are turns of their own; a
conversation whose turns all go is a member of the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.ordered import carried
from sluice.llm.scratch import written
from sluice.llm.words import mix

SHARD_CONVERSATIONS = 2_048
BAND_TURNS = 32
MAX_ROUNDS = 64
_STEPS = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F)
NODE = ("depth", "s1", "s2")


def numbered_turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Per turn: conv, pos (from 1), key (MD5 of role and text) and the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    return carried(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("key")], name="turns").select(
        "conv", F.col("nth").alias("pos"), "key", "bytes"
    )


def rebuilt(turns: DataFrame, donor: Column, head: Column) -> DataFrame:
    """Conversations that start with the first `head` turns of another: conv, pos, key, bytes, size and a row of
    position 0 for each. `donor` and `head` are expressions over conv."""
    lengths = written(turns.groupBy("conv").agg(F.max("pos").alias("len")), "lengths")
    given = lengths.select("conv", "len", donor.alias("donor"), head.cast("bigint").alias("head"))
    donors = lengths.select(F.col("conv").alias("donor"), F.col("len").alias("donor_len"))
    given = given.join(donors, "donor", "left").select(
        "conv", "donor", "head", F.least("head", F.coalesce("donor_len", F.lit(0))).alias("taken"), F.greatest(F.col("len") - F.col("head"), F.lit(0)).alias("left")
    )
    given = written(given.select("*", (F.col("taken") + F.col("left")).alias("size")), "rebuilt")
    own = turns.join(given, "conv").where("pos > head").select("conv", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "key", "bytes", "size")
    # A donor's head is a few turns; it goes to the few conversations that ask for it.
    lent = turns.withColumnRenamed("conv", "donor").join(given.where("taken > 0"), "donor").where("pos <= taken").select("conv", "pos", "key", "bytes", "size")
    start = given.select("conv", F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("bytes"), "size")
    return own.unionByName(lent).unionByName(start)


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square = np.ones(len(exponents), np.uint64), base
    rest = exponents.copy()
    while rest.any():
        out = np.where(rest & 1, out * np.uint64(square), out)
        square, rest = square * square % (1 << 64), rest >> 1
    return out


def _with_terms(rows: DataFrame) -> DataFrame:
    """Adds each turn's share of the two path hashes (t1, t2); sums of shares are the hash of a path."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            pos = batch.column("pos").to_numpy()
            raw = np.frombuffer(bytes.fromhex("".join(k or "0" * 32 for k in keys)), np.uint64).reshape(-1, 2)
            shares = [np.where(pos > 0, mix(raw[:, i] + np.uint64(i)) * _powers(_STEPS[i], pos), np.uint64(0)) for i in (0, 1)]
            columns = [batch.column(c) for c in ("conv", "pos", "bytes", "size", "shard")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(s.view(np.int64)) for s in (*shares, *shares))], names=_ROW)

    return rows.mapInArrow(terms, ", ".join(f"{c} bigint" for c in _ROW))


_ROW = ["conv", "pos", "bytes", "size", "shard", "t1", "t2", "s1", "s2"]
_FOUND = ["shard", "depth", "s1", "s2", "p1", "p2", "n", "conv", "bytes", "ends"]


def descend(shard: pa.Table, band_turns: int) -> pa.Table:
    """The nodes of one shard and band: path hash, parent's path hash, members, smallest member, bytes of the last text,
    and the members that end there (ids, comma-joined)."""
    out: dict[str, list] = {c: [] for c in _FOUND}
    if shard.num_rows:
        v = {c: shard[c].to_numpy() for c in _ROW}
        ids, member = np.unique(v["conv"], return_inverse=True)
        before = [(v[s].view(np.uint64) - v[t].view(np.uint64)).view(np.int64) for s, t in (("s1", "t1"), ("s2", "t2"))]
        row_at: dict[int, dict[int, int]] = {}
        posting: dict[tuple[int, int, int], int] = {}
        present: dict[int, int] = {}
        ending: dict[int, int] = {}
        columns = (member, v["pos"], v["t1"], v["t2"], v["size"])
        for row, (m, pos, t1, t2, size) in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
            bit = 1 << m
            row_at.setdefault(pos, {})[m] = row
            posting[pos, t1, t2] = posting.get((pos, t1, t2), 0) | bit
            present[pos] = present.get(pos, 0) | bit
            if pos == size:
                ending[pos] = ending.get(pos, 0) | bit
        t1s, t2s, bytes_of = v["t1"].tolist(), v["t2"].tolist(), v["bytes"].tolist()
        s1s, s2s, p1s, p2s, names = v["s1"].tolist(), v["s2"].tolist(), before[0].tolist(), before[1].tolist(), ids.tolist()
        first = min(row_at)
        stack: list[tuple[int, int]] = []
        if first > 0:  # classes of conversations that are one node at the end of the band before
            classes: dict[tuple[int, int], int] = {}
            for m, row in row_at[first].items():
                key = p1s[row], p2s[row]
                classes[key] = classes.get(key, 0) | 1 << m
            stack += [(first - 1, bits) for bits in classes.values()]
        else:
            stack.append((-1, present[0]))
        while stack:
            depth, bits = stack.pop()
            depth += 1
            rest = bits & present.get(depth, 0)
            while rest:
                m = (rest & -rest).bit_length() - 1
                row = row_at[depth][m]
                child = rest & posting[depth, t1s[row], t2s[row]]
                rest &= ~child
                last = child & ending.get(depth, 0)
                out["depth"].append(depth)
                out["s1"].append(s1s[row])
                out["s2"].append(s2s[row])
                out["p1"].append(p1s[row])
                out["p2"].append(p2s[row])
                out["n"].append(child.bit_count())
                out["conv"].append(names[m])
                out["bytes"].append(bytes_of[row])
                out["ends"].append(",".join(str(names[i]) for i in _bits(last)) if last else None)
                if child != last:
                    stack.append((depth, child))
        out["shard"] = [int(v["shard"][0])] * len(out["depth"])
    return pa.table([pa.array(out[c], pa.string() if c == "ends" else pa.int64()) for c in _FOUND], names=_FOUND)


def _bits(bits: int) -> list[int]:
    if bits.bit_count() == 1:
        return [bits.bit_length() - 1]
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little")).tolist()


def _end_hashes(found: DataFrame) -> DataFrame:
    """SHA-256 of each node's end list. Shards follow each other in id order, so their lists are hashed one after another
    and none is ever put together."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in (*NODE, "ends"))
            for *key, ends in zip(*columns, strict=True):
                if key == node:
                    digest.update(b"," + ends.encode())
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ends.encode())
            yield _end_batch(done)
        if node is not None:
            yield _end_batch([(*node, digest.hexdigest())])

    rows = found.where("ends is not null").select(*NODE, "shard", "ends")
    ordered = rows.repartition(*NODE).sortWithinPartitions(*NODE, "shard")
    return ordered.mapInArrow(hashed, "depth bigint, s1 bigint, s2 bigint, ends_sha256 string")


def _end_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    arrays = [pa.array(c, pa.int64()) for c in columns[:3]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])


def trie(rows: DataFrame, shard_conversations: int = SHARD_CONVERSATIONS, band_turns: int = BAND_TURNS) -> DataFrame:
    """All nodes of conversations given as conv, pos (0 for the start, then turns from 1), key, bytes, size.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    convs = carried(rows.where("pos = 0").select("conv"), [], ["conv"], name="convs")
    shards = convs.select("conv", F.floor((F.col("nth") - 1) / shard_conversations).alias("shard"))
    hashed = carried(_with_terms(rows.join(shards, "conv")), ["conv"], ["pos"], ["s1", "s2"], name="paths")
    band = F.greatest(F.floor((F.col("pos") - 1) / band_turns), F.lit(0)).alias("band")
    schema = ", ".join(f"{c} {'string' if c == 'ends' else 'bigint'}" for c in _FOUND)
    found = written(
        hashed.select(*_ROW, band).groupBy("shard", "band").applyInArrow(lambda t: descend(t, band_turns), schema), "found"
    )
    merged = found.groupBy(*NODE).agg(*(F.max(c).alias(c) for c in ("p1", "p2", "bytes")), F.sum("n").alias("n"), F.min("conv").alias("conv"))
    nodes = written(merged.join(_end_hashes(found), list(NODE), "left"), "nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    counted = nodes.join(below.agg(F.count("*").alias("n_children")), list(NODE), "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv").alias("parent"))
    linked = written(
        counted.join(parents, ["depth", "p1", "p2"], "left").select(
            "conv", "depth", "parent", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), "ends_sha256",
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
            ((F.col("n") - 1) * F.col("bytes")).alias("saved"),
        ),
        "linked",
    )
    # A path is named after its smallest conversation; it hangs on the node above its first one.
    hangs = linked.where("parent is null or parent <> conv").select("conv", F.col("parent").alias("up"), (F.col("depth") - 1).alias("up_depth"))
    own = linked.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = written(own.join(hangs.select("conv", "up"), "conv"), "totals")
    for _ in range(MAX_ROUNDS):
        if totals.where("up is not null").isEmpty():
            break
        gifts = totals.where("up is not null").groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        higher = totals.select(F.col("conv").alias("up"), F.col("up").alias("next"))
        totals = written(
            totals.join(gifts, "conv", "left").join(higher, "up", "left").select(
                "conv", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("next").alias("up")
            ),
            "totals",
        )
    else:
        raise RuntimeError(f"paths did not settle in {MAX_ROUNDS} rounds")
    gifts = hangs.where("up is not null").join(totals.drop("up"), "conv").groupBy(F.col("up").alias("conv"), F.col("up_depth").alias("depth"))
    gifts = gifts.agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    weighed = linked.join(gifts, ["conv", "depth"], "left").select(
        "conv", "depth", "parent", "n", "n_children", "ends_sha256", (-F.col("depth")).alias("up_order"),
        (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
    )
    summed = carried(weighed, ["conv"], ["up_order"], ["leaves", "saved"], name="weighed")
    return summed.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def shared_heads(
    conversations: DataFrame,
    donor: Column,
    head: Column,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard_conversations: int = SHARD_CONVERSATIONS,
    band_turns: int = BAND_TURNS,
) -> DataFrame:
    """The trie of conversations rebuilt with the first `head` turns of conversation `donor` (expressions over conv)."""
    turns = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    return trie(written(rebuilt(turns, donor, head), "rows"), shard_conversations, band_turns)
