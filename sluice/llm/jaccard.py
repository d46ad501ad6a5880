"""N-gram Jaccard join with prefix filtering.

Each text becomes its set of distinct word n-grams. Grams are put in one global order, rare ones first: the order comes
from a count of all documents' grams over a fixed number of hash cells, so the table that every task gets has a set
size. A pair within the threshold must share a gram of both prefixes; candidates come from a join on prefix grams and
are thinned by length, by the position of the first shared gram and by a suffix bound (grams counted by hash range).
What is left is verified once on the whole sets.

A large group of near copies would give pairs without end, and one link per document is enough to know its group. So
the join runs twice: first each document is compared with one hub, the member of its buckets with the most common
grams; then only pairs of documents that are still in different groups are formed. No link between groups is lost: a
pair is left out only when its documents are known to be in the same group.

Defined cases: texts without words (null, empty) have no gram and no partner; a text shorter than n words is one gram;
equal sets are one class and linked (when not empty); a null id is a document like any other, but never names a group
with other members; repeated rows are equal sets; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import components
from sluice.llm.scratch import written
from sluice.llm.words import chunks, grams, mix, signed, small_batches, words

CELL_BITS = 18
RANGE_BITS = 6
SEEN_LIMIT = 200_000

_U = np.uint64


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashed n-grams of each text, A-Z lower-cased."""
    w = words(texts, lower=True)
    gram = grams(w.hashes, n)
    for start, end in zip(w.first[:-1], w.first[1:], strict=True):
        if end - start >= n:
            yield np.unique(gram[start : end - n + 1])
        elif end > start:
            # A short text is one gram, tagged with its length: no n-gram equals it.
            yield mix(grams(w.hashes[start:end], end - start) + _U(end - start))
        else:
            yield np.zeros(0, _U)


def gram_weights(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """How common grams are, by hash cell: 2**CELL_BITS logarithmic weights of 15 bits, from all documents."""
    cells = 1 << CELL_BITS

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in chunks(batches, "text"):
            found = [s for s in shingle_sets(batch.column("text"), n) if len(s)]
            if found:
                total += np.bincount((np.concatenate(found) & _U(cells - 1)).astype(np.int64), minlength=cells)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["cell", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(per_batch, "cell int, n bigint")
    table = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(cells, np.int64)
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return np.minimum(np.round(700 * np.log2(1.0 + counts)), (1 << 15) - 1).astype(np.uint16)


def prefixes(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Per document: set size, 128 bits naming its set, a class number, its prefix grams, its grams by hash range.

    The class number holds the weight of the set's rarest gram in its upper bits: the larger, the more all of the text
    is found elsewhere, which is what makes a good hub. Equal sets within a task give their prefix once.
    """
    weights = gram_weights(docs, text_col, n)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in chunks(batches, "text"):
            sizes, s1, s2, number, prefix, spread = [], [], [], [], [], []
            for s in shingle_sets(batch.column("text"), n):
                size = len(s)
                a = int(mix(np.sum(mix(s ^ _U(0x1F83D9ABFB41BD6B)), keepdims=True, dtype=_U) + _U(size))[0]) if size else 0
                b = int(mix(np.sum(mix(s ^ _U(0x5BE0CD19137E2179)), keepdims=True, dtype=_U) + _U(size))[0]) if size else 0
                sizes.append(size)
                s1.append(a - (1 << 64) if a >> 63 else a)
                s2.append(b - (1 << 64) if b >> 63 else b)
                if not size:
                    number.append(-1), prefix.append(None), spread.append(None)
                    continue
                weight = weights[(s & _U((1 << CELL_BITS) - 1)).astype(np.int64)].astype(_U)
                order = np.argsort(weight << _U(48) | s >> _U(16), kind="stable")
                number.append(int(weight[order[0]]) << 48 | a >> 16)
                if a in seen:
                    prefix.append(None), spread.append(None)
                    continue
                if len(seen) < SEEN_LIMIT:
                    seen.add(a)
                reach = size - -(-size * percent // 100) + 1
                prefix.append(s[order[:reach]].view(np.int64))
                spread.append(np.bincount((s >> _U(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("row"),
                    pa.array(sizes, pa.int64()),
                    pa.array(s1, pa.int64()),
                    pa.array(s2, pa.int64()),
                    pa.array(number, pa.int64()),
                    pa.array(prefix, pa.list_(pa.int64())),
                    pa.array(spread, pa.list_(pa.int32())),
                ],
                names=["id", "row", "n", "s1", "s2", "number", "prefix", "spread"],
            )

    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, row bigint, n bigint, s1 bigint, s2 bigint, number bigint, prefix array<bigint>, spread array<int>"
    )
    return keyed.mapInArrow(per_batch, schema)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs a, b of class numbers whose sets meet the threshold, with the sizes of intersection and union."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(chunks(batches, "text_a"), "text_b"):
            left, right = shingle_sets(batch.column("text_a"), n), shingle_sets(batch.column("text_b"), n)
            shared, either = [], []
            for x, y in zip(left, right, strict=True):
                both = len(x) + len(y) - len(np.union1d(x, y))
                shared.append(both)
                either.append(len(x) + len(y) - both)
            out = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(either, pa.int64())],
                names=["a", "b", "shared", "either"],
            )
            yield out.filter(pa.array([100 * s >= percent * e for s, e in zip(shared, either, strict=True)], pa.bool_()))

    side = lambda name: texts.select(F.col("number").alias(name), F.col("text").alias(f"text_{name}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(per_batch, "a bigint, b bigint, shared bigint, either bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85
) -> DataFrame:
    """Every document with its set size `n_shingles` and `component_id`, the least id it is linked with over any chain;
    also `row` (xxhash64 of the text) and `group` (a number for each group, null without words).

    Two documents are linked when 100 * shared >= percent * union over their sets of n-grams.
    """
    small_batches(docs.sparkSession)
    sets = written(prefixes(docs, id_col, text_col, n, percent), "prefixes")
    classes = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("least"), F.first("number").alias("number"))
    groups = _groups(docs, sets, id_col, text_col, n, percent)
    named = (
        classes.join(groups, "number", "left")
        .withColumn("component", F.coalesce("component", "number"))
        .select("s1", "s2", "component", "least")
    )
    named = written(named, "named")
    least = written(named.groupBy("component").agg(F.min("least").alias("least")), "least")
    named = named.drop("least").join(least, "component").select("s1", "s2", "least", F.col("component").alias("group"))
    return (
        sets.select("id", "row", "n", "s1", "s2")
        .join(named, ["s1", "s2"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("least")).alias("component_id"),
            "row",
            "group",
        )
    )


def _may_link(percent: int) -> str:
    """Length and positional filter for a shared gram at places at_a and at_b of sets of n_a and n_b grams.

    If the gram is the first shared one, all others come after it in both; that must leave enough of them.
    """
    return (
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and "
        f"least(n_a - at_a, n_b - at_b) >= ceil({percent} * (n_a + n_b) / {100 + percent}.0)"
    )


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: pairs a, b whose grams, counted by hash range, can still overlap enough."""
    spread = sets.where("spread is not null").groupBy("number").agg(F.first("spread").alias("spread"), F.first("n").alias("n"))
    for side in ("a", "b"):
        own = spread.select(F.col("number").alias(side), F.col("spread").alias(f"s_{side}"), F.col("n").alias(f"n_{side}"))
        pairs = pairs.join(own, side)
    most = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return pairs.where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _groups(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Components over class numbers: columns number, component."""
    rows = sets.where("prefix is not null").select("number", "n", F.posexplode("prefix").alias("at", "gram"))
    # Written first, so that the join has two plain exchanges and a hot gram can be split between tasks.
    hubs = written(
        rows.groupBy("gram").agg(F.max("number").alias("hub"), F.min("number").alias("low")).where("low < hub").drop("low"),
        "hubs",
    )
    members = written(rows.join(hubs, "gram").distinct(), "members")

    # First join: one hub for each document, of those it may be linked with the one it shares most prefix grams with.
    own = members.where("number < hub").select("gram", "number", "hub", F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    hub = members.where("number = hub").select("gram", F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    first = (
        own.join(hub, "gram")
        .where(_may_link(percent))
        .groupBy("number", "hub")
        .count()
        .groupBy("number")
        .agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
        .select(F.col("number").alias("a"), F.col("hub").alias("b"))
    )
    first = written(_bounded(first, sets, percent), "first")
    star = components(verified(first, _texts(docs, sets, first, id_col, text_col), n, percent).select("a", "b"))

    # Second join: documents of one bucket that are in different groups so far.
    labelled = written(
        members.select("gram", "number", "n", "at")
        .join(star.select(F.col("node").alias("number"), "component"), "number", "left")
        .withColumn("component", F.coalesce("component", "number")),
        "labelled",
    )
    mixed = written(
        labelled.groupBy("gram")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("gram"),
        "mixed",
    )
    open_rows = written(labelled.join(mixed, "gram"), "open")
    side = lambda name: open_rows.select("gram", *(F.col(c).alias(f"{c}_{name}") for c in ("number", "n", "at", "component")))
    met = (
        side("a")
        .join(side("b"), "gram")
        .where("number_a < number_b and component_a <> component_b")
        .where(_may_link(percent))
        .select(F.col("number_a").alias("a"), F.col("number_b").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    second = written(_bounded(met, sets, percent), "second")
    links = verified(second, _texts(docs, sets, second, id_col, text_col), n, percent)
    return _merged(star, links.select("a", "b"))


def _merged(star: DataFrame, links: DataFrame) -> DataFrame:
    """Components after both joins: the second round's links go between the groups of the first."""
    end = lambda name: star.select(F.col("node").alias(name), F.col("component").alias(f"g_{name}"))
    between = (
        links.join(end("a"), "a", "left")
        .join(end("b"), "b", "left")
        .select(F.coalesce("g_a", "a").alias("a"), F.coalesce("g_b", "b").alias("b"))
    )
    joined = components(between)
    known = star.join(joined.withColumnRenamed("component", "over").withColumnRenamed("node", "component"), "component", "left")
    known = known.select(F.col("node").alias("number"), F.coalesce("over", "component").alias("component"))
    alone = joined.select(F.col("node").alias("number"), "component").join(known.select("number"), "number", "left_anti")
    return known.unionByName(alone)


def _texts(docs: DataFrame, sets: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One text for each class number in the pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct()
    of = [F.col("of.id").isNull().alias("no_id"), F.coalesce("of.id", F.lit(0)).alias("id"), F.col("of.row").alias("row")]
    one = sets.where("n > 0").groupBy("number", "s1", "s2").agg(F.min(F.struct("id", "row")).alias("of"))
    one = one.join(wanted, "number").select("number", *of)
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row")).alias("of"), F.col(text_col).alias("text"))
    keys = ["no_id", "id", "row"]
    # Repeated rows give one text; the aggregate uses the partitioning of the join.
    found = keyed.select(*of, "text").join(one, keys).groupBy(*keys, "number").agg(F.first("text").alias("text"))
    return written(found.select("number", "text"), "texts")


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """The documents with all their columns, of each group of near copies only the one of least id.

    Texts without words are in no group and stay. Rows of equal id and text are one document.
    """
    groups = near_duplicates(docs, id_col, text_col, n, percent)
    named = F.struct(F.col(id_col).alias("id"), "row")
    alone = groups.where("group is null").select(named.alias("of")).distinct()
    first = groups.where("group is not null").groupBy("group").agg(F.min(named).alias("of")).select("of")
    of = [F.col("of.id").isNull().alias("no_id"), F.coalesce("of.id", F.lit(0)).alias("id"), F.col("of.row").alias("row")]
    kept = alone.unionByName(first).select(*of)
    keyed = docs.select(
        F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row")).alias("of"), F.struct("*").alias("whole")
    )
    keys = ["no_id", "id", "row"]
    found = keyed.select(*of, "whole").join(kept, keys).groupBy(*keys).agg(F.first("whole").alias("whole"))
    return found.select("whole.*")
