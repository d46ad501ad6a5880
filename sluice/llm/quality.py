"""Quality classifier by co-training.

Two logistic classifiers look at different sides of a document: its content (shares of bytes and of byte class changes,
how varied its words are) and its page metadata (language, source, declared length, layout of lines). Each is fitted on
the labelled rows; in every round each scores all unlabelled documents and labels those it is most sure of for the other,
in the proportion of the labels. At the end each view is calibrated on labelled rows that took no part in fitting, the two
calibrated log-odds are combined by a third fit on these rows, and all documents are scored.

Fitting uses at most LABELLED_ROWS labelled documents, half of them of each class as far as there are so many, picked by
a hash of their id and weighted so that each class counts as in the whole table; and the surest unlabelled ones: in
round r each view gives PER_ROUND * r, so POOL_ROWS in all at most. Only the ids and features (a fixed number of numbers
each) of these come to the driver. A round is one pass over the documents that writes two numbers for each, a top-n per
view and class over these, and a second read of the texts just chosen; the final scores are one more pass.

Defined cases: null and empty texts have features of zero; null metadata is a value of its own; labels of unknown
documents, null labels and repeated labels that disagree are left out; without labels of both classes every document
gets the share of good labels (1.0 without any) and is kept; equal rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.llm.scratch import written
from sluice.llm.words import buffers, chunks, small_batches, words

LABELLED_ROWS = 6_000
POOL_ROWS = 6_000
ROUNDS = 4
PER_ROUND = 200
SURE_ODDS = 1.5
HELD_OUT = 4
META_SLOTS = 256
KEEP_FROM = 0.5
FIT_ROWS = 1_000
META = ("lang", "source", "n_chars")
ADDED = ("p_content", "p_metadata", "p_quality", "keep")

_CLASSES = np.zeros(256, np.int64)
for _chars, _number in ((b" ", 1), (b"\t\n\x0b\x0c\r", 2), (b"0123456789", 3), (b".,;:", 4), (bytes(range(65, 91)), 5), (bytes(range(97, 123)), 6), (bytes(range(128, 256)), 7)):
    _CLASSES[list(_chars)] = _number


def content_features(texts: pa.Array) -> np.ndarray:
    """Per text: square roots of byte shares and of class-change shares, distinct word share, repeat share, top share."""
    data, bounds = buffers(texts)
    w = words(texts)
    out = np.zeros((len(texts), 256 + 64 + 4))
    classes = _CLASSES[data]
    for i, (start, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        size = end - start
        if not size:
            continue
        out[i, :256] = np.sqrt(np.bincount(data[start:end], minlength=256) / size)
        if size > 1:
            steps = classes[start : end - 1] * 8 + classes[start + 1 : end]
            out[i, 256:320] = np.sqrt(np.bincount(steps, minlength=64) / (size - 1))
        own = w.hashes[w.first[i] : w.first[i + 1]]
        if len(own):
            _, counts = np.unique(own, return_counts=True)
            out[i, 320:] = (
                len(counts) / len(own),
                counts.max() / len(own),
                np.mean(own[1:] == own[:-1]) if len(own) > 1 else 0.0,
                np.log1p(len(own)) / 10,
            )
    return out


def metadata_features(texts: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Per row: hashed language and source, the declared length, and the layout of lines, as slots of 0 or 1."""
    out = np.zeros((len(texts), META_SLOTS))
    data, bounds = buffers(texts)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    lines = breaks[bounds[1:]] - breaks[bounds[:-1]] + 1
    length = np.diff(bounds)
    named = zip(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist(), strict=True)
    for i, (language, origin, size) in enumerate(named):
        declared = -1 if size is None else int(2 * np.log2(1 + max(size, 0)))
        facts = (
            f"lang={language}",
            f"source={origin}",
            f"length={declared}",
            f"lines={int(2 * np.log2(lines[i]))}",
            f"line={int(2 * np.log2(1 + length[i] / lines[i]))}",
        )
        for fact in facts:
            out[i, zlib.crc32(fact.encode()) % META_SLOTS] = 1.0
    return out


@dataclass
class Logistic:
    """Logistic regression with a ridge, fitted by Newton steps."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, ridge: float = 1.0) -> Logistic:
        center, scale = x.mean(0, dtype=np.float64), np.maximum(x.std(0, dtype=np.float64), 1e-3)
        weight = np.broadcast_to(np.asarray(weight, float), y.shape)
        size = x.shape[1] + 1
        penalty = np.full(size, ridge)
        penalty[-1] = 1e-6
        w = np.zeros(size)
        for _ in range(30):
            gradient, curvature = -penalty * w, np.diag(penalty)
            # Rows are standardised some at a time: the driver never holds a second copy of all of them.
            for at in range(0, len(x), FIT_ROWS):
                part = slice(at, at + FIT_ROWS)
                z = np.column_stack([(x[part] - center) / scale, np.ones(len(x[part]))])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                gradient += z.T @ (weight[part] * (y[part] - p))
                curvature += (z * (weight[part] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
            step = np.linalg.solve(curvature, gradient)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return Logistic(center, scale, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


#: From both views and how many rows of bad and of good quality to find: for each view the rows it is surest of, as id,
#: label and both feature vectors.
Surest = Callable[[tuple[Logistic, Logistic], int, int], list[list[tuple[object, float, tuple[np.ndarray, np.ndarray]]]]]


@dataclass
class CoTrained:
    """Both views, their calibrations, and how they are combined."""

    content: Logistic
    metadata: Logistic
    calibrated: tuple[Logistic, Logistic]
    combined: Logistic

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of good quality by content, by metadata, and by both."""
        views = [c.odds(v.odds(x)[:, None]) for c, v, x in zip(self.calibrated, (self.content, self.metadata), (content, metadata), strict=True)]
        both = self.combined.odds(np.column_stack(views))
        return tuple(1 / (1 + np.exp(-o)) for o in (*views, both))


def co_train(
    content: np.ndarray,
    metadata: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    surest: Surest,
    rounds: int = ROUNDS,
    per_round: int = PER_ROUND,
) -> CoTrained:
    """Fit on labelled rows, exchange sure labels of unlabelled rows over rounds, calibrate on every HELD_OUT-th labelled row."""
    held = np.arange(len(y)) % HELD_OUT == HELD_OUT - 1
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    check = held if held.any() else ~held
    sides = [content, metadata]
    # By side: the rows the other one has labelled, in the order of their ids.
    taken: list[dict[object, tuple[np.ndarray, float]]] = [{}, {}]
    good = np.average(y[~held], weights=weight[~held])
    few = max(1, round(per_round * (1 - good)))
    many = max(1, per_round - few)
    for turn in range(rounds + 1):
        models = []
        for side in (0, 1):
            extra = [taken[side][i] for i in sorted(taken[side])]
            x = np.concatenate([sides[side][~held], *(v[None, :] for v, _ in extra)])
            labels = np.concatenate([y[~held], [label for _, label in extra]])
            models.append(Logistic.fit(x, labels, np.concatenate([weight[~held], np.ones(len(extra))])))
        if turn == rounds or per_round < 2:
            break
        for side, found in enumerate(surest((models[0], models[1]), few * (turn + 1), many * (turn + 1))):
            for i, label, views in found:
                taken[1 - side].setdefault(i, (views[1 - side], label))
    views = [m.odds(s[check])[:, None] for m, s in zip(models, sides, strict=True)]
    calibrated = tuple(Logistic.fit(v, y[check], weight[check]) for v in views)
    stacked = np.column_stack([c.odds(v) for c, v in zip(calibrated, views, strict=True)])
    return CoTrained(*models, calibrated, Logistic.fit(stacked, y[check], weight[check]))


def _features(rows: DataFrame) -> DataFrame:
    """The id with both feature vectors."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts, *meta = (batch.column(c) for c in ("text", "lang", "source", "n_chars"))
            views = [pa.array(list(f), pa.list_(pa.float32())) for f in (content_features(texts), metadata_features(texts, *meta))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *views], names=["id", "content", "metadata"])

    return rows.mapInArrow(per_batch, f"id {rows.schema['id'].dataType.simpleString()}, content array<float>, metadata array<float>")


def _vectors(table: pa.Table, name: str) -> np.ndarray:
    if not table.num_rows:
        return np.zeros((0, 1), np.float32)
    return np.concatenate([c.flatten().to_numpy() for c in table.column(name).chunks]).reshape(table.num_rows, -1)


def surest_rows(rows: DataFrame, labels: DataFrame) -> Surest:
    """Search of all documents without a label. Of rows with equal id one counts, the same in each round."""
    rows = rows.where("id is not null").withColumn("row", F.xxhash64("text", "lang", "source", "n_chars"))
    id_type = rows.schema["id"].dataType.simpleString()
    known = labels.select("id").distinct()
    features: dict[object, tuple[np.ndarray, np.ndarray]] = {}

    def surest(models: tuple[Logistic, Logistic], few: int, many: int) -> list[list[tuple]]:
        def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                texts, *meta = (batch.column(c) for c in ("text", "lang", "source", "n_chars"))
                odds = models[0].odds(content_features(texts)), models[1].odds(metadata_features(texts, *meta))
                own = [batch.column("id"), batch.column("row")]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, odds)], names=["id", "row", "odds0", "odds1"])

        scored = rows.mapInArrow(per_batch, f"id {id_type}, row bigint, odds0 double, odds1 double")
        one = scored.groupBy("id").agg(F.min(F.struct("row", "odds0", "odds1")).alias("one")).select("id", "one.*")
        odds = written(one.join(known, "id", "left_anti"), "odds")
        found, keys = [[], []], {}
        for side in (0, 1):
            score = F.col(f"odds{side}")
            for n, label, sure, order in ((few, 0.0, score < -SURE_ODDS, score), (many, 1.0, score > SURE_ODDS, -score)):
                for r in odds.where(sure).orderBy(order, F.xxhash64("id"), "id").limit(n).select("id", "row").collect():
                    found[side].append((r.id, label))
                    keys[r.id] = r.row
        new = [(i, row) for i, row in keys.items() if i not in features]
        if new:
            wanted = rows.sparkSession.createDataFrame(new, odds.select("id", "row").schema)
            # A bounded number of ids: small enough for every task, so texts are not shuffled.
            table = _features(rows.join(F.broadcast(wanted), ["id", "row"]).dropDuplicates(["id"])).toArrow()
            vectors = zip(_vectors(table, "content"), _vectors(table, "metadata"), strict=True)
            features.update(zip(table.column("id").to_pylist(), vectors, strict=True))
        return [[(i, label, features[i]) for i, label in side] for side in found]

    return surest


def quotas(known: dict[int, int], most: int) -> dict[int, int]:
    """How many labels of each of two classes to take: half of `most`, and what one class lacks of that from the other."""
    if sum(known.values()) <= most:
        return known
    return {c: max(1, min(n, max(most // 2, most - (sum(known.values()) - n)))) for c, n in known.items()}


def train(rows: DataFrame, labels: DataFrame, labelled_rows: int, pool_rows: int) -> tuple[CoTrained | None, float]:
    """The model, or none and the share of good labels. `rows` has id, text, lang, source, n_chars; `labels` id, y.

    At most `labelled_rows` labelled rows and, over all rounds, `pool_rows` unlabelled ones reach the fit.
    """
    clear = labels.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("high")).where("y = high").drop("high")
    ids = rows.select("id").where("id is not null").distinct()
    usable = written(clear.join(ids, "id"), "labelled")
    known_of = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    share = known_of.get(1, 0) / sum(known_of.values()) if known_of else 1.0
    if len(known_of) < 2:
        return None, share
    y_of, weight_of = {}, {}
    for label, n in quotas(known_of, labelled_rows).items():
        few = usable.where(F.col("y") == label).orderBy(F.xxhash64("id"), "id").limit(n).collect()
        y_of |= {r.id: float(label) for r in few}
        weight_of[float(label)] = known_of[label] / n
    wanted = rows.sparkSession.createDataFrame([(i,) for i in y_of], rows.select("id").schema)
    # At most labelled_rows ids: small enough for every task, so texts are not shuffled.
    table = _features(rows.join(F.broadcast(wanted), "id").dropDuplicates(["id"])).toArrow()
    ids_found = np.array(table.column("id").to_pylist(), object)
    # In the order of ids, labels may come in runs: deal them out anew, the same way each time.
    known = np.random.Generator(np.random.PCG64(1)).permutation(np.argsort(ids_found, kind="stable"))
    y = np.array([y_of[ids_found[i]] for i in known])
    weight = np.array([weight_of[v] for v in y])
    weight /= weight.mean()
    # Over the rounds both views give 2 * (1 + 2 + ... + ROUNDS) times as many rows at most.
    per_round = min(PER_ROUND, pool_rows // (ROUNDS * (ROUNDS + 1)))
    search = surest_rows(rows, labels)
    views = _vectors(table, "content")[known], _vectors(table, "metadata")[known]
    del table, ids_found
    pa.default_memory_pool().release_unused()
    return co_train(*views, y, weight, search, per_round=per_round), share


def _scored(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    labelled_rows: int,
    pool_rows: int,
    keep_from: float,
) -> tuple[DataFrame, dict[str, str]]:
    """All columns of `docs` and the results under names no column has: the frame and the names."""
    small_batches(docs.sparkSession)
    named = [F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")]
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.length(text_col).cast("bigint")
    meta_columns = [named[0].cast("string"), named[1].cast("string"), n_chars]
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(c.alias(n) for c, n in zip(meta_columns, META, strict=True)))
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    model, share = train(narrow, given, labelled_rows, pool_rows)
    names = docs.columns
    mark = "_"
    while any(n.startswith(mark) for n in names):
        mark += "_"
    meta, added = [mark + n for n in META], {n: mark + n for n in ADDED}

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            if model is None:
                scores = [np.full(batch.num_rows, share)] * 3
                keep = np.ones(batch.num_rows, bool)
            else:
                texts, facts = batch.column(text_col), [batch.column(c) for c in meta]
                scores = model.score(content_features(texts), metadata_features(texts, *facts))
                keep = scores[2] >= keep_from
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, scores), pa.array(keep)], names=[*names, *added.values()])

    schema = StructType(list(docs.schema.fields))
    for name in ADDED:
        schema = schema.add(added[name], "boolean" if name == "keep" else "double")
    rows = docs.select("*", *(c.alias(n) for c, n in zip(meta_columns, meta, strict=True)))
    return rows.mapInArrow(per_batch, schema), added


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    labelled_rows: int = LABELLED_ROWS,
    pool_rows: int = POOL_ROWS,
    keep_from: float = KEEP_FROM,
) -> DataFrame:
    """Every row of `docs` with its columns and p_content, p_metadata, p_quality (chances of good quality), keep. These
    four take the place of columns of the same names."""
    scored, added = _scored(docs, labels, id_col, text_col, label_col, labelled_rows, pool_rows, keep_from)
    return scored.select(*(c for c in docs.columns if c not in ADDED), *(F.col(a).alias(n) for n, a in added.items()))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `docs` that `classify` keeps, with exactly their own columns."""
    scored, added = _scored(docs, labels, id_col, text_col, label_col, LABELLED_ROWS, POOL_ROWS, KEEP_FROM)
    return scored.where(added["keep"]).select(*docs.columns)
