"""SentencePiece encoding to the N best segmentations, and decoding.

The piece lattice of a text is searched as a unigram model does it: a forward Viterbi pass gives the best score of every
prefix, and these scores are the exact heuristic of an A-star search from the end backwards, which therefore pops whole
segmentations best first. A lattice falls into parts where no piece of the vocabulary can lie across (between words, and
between letters and other signs if the vocabulary has no piece with both). Parts repeat, so each task searches a part
once; the N best of a text are the best combinations of the N best of its parts. Only the N - 1 parts with the smallest
loss to their second segmentation can change among the N best, so only those are searched backwards.

Piece scores: a merge-based vocabulary file holds ranks, no log-probabilities. `scoring="zipf"` (default) reads them as
such, log p = -log(rank + 1); `scoring="file"` takes the scores of the file as they are.

Spaces become U+2581 and one is put in front, as the library does. Signs without a piece, and U+2581 itself, become
bytes, so decoding gives back every text exactly.

Defined cases: null and empty texts have no ids, score 0 and no alternatives; texts with fewer segmentations than N have
fewer alternatives; among equal scores the earlier and then the longer piece wins; other columns are ignored by `encode`
and kept by callers that join.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.words import chunks, small_batches

N_BEST = 4
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: What a worker keeps of parts and their segmentations, as an estimate of their size in memory.
CACHE_BYTES = 128 << 20
_ENTRY_BYTES = 320
INF = math.inf


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# Best ids (as int32 bytes), their score and the loss of the second segmentation. A plain tuple of such values is not
# followed by the garbage collector, which matters with a million of them.
Part = tuple[bytes, float, float]
# Score, id and what follows of a start of pieces.
Node = tuple[float, int, "dict[str, Node] | None"]


@dataclass
class Pieces:
    """Vocabulary with the lattice search. Built in each task from the bytes of the model file."""

    model: bytes
    scoring: str = "zipf"
    cache: dict[str, Part] = field(default_factory=dict)
    held: int = 0
    ranked: dict[tuple[str, int], list[tuple[float, list[int]]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_proto=self.model)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        self.byte_ids = {}
        self.surface = [b""] * size
        plain = []
        for i, name in enumerate(names):
            if lib.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.surface[i] = bytes([value])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.surface[i] = name.replace(SPACE, " ").encode()
                plain.append(i)
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        if self.scoring == "zipf":
            order = sorted(plain, key=lambda i: -lib.get_score(i))
            score = {i: -math.log(rank + 1) for rank, i in enumerate(order, 1)}
        else:
            score = {i: lib.get_score(i) for i in plain}
        self.pieces = {names[i]: (i, score[i]) for i in plain}
        self.unknown = min(score.values()) - UNKNOWN_PENALTY
        # Every start of a piece, with the piece's score; -inf where it only goes on to longer ones.
        self.starts = {name[:n]: -INF for name in self.pieces for n in range(1, len(name))}
        self.starts |= {name: score for name, (_, score) in self.pieces.items()}
        self.tree = self._tree()
        self.longest = max(map(len, self.pieces))
        self.splitter = self._splitter()

    def _tree(self) -> dict[str, Node]:
        """The starts by their signs: each with score, id (-1 if it is no piece) and the signs it goes on with.

        A first sign that is no piece has the score of an unknown one.
        """
        below: dict[str, dict[str, Node]] = {"": {}}
        for name in sorted(self.starts, key=len, reverse=True):
            id_, score = self.pieces.get(name, (-1, -INF))
            below.setdefault(name[:-1], {})[name[-1]] = (score, id_, below.pop(name, None))
        return {sign: (score if id_ >= 0 else self.unknown, id_, more) for sign, (score, id_, more) in below[""].items()}

    def _splitter(self) -> re.Pattern[str]:
        """Cuts a text where no piece lies across; as fine as the vocabulary allows."""
        pairs = {(a, b) for name in self.pieces for a, b in zip(name, name[1:], strict=False)}
        if any(a != SPACE and b == SPACE for a, b in pairs) or any("\n" in p for p in pairs):
            return re.compile(r"(?s).+")
        odd: set[str] = set()
        for _ in range(3):
            letter = re.compile(rf"[^\W\d_{''.join(map(re.escape, sorted(odd)))}]")
            mixed = {a if letter.fullmatch(a) else b for a, b in pairs if SPACE not in (a, b) and bool(letter.fullmatch(a)) != bool(letter.fullmatch(b))}
            if not mixed:
                inside = letter.pattern[2:-1]
                return re.compile(rf"{SPACE}*(?:[^{inside}]+|(?:(?![^{inside}])[^{SPACE}\n])+)|{SPACE}+|\n")
            odd |= mixed
        return re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def units_of(self, piece: str) -> tuple[int, ...]:
        known = self.pieces.get(piece)
        return (known[0],) if known else tuple(self.byte_ids[b] for b in piece.encode())

    def forward(self, part: str) -> tuple[list[float], list[int], list[int], list[float]]:
        """Per end position: best score, start and id of the last piece (-1: none), and loss of the second best last piece."""
        n, signs, first, unknown = len(part), list(part), self.tree.get, (self.unknown, -1, None)
        best, back, last, loss = [0.0] + [-INF] * n, list(range(-1, n)), [-1] * (n + 1), [INF] * (n + 1)
        for start, sign in enumerate(signs):
            at = best[start]
            end = start + 1
            step, id_, more = first(sign, unknown)
            score = at + step
            lead = score - best[end]
            if lead > 0:
                loss[end], best[end], back[end], last[end] = lead, score, start, id_
            elif -lead < loss[end]:
                loss[end] = -lead
            while more is not None and end < n:
                node = more.get(signs[end])
                if node is None:
                    break
                end += 1
                step, id_, more = node
                if id_ < 0:
                    continue
                score = at + step
                lead = score - best[end]
                if lead > 0:
                    loss[end], best[end], back[end], last[end] = lead, score, start, id_
                elif -lead < loss[end]:
                    loss[end] = -lead
        return best, back, last, loss

    def lattice(self, part: str) -> tuple[list[float], list[list[tuple[int, float]]]]:
        """Per end position the best score of what is before it, and all pieces that end there: start and score."""
        n = len(part)
        best, edges = [0.0] + [-INF] * n, [[] for _ in range(n + 1)]
        for start in range(n):
            for end in range(start + 1, min(n, start + self.longest) + 1):
                step = self.starts.get(part[start:end])
                if end == start + 1 and (step is None or step == -INF):
                    step = self.unknown
                elif step is None:
                    break
                if step > -INF:
                    edges[end].append((start, step))
                    best[end] = max(best[end], best[start] + step)
        return best, edges

    def part(self, text: str) -> Part:
        found = self.cache.get(text)
        if found is None:
            best, back, last, loss = self.forward(text)
            ids: list[int] = []
            end, least = len(text), INF
            while end:
                if loss[end] < least:
                    least = loss[end]
                start, id_ = back[end], last[end]
                if id_ >= 0:
                    ids.append(id_)
                else:
                    ids.extend(reversed(self.units_of(text[start:end])))
                end = start
            ids.reverse()
            found = (array("i", ids).tobytes(), best[-1], least)
            self.keep(self.cache, text, found, _ENTRY_BYTES + 4 * len(text) + len(found[0]))
        return found

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a part, best first."""
        if (text, n) in self.ranked:
            return self.ranked[text, n]
        best, edges = self.lattice(text)
        out: list[tuple[float, list[int]]] = []
        queue: list[tuple[float, int, int, float, tuple]] = [(-best[-1], 0, len(text), 0.0, ())]
        count = 0
        while queue and len(out) < n:
            _, _, end, done, path = heapq.heappop(queue)
            if not end:
                ids: list[int] = []
                while path:
                    piece, path = path
                    ids += self.units_of(piece)
                out.append((done, ids))
                continue
            for start, step in edges[end]:
                count += 1
                score = done + step
                heapq.heappush(queue, (-(best[start] + score), count, start, score, (text[start:end], path)))
        self.keep(self.ranked, (text, n), out, _ENTRY_BYTES + 4 * len(text) + sum(120 + 8 * len(ids) for _, ids in out))
        return out

    def keep(self, cache: dict, key: object, value: object, size: int) -> None:
        """Remember a result; both caches start anew when they would hold more than CACHE_BYTES."""
        if self.held + size > CACHE_BYTES:
            self.cache.clear()
            self.ranked.clear()
            self.held = 0
        if size <= CACHE_BYTES:
            cache[key] = value
            self.held += size

    def parts(self, text: str) -> list[str]:
        """Parts of a text; a U+2581 of its own stands as the empty part."""
        if SPACE not in text:
            return self.splitter.findall(SPACE + text.replace(" ", SPACE))
        out: list[str] = []
        for i, piece in enumerate(text.split(SPACE)):
            if i:
                out.append("")
            out += self.splitter.findall((SPACE if not i else "") + piece.replace(" ", SPACE))
        return out

    def encode(self, text: str, n: int) -> tuple[np.ndarray, float, list[dict]]:
        """Ids and score of the best segmentation, and the others as changes to it."""
        if not text:
            return np.zeros(0, np.int32), 0.0, []
        names = self.parts(text)
        own = (np.array([self.byte_ids[b] for b in SPACE.encode()], np.int32).tobytes(), self.unknown, INF)
        cache = self.cache
        parts = list(map(cache.get, names))
        if None in parts:
            parts = [found or cache.get(p) or (self.part(p) if p else own) for p, found in zip(names, parts, strict=True)]
        coded, scores, lost = zip(*parts, strict=True)
        ids = np.frombuffer(b"".join(coded), np.int32)
        score = math.fsum(scores)
        if n < 2:
            return ids, score, []
        losses = np.array(lost)
        few = min(n - 1, len(losses))
        open_at = np.sort(np.argsort(losses, kind="stable")[:few]) if len(losses) <= 64 else self._smallest(losses, few)
        open_at = [int(i) for i in open_at if losses[i] < INF]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts = np.cumsum(sizes) - sizes
        choices = [self.n_best(names[i], n) for i in open_at]
        best = [c[0][0] for c in choices]
        queue: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(choices))]
        others: list[dict] = []
        while queue and len(others) < n:
            lost, taken = heapq.heappop(queue)
            others.append(
                {
                    "score": score - lost,
                    "changes": [
                        {"at": int(starts[i]), "n": int(sizes[i]), "ids": choices[j][t][1]}
                        for j, (i, t) in enumerate(zip(open_at, taken, strict=True))
                        if t
                    ],
                }
            )
            last = max((j for j, t in enumerate(taken) if t), default=0)
            for j in range(last, len(taken)):
                if taken[j] + 1 < len(choices[j]):
                    more = (*taken[:j], taken[j] + 1, *taken[j + 1 :])
                    total = math.fsum(best[x] - choices[x][t][0] for x, t in enumerate(more))
                    heapq.heappush(queue, (total, more))
        return ids, score, others[1:]

    @staticmethod
    def _smallest(losses: np.ndarray, few: int) -> np.ndarray:
        cut = np.partition(losses, few - 1)[few - 1]
        below = np.flatnonzero(losses < cut)
        return np.sort(np.concatenate([below, np.flatnonzero(losses == cut)[: few - len(below)]]))

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def changed(ids: list[int], changes: list[dict]) -> list[int]:
    """The ids of an alternative: the best ids with its changes made."""
    out, at = [], 0
    for c in sorted(changes, key=lambda c: c["at"]):
        out += ids[at : c["at"]] + list(c["ids"])
        at = c["at"] + c["n"]
    return out + ids[at:]


_loaded: dict[tuple[int, str], Pieces] = {}


def _pieces(model: bytes, scoring: str) -> Pieces:
    """One vocabulary and cache for each Python worker, also over several tasks."""
    key = (hash(model), scoring)
    if key not in _loaded:
        _loaded[key] = Pieces(model, scoring)
    return _loaded[key]


def _read(spark, path: str) -> bytes:
    """The model file, by the driver; from any store Spark reads if it is not a local file."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first().content)
    with open(path, "rb") as file:
        return file.read()


ALTERNATIVES = "array<struct<score: double, changes: array<struct<at: int, n: int, ids: array<int>>>>>"


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_best: int = N_BEST,
    model_path: str | None = None,
    scoring: str = "zipf",
) -> DataFrame:
    """Each text's best ids with its score, the next best segmentations, and whether decoding gives the text back.

    Columns: the id, n_ids, ids, score, alternatives (the second to the N-th best: score and changes to the ids; see
    `changed`), round_trip.
    """
    small_batches(docs.sparkSession)
    model = _read(docs.sparkSession, model_path or default_model())

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, scoring)
        change = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
        other = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))
        for batch in chunks(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = [pieces.encode(t, n_best) for t in texts]
            counts = [len(c[0]) for c in coded]
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            flat = pa.array(np.concatenate([c[0] for c in coded]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(offsets, flat),
                    pa.array([c[1] for c in coded], pa.float64()),
                    pa.array([c[2] for c in coded], other),
                    pa.array([pieces.decode(c[0]) == t for c, t in zip(coded, texts, strict=True)], pa.bool_()),
                ],
                names=[id_col, "n_ids", "ids", "score", "alternatives", "round_trip"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_ids bigint, ids array<int>, score double, alternatives {ALTERNATIVES}, round_trip boolean"
    return rows.mapInArrow(per_batch, schema)


def decode(coded: DataFrame, ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """The rows with the `text` of their ids; null ids give null."""
    model = _read(coded.sparkSession, model_path or default_model())

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        pieces = _pieces(model, "zipf")
        return ids.map(lambda x: None if x is None else pieces.decode(np.asarray(x, np.int32)))

    return coded.withColumn("text", text_of(ids_col))
