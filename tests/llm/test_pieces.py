from __future__ import annotations

import itertools
import random
import struct

import numpy as np
import pytest

from sluice.llm.pieces import Pieces, changed, decode, default_model, encode

from helpers import awkward, frame


def varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data):
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(data, at)
            value = data[at : at + size]
            at += size
        yield number, kind, value


def coded(x):
    out = b""
    while True:
        x, low = x >> 7, x & 127
        out += bytes([low | (128 if x else 0)])
        if not x:
            return out


def put(number, kind, value):
    body = coded(value) if kind == 0 else coded(len(value)) + value if kind == 2 else value
    return coded(number << 3 | kind) + body


@pytest.fixture(scope="module")
def pieces():
    with open(default_model(), "rb") as file:
        return Pieces(file.read())


@pytest.fixture(scope="module")
def library(pieces):
    """The public library on the same pieces, told to search them as a unigram model with our scores."""
    from sentencepiece import SentencePieceProcessor

    model = b""
    for number, kind, value in fields(pieces.model):
        if number == 1:
            parts = list(fields(value))
            name = next(v for n, _, v in parts if n == 1).decode()
            known = pieces.pieces.get(name)
            value = b"".join(put(n, k, struct.pack("<f", known[1]) if n == 2 and known else v) for n, k, v in parts)
        elif number == 2:
            value = b"".join(put(n, k, 1 if n == 3 else v) for n, k, v in fields(value))
        model += put(number, kind, value)
    return SentencePieceProcessor(model_proto=model)


def score(pieces, ids):
    scores, total, run = dict(pieces.pieces.values()), 0.0, b""
    values = {i: b for b, i in pieces.byte_ids.items()}
    for i in [*ids, None]:
        if i in values:
            run += bytes([values[i]])
            continue
        total += pieces.unknown * len(run.decode())
        run = b""
        total += 0 if i is None else scores[i]
    return total


def test_n_best_scores_are_those_of_the_library(pieces, library):
    rng = random.Random(4)
    texts = ["Hello world", "a  b   c", "in the, of\nthe 12!! %%%", "x² ½ é漢"]
    texts += [" ".join("".join(rng.choice("aeinrstho,.") for _ in range(rng.randrange(1, 9))) for _ in range(6)) for _ in range(40)]
    for text in texts:
        ids, best, others = pieces.encode(text, 4)
        ours = [best] + [o["score"] for o in others]
        theirs = [score(pieces, x) for x in library.nbest_encode(text, nbest_size=4, out_type=int)]
        assert np.allclose(ours, theirs, rtol=1e-5), text
        alternatives = [changed(ids.tolist(), o["changes"]) for o in others]
        assert np.allclose([score(pieces, a) for a in alternatives], ours[1:])
        assert len({tuple(a) for a in [ids.tolist(), *alternatives]}) == len(ours)
        assert all(pieces.decode(np.array(a)) == text for a in alternatives)


def test_n_best_against_all_segmentations(pieces):
    for text in ("the▁of"[:3], "inthe", "on, a", "zé"):
        full = "▁" + text.replace(" ", "▁")
        every = []
        for cuts in itertools.product([0, 1], repeat=len(full) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(full)]
            parts = [full[a:b] for a, b in zip(at, at[1:])]
            if all(p in pieces.pieces or len(p) == 1 for p in parts):
                every.append(sum(pieces.pieces[p][1] if p in pieces.pieces else pieces.unknown for p in parts))
        ids, best, others = pieces.encode(text, 6)
        assert np.allclose([best, *(o["score"] for o in others)], sorted(every, reverse=True)[:6])


def test_round_trip_and_defined_cases(spark):
    rows = awkward() + [(1, "▁ literal ▁▁ x"), (2, " leading"), (3, "trailing "), (4, "tab\tand\r\nlines\n\n"), (5, "a" * 3_000)]
    got = encode(frame(spark, rows))
    back = {}
    for r in decode(got).collect():
        back.setdefault(r.doc_id, set()).add(r.text)
        assert r.round_trip and r.n_ids == len(r.ids)
    for i, t in rows:
        assert (t or "") in back[i]
    empty = [r for r in got.collect() if r.doc_id in (900, 901)]
    assert all(r.ids == [] and r.alternatives == [] and r.score == 0 for r in empty)


def test_empty_table(spark):
    assert encode(frame(spark, [])).collect() == []


def test_the_cache_is_bounded_by_bytes(monkeypatch):
    from sluice.llm import pieces

    monkeypatch.setattr(pieces, "CACHE_BYTES", 20_000)
    small, plain = pieces.Pieces(open(pieces.default_model(), "rb").read()), pieces.Pieces(open(pieces.default_model(), "rb").read())
    monkeypatch.setattr(plain, "keep", lambda *_: None)
    for i in range(300):
        word = f"part{i % 90}" * (1 + i % 40)
        assert small.part(word) == plain.part(word) and small.n_best(word[:40], 2) == plain.n_best(word[:40], 2)
        assert small.held <= 20_000 and len(small.cache) + len(small.ranked) <= 20_000 / 320


def test_a_part_is_searched_sign_by_sign_without_cutting_it(pieces):
    def walk(nodes, before=""):
        for sign, (score, id_, more) in nodes.items():
            yield before + sign, score, id_
            yield from walk(more or {}, before + sign)

    found = {name: (score, id_) for name, score, id_ in walk(pieces.tree)}
    assert found.keys() == pieces.starts.keys()
    for name, (score, id_) in found.items():
        piece = pieces.pieces.get(name)
        assert (id_, score) == (piece or (-1, pieces.unknown if len(name) == 1 else -float("inf")))

    class Whole(str):
        def __getitem__(self, at):
            raise AssertionError("cut")

    for text in ("▁palavra", "▁zz中\U0001f600q", "x"):
        best, back, last, loss = pieces.forward(Whole(text))
        assert best == pieces.lattice(text)[0]
        end, ids = len(text), []
        while end:
            ids[:0] = [last[end]] if last[end] >= 0 else pieces.units_of(text[back[end] : end])
            end = back[end]
        assert ids == np.frombuffer(pieces.part(text)[0], np.int32).tolist()
