from __future__ import annotations

import re

from sluice.llm.licenses import TEMPLATES, THRESHOLD, scan

from helpers import awkward, frame, prose


def grams(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    plain = re.sub(r"(?:[^\w.]|_|(?<![0-9])\.|\.(?![0-9]))+", " ", text).split()
    return {" ".join(p) for p in zip(plain, plain[1:], strict=False)} or {" ".join(plain)} - {""}


def units(text):
    for i, line in enumerate((text or "").split("\n")):
        yield "line", i + 1, line
    for i, part in enumerate(re.split(r"\n(?:[ \t\r]*\n)+", text or "")):
        if "\n" in part.strip("\n"):
            yield "paragraph", i + 1, part


def brute(rows):
    out = set()
    templates = {k: grams(v) for k, v in TEMPLATES.items()}
    for i, text in rows:
        for unit, nth, part in units(text):
            own = grams(part)
            scored = [(-2 * len(own & t) / (len(own) + len(t)), k) for k, t in templates.items() if own]
            if scored and -min(scored)[0] >= THRESHOLD:
                out.add((i, unit, nth, min(scored)[1], round(-min(scored)[0], 9)))
    return out


def rows():
    mit = TEMPLATES["MIT"].split()
    wrapped = "\n".join(" ".join(mit[i : i + 12]) for i in range(0, len(mit), 12))
    return awkward() + [
        (1, f"{prose(1, 40)}\nReleased under the MIT License.\n{prose(2, 40)}"),
        (2, "This work is licensed under the GNU General Public License; version 3!\n\n\n" + prose(3, 60)),
        (3, f"Copyright me\n\n{wrapped}\n\n{prose(4, 30)}"),
        (4, "licensed under cc by-nc 4.0\nLicensed under CC BY 4.0"),
        (5, TEMPLATES["MIT"] + " " + prose(5, 400)),
        (6, "The License is nice"),
        (7, TEMPLATES["ISC"]),
        (7, TEMPLATES["ISC"]),
        (None, "All rights reserved."),
    ]


def test_against_plain_comparison(spark):
    got = scan(frame(spark, rows())).collect()
    assert {(r.doc_id, r.unit, r.nth, r.license, round(r.dice, 9)) for r in got} == brute(rows())
    assert len(got) == len(brute(rows()))
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 7, None}


def test_no_python_in_the_plan(spark):
    plan = scan(frame(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty_table(spark):
    assert scan(frame(spark, [])).collect() == []


def test_any_two_thirds_of_a_template_hold_a_word_of_the_signature(spark):
    import random

    from sluice.llm.licenses import signature, template_grams

    rows = template_grams(spark, TEMPLATES).collect()
    reach = (2 - THRESHOLD) / THRESHOLD
    words = set(signature(rows, reach))
    assert len(words) < 60
    rng = random.Random(1)
    for name in TEMPLATES:
        own = [set(r.gram.split(" ")) for r in rows if r.license == name]
        hit = lambda g: any(w in x for w in words for x in g)
        covered = sum(map(hit, own))
        assert covered > len(own) * (1 - 1 / reach)
        least = -(-len(own) * 2 // 3)
        for _ in range(20):
            assert any(map(hit, rng.sample(own, least)))
