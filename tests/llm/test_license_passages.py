from __future__ import annotations

import re

import pytest

from sluice.llm.licenses import TEMPLATES, THRESHOLD, passages

from helpers import awkward, frame, prose


def norm(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.sub(r"(?:[^\w.]|_|(?<![0-9])\.|\.(?![0-9]))+", " ", text).split()


def grams(words):
    return {" ".join(p) for p in zip(words, words[1:], strict=False)} or set(words)


def brute(rows, templates):
    """All stretches of words, best first, those that overlap one taken left out."""
    out = set()
    for i, text in rows:
        words = norm(text)
        for name, template in templates.items():
            own, scored = grams(norm(template)), []
            for a in range(len(words)):
                for b in range(a, len(words)):
                    g = grams(words[a : b + 1])
                    dice = 2 * len(g & own) / (len(g) + len(own))
                    if dice >= THRESHOLD:
                        scored.append((-dice, b - a, a + 1, b + 1))
            taken = []
            for s in sorted(scored):
                if all(t[3] < s[2] or s[3] < t[2] for t in taken):
                    taken.append(s)
            out |= {(i, name, t[2], t[3], round(-t[0], 9)) for t in taken}
    return out


def cut(text, *starts):
    """The text in paragraphs that begin at the given words, wrapped to lines of ten words."""
    for s in starts:
        assert s in text
        text = text.replace(s, "\n\n" + s)
    return "\n\n".join("\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10)) for w in map(str.split, text.split("\n\n")))


USUAL = {
    "MIT": cut(TEMPLATES["MIT"], "The above copyright", "THE SOFTWARE IS"),
    "GPL-3.0-header": cut(TEMPLATES["GPL-3.0-header"], "This program is distributed"),
    "Apache-2.0-header": cut(TEMPLATES["Apache-2.0-header"], "You may obtain", "http://www", "Unless required"),
}


@pytest.mark.parametrize("name", USUAL)
def test_usual_layouts(spark, name):
    commented = "\n".join("# " + x for x in USUAL[name].split("\n"))
    # Ends whose bigrams come up inside as well ("in the software" of MIT) belong to no shortest stretch.
    words = norm(TEMPLATES[name])
    spans = [(b - a, a, b) for a in range(4) for b in range(len(words) - 4, len(words) + 1) if grams(words[a:b]) == grams(words)]
    _, a, b = min(spans)
    rows = [(1, USUAL[name]), (2, f"{prose(1, 30)}\n\n{commented}\n\n{prose(2, 30)}"), (3, f"{prose(3, 200)} {TEMPLATES[name]} {prose(4, 400)}")]
    got = {(r.doc_id, r.first_word, r.last_word, r.dice) for r in passages(frame(spark, rows)).collect() if r.license == name}
    assert got == {(i, n + a + 1, n + b, 1.0) for i, n in ((1, 0), (2, 30), (3, 200))}


def test_against_all_stretches(spark):
    templates = {
        "notice": "Released under the MIT License.",
        "two": "All rights reserved.",
        "one": "Unlicense",
        "twice": "use or sell the software and use or copy the software or sell it",
    }
    text = templates["twice"]
    rows = [
        (1, f"a b\nReleased under\n\nthe MIT License. c {text} d"),
        (2, " ".join([text] * 3)),
        (3, "use or sell the software and " + "filler " * 60 + "use or copy the software or sell it"),
        (4, "released under the mit license released under the mit x license all rights reserved all rights reserved unlicense"),
        (5, "use or sell the software and use or copy " + text + " the software or sell it all rights"),
        (6, "Unlicense"),
        (7, "rights reserved all"),
        (8, text),
        (8, text),
        (8, "see unlicense unlicense"),
        (None, "all\nrights\nreserved"),
    ] + [r for r in awkward() if len(r[1] or "") < 500]
    got = passages(frame(spark, rows), templates).collect()
    expected = brute(rows, templates)
    assert {(r.doc_id, r.license, r.first_word, r.last_word, round(r.dice, 9)) for r in got} == expected
    assert len(got) == len(expected)


def test_plan_and_empty_table(spark):
    plan = passages(frame(spark, [(1, "All rights reserved")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert passages(frame(spark, [])).collect() == []
