"""Notices with a reworded opening are found like those reworded elsewhere."""

import random
import time

import pytest

from kindred.llm import licences


@pytest.mark.parametrize("text, name", [
    ("Our software is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Some words before. Our software is licensed under the GNU Affero General Public License, version 3. And after.", "AGPL-3.0"),
    ("Free permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "MIT"),
])
def test_reworded_openings(text, name):
    assert [f[0] for f in licences.findings(text, licences.TemplateSet())] == [name]


def test_too_many_differences_stay_out():
    assert licences.findings("Our own new software is under some public license, version 3.", licences.TemplateSet()) == []


def brute(text, templates, tolerance=0.2):
    """Every template at every place, by the plain recurrence; the longest of the exact ones first, then any that fits."""
    words = licences._words(text)
    fits = []
    for (name, t), own in zip(templates.templates, templates.words):
        row = [(0, -j) for j in range(len(words) + 1)]
        for i, w in enumerate(own, 1):
            new = [(i, 0)]
            for j, v in enumerate(words, 1):
                new.append(min((row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1]), *([row[j - 1]] if v == w else [])))
            row = new
        fits += [(len(own) - 3 * c, name, -b, j) for j, (c, b) in enumerate(row) if c <= tolerance * len(own) and all(x in words[-b:j] for x in own if any(y.isdigit() for y in x))]
    out, taken = [], []
    for _, name, first, end in sorted(fits, key=lambda f: -f[0]):
        if all(end <= a or first >= b for a, b in taken):
            taken.append((first, end))
            out.append((first, name))
    return [name for _, name in sorted(out)]


def test_notices_like_brute_force():
    r, templates = random.Random(3), licences.TemplateSet()
    for _ in range(25):
        parts = []
        for name, t in r.sample(licences.TEMPLATES, 2):
            words = t.split()
            for _ in range(r.randint(0, max(0, int(0.12 * len(words)) - 1))):  # reworded here and there, but not the numbers
                k = r.randrange(len(words))
                if not any(c.isdigit() for c in words[k]) and not licences._CUE.search(words[k].lower().encode()):
                    words[k : k + 1] = r.choice([[], [f"new{r.randrange(99)}x"], [words[k], "so"]])
            parts.append(" ".join(f"w{r.randrange(500)}" for _ in range(60)) + "\n" + " ".join(words))
        text = " ".join(parts) + " and no more of it"
        assert [f[0] for f in licences.findings(text, templates)] == brute(text, templates), text


def test_whole_texts_and_their_first_sentences():
    templates = licences.TemplateSet()
    for name, text in licences.TEMPLATES:
        assert [(f[0], f[1], f[5:]) for f in licences.findings(f"some words {text} more words", templates)] == [(name, text, (0, 0))]


def test_a_megabyte_of_notices_and_odd_rows(spark):
    notice = "Released under the MIT License. "
    began = time.monotonic()
    assert len(licences.findings(notice * 33_000, licences.TemplateSet())) == 33_000
    assert time.monotonic() - began < 60
    rows = [(None, notice), (1, notice), (1, notice), (2, None), (3, ""), (4, notice * 2)]
    got = licences.license_findings(spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, missing string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.license, r.start) for r in got) == [(False, 1, "MIT", 0), (False, 1, "MIT", 0), (False, 4, "MIT", 0), (False, 4, "MIT", 32), (True, 0, "MIT", 0)]
