"""License notices inside prose, over several lines, and next to many others."""

import random
import textwrap

import llm_brute as brute
import pytest

from swipeline.llm.licenses import TEMPLATES, Scanner, decides, license_scan, words_of

PROSE = (
    "it is not for you or for any of us to say that this is the way to use it and that is as it may be in the end as you are "
    "to be with it on the way from this to that and by the time that it is in use you may not be in need of any of it "
) * 2
SHORT = [("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("All rights reserved.", "All-rights-reserved"), ("Licensed under CC BY 4.0.", "CC-BY-4.0")]


@pytest.mark.parametrize("before", [0, 1])
def test_short_notice_in_a_paragraph(spark, before):
    rows = [(k, PROSE * before + notice + " " + PROSE, "s") for k, (notice, _) in enumerate(SHORT)] + [(9, PROSE + "the software", "s")]
    out = license_scan(brute.table(spark, rows)).collect()
    start = len(PROSE.split()) * before
    assert {(r.doc_id, r.license, r.start_word, r.end_word) for r in out if r.confirmed} == {(k, name, start, start + len(notice.split())) for k, (notice, name) in enumerate(SHORT)}
    assert not [r for r in out if r.doc_id == 9]


def test_changed_short_notice_in_a_paragraph(spark):
    """Too different to confirm, but still a row."""
    out = license_scan(brute.table(spark, [(1, PROSE + "released under MIT license " + PROSE, "s")])).collect()
    assert [(r.license, r.confirmed, r.missing_words, r.added_words) for r in out] == [("MIT", False, 1, 0)]


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
LONG = {"MIT": MIT, "GPL-3.0": GPL, "BSD-2-Clause OR BSD-3-Clause": BSD, "ISC": ISC, "MPL-2.0": MPL, "All-rights-reserved": "All rights reserved."}


@pytest.mark.parametrize("mark", ["", "// ", " * ", "# ", "dnl ", "REM ", "<!-- ", "> | "])
@pytest.mark.parametrize("width", [20, 72])
def test_wrapped_and_commented_notices(spark, mark, width):
    lines = {name: textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False) for name, text in LONG.items()}
    rows = [(k, "\n".join(["first line", "", *(mark + x for x in own), "", "last line"]), name) for k, (name, own) in enumerate(lines.items())]
    out = license_scan(brute.table(spark, rows)).collect()
    assert {(r.doc_id, r.license, r.block, r.end_word - r.start_word, r.missing_words, r.added_words) for r in out if r.confirmed} == {
        (k, name, 2, len(words_of(text)), 0, 0) for k, (name, text) in enumerate(LONG.items())
    }
    assert not [r for r in out if not r.confirmed]


def test_every_form_is_compared(spark):
    """A form that seven others outrank by the bytes that they save is confirmed all the same."""
    near = {f"near{k}": [" ".join(f"alpha{j} beta{j}" for j in range(30)) + f" license tail{k}"] for k in range(7)}
    forms = near | {"exact": ["alpha3 beta3 license"]}
    text = " ".join(f"alpha{j} beta{j}" for j in range(0, 30, 2)) + " alpha3 beta3 license"
    assert [r.license for r in license_scan(brute.table(spark, [(1, text, "s")]), forms).collect() if r.confirmed] == ["exact"]


def indel(want, words):
    """Words missing and added between two lists, by the longest common subsequence."""
    row = [0] * (len(words) + 1)
    for w in want:
        last, row = row, [0]
        for j, x in enumerate(words):
            row.append(last[j] + 1 if w == x else max(last[j + 1], row[j]))
    return len(want) + len(words) - 2 * row[-1]


def cheapest_ends(want, words):
    """For each end of a stretch of ``words``, the fewest words missing and added of the best stretch that ends there."""
    row = [0] * (len(words) + 1)
    for w in want:
        last, row = row, [row[0] + 1]
        for j, x in enumerate(words):
            row.append(min(last[j] if w == x else last[j + 1] + 1, last[j + 1] + 1, row[j] + 1))
    return row


def test_against_brute_force(spark):
    """Every place that a form is within its slack of has a confirmed row, and every confirmed row is such a place, of its license."""
    forms = [(name, words_of(form)) for name, own in TEMPLATES.items() for form in own]
    draw = random.Random(7)
    prose = "the software of license and copyright public terms you permission any free notice this in version".split()
    rows, planted = [], {}
    for k in range(2 * len(forms)):
        name, own = forms[k % len(forms)]
        words = list(own)
        for _ in range(0 if k < len(forms) else draw.randint(0, 2 + len(own) // 9)):
            at = draw.randrange(len(words))
            if decides(words[at]):
                continue
            words[at : at + 1] = draw.choice(([], [words[at], "foreign"], ["changed"]))
            words = words or ["changed"]
        before, after = ([draw.choice(prose) for _ in range(draw.randint(0, 12))] for _ in range(2))
        rows.append((k, " ".join([*before, *words, *after]), "s"))
        if k < len(forms):
            planted[k] = (name, len(before), len(before) + len(words))
    found = {}
    for r in license_scan(brute.table(spark, rows)).filter("confirmed").collect():
        found.setdefault(r.doc_id, []).append(r)
    for k, text, _ in rows:
        words = text.split()
        own = found.get(k, [])
        for r in own:
            costs = [(indel(form, words[r.start_word : r.end_word]), len(form)) for name, form in forms if name == r.license]
            assert any(c == r.missing_words + r.added_words <= int(0.1 * n + 1e-9) for c, n in costs), (text, r)
        for name, form in forms:
            most = int(0.1 * len(form) + 1e-9)
            for end, cost in enumerate(cheapest_ends(form, words)):
                if cost <= most:
                    assert any(r.start_word < end and r.end_word > end - (len(form) - most) for r in own), (name, end, text)
    for k, (name, start, end) in planted.items():
        assert [r.license for r in found[k] if r.start_word == start and r.end_word == end and not r.missing_words + r.added_words] == [name], (k, name, found[k])


APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
LGPL = GPL.replace("GNU General", "GNU Lesser General")


@pytest.mark.parametrize(
    "text",
    [
        "This work is licensed under the GNU General Public License, version 1.",
        GPL.replace("version 3", "version 1"),
        LGPL.replace("version 3", "version 2"),
        "This work is not licensed under the GNU General Public License, version 3.",
        "This work is no longer, and never was, licensed under the Apache License, Version 2.0.",
        "The files may not be released under the MIT License.",
        "Not all rights reserved.",
        GPL.replace("GNU General", "Affero General"),
        ISC.replace("with or without fee", "with a fee"),
        APACHE.replace("2.0 (the", "1.1 (the"),
        MIT.replace("Permission is hereby granted", "Permission is not hereby granted"),
    ],
)
def test_a_word_that_decides_is_never_confirmed(spark, text):
    for whole in (text, "Some prose first. " + text + " And more of it."):
        assert not license_scan(brute.table(spark, [(1, whole, "s")])).filter("confirmed").count()


def test_negations_of_other_clauses_do_not_matter(spark):
    texts = ["Whether you like it or not. All rights reserved.", "It is not ours; released under the MIT License.", "There is no warranty:\nlicensed under CC BY 4.0."]
    out = license_scan(brute.table(spark, [(k, t, "s") for k, t in enumerate(texts)])).filter("confirmed").collect()
    assert {(r.doc_id, r.license) for r in out} == {(0, "All-rights-reserved"), (1, "MIT"), (2, "CC-BY-4.0")}


def test_notices_without_a_trigger_word(spark):
    """Every form is found with a word changed, whatever words the change leaves."""
    rows, names = [], {}
    for name, own in TEMPLATES.items():
        for form in own:
            words = words_of(form)
            free = [k for k, w in enumerate(words) if not decides(w)]
            if len(words) >= 20:
                for k in free[:: max(1, len(free) // 4)]:
                    names[len(rows)] = name
                    rows.append((len(rows), " ".join([*words[:k], "program", *words[k + 1 :]]), "s"))
    found = {}
    for r in license_scan(brute.table(spark, rows)).filter("confirmed").collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert all(names[k] in found.get(k, ()) for k in names)
    spotter = Scanner(TEMPLATES, 3, 0.1)
    assert spotter.spots("dnl All\nDNL rights -- reserved.") and not spotter.spots("all the rights are reserved")


def test_wording_that_licenses_share(spark):
    """The two conditions of both are told apart by the third condition, or by a short form."""
    forms = TEMPLATES["BSD-2-Clause OR BSD-3-Clause"]
    opening, third = "\n".join(forms[:3]), TEMPLATES["BSD-3-Clause"][1]
    rows = [(1, opening, "s"), (2, opening + "\n" + third, "s"), (3, "Released under the BSD 2-Clause License.\n" + opening, "s"), (4, "Released under the BSD 3-Clause License.", "s")]
    got = {}
    for r in license_scan(brute.table(spark, rows)).filter("confirmed").collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert got == {1: ["BSD-2-Clause OR BSD-3-Clause"] * 3, 2: ["BSD-3-Clause"] * 4, 3: ["BSD-2-Clause"] * 4, 4: ["BSD-3-Clause"]}


def test_unconfirmed_rows_hold_half_of_the_rarer_words(spark):
    rows = [(1, "the software license of the holder and its permission dialog", "s"), (2, MIT.replace("hereby granted, free of charge", "given").replace("deal in the Software without restriction", "use it"), "s")]
    out = license_scan(brute.table(spark, rows)).collect()
    assert {(r.doc_id, r.license, r.confirmed) for r in out} == {(2, "MIT", False)}
