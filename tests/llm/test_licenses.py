from __future__ import annotations

import re
import string
from pathlib import Path

import pytest

from textloom.llm import licenses as lic

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(text: str | None) -> dict:
    """Words, phrases and rules one after the other, in plain loops; every rule is tried on every text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in lic.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    joined = " " + " ".join(words) + " "
    found = [(m.start(), m.end(), r) for r in lic.rules() for m in re.finditer(r.pattern, joined)]
    found.sort(key=lambda x: (x[0], -x[1], -x[2].priority, x[2].order))
    kept = []
    for s, e, r in found:
        if not any(a <= s and b >= e and q.priority >= r.priority for a, b, q in kept):
            kept.append((s, e, r))
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {r.label for *_, r in kept})), "score": max((r.confidence for *_, r in kept), default=0.0),
    }


TEXTS = [
    "Released under the MIT License.", "under the mit license under the MIT license", "under the mitt license", "Apache License, Version 2.0, and Apache License version 2!", "cc-by-nc CC BY NC 4.0", "cc by ncé",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: BSD-3-Clause", "Copyright (c) 2020 Some One. All rights reserved.", "dedicated to the public domain",
    "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal without restriction, subject to: the above copyright notice", "LICENSE", "Mozilla Public License 2.0 or GPLv2",
    "creative commons attribution non-commercial license 4.0", "CC0 1.0 Universal", "licensed under the", "under THE mit İlicense license under the mit license", "gpl " * 300, "",
]


def test_against_brute_force(spark, documents, rows):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in lic.scan(df).collect():
        assert {k: r[k] for k in r.asDict() if k != "doc_id"} == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id][:60]
    got = {r.doc_id: r for r in lic.scan(documents).collect()}
    for r in rows:
        assert {k: got[r.doc_id][k] for k in got[r.doc_id].asDict() if k != "doc_id"} == brute(r.text)


def samples(parsed) -> list[str]:
    """Strings that a pattern matches: each alternative is in one of them, each option there in one and missing in another."""
    out = [""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                got = [chr(arg)]
            case "IN":
                got = sorted({"x" if str(o) == "NEGATE" else chr(a) if str(o) == "LITERAL" else chr(a[0]) for o, a in arg[:1]})
            case "NOT_LITERAL":
                got = ["x"]
            case "BRANCH":
                got = [x for branch in arg[1] for x in samples(branch)]
            case "SUBPATTERN":
                got = samples(arg[3])
            case "MAX_REPEAT":
                got = [x * max(1, arg[0]) for x in samples(arg[2])] + ([""] if not arg[0] else [])
            case _:
                got = [""]
        n = max(len(out), len(got))
        out = [out[i % len(out)] + got[i % len(got)] for i in range(n)]
    return out


BARE = ["Released under BSD-3-Clause.", "2-clause BSD", "FreeBSD", "0BSD", "You may redistribute it under the same terms as Perl itself.", "NASA Open Source Agreement", "MIT No Attribution"]


def test_no_rule_needs_what_the_gate_lacks(spark):
    gate = re.compile(lic.gate(lic.rules()))
    for r in lic.rules():
        keys = lic.keywords(r.pattern)
        assert keys and min(map(len, keys)) > 2, r
        for x in samples(re._parser.parse(r.pattern)):
            assert re.search(r.pattern, x + " "), (r, x)
            assert any(k in x for k in keys) and gate.search(x), (r, x)
    got = lic.scan(spark.createDataFrame(list(enumerate(BARE)), "doc_id long, text string")).collect()
    for r in got:
        assert {k: r[k] for k in r.asDict() if k != "doc_id"} == brute(BARE[r.doc_id]) and r.labels and r.score > 0


def test_keywords_of_expressions():
    assert lic.keywords("ab(?:cd|e)?fgh") == {"fgh"}
    assert lic.keywords("(?:cat|horse) [xy]") == {"cat", "horse"} and lic.keywords("x(?:ab)cd") == {"xabcd"}
    assert lic.keywords("[ab]?") == frozenset() and lic.keywords("(?:a|b?)(?:cd)+") == {"cd"}


MIT_NOTICE = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
ISC_NOTICE = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies."""
REAL = [
    (MIT_NOTICE, "mit"), (ISC_NOTICE, "isc"), ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions", "bsd-2"), ("GNU Library General Public License", "lgpl"), ("the Expat license", "mit"),
    ("you may not use this file except in compliance with the License.", "apache-2"), ("either version 2 of the License, or (at your option) any later version.", "gpl"), ("Zero-Clause BSD", "bsd-0"),
    ("It is licensed under the following conditions", "unnamed"), ("files licensed under a number of conditions", "unnamed"),
]


def test_every_rule_finds_its_texts(spark):
    """Each rule labels each of its alternatives by itself, and real notices are found."""
    given = lic.rules()
    found = [(r, x.strip()) for r in given for x in samples(re._parser.parse(r.pattern))]
    for r, x in found:
        assert "  " not in x, (r, x)
    texts = sorted({x for _, x in found}) + [t for t, _ in REAL]
    got = sorted(lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect())
    for r in got:
        assert {k: r[k] for k in r.asDict() if k != "doc_id"} == brute(texts[r.doc_id]), texts[r.doc_id]
    for r, (text, label) in zip(got[-len(REAL) :], REAL, strict=True):
        assert label in r.labels.split(","), (text, r.labels)


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = BSD + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
HEADERS = {
    "mit": MIT_NOTICE, "isc": ISC_NOTICE, "bsd-2": BSD, "bsd-3": BSD_3,
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: Whole texts that many systems hold, and the label that must be among theirs.
WHOLE = {"GPL-2": "gpl-2", "GPL-3": "gpl-3", "LGPL-2.1": "lgpl-2.1", "LGPL-3": "lgpl-3", "Apache-2.0": "apache-2", "MPL-2.0": "mpl-2", "MPL-1.1": "mpl-1.1", "Artistic": "artistic-1", "BSD": "bsd-3", "GFDL-1.3": "fdl", "CC0-1.0": "cc0"}


def test_full_texts(spark):
    texts = list(HEADERS.items()) + [(label, f.read_text("utf-8", "replace")) for name, label in WHOLE.items() if (f := Path("/usr/share/common-licenses") / name).exists()]
    got = sorted(lic.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect())
    for r, (label, text) in zip(got, texts, strict=True):
        found = r.labels.split(",")
        assert label in found, (label, found)
        assert {k: r[k] for k in r.asDict() if k != "doc_id"} == brute(text)
        assert label != "bsd-3" or "bsd-2" not in found


def test_many_detections(spark):
    """More of them than one portion holds."""
    text = "the MIT license, " * 1000 + "cc by nc " + "x " * 300 + "GPLv3 " * 400
    assert brute(text) == {k: v for k, v in lic.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().asDict().items() if k != "doc_id"}


def test_rules_are_many_and_valid():
    given = lic.rules()
    assert len(lic.SENTENCES) > 80 and len(given) > 400 and len({r.order for r in given}) == len(given)
    for r in given:
        re.compile(r.pattern)
        assert 1 <= r.priority <= lic.PRIORITIES and 0 < r.confidence <= 1


@pytest.mark.parametrize(("text", "labels"), [(TEXTS[6], "gpl-3"), (TEXTS[7], "bsd-3"), (TEXTS[8], "proprietary"), (TEXTS[3], "apache-2"), (TEXTS[4], "cc-by-nc")])
def test_contained_detections_are_suppressed(spark, text, labels):
    assert lic.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def test_stays_in_the_jvm(documents):
    plan = lic.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_odd_rows(crowded, odd, empty):
    got = lic.scan(crowded).collect()
    assert len(got) == odd.count() and lic.scan(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].labels, by[1].score, by[1].first_word) == (0, "", 0.0, None)
    assert by[4].n_words == 30_001 and by[7].n_words == 1
