import re

import pytest

from tessera.llm import licenses as lic

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    w = WORD.findall((text or "").translate(LOWER))
    out = []
    for phrase, label in lic.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def brute_found(text):
    """Every rule on every text, and suppression by comparing all pairs."""
    text = text.translate(LOWER)
    found = [(r, m.start(), m.end()) for r in lic.rules() for m in re.finditer(r.pattern, text, re.S) if m.end() > m.start()]
    found.sort(key=lambda x: (-x[0].priority, x[1] - x[2], x[1], x[0].name))
    kept = []
    for r, a, b in found:
        if not any(x <= a and b <= y for _, x, y in kept):
            kept.append((r, a, b))
    return {(r.name, a, b) for r, a, b in kept}


SAMPLES = [
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: BSD-3-Clause", "mit-license and MIT  License; the MIT.License", "GNU Lesser General Public License", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "see https://www.apache.org/licenses/LICENSE-2.0 under the terms of the ISC license", "license: zlib", "the smith license", "general public licenses", "mit license" * 3, "mit license mit license", "under the terms of the Mozilla Public License, v2.0 or the Apache license 2.0", "dedicated to the public domain", "İ MIT License",
]


def test_rules():
    assert len(lic.rules()) > 500 and len({r.name for r in lic.rules()}) == len(lic.rules()) and [r.priority for r in lic.rules()] == sorted((r.priority for r in lic.rules()), reverse=True)


@pytest.mark.parametrize("text", SAMPLES)
def test_samples_against_brute_force(text):
    got = {(r.name, a, b) for r, a, b, k in lic.Scanner(lic.rules()).detect(text.encode().translate(lic._ASCII)) if k}
    assert got == brute_found(text)
    assert lic.base_places(text.encode()) == brute_base(text)


def test_labels():
    label = lambda t: {r.label for r, _, _, k in lic.Scanner(lic.rules()).detect(t.lower().encode()) if k}
    assert label(SAMPLES[0]) == {"apache"} and label(SAMPLES[1]) == {"gpl"} and label(SAMPLES[2]) == {"mit"} and label(SAMPLES[3]) == {"cc-by-nc"}
    assert label(SAMPLES[4]) == {"bsd-3-clause"} and label("the smith license") == set() and label("an ordinary text under a tree") == set()


def test_contained_intervals():
    kept = lic.Intervals()
    for a, b in ((5, 10), (0, 3), (4, 20), (20, 25)):
        assert not kept.hold(a, b)
        kept.add(a, b)
    assert kept.hold(4, 20) and kept.hold(6, 9) and not kept.hold(3, 6) and not kept.hold(19, 22)


def test_edge_rows(spark, edge, empty, docs):
    rows = lic.scan(edge.unionByName(docs, allowMissingColumns=True), to="found").select("text", "found.*").collect()
    for r in rows:
        assert (r.n_words, [(b.word, b.label) for b in r.base]) == brute_base(r.text)
        if r.text and len(r.text) < 3000:
            assert {(f.rule, f.start, f.stop) for f in r.found if f.kept} == brute_found(r.text)
    assert lic.scan(empty).count() == 0


def texts_of(parsed, r):
    """A text that a parsed pattern matches, white space of any kind."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "ANY":
            out += "x"
        elif op == "IN":
            kind, value = r.choice([x for x in arg if str(x[0]) != "NEGATE"])
            out += chr(value if str(kind) == "LITERAL" else value[0]) if str(kind) in ("LITERAL", "RANGE") else "x" if "WORD" in str(value) else r.choice(" \n\t\u2003")
        elif op == "MAX_REPEAT":
            low, high, sub = arg
            out += "".join(texts_of(sub, r) for _ in range(r.randint(low, min(high, low + 2))))
        elif op == "SUBPATTERN":
            out += texts_of(arg[3], r)
        elif op == "BRANCH":
            out += texts_of(r.choice(arg[1]), r)
    return out


def test_no_gate_loses_a_rule():
    import random
    from re import _parser

    r, scanner = random.Random(11), lic.Scanner(lic.rules())
    broken = ["under gplv3 since 2009.", "code (under gplv3).", "the terms\nof the gplv2 apply", "see terms of the gpl", "\"under\tgplv3", "conditions\nof the gpl", "provisions\tof gplv2", "released into the public\ndomain", "permission to use,\ncopy, modify, and distribute this software for any purpose"]
    made = [texts_of(_parser.parse(x.pattern), r) for x in lic.rules() for _ in range(3)]
    lost = [t for t in broken + [r.choice(("", "(", "\"", "\t")) + t for t in made] if {(x.name, a, b) for x, a, b, k in scanner.detect(t.encode()) if k} != brute_found(t)]
    assert not lost, lost
    assert all(brute_found(t) for t in broken)


def test_texts_of_licenses():
    label = lambda t: {r.label for r, _, _, k in lic.Scanner(lic.rules()).detect(t.encode().translate(lic._ASCII)) if k}
    assert label("Redistributions of source code must\n * retain the above copyright notice") == set()  # a comment's star is no white space
    assert label("Redistributions of source code must\n retain the above copyright notice") == {"bsd"}
    assert label("The origin of this software must not be misrepresented") == {"zlib"}
    assert label("You may not use this file except in compliance with\n  the License.") == {"apache"}
    assert label("The Software shall be used for Good,\tnot Evil.") == {"json"}
    assert label("as published by MongoDB, Inc.") == {"sspl"} and label("a word of the open sea, the common good and later work") == set()


def test_clashing_column_is_replaced(edge):
    out = lic.scan(edge, to="size")
    assert sorted(out.columns) == sorted(edge.columns) and out.schema["size"].dataType.typeName() == "struct"
