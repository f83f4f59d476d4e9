"""License rules: their gates let every match through."""

import itertools
import random
import time
from re import _parser as sre

import pytest

from tidemark.llm import license_rules, licenses


def labels(text):
    s = licenses.Scanner()
    return [x[3] for x in s.detections(b" " + b" ".join(text.encode().translate(licenses.WORDS).split()) + b" ")]


def wordings(tree):
    """Strings that a parsed expression matches: all choices, loops once at their least and once a little longer."""
    parts = []
    for op, arg in tree:
        if op is sre.LITERAL:
            parts.append([chr(arg)])
        elif op is sre.NOT_LITERAL:
            parts.append(["x"])
        elif op is sre.IN:
            parts.append([chr(a) for o, a in arg if o is sre.LITERAL] or ["x"])
        elif op is sre.BRANCH:
            parts.append([w for t in arg[1] for w in wordings(t)])
        elif op is sre.SUBPATTERN:
            parts.append(wordings(arg[3]))
        elif op is sre.MAX_REPEAT:
            least, most, inner = arg
            parts.append([w * n for n in sorted({least, min(most, least + 1)}) for w in wordings(inner)])
        else:
            raise AssertionError(op)
    return ["".join(p) for p in itertools.product(*parts)]


def test_gates_pass_every_match():
    for label, _, keyword, expression in license_rules.RULES:
        for words in wordings(sre.parse(expression)):
            assert f" {keyword}" in f" {words} ", (label, keyword, words)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Creative Commons Attribution-NonCommercial 4.0 International", "cc-by-nc-4.0"),
        ("Creative Commons Attribution-NonCommercial 3.0 Unported", "cc-by-nc-3.0"),
        ("Creative Commons Attribution-NoDerivatives 4.0 International", "cc-by-nd-4.0"),
        ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "cc-by-nc-nd-4.0"),
        ("CreativeML Open RAIL-M License", "openrail"),
        ("BigScience OpenRAIL-M License", "openrail"),
    ],
)
def test_official_names(text, label):
    assert labels(text) == [label]


def test_classpath_headers():
    header = "redistribute it and/or modify it under the terms of the GNU General Public License version 2 only, as published by the Free Software Foundation. {} designates this particular file as subject to the \"Classpath\" exception as provided by {}"
    for name in ("Oracle", "Sun", "Société Générale"):
        assert "gpl-2.0-classpath" in labels(header.format(name, name))
    assert "gpl-2.0-classpath" in labels("GPLv2 with Classpath exception")
    assert "gpl-2.0-classpath" not in labels("GPL " + "word " * 40 + "classpath exception")


def test_repeats_are_found_side_by_side():
    affero = "GNU Affero General Public License version 3 "
    for n in (1, 2, 5):
        assert labels(affero * n) == ["agpl-3.0"] * n
    s = licenses.Scanner()
    one, two = (s.scan((affero * n).encode()) for n in (1, 2))
    assert one[5] == two[5] == "agpl-3.0" and one[6] == pytest.approx(0.9) and two[6] == pytest.approx(0.99)


def test_suppression_is_that_of_all_pairs():
    rng = random.Random(4)
    parts = ["gnu", "affero", "lesser", "general public license", "version 3", "version 2", "or at your option any later version", "cc by", "nc", "sa", "4 0", "apache license", "version 2 0", "x"]
    s = licenses.Scanner()
    for _ in range(300):
        line = (" " + " ".join(rng.choice(parts) for _ in range(rng.randrange(40))) + " ").encode()
        found = sorted((-p, m.start() - m.end(), m.start(), m.end(), label) for keyword, rules in s.rules.items() if keyword in line for p, label, rx in rules for m in rx.finditer(line))
        kept = []
        for p, _, a, b, label in found:
            if not any(c <= a and b <= d for _, c, d, _ in kept):
                kept.append((-p, a, b, label))
        assert s.detections(line) == kept


def test_long_texts_take_time_in_proportion():
    s = licenses.Scanner()
    text = b"GNU Lesser General Public License version 2.1, CC BY-NC-SA 4.0 and the MIT License; "
    took = []
    for size in (500_000, 5_000_000):
        start = time.process_time()
        s.scan(text * (size // len(text)))
        took.append(time.process_time() - start)
    assert took[1] < 25 * max(took[0], 0.05)
