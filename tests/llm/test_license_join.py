"""Licence scan against looking at every line and every word."""

from __future__ import annotations

import random
import re

from faultline.llm import license_join as L

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def low(text):
    return "".join(c.lower() if c in L.UPPER else c for c in text or "")


def plain(text):
    words = WORD.findall(low(text))
    spots = []
    for phrase, label in L.PHRASES.items():
        parts = phrase.split()
        spots += [(n, label) for n in range(len(words)) if words[n : n + len(parts)] == parts]
    matched = {}
    for line in low(text).split("\n"):
        own = set(WORD.findall(line))
        for label, template in L.TEMPLATES.items():
            wanted = set(template.split())
            if 5 * len(own & wanted) >= 4 * len(wanted):
                matched[label] = max(matched.get(label, 0), len(own & wanted) / len(wanted))
    starts = [n for n, _ in spots]
    return len(words), len(spots), min(starts, default=None), max(starts, default=None), sorted({x for _, x in spots}), matched


def texts():
    rnd = random.Random(2)
    out = [None, "", " \n\n ", "MIT License", "mit-license/apache\nlicense", "the MIT licensé", "general public license " * 3, "license mit license"]
    out += ["Kelvin K licence K mit license", "1mit license 2 mit license3", "word " * 60_000 + "mit license", "a\x00mit license"]
    for template in L.TEMPLATES.values():
        words = template.split()
        for share in (1.0, 0.85, 0.8, 0.75, 0.4):
            some = rnd.sample(words, round(len(words) * share))
            some += ["filler"] * rnd.choice([0, 3]) + rnd.sample(words, 2) * rnd.choice([0, 5])
            rnd.shuffle(some)
            out.append("first line\n" + " ".join(some).upper() + ".\nall rights")
    return out


def test_scan_equals_the_plain_reading(spark):
    rows = [(n, text, "x", "y") for n, text in enumerate(texts())]
    rows += [rows[3], (None, "mit license", "x", "y"), (3, "another text of id 3", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string, name1 string")
    got = sorted(
        ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, sorted(r.base), {m.label: m.contained for m in r.matched or []}) for r in L.scan(docs).collect()),
        key=repr,
    )
    assert got == sorted(((i, *plain(text)) for i, text, *_ in rows), key=repr)
    assert any(m for *_, m in got) and not all(m for *_, m in got)


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
