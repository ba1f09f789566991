from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import disclosure as D

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(reversed(digits)))
            if (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == 2 and 14 <= len(digits) <= 19 and total % 10 == 0)
                or (kind == 3 and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@@..0123456789 -+()é%"), max_size=60))
def test_spans_equal_the_plain_patterns(text):
    assert D.base_spans(text) == plain(text)


def test_known_spans_and_long_runs():
    text = "mail a.b@c.example.com or 10.0.0.255, card 4111 1111 1111 1111, phone +1 (459) 555-7415 now"
    assert D.base_spans(text) == plain(text) and [k for _, k, _ in D.base_spans(text)] == [0, 1, 2, 3]
    for run in ("1" * 200_000, "a" * 200_000, "1." * 50_000, "a@" * 50_000, "+1(" * 50_000):
        D.base_spans(run)


def test_terms_that_give_an_entity_away(spark):
    odd = "alpha bravo charly delta echo foxtrot".split()
    rows = [(n, f"some filler moonraker {odd[n]} number {n} ann@x.org some other text here", "x") for n in range(6)]
    rows += [(n, f"plain text number {n} filler some other here with nobody@y{n}.org in it", "x") for n in range(10, 40)]
    rows += [(50, None, "x"), (51, "", "x"), (None, "ann@x.org é moonraker", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, base string")
    got = D.spans(docs)
    assert got.count() == len(rows)
    more = {r.doc_id: r.more for r in got.collect() if r.more}
    assert set(more) == {0, 1, 2, 3, 4, 5, None}
    for id_, text, _ in rows:
        if id_ in more:
            assert [text[s.start : s.end] for s in more[id_]] == ["moonraker"]
    clean = {r.doc_id: r.text for r in D.sanitised(docs).collect()}
    assert "moonraker" not in clean[1] and "[EMAIL]" in clean[1] and clean[50] == "" and "nobody" not in clean[12]
    assert D.spans(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from faultline.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op3_disclosure"](spark, sf_dir).collect()}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want = plain(row.text or "")
        text = ",".join(f"{D.KINDS[k]}:{a}:{b}" for a, k, b in want)
        one = got[row.doc_id]
        assert one.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [one.n_email, one.n_ip, one.n_card, one.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(text.split(",")) - {""} <= set(one.spans.split(","))
