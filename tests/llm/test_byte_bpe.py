from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import byte_bpe
from faultline.llm.byte_bpe import Coder, read_chunk, stitch

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODER = Coder(RANKS, public_tokenizers.PATTERN)


def by_chunks(text: str, chunk: int, overlap: int) -> list[int]:
    starts = [s for s in range(0, len(text), chunk) if s == 0 or s + overlap < len(text)]
    parts = [
        read_chunk(CODER, s, text[s : s + chunk + overlap], s + chunk + overlap >= len(text)) for s in starts
    ]
    return stitch(CODER, parts).tolist()


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet=st.sampled_from("ab'lst 12.\n\t é漢😀-"), min_size=1, max_size=200),
    st.integers(10, 40),
    st.integers(4, 30),
)
def test_stitched_chunks_equal_the_whole(text, chunk, overlap):
    assert by_chunks(text, chunk, overlap) == CODER.whole(text)


@pytest.mark.parametrize("text", ["a" * 500, " " * 500, "'l" * 200, "x" * 90 + " " + "y" * 300, "1" * 77])
def test_long_pieces_are_read_across_chunks(text):
    assert by_chunks(text, 32, 8) == CODER.whole(text)


def test_rows_of_every_kind(spark):
    texts = [None, "", " ", "It's 12 o'clock\n\n  fine", "word " * 40, "é漢😀" * 60, "z" * 300, "word " * 40]
    rows = [(n, t, "x") for n, t in enumerate(texts)] + [(None, "null id", "x"), (4, "word " * 40, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=64, overlap=16)
    got = byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), tuple(CODER.whole(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4")), bytes(r.raw)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf_dir):
    from faultline.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op9_byte_bpe"](spark, sf_dir).collect()}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = CODER.whole(row.text or "")
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
