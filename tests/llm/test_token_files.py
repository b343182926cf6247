import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockstrata.llm import queries, token_files

PATH = queries.tokenizer_file("byte_bpe_50k.json")


def _library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=900))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(values):
    v = np.array(values, np.uint32)
    data, starts = token_files.pack(v)
    assert token_files.unpack(data, starts, len(v)).tolist() == values


@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t  \u0085\x1c abcé'sΩ漢😀12!?<|")), max_size=40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_librarys_ids(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in token_files.ChunkEncoder.of(PATH).encode(texts)]
    assert got == _library(texts)


def test_query(spark, odd, none, as_dir):
    folder = as_dir(documents=odd)
    out = queries.op4_token_files(spark, folder).collect()
    rows = [(d, t or "") for d, t in ((r.doc_id, r.text) for r in odd.collect())]
    ids = dict(zip([t for _, t in rows], _library([t for _, t in rows]), strict=True))
    want = sorted((d is not None, d or 0, len(ids[t]) + 1, zlib.crc32(np.array([*ids[t], 0], "<u4").tobytes())) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert queries.op4_token_files(spark, as_dir(documents=none)).collect() == []


def test_export(spark, odd, tmp_path):
    token_files.export(token_files.files(odd, PATH, most_ids=50), str(tmp_path / "f"))
    found = [d for p in sorted((tmp_path / "f").glob("*.pfr")) for d, _ in token_files.from_file(p.read_bytes())]
    assert len(found) == 18
    with pytest.raises(ValueError):
        list(token_files.from_file(b"x" * 64))
