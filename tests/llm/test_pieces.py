import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from blockstrata.llm import pieces, queries

PATH = queries.tokenizer_file("piece_bpe_32k.model")


def _library(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [model.encode(t) for t in texts]
    return [(",".join(map(str, x)).encode(), model.decode(x)) for x in ids]


@given(st.lists(st.text(alphabet=st.sampled_from(list("   \n\t ▁abcthe é漢😀�\x00<s>/0")), max_size=40) | st.text(max_size=20), max_size=6))
@settings(max_examples=400, deadline=None)
def test_like_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    table = pieces.ChunkTable.of(PATH)
    assert not table.whole
    assert table.encode(texts) == _library(texts)


def test_query(spark, odd, none, as_dir):
    out = queries.op6_sentencepiece(spark, as_dir(documents=odd)).collect()
    want = sorted((r.doc_id or -1, len(i.split(b",")) if i else 0, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for r, (i, d) in zip(odd.collect(), _library([r.text or "" for r in odd.collect()]), strict=True))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert queries.op6_sentencepiece(spark, as_dir(documents=none)).collect() == []


def test_encode_then_decode(spark, odd):
    back = pieces.decode(pieces.encode(odd, PATH), PATH).collect()
    want = {r.text or "": d for r, (_, d) in zip(odd.collect(), _library([r.text or "" for r in odd.collect()]), strict=True)}
    assert len(back) == 18 and all(r.decoded == want[r.text or ""] for r in back)
