import public_tokenizers
import sentencepiece

from symweave.llm import sentencepiece_backend as B

from .cases import ROWS, table


def test_ids_are_returned_and_decoded_whole(spark):
    other = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [*(r[1] for r in ROWS), "  a  b ", "a▁b", "日本語 😀é\x00", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in B.encode(docs).collect()}
    for k, text in enumerate(texts):
        assert got[k].ids == other.encode(text or "")
        assert (got[k].parity, got[k].round_trip, got[k].decode_parity) == (True, "▁" not in (text or ""), True)
    decoded = {r.doc_id: r for r in B.decode(B.encode(docs).select("doc_id", "ids")).collect()}
    assert all(decoded[k].decoded == (t or "").replace("▁", " ") and decoded[k].decode_parity for k, t in enumerate(texts))
