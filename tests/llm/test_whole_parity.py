"""Parity is told of each text by the whole of it."""

import pyarrow as pa

from symweave.llm import sentencepiece_backend as S


def test_every_text_is_compared_as_a_whole(monkeypatch):
    backend, by_parts = S.backend_for(S.model_path(None)), S.encode_by_parts
    texts = pa.array([f"Text number {i} has its own words" for i in range(64)] + ["", " two  spaces ", "été"])
    ids, counts, parity = backend.encode(texts)
    assert parity.all() and ids.tolist() == [i for x in backend.other.encode(texts.to_pylist()) for i in x] and counts.sum() == len(ids)

    def exchanged(*a, **k):
        ids, counts, fine = by_parts(*a, **k)
        return ids[::-1].copy(), counts, fine

    monkeypatch.setattr(S, "encode_by_parts", exchanged)
    assert backend.encode(texts)[2].tolist() == [False] * 64 + [True, True, False]
    assert backend.encode(texts[:0])[2].tolist() == []
