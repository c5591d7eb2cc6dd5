"""What keeps the comparison of every whole text within its cost, and what it must not change."""

import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer, decoders

from symweave.llm import parts
from symweave.llm import sentencepiece_backend as S


def test_different_parts_are_encoded_once_over_batches(monkeypatch):
    path, calls, encode = S.model_path(None), [], S.Backend.encode_batch
    monkeypatch.setattr(S.Backend, "encode_batch", lambda self, texts: calls.extend(texts) or encode(self, texts))
    texts = [f"word{i} and word{i + 1} again" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    got = [r for b in S._encoded(iter([batch] * 4), path) for r in b.to_pylist()]
    words = [w for run in calls for w in run.split(" ")]
    assert len(words) == len(set(words)) == 303
    expected = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts * 4)
    assert [r["ids"] for r in got] == expected and all(r["parity"] for r in got) and [r["text"] for r in got] == texts * 4


def test_joined_batches_are_bounded():
    batches = [pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array(["x" * n])], ["doc_id", "text"]) for n in (10, 20, 5000, 900, 1, 2)]
    got = list(parts.joined(iter(batches), 1000))
    assert [b["doc_id"].to_pylist() for b in got] == [[10, 20], [5000], [900, 1, 2]]
    assert list(parts.joined(iter([]))) == []


def test_marks_made_of_bytes_stay_marks(spark):
    backend = S.backend_for(S.model_path(None))
    mark = [backend.tokenizer.token_to_id(f"<0x{k:02X}>") for k in S.MARK.encode()]
    plain, check = backend.encode_batch(["the house", "  two \n spaces"]), [backend.tokenizer.token_to_id(f"<0x{k:02X}>") for k in "✓".encode()]
    ids = [plain[0], mark, plain[1], plain[0] + mark + plain[1], check, [], mark[:2] + plain[0]]
    assert backend.decode_batch(ids) == [backend.other.decode(x) if x else "" for x in ids]
    assert backend.decode_batch(ids)[1] == S.MARK
    slow = Tokenizer(backend.tokenizer.model)
    slow.decoder = decoders.Sequence([decoders.Replace(S.MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    odd = [*ids, mark[1:] + mark, mark[:1], plain[0] + mark[2:] + mark * 2]
    assert backend.decode_batch(odd) == slow.decode_batch(odd, skip_special_tokens=False)
    rows = spark.createDataFrame(list(enumerate(ids)), "doc_id int, ids array<int>")
    assert all(r.decode_parity for r in S.decode(rows).collect())
