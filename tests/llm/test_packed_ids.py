from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from symweave.llm import pattern_packing as P

from .cases import ROWS, table


def test_packed_sequences_hold_the_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [P.END] for r in ROWS)
    got = dict(corpus_pipeline.STAGES)["packing"](spark, table(spark), "").collect()
    of_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length
        of_doc[r.doc_id].append((r.piece, r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.ids))
    for own in sequences.values():
        flat = [i for _, ids in sorted(own) for i in ids]
        assert len(flat) <= P.LENGTH and all(flat[o : o + len(ids)] == ids for o, ids in own)
    single = {r[0]: r[1] for r in ROWS if r[0] not in (10, None)}
    for doc_id, text in single.items():
        ids = [i for _, _, own in sorted(of_doc[doc_id]) for i in own]
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END]
    assert sum(map(len, expected)) == sum(r.length for r in got)
