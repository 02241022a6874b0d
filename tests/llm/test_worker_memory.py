"""What Python workers of the pipeline's stages keep."""

import pyarrow as pa

import corpus_pipeline
from tessera.llm import near_dup, packing, tokens


def test_packing_keeps_few_words_and_gives_equal_pieces():
    texts = [" ".join(f"w{97 * k + j}x" for j in range(60)) for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

    def run(most):
        tokens._encoders.clear()
        got = pa.Table.from_batches(list(packing._cut(tokens.WORD_BPE, 64, 1, most)(iter([batch]))))
        enc = tokens._encoders[tokens.WORD_BPE]
        return got, len(enc.kept) + len(enc.old)

    (few, held), (many, all_) = run(100), run(tokens.KEPT)
    tokens._encoders.clear()
    assert few.equals(many) and held < all_
    assert corpus_pipeline.WORDS < tokens.KEPT


def test_near_dedup_workers_keep_no_words_after_the_sets():
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([f"a b c {k}" for k in range(3000)])], names=["doc_id", "text"])
    signed = list(near_dup._sign(3)(iter([batch])))
    assert sum(b.num_rows for b in signed) == 3000 and max(b.num_rows for b in signed) <= 1024
    list(near_dup._sets(3)(iter([batch])))
    assert not near_dup._words
