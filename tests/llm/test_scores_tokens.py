"""LM scoring, the token store and packing against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import lm_score, packing, token_store, tokens
from tessera.llm.common import Workspace, crc_of, crc_text

from .conftest import SF


def brute_word(w, prob):
    table, n = lm_score.pieces()
    t = lm_score.START + w.decode()

    def go(i):
        if i == len(t):
            return 1.0
        s = sum(prob[table[t[i:j]]] * go(j) for j in range(i + 1, len(t) + 1) if table.get(t[i:j], -1) >= 0)
        if table.get(t[i], -1) < 0:
            s += math.prod(prob[n + b] for b in t[i].encode()) * go(i + 1)
        return s

    return math.log(go(0))


@pytest.mark.parametrize("w", ["hello", "straße", "日本x", "a", "thereon"])
def test_forward_sums_all_segmentations(w):
    logp = lm_score.first_scores().tolist()
    assert lm_score.forward(w.encode(), logp) == pytest.approx(brute_word(w.encode(), np.exp(logp).tolist()), rel=1e-9)


def test_probabilities_sum_to_one_and_expectations_agree():
    logp = lm_score.first_scores()
    assert np.exp(logp).sum() == pytest.approx(1)
    a, b = [0.0] * len(logp), [0.0] * len(logp)
    lm_score.expect(b"thereafter", 2, np.exp(logp).tolist(), logp.tolist(), a)
    lm_score._expect_logs(lm_score.arcs(b"thereafter"), 2, logp.tolist(), b)
    assert np.allclose(a, b)
    chars = sum(x * len(t) for t, k in lm_score.pieces()[0].items() if k >= 0 and (x := a[k]))
    assert chars == pytest.approx(2 * len("_thereafter"))


def test_score_base_and_counts(spark, odd_docs):
    got = lm_score.score(odd_docs, crc_text("doc_id") % 10 == 0, Workspace(spark, "t")).collect()
    rows = odd_docs.collect()
    words = lambda t: [w for w in (t or "").encode().lower().split()] + [b""]
    held = lambda d: d is not None and crc_of(d) % 10 == 0
    c = collections.Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id if r.doc_id is not None else -1, held(r.doc_id), len(w := words(r.text)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_rare_words_are_joined_alike(spark, odd_docs, monkeypatch):
    key = lambda rows: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    held = F.col("doc_id") == 1
    whole = key(lm_score.score(odd_docs, held, Workspace(spark, "t")).collect())
    monkeypatch.setattr(lm_score, "HOT_WORDS", 3)
    assert key(lm_score.score(odd_docs, held, Workspace(spark, "t")).collect()) == whole


def test_score_of_nothing(spark, no_docs):
    assert lm_score.score(no_docs, F.lit(False), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(spark, name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", "a  b\n\n c\t", "don't I'LL we've 12345 1.5e3", "İstanbul ﬁ é é", "x y  z", "日本 <|endoftext|> ok", "\x1c\x85 a", "  lead", "trail  ", "ÀÉÎ ŒŸ"]
    enc = tokens.Encoder(path)
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    assert enc.ids(None) == b""


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_on_random_texts(name):
    """Mixed white space, punctuation, abbreviations and the whole plain set."""
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    enc, rng = tokens.Encoder(path), random.Random(8)
    kinds = [" \n", "  \n\t\r", " \n\t'ab.", "ab Ab1'", "aé ß\n.,'", "a b c d\n  \n", tokens.PLAIN.decode("latin-1")]
    parts = ["don't", "I'LL", "we've", "12345", "1.5e3", "the", "<|endoftext|>", "ÀÉÎ", "...", "\n\n", " \n", "  ", " ", "\t", "\r\n", "日本", "\x01", "\x00"]
    texts = ["x \n", "a \n\nb", "a\n\nb", "\n\na", " a", "a ", "a\n", "a\n\n", "\n", " ", "a\n\n\nb"]
    for _ in range(100_000):
        k = rng.choice(kinds)
        texts.append("".join(rng.choice(k) for _ in range(rng.randint(0, 14))) if rng.random() < 0.6 else "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 6))))
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, w in zip(texts, want) if enc.ids(t) != w] == []


def test_store_round_trip(spark, odd_docs, tmp_path):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    path = f"file://{tmp_path}/store"
    token_store.write(docs, path)
    lib = Tokenizer.from_file(tokens.BYTE_BPE)
    lib.encode_special_tokens = True
    at = 0
    got = {r.doc_id: r for r in token_store.digest(spark, path, Workspace(spark, "t")).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert token_store.load(spark, path, [r.doc_id]).first().ids == ids
        at += len(ids)
    plan = token_store.load(spark, path, [5])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,5)" in plan or "In(doc_id" in plan


def test_store_of_nothing(spark, no_docs, tmp_path):
    token_store.write(no_docs, f"file://{tmp_path}/none")
    assert token_store.digest(spark, f"file://{tmp_path}/none", Workspace(spark, "t")).count() == 0


def optimum(items, size):
    best = len(items)
    items = sorted(items, reverse=True)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for room in {b for b in bins if b >= items[k]}:
            rest = list(bins)
            rest.remove(room)
            go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*bins, size - items[k]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 11))]
        got = packing.complete_bins(dict(collections.Counter(items)), 20)
        assert sorted(x for p, n in got for x in p * n) == sorted(items)
        assert all(sum(p) <= 20 for p, _ in got)
        assert sum(n for _, n in got) == optimum(items, 20)


def test_bin_completion_meets_the_bound_on_many():
    rng = random.Random(4)
    counts = collections.Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000))
    got = packing.complete_bins(dict(counts))
    assert sum(n for _, n in got) <= -(-sum(k * n for k, n in counts.items()) // 4096) + 1


def test_place(spark, odd_docs, no_docs):
    rows = packing.place(packing.cut(odd_docs), Workspace(spark, "t")).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= packing.SIZE
    lib = Tokenizer.from_file(tokens.WORD_BPE)
    lib.encode_special_tokens = True
    n = sum(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert sum(r.length for r in rows) == n and len(by) == -(-n // packing.SIZE)
    assert packing.place(packing.cut(no_docs), Workspace(spark, "t")).count() == 0
