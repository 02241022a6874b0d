"""LM scoring by subword lattice likelihood.

A text is a row of words, each a path through a lattice of the pieces of a public vocabulary. A piece has a
probability; a word's probability is the sum over all its segmentations, by a forward recursion in log space, and a
document's that of its words and one end. As no piece spans a word boundary, this product is the marginal over all
segmentations of the whole text. The vocabulary's own scores (its order) give the first piece probabilities; rounds
of expectation maximisation over the training documents' word counts re-estimate them, so what is learned covers
every training document and grows with them. The probabilities of pieces, bytes and end sum to one.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, crc_of, crc_text, read

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Words whose counts go to every worker: a bound on what is broadcast; all other words are joined.
HOT_WORDS = 1 << 17
ROUNDS = 2
#: Added to each piece's expected count, so that none has probability 0.
PRIOR = 0.05
START = "▁"
LOG10 = math.log(10)

_state: dict = {}


def pieces(model: str = MODEL) -> tuple[dict[str, int], int]:
    """Ids of the vocabulary's pieces that lie within a word (its start mark included), -1 for other beginnings of
    pieces; and the number of pieces. The ids of 256 bytes and of the end follow."""
    if model not in _state:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        texts = [t for t in texts if START not in t[1:]]
        table = dict.fromkeys((t[:k] for t in texts for k in range(1, len(t) + 1)), -1)
        _state[model] = table | {t: k for k, t in enumerate(texts)}, len(texts)
    return _state[model]


def first_scores(model: str = MODEL) -> np.ndarray:
    """Natural log probabilities from the vocabulary's order: an id's weight falls as its rank rises."""
    _, n = pieces(model)
    w = np.concatenate([1.0 / (np.arange(n) + 100.0), np.full(256, 1e-7), [1e-3]])
    return np.log(w / w.sum())


def arcs(word: bytes, model: str = MODEL) -> list[tuple[int, int, int | tuple]]:
    """(from, to, piece id, or ids of a character's bytes) of the lattice, ordered by from. Invalid bytes stand for themselves."""
    table, n = pieces(model)
    get = table.get
    text = START + word.decode("utf-8", "surrogateescape")
    size = len(text)
    out = []
    for i in range(size):
        if get(text[i], -1) < 0:
            out.append((i, i + 1, tuple([n + b for b in text[i].encode("utf-8", "surrogateescape")])))
        j = i + 1
        while j <= size:
            k = get(text[i:j])
            if k is None:
                break
            if k >= 0:
                out.append((i, j, k))
            j += 1
    return out


def forward(word: bytes, logp: list[float], model: str = MODEL) -> float:
    """Natural log of the word's probability over all segmentations."""
    table, n = pieces(model)
    get, exp, log = table.get, math.exp, math.log
    text = START + word.decode("utf-8", "surrogateescape")
    size = len(text)
    into: list[list[float]] = [[] for _ in range(size + 1)]
    into[0] = [0.0]
    for i in range(size + 1):
        x = into[i]
        alpha = x[0]
        if len(x) > 1:
            alpha = max(x)
            alpha += log(sum([exp(v - alpha) for v in x]))
        if i == size:
            return alpha
        if get(text[i], -1) < 0:
            into[i + 1].append(alpha + sum([logp[n + b] for b in text[i].encode("utf-8", "surrogateescape")]))
        j = i + 1
        while j <= size:
            k = get(text[i:j])
            if k is None:
                break
            if k >= 0:
                into[j].append(alpha + logp[k])
            j += 1
    raise AssertionError("every word has a path")


def _log_sum(x: list[float]) -> float:
    if len(x) == 1:
        return x[0]
    top = max(x)
    return top + math.log(sum([math.exp(v - top) for v in x]))


def expect(word: bytes, weight: float, prob: list[float], logp: list[float], into: list[float], model: str = MODEL) -> None:
    """Adds ``weight`` times the expected uses of each piece in the word, by forward and backward sums of
    probabilities, or of their logarithms where a long word's would vanish."""
    lattice = arcs(word, model)
    size = lattice[-1][1] + 1
    alpha, beta = [0.0] * size, [0.0] * size
    alpha[0] = beta[-1] = 1.0
    cost = []
    for i, j, k in lattice:
        c = prob[k] if type(k) is int else math.prod([prob[x] for x in k])
        cost.append(c)
        alpha[j] += alpha[i] * c
    total = alpha[-1]
    if total < 1e-250:
        _expect_logs(lattice, weight, logp, into)
        return
    for x in range(len(lattice) - 1, -1, -1):
        i, j, k = lattice[x]
        b = beta[j] * cost[x]
        if b:
            beta[i] += b
            p = weight * alpha[i] * b / total
            if type(k) is int:
                into[k] += p
            else:
                for y in k:
                    into[y] += p


def _expect_logs(lattice: list, weight: float, logp: list[float], into: list[float]) -> None:
    cost = [logp[k] if type(k) is int else sum(logp[x] for x in k) for _, _, k in lattice]
    size = lattice[-1][1] + 1
    inc: list[list[float]] = [[] for _ in range(size)]
    alpha = [0.0] * size
    at = 0
    for (i, j, _), c in zip(lattice, cost):
        if i != at:
            at, alpha[i] = i, _log_sum(inc[i])
        inc[j].append(alpha[i] + c)
    total = _log_sum(inc[size - 1])
    back: list[list[float]] = [[] for _ in range(size)]
    beta = [0.0] * size
    at = size - 1
    for x in range(len(lattice) - 1, -1, -1):
        i, j, k = lattice[x]
        if not back[j] and j != size - 1:
            continue
        if j != size - 1:
            beta[j] = _log_sum(back[j])
        back[i].append(beta[j] + cost[x])
    for (i, j, k), c in zip(lattice, cost):
        if j != size - 1 and not back[j]:
            continue
        p = weight * math.exp(alpha[i] + c + beta[j] - total)
        if type(k) is int:
            into[k] += p
        else:
            for y in k:
                into[y] += p


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _count(batches):
    """Word counts of training documents, and the words of all; the empty word stands for the end."""
    out: dict[bytes, int] = {}

    def full():
        return pa.RecordBatch.from_arrays([pa.array(list(out.keys()), pa.binary()), pa.array(list(out.values()), pa.int64())], names=["word", "c"])

    for b in batches:
        for text, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            one, get = (0 if held else 1), out.get
            for w in _words(text):
                out[w] = get(w, 0) + one
            out[b""] = get(b"", 0) + one
            if len(out) > 250_000:
                yield full()
                out.clear()
    if out:
        yield full()


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word binary, c long): training count of every word of all documents, and of the end as the empty word."""
    return docs.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn(words: DataFrame, model: str = MODEL, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (natural logs) from counted words. Only sums over the fixed vocabulary reach the driver."""
    logp = first_scores(model)
    spark = words.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logp)

        def run(batches, sent=sent):
            logp, prob, total = sent.value.tolist(), np.exp(sent.value).tolist(), [0.0] * len(sent.value)
            for b in batches:
                for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if w:
                        expect(w, c, prob, logp, total, model)
                    else:
                        total[-1] += c
            total = np.array(total)
            k = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["k", "x"])

        rows = words.where("c > 0").select("word", "c").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        got = np.full(len(logp), PRIOR)
        for r in rows:
            got[r["k"]] += r["x"]
        logp = np.log(got / got.sum())
    return logp


def score(docs: DataFrame, held: F.Column, ws: Workspace, model: str = MODEL, rounds: int = ROUNDS) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text); rows where ``held`` is true are not learned from.

    Null text counts as empty: its one token is the end. Very long words and texts are whole; repeated rows are
    scored each; an empty table gives no rows; columns other than these two are ignored. With no training rows the
    vocabulary's own scores hold. Words outside the hot ones (a fixed number, by count) are joined by a shuffle, in
    which none is frequent by construction.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    words = ws.put(count_words(docs.select("text", "held")), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    logp = learn(words, model, rounds)
    sent = spark.sparkContext.broadcast(logp)
    tail = math.log10(n + 0.1 * (v + 1)) if n or v else 0.0

    def rate(batches):
        logp = sent.value.tolist()
        for b in batches:
            s = [(forward(w, logp, model) if w else logp[-1]) / LOG10 for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=["word", "c", "lp"])

    rated = ws.put(words.select("word", "c").mapInArrow(rate, "word binary, c long, lp double"), "rated")
    hot = spark.sparkContext.broadcast([tuple(r) for r in rated.orderBy(F.desc("c"), "word").limit(HOT_WORDS).collect()])

    def first(batches):
        if _state.get("hot") is not hot:
            rows = hot.value
            c = np.array([r[1] for r in rows] or [0], float)
            _state.update(hot=hot, at={bytes(r[0]): k for k, r in enumerate(rows)}, table=np.stack([c > 0, np.log10(c + 0.1) - tail, np.array([r[2] for r in rows] or [0.0])], 1))
        at, table = _state["at"], _state["table"]
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                w = _words(text) + [b""]
                k = np.fromiter(map(at.get, w, repeat(-1)), np.int64, len(w))
                known, base, lp = table[k[k >= 0]].sum(0).tolist()
                out.append((len(w), int(known), base, lp, [w[x] for x in np.nonzero(k < 0)[0]]))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "held", "n_tokens", "known", "base", "lp", "rest"])

    schema = "doc_id long, held boolean, n_tokens long, known long, base double, lp double, rest array<binary>"
    part = ws.put(docs.select(F.col("doc_id").cast("long"), "text", "held").mapInArrow(first, schema).withColumn("row", F.monotonically_increasing_id()), "part")
    rest = part.select("row", F.explode("rest").alias("word")).groupBy("row", "word").count()
    rest = rest.join(rated, "word").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("count")).otherwise(0)).alias("known2"), F.sum(F.col("count") * (F.log10(F.col("c") + 0.1) - tail)).alias("base2"), F.sum(F.col("count") * F.col("lp")).alias("lp2"))
    zero = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return part.drop("rest").join(rest, "row", "left").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", zero("known", "known2").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), zero("base", "base2").alias("base_score"), zero("lp", "lp2").alias("score")
    )


def op1_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, crc_text("doc_id") % 10 == 0, Workspace(spark, "op1"))


__all__ = ["op1_lattice_score", "score", "learn", "forward", "crc_of"]
