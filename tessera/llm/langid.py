"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's script (from the code point ranges of its letters) leaves only the languages whose training words used that
script. Each language gives the word a score, the mean log probability of its character trigrams (with start and end
marks) under the language's smoothed counts, times the word's weight. A Viterbi pass over the words of a text, with a
penalty for every switch, labels each word; neighbouring words of one label form a span. The text's language is the
label with the most letters, its score that label's share of all letters.
"""

from __future__ import annotations

import bisect
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_text, give_back, read, remembers, ship, take_over

#: Labelled rows that the classifier is fitted on: at most so many of each language, chosen by a hash of doc_id.
TRAIN_PER_LANG = 1500
SWITCH = 6.0
#: The most that a single word can count, in natural log units, against the best language for it.
WORD_MOST = 4.0
ADD = 0.1
#: Bytes of words and their scores that a worker keeps at most; cells of word and language that the recursion holds, unless
#: a single text has more; rows of a batch at a time.
KEPT = 48 << 20
CELLS = 2_000_000
ROWS = 1024
WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*")

#: First code points of script ranges.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]
_KINDS = sorted({k for _, k in SCRIPTS})


def script(word: str) -> int:
    return _KINDS.index(SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1])


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the features of words (character trigrams with marks at start and end; the whole word, if short), and the
    number of the word that each belongs to. A trigram's key is its three code points side by side, below 2^63; a
    word's is a hash above that."""
    flat = np.frombuffer("".join([f"\2{w}\3" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64) + 2
    first = np.cumsum(size) - size
    who = np.repeat(np.arange(len(words)), size - 2)
    at = np.arange(len(who)) + np.repeat(first - (np.cumsum(size - 2) - (size - 2)), size - 2)
    key = (flat[at] << np.uint64(42)) | (flat[at + 1] << np.uint64(21)) | flat[at + 2]
    short = np.nonzero(size <= 10)[0]
    whole = np.array([xxhash.xxh64_intdigest(words[k].encode("utf-8", "surrogatepass")) for k in short.tolist()], np.uint64) | np.uint64(1 << 63)
    return np.concatenate([key, whole]), np.concatenate([who, short])


def _train_counts(batches):
    """(number of the language, key, is_script, count) of the training texts."""
    take_over("langid")
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            c = b.slice(k, ROWS)
            by: dict[int, dict[str, int]] = {}
            for text, lang in zip(c.column(0).to_pylist(), c.column(1).to_pylist()):
                words = by.setdefault(lang, {})
                for w in WORD.findall(text.lower()):
                    words[w] = words.get(w, 0) + 1
            for lang, words in by.items():
                if not words:
                    continue
                n = np.array(list(words.values()), np.int64)
                keys, who = grams(list(words))
                key, at = np.unique(keys, return_inverse=True)
                kinds, put = np.unique([script(w) for w in words], return_inverse=True)
                sums = np.concatenate([np.bincount(at, n[who]), np.bincount(put, n)]).astype(np.int64)
                flag = np.arange(len(sums)) >= len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sums), lang), pa.int32()), pa.array(np.concatenate([key.view(np.int64), kinds.astype(np.int64)])), pa.array(flag), pa.array(sums)], names=["lang", "key", "is_script", "n"]
                )
    give_back()


def fit(labelled: DataFrame, per_lang: int = TRAIN_PER_LANG) -> dict:
    """A model from rows (doc_id, text, lang) with neither null: about ``per_lang`` rows of each language, those with the
    smallest hash of doc_id, whole texts; every language and every trigram of theirs is kept. The sample bounds the
    model's size; no rows give a model without languages.

    The model holds counts by key and language as they are (few keys have many languages): ``at`` and ``lang`` for the
    sorted ``keys``, ``gain`` the log of a count against that of a count of 0, ``base`` the latter's log probability.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    share = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(share)
    none = np.zeros(0)
    if not langs:
        return {"langs": [], "keys": none.astype(np.uint64), "at": np.zeros(1, np.int64), "lang": none.astype(np.int32), "gain": none.astype(np.float32), "base": none, "scripts": np.zeros((len(_KINDS), 0), bool)}
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 20))
    spark = rows.sparkSession
    cuts = spark.createDataFrame([(x, k, min(1 << 20, -(-(per_lang << 20) // share[x]))) for k, x in enumerate(langs)], "lang string, no int, cut long")
    ship(spark)
    # broadcast: a row for each language, of which the model holds far more
    picked = rows.join(F.broadcast(cuts), "lang").where(h < F.col("cut")).select("text", F.col("no").alias("lang"))
    counts = picked.mapInArrow(_train_counts, "lang int, key long, is_script boolean, n long").groupBy("key", "is_script", "lang").agg(F.sum("n").alias("n")).toArrow()
    lang = counts.column("lang").to_numpy()
    key, flag, n = counts.column("key").to_numpy().view(np.uint64), counts.column("is_script").to_numpy(), counts.column("n").to_numpy().astype(float)
    scripts = np.zeros((len(_KINDS), len(langs)), bool)
    scripts[key[flag].astype(int), lang[flag]] = True
    key, lang, n = key[~flag], lang[~flag], n[~flag]
    order = np.lexsort((lang, key))
    key, lang, n = key[order], lang[order], n[order]
    keys, first = np.unique(key, return_index=True)
    total = np.bincount(lang, n, len(langs)) + ADD * (len(keys) + 1)
    return {"langs": langs, "keys": keys, "at": np.append(first, len(key)).astype(np.int64), "lang": lang, "gain": np.log((n + ADD) / ADD).astype(np.float32), "base": np.log(ADD / total), "scripts": scripts}


class Labeller:
    def __init__(self, model: dict, switch: float = SWITCH):
        self.model, self.langs, self.scripts, self.switch = model, model["langs"], model["scripts"], switch
        self.fresh()

    def fresh(self) -> None:
        self.kept: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)
        self.letters = np.zeros(0, np.int32)
        self.bytes = 0

    def raw(self, words: list[str]) -> np.ndarray:
        """Sum of the log probabilities of each word's features by language."""
        m = self.model
        keys, who = grams(words)
        at = np.minimum(np.searchsorted(m["keys"], keys), max(0, len(m["keys"]) - 1))
        seen = m["keys"][at] == keys if len(m["keys"]) else np.zeros(len(keys), bool)
        lo, hi = m["at"][at[seen]], m["at"][at[seen] + 1]
        many = hi - lo
        cell = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        flat = np.repeat(who[seen], many) * len(self.langs) + m["lang"][cell]
        out = np.bincount(flat, m["gain"][cell], len(words) * len(self.langs)).reshape(len(words), len(self.langs))
        return out + np.bincount(who, minlength=len(words))[:, None] * m["base"]

    def learn(self, new: list[str]) -> None:
        """Works out the scores of new words, once for each."""
        low = [w.lower() for w in new]
        k = self.raw(low)
        k = np.maximum(k - k.max(1, keepdims=True), -WORD_MOST)
        ok = self.scripts[[script(w) for w in low]]
        narrow = ok.any(1) & ~ok.all(1)
        k[narrow] = np.where(ok[narrow], k[narrow], -8 * WORD_MOST)
        n = len(self.kept)
        self.kept |= zip(new, range(n, n + len(new)))
        if n + len(new) > len(self.scores):  # grows by doubling
            more = max(n + len(new), 2 * n) - n
            self.scores = np.concatenate([self.scores[:n], np.zeros((more, len(self.langs)), np.float32)])
            self.letters = np.concatenate([self.letters[:n], np.zeros(more, np.int32)])
        self.scores[n : n + len(new)] = k
        self.letters[n : n + len(new)] = [sum(map(str.isalpha, w)) for w in new]
        self.bytes += sum(map(len, new)) + len(new) * (180 + 4 * len(self.langs))

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """The rows of each text's words."""
        if self.bytes > KEPT:
            self.fresh()
        out = []
        for t in texts:
            ws = WORD.findall(t) if t and self.langs else []
            k = np.fromiter(map(self.kept.get, ws, repeat(-1)), np.int32, len(ws))
            if (k < 0).any():
                new = {ws[i] for i in np.nonzero(k < 0)[0].tolist()}
                self.learn(sorted(new))
                k = np.fromiter(map(self.kept.__getitem__, ws), np.int32, len(ws))
            out.append(k)
        return out

    def labels(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its words' letters and labels. Texts of like length go through the recursion side by side."""
        rows = self.rows(texts)
        out: list = [None] * len(texts)
        order, k = sorted(range(len(texts)), key=lambda i: -len(rows[i])), 0
        while k < len(order):
            n, cells = k, 0
            while n < len(order) and (n == k or cells + len(rows[order[n]]) * max(1, len(self.langs)) <= CELLS):
                cells += len(rows[order[n]]) * max(1, len(self.langs))
                n += 1
            part = order[k:n]
            for i, path in zip(part, self._viterbi([rows[i] for i in part])):
                out[i] = self.letters[rows[i]], path
            k = n
        return out

    def _viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(r) for r in rows])
        first = np.cumsum([0, *lengths])
        flat = np.concatenate(rows)
        score = self.scores[flat]
        stay = np.ones((len(flat), len(self.langs)), bool)  # whether the best path into a label stays in it
        came = np.zeros(len(flat), np.int32)  # or comes from this label
        last = np.zeros(len(rows), np.int64)
        live, v = int((lengths > 0).sum()), None
        for t in range(int(lengths[0])):
            at = first[:live] + t
            if t:
                best = v.argmax(1)
                jump = v[np.arange(live), best][:, None] - self.switch
                keep = v >= jump
                stay[at], came[at] = keep, best
                v = np.where(keep, v, jump) + score[at]
            else:
                v = score[at]
            on = int((lengths > t + 1).sum()) if t + 1 >= lengths[live - 1] else live
            last[on:live] = v[on:].argmax(1)
            v, live = v[:on], on
        out = []
        for n in range(len(rows)):
            path, k, end = np.zeros(lengths[n], np.int32), int(last[n]), int(lengths[n])
            here = stay[first[n] : first[n + 1]]
            for t in np.nonzero(~here.all(1))[0][::-1].tolist():
                if not here[t, k]:
                    path[t:end] = k
                    k, end = int(came[first[n] + t]), t
            path[:end] = k
            out.append(path)
        return out

    def spans(self, text: str, path: np.ndarray) -> list[dict]:
        """Runs of one label: code points from the first word's start to the last one's end."""
        out: list[dict] = []
        for m, k in zip(WORD.finditer(text), path.tolist()):
            if out and out[-1]["lang"] == self.langs[k]:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end(), "lang": self.langs[k]})
        return out


_state: dict = {}
remembers("langid", _state.clear)


def _labeller(sent, switch: float) -> Labeller:
    take_over("langid")
    if _state.get("sent") is not sent:
        _state.update(sent=sent, labeller=Labeller(sent.value, switch))
    return _state["labeller"]


def label(docs: DataFrame, model: dict, spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """``docs`` (text and any other columns, kept as they are) with lang_pred, lang_score and, if asked for, lang_spans.

    Null text, text without letters and a model without languages give `und`, score 0 and no spans. Whole texts are
    read whatever their length; repeated rows get equal labels; ties go to the language that sorts first; an empty
    table gives no rows. Columns of the input that are named like a result are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "lang_score", "lang_spans")]
    docs = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        who = _labeller(sent, switch)
        for b in (c.slice(k, ROWS) for c in batches for k in range(0, c.num_rows, ROWS)):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            pred, share, parts = [], [], []
            for text, (letters, path) in zip(texts, who.labels(texts)):
                if not len(path):
                    pred.append("und"), share.append(0.0), parts.append([])
                    continue
                sums = np.bincount(path, weights=letters, minlength=len(who.langs))
                pred.append(who.langs[int(sums.argmax())]), share.append(float(sums.max() / sums.sum()))
                parts.append(who.spans(text, path) if spans else [])
            cols = [pa.array(pred, pa.string()), pa.array(share, pa.float64())] + ([pa.array(parts, kind)] if spans else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "lang_pred", "lang_score", "lang_spans"][: len(b.columns) + len(cols)])
        who.fresh()  # what later stages run beside shouldn't hold these words
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, lang_score double" + ", lang_spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.mapInArrow(run, schema)


def op8_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_text("doc_id") % 4 == 2, F.lit(False))
    model = fit(docs.where(~held))
    out = label(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), model, spans=False)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
