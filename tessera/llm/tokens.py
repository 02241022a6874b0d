"""Token ids of whole texts by public tokenizers, as little-endian unsigned 32-bit integers.

Both tokenizers cut a text into words by a pattern and encode each word by itself, and no word reaches across a single
space or line end between other characters. So a text is split there by plain string operations, and a worker keeps the
ids of the chunks and words it has met (a bounded memory), asking the tokenizers library for new words only. Texts with
characters outside the plain set below, for which the pattern and the normaliser here are known to agree with the
library's, are encoded by the library as a whole.
"""

from __future__ import annotations

import codecs
import os
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tessera.llm.common import remembers, take_over

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Chunks and words whose ids a worker keeps at most in each of two generations: what is used again moves to the newer.
KEPT = 500_000

#: The word patterns of the two tokenizer files.
PATTERNS = {
    "byte_bpe_50k.json": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word_bpe_49k.json": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: The character that stands for each byte in byte-level vocabularies. Printable Latin-1 stands for itself,
#: the other bytes for the characters from 256 on; byte 0 is kept to stand between words, as plain texts don't hold it.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = "\0" + "".join(chr(b if b in _SELF else 256 + sum(x not in _SELF for x in range(b))) for b in range(1, 256))
#: The plain set: printable Latin-1 without no-break space and soft hyphen, tab and line ends.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])


def _plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return False


def _loose(t: str) -> bool:
    """Whether white space stands together otherwise than as two line ends between other characters, or a space ends the text."""
    return t[-1] == " " or "  " in t or "\n\n\n" in t or " \n" in t or "\n " in t or t[-2:] == "\n\n" or "\t" in t or "\r" in t


#: First characters of chunks that aren't looked up, or may not be; and one that stands in for them.
_MARKS, _ANY = ("", "\0", "\1", "\2"), "a"


class Encoder:
    """``encode_special_tokens`` is set: the strings of special tokens in a text are ordinary text, as add_special_tokens=False
    means for what stands around it."""

    def __init__(self, path: str, most: int = KEPT):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        name = os.path.basename(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.pattern, self.spaceless = regex.compile(PATTERNS[name]) if name in PATTERNS else None, name == "word_bpe_49k.json"
        self.most = most
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words of plain texts, by the library's model: what the library does once it has cut a text into words."""
        tokenize = self.model.tokenize
        mapped = codecs.charmap_decode("\0".join(words).encode(), "strict", BYTE_CHARS)[0].split("\0")
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in mapped]

    def _key(self, word: str) -> str:
        """Words are kept as chunks are: without the space before them, or with a mark if there is none. A space that
        stands in white space alone is no such space."""
        return word if self.spaceless else word[1:] if word[0] == " " and not word.isspace() else f"\0{word}"

    def _fill(self, keys: set[str]) -> None:
        """Works out what is to be kept for new keys."""
        if len(self.kept) > self.most:
            self.kept, self.old = {}, self.kept
        kept, old = self.kept, self.old
        lead = "" if self.spaceless else " "
        alone, parts = {}, {}  # keys that are one word; the words of other keys
        for k in keys:
            if k in old:
                kept[k] = old[k]
            elif k.isalpha():
                alone[k] = lead + k
            else:
                if k[-1] in ".,;:!?" and (w := k[:-1]).isalpha():
                    words, own = (lead + w, k[-1]), (w, self._key(k[-1]))
                else:
                    words = self.pattern.findall(k if self.spaceless else k[1:] if k[0] == "\0" else k if k[0] == "\n" else lead + k)
                    own = [self._key(w) for w in words]
                parts[k] = own
                for w, x in zip(words, own):
                    if x not in kept:
                        if x in old:
                            kept[x] = old[x]
                        else:
                            alone[x] = w
        if alone:
            kept.update(zip(alone, self.encode_words(list(alone.values()))))
        for k, own in parts.items():
            kept[k] = b"".join([kept[w] for w in own])

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        got = list(map(self.kept.get, chunks))
        if None in got:
            self._fill({c for c, g in zip(chunks, got) if g is None})
            kept = self.kept  # what was found before may be in the older generation now
            got = [kept[c] if g is None else g for c, g in zip(chunks, got)]
        return got

    def _apart(self, text: str) -> bytes:
        """The ids of a text that can't be cut at single spaces and line ends."""
        return b"".join(self._look_up([self._key(w) for w in self.pattern.findall(text)])) if self.pattern and _plain(text) else self.slow(text)

    def ids(self, text: str | None) -> bytes:
        """The ids of a text; null and empty texts have none."""
        return self.column(pa.array([text], pa.string()))[0].tobytes()

    def column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a string column one after another, each with ``end`` behind it if given; and where each text's begin, with the end of all.

        Arrow cuts texts into chunks and tells equal ones apart, so that each different chunk of a column is looked up once.
        """
        own = []  # of texts that are encoded by themselves; a control character, which no plain text holds, and a number stand for them
        rows = texts.to_pylist()
        for k, t in enumerate(rows):
            if t and (self.pattern is None or not _plain(t) or (not self.spaceless and _loose(t))):
                rows[k] = f"\2{len(own)}"
                own.append(self._apart(t))
        if own:
            texts = pa.array(rows, pa.string())
        if self.spaceless:  # white space only separates
            cut = pc.ascii_split_whitespace(pc.binary_join_element_wise(pc.fill_null(pc.utf8_lower(texts), ""), "\1", " "))
        else:  # a chunk goes with the space before it, or with the line end it begins with; the first has neither
            cut = pc.replace_substring(pc.binary_join_element_wise("\0", pc.fill_null(texts, ""), ""), "\n", " \n")
            cut = pc.split_pattern(pc.binary_join_element_wise(cut, "\1", " "), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        special = [k for k, w in enumerate(words) if w[:1] in _MARKS]
        values = {k: b"" if words[k] in ("", "\0") else np.array([] if end is None else [end], "<u4").tobytes() if words[k] == "\1" else own[int(words[k].strip("\0\2"))] if "\2" in words[k] else None for k in special}
        values = {k: v for k, v in values.items() if v is not None}
        for k in values:
            words[k] = _ANY
        found = self._look_up(words)
        for k, v in values.items():
            found[k] = v
        flat = pa.array(found, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] // 4
        return np.frombuffer(flat.buffers()[2], "<u4") if len(flat) else np.zeros(0, "<u4"), at[cut.offsets.to_numpy() - cut.offsets[0].as_py()]


_encoders: dict[str, Encoder] = {}
remembers("tokens", _encoders.clear)


def encoder(path: str, most: int = KEPT) -> Encoder:
    """The worker's encoder; ``most``: chunks and words that it keeps in each generation, which changes its memory, not its ids."""
    take_over("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path, most)
    _encoders[path].most = most
    return _encoders[path]


#: Rows of a batch that are worked on at once, a bound on memory beside that by bytes.
ROWS, BYTES = 1024, 8 << 20


def slices(batch: pa.RecordBatch, text: int):
    """Parts of a batch of at most ROWS rows and, unless a single text is longer, about BYTES bytes of texts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    k = 0
    while k < batch.num_rows:
        n = int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + BYTES, side="right")) - k
        n = min(max(1, n), ROWS)
        yield batch.slice(k, n)
        k += n


def encode_batches(path: str, end: int):
    """A mapInArrow function: (doc_id, text) to (doc_id, ids list<int>), with the end id after each text."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for c in slices(b, 1):
                ids, at = enc.column(c.column(1), end)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view("<i4")))], names=["doc_id", "ids"])

    return run
