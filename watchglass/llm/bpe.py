"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

The Aho-Corasick automaton of all tokens gives the longest token at every position of a word in one pass. The encoder
walks over the word with these, keeps a token only where it can follow the one before it (the pair-compatibility
check: no merge across their border would have come before those inside them), tries the next shorter token
otherwise, and steps back over a token when none is left. A position found dead is never entered again, so the
work is linear in the word. The result is that of applying all merges by rank.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.llm.common import table

#: Chunks between white space whose ids a worker remembers; the memory is cleared when it is full.
CACHED = 500_000
END = "\0"


class Vocabulary:
    """Tokens of a ``tokenizers`` BPE file with word ends, with the tables that encoding and decoding need."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        whole = Tokenizer.from_file(path)
        self._normalizer, self._words = whole.normalizer, whole.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self._of_byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        # Printable ASCII and composed Latin letters that have a lower case of one letter: normalising only lowers them.
        self._simple = re.compile("[!-~À-ÖØ-öø-įı-ň]*")
        self._words_of = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ň]+|[0-9]|[^a-zß-öø-ň0-9]+").findall

        size = max([*ids.values(), *self.special.values()]) + 1
        texts = [""] * size
        for token, i in (ids | self.special).items():
            texts[i] = token
        self._table = b"".join(t.encode() + b" " for t in texts)
        self._offsets = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])

        #: The two tokens that a merge joins; a token that no merge makes stands for itself.
        self.parts = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        base = len(ids) - len(model["merges"]) - len(self.special.keys() & ids.keys())
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            both, token = (ids[left], ids[right]), ids[left.removesuffix(suffix) + right if left.endswith(suffix) else left + right]
            if token != base + rank:
                raise ValueError("ids must follow the order of merges")
            self.merged[both] = token
            self.parts[token] = both
        self.text = [t[: -len(suffix)] + END if t.endswith(suffix) else t for t in texts]
        automaton, reachable = ahocorasick.Automaton(), [False] * size
        for i in sorted(set(ids.values()) - set(self.special.values())):
            left, right = self.parts[i]
            reachable[i] = left == right == i or (reachable[left] and reachable[right] and self.fits(left, right, i))
            if reachable[i]:
                automaton.add_word(self.text[i], i)
        #: The longest token that is a true prefix of a token, or -1.
        self.shorter = [-1] * size
        for i, t in enumerate(self.text):
            if reachable[i]:
                self.shorter[i] = next((automaton.get(t[:n]) for n in range(len(t) - 1, 0, -1) if t[:n] in automaton), -1)
        automaton.make_automaton()
        self._automaton = automaton
        self._length = [len(t) for t in self.text]
        self._compatible: dict[tuple[int, int], bool] = {}
        self._known: dict[str, bytes] = {}
        self._word_ids: dict[str, bytes] = {}

    def fits(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of a rank below ``before`` crosses the border between two tokens.

        Both are taken apart along their merges, the later merge first, and at each step the tokens that then meet
        at the border must not have a merge earlier than the one just undone.
        """
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < before:
                return False
            inner_left, inner_right = self.parts[left][1], self.parts[right][0]
            can_left, can_right = inner_left != left, inner_right != right
            if not can_left and not can_right:
                return True
            if can_left and (not can_right or left > right):
                before, left = left, inner_left
            else:
                before, right = right + 1, inner_right

    def _follows(self, left: int, right: int) -> bool:
        found = self._compatible.get((left, right))
        if found is None:
            if len(self._compatible) > CACHED:
                self._compatible.clear()
            found = self._compatible[left, right] = self.fits(left, right, len(self.parts))
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        return self._encode("".join([self._of_byte[b] for b in word]))

    def _encode(self, word: str) -> list[int]:
        """Ids of one word, given with a character for each byte, in time linear in its length."""
        text = word + END
        size, length, shorter, pairs = len(text), self._length, self.shorter, self._compatible
        longest = [-1] * size
        for end, token in self._automaton.iter(text):
            start = end - length[token] + 1
            longest[start] = token  # ends come in order: a later one is of a longer token
        token = longest[0]
        if token >= 0 and length[token] == size:
            return [token]
        out: list[int] = []
        dead, at, last = bytearray(size + 1), 0, -1
        while at < size:
            while token >= 0:
                if not dead[at + length[token]]:
                    if last < 0:
                        break
                    if (fits := pairs.get((last, token))) is None:
                        fits = self._follows(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last, token = token, longest[at] if at < size else -1
            else:
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text whose words don't depend on what is around it."""
        if self._simple.fullmatch(chunk):
            words = [w if w.isascii() else "".join([self._of_byte[b] for b in w.encode()]) for w in self._words_of(chunk.lower())]
        else:
            words = [w for w, _ in self._words.pre_tokenize_str(self._normalizer.normalize_str(chunk))]
        out = []
        for word in words:
            if (ids := self._word_ids.get(word)) is None:
                ids = array("I", self._encode(word)).tobytes()
                if len(word) < 64:
                    if len(self._word_ids) > CACHED:
                        self._word_ids.clear()
                    self._word_ids[word] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() cuts there, the pre-tokenizer doesn't
            return self._chunk(text)
        chunks, known = text.split(), self._known
        out = list(map(known.get, chunks))
        if None in out:
            if len(known) > CACHED:
                known.clear()
                self._word_ids.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    chunk = chunks[i]
                    if (ids := known.get(chunk)) is None:
                        ids = self._chunk(chunk)
                        if len(chunk) < 64:
                            known[chunk] = ids
                    out[i] = ids
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian unsigned 32-bit; strings of special tokens give their ids."""
        if not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self._split.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts with a space between them, gathered from one table by offsets."""
        tokens = np.frombuffer(ids, "<u4")
        if not len(tokens):
            return b""
        start = self._offsets[tokens]
        lengths = self._offsets[tokens + 1] - start
        ends = np.cumsum(lengths)
        at = np.repeat(start - (ends - lengths), lengths) + np.arange(ends[-1])
        return np.frombuffer(self._table, np.uint8)[at[:-1]].tobytes()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """Encodes every whole text: doc_id, n_tokens, ids (binary) and, if ``decoded``, the text that they decode to.

    A null text is an empty one: no ids, empty decoded text. A null doc_id stays null; repeated rows each give a row;
    an empty table gives none. Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            ids = [known.encode(text or "") for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([known.decode(x) for x in ids], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Decodes ids (binary) into texts: doc_id, decoded. Null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            texts = pa.array([known.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_documents(table(spark, sf_dir, "documents"), default_path(), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
