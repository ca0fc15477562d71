"""Byte-pair encoding without replaying merges.

An Aho-Corasick automaton gives the vocabulary's longest match at a place in a word; the encoder takes that, or the longest token that
begins it, which is compatible with the token before, and steps back where none is. Two tokens are compatible if merging their joined text would leave the cut between
them, which undoing their merges from the outside in decides; answers are kept in a table. Each position is given up at most once,
so the time is linear in the word. Decoding gathers slices of one byte buffer by an offset table.

Spoken for: tokenizer files of kind BPE with an end-of-word suffix, a byte-level alphabet, and the normaliser NFC, white space to
one space, lower case (word_bpe_49k.json is one). Special tokens that stand in a text are ids of their own, as the library has it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import keep_only, map_batches, texts

#: Stands for the end of a word inside token texts; no byte-level character is that low.
END = "\0"
NONE = (0, -1)
#: White space by the Unicode property, and the pattern of words.
SPACE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^\p{{L}}\p{{N}}{SPACE[1:-1]}]+")
SPACES = regex.compile(SPACE + "+")
#: str.split() splits at these too, though they are not white space by the property.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Distinct chunks and words whose ids a worker remembers.
REMEMBERED, LONGEST_KEPT = 1_200_000, 64
#: Under this name a worker keeps encoders from task to task.
OWNER = "encoder"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Slices:
    """Byte strings in one buffer with an offset table."""

    def __init__(self, strings: list[bytes]) -> None:
        self.buffer = np.frombuffer(b"".join(strings), np.uint8)
        self.offset = np.r_[0, np.cumsum([len(s) for s in strings])]

    def join(self, ids: np.ndarray) -> bytes:
        """The strings of ids, one after the other."""
        begin = self.offset[ids]
        size = self.offset[ids + 1] - begin
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.buffer[np.repeat(begin - ends + size, size) + np.arange(ends[-1])].tobytes()


class Remembered(dict):
    """Results of a function by argument; what is missing is worked out. A full table begins anew; long arguments are never kept."""

    def __init__(self, work: Callable[[str], bytes]) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, key: str) -> bytes:
        value = self.work(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [t for t in model["vocab"] if t not in made]
        # Tokens are numbered by rank here: those that no merge makes, then by merge.
        names = base + [a + b for a, b in merges]
        rank = {t: i for i, t in enumerate(names)}
        self.base = len(base)
        self.raw = [np.uint32(model["vocab"][t]).tobytes() for t in names]  # ids as bytes, by rank
        self.left, self.right, self.pair = [0] * self.base, [0] * self.base, {}
        content = [t.removesuffix(suffix) + END if len(t) > 1 and t.endswith(suffix) else t for t in base]
        for i, (a, b) in enumerate(merges, self.base):
            self.left.append(rank[a])
            self.right.append(rank[b])
            self.pair[rank[a], rank[b]] = i
            content.append(content[rank[a]] + content[rank[b]])
        self.size = [len(c) for c in content]
        sound = [True] * self.base
        for i in range(self.base, len(content)):
            a, b = self.left[i], self.right[i]
            sound.append(sound[a] and sound[b] and self._cut(a, b, i))
        self.automaton = ahocorasick.Automaton()
        for i, c in enumerate(content):
            if sound[i]:
                self.automaton.add_word(c, i)
        self.automaton.make_automaton()
        found = {content[i]: i for i in range(len(content)) if sound[i]}
        #: The longest token that begins each token, -1 if there is none.
        self.shorter = [next((found[c[:k]] for k in range(len(c) - 1, 0, -1) if c[:k] in found), -1) for c in content]
        self.compatible: dict[int, bool] = {}
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        strings = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        top = max(strings) + 1
        self.decoded = Slices([(strings.get(i, "") + " ").encode() for i in range(top)])  # the file names no decoder: tokens are joined by a space
        self.decimal = Slices([b"%d " % i for i in range(top)])
        self.known = Remembered(self._chunk)

    def _cut(self, a: int, b: int, limit: int) -> bool:
        """Whether merges of rank under `limit` leave a cut between tokens a and b: no pair across it may come before what undoes it."""
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                if a < self.base:
                    return True
                limit, a = a, self.right[a]
            else:
                if b < self.base:
                    return True
                limit, b = b + 1, self.left[b]  # of equal ranks the one to the left comes first

    def _fits(self, a: int, b: int) -> bool:
        """_cut() of two whole tokens, remembered under one number."""
        if len(self.compatible) > 1 << 20:
            self.compatible.clear()
        known = self.compatible[a << 20 | b] = self._cut(a, b, len(self.size))
        return known

    def ranks(self, word: str) -> list[int]:
        """Tokens (as ranks) of a word in the byte-level alphabet, which ends with END."""
        n, size, compatible, shorter, longest = len(word), self.size, self.compatible, self.shorter, self.automaton.iter_long
        out: list[int] = []
        dead: set[int] = set()
        at, last = 0, -1
        token = next(longest(word))[1]
        while True:
            while token >= 0:
                if not (dead and at + size[token] in dead):
                    if last < 0:
                        break
                    fits = compatible.get(last << 20 | token)
                    if fits or (fits is None and self._fits(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = at + size[token], token
                if at == n:
                    return out
                token = next(longest(word, at), NONE)[1]  # the longest match from here; the end mark alone has none
            else:  # nothing leads on from here: shorten the token before
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                dead.add(at)
                token = out.pop()
                at -= size[token]
                token, last = shorter[token], out[-1] if out else -1

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.alphabet[b] for b in word.encode()])  # printable ASCII stands for itself
        raw = self.raw
        return b"".join([raw[r] for r in self.ranks(word + END)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space. A chunk that is one word and that word have the same ids, so they share a table."""
        if not chunk.isalpha():
            words = WORD.findall(chunk)
            if words != [chunk]:
                known = self.known
                return b"".join([known[w] for w in words])
        return self._word(chunk)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. White space never lies inside a word, so that chunks between it stand alone."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter, without the rule for a final sigma
        parts = [x for x in SPACES.split(text) if x] if SEPARATORS.search(text) else text.split()
        known = self.known
        return b"".join([known[x] for x in parts])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self._plain(text[at : m.start()]), np.uint32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the tokens' texts, joined by spaces."""
        return self.decoded.join(ids)[:-1]


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """A worker process reads a tokenizer file once, and again after tasks of other operators than those that encode."""
    keep_only(OWNER, _encoder.cache_clear)
    return _encoder(path)


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) for every row of docs: the operator's real output. Null text counts as empty: no ids."""

    def start():
        e = encoder(path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = [e.encode(t) for t in texts(batch)]
            offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))]

        return work

    return map_batches(docs.select("doc_id", "text"), start, [T.StructField("ids", T.ArrayType(T.IntegerType()))], ["doc_id"], OWNER)


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded (string) of rows (doc_id, ids). Null ids count as none: an empty string."""

    def start():
        e = encoder(path)
        return lambda batch: [pa.array([e.decode(np.array(x or [], np.int64)).decode() for x in batch.column("ids").to_pylist()], pa.string())]

    return map_batches(encoded.select("doc_id", "ids"), start, [T.StructField("decoded", T.StringType())], ["doc_id"], OWNER)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs; columns beside doc_id and text are ignored.

    Null text counts as empty: no tokens, and the digests of the empty string. Rows that repeat are encoded as often. Texts of any
    length are encoded whole; a text's working arrays are about 60 bytes a token.
    """

    def start():
        e = encoder(path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for t in texts(batch):
                ids = np.frombuffer(e.encode(t), np.uint32).astype(np.int64)
                out.append((len(ids), hashlib.sha256(e.decimal.join(ids)[:-1]).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()))
            n, a, b = zip(*out, strict=True)
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_batches(docs.select(F.col("doc_id"), "text"), start, fields, ["doc_id"], OWNER)
