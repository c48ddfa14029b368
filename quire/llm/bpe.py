"""BPE encoding and decoding of whole texts with a word-end vocabulary.

Text is normalised as the vocabulary file says (NFC, white space runs, lower case), cut into
pre-tokens, and each pre-token is merged on its own. Pre-tokens repeat, so a bounded cache maps
words to their ids; only unseen ones are merged. Two engines merge them:

* `MergeRounds`, in numpy: the symbols of all unseen words of a batch lie in one flat array. In
  each round the rank of every neighbouring pair is found by binary search over the sorted pair
  keys, and in each word all pairs of its lowest rank are merged at once.
* `LibraryMerges`, which gives the unseen words to the tokenizers library.

Defined results: null and empty text give no ids and an empty decoded text; repeated rows give
repeated results; a text without word characters gives the ids of its punctuation only. Only the
id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import map_batches, slices, texts_of

#: Fixed values of the vocabulary file's format: its pre-token pattern and its white space.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

BATCH = 4 << 20  # bytes of text that are encoded together

_SPACES = re.compile(f"[{SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_MARKS = ".,;:!?%&$*#|"
_NEWER = "\U0002ebf0"  # from here on this Python knows letters that the library may not (see `unassigned`)


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others take code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Characters that this Python doesn't know; libraries of other Unicode versions may."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        new = c <= sys.maxunicode and (unicodedata.category(chr(c)) == "Cn" or 0x2EBF0 <= c < 0x30000)
        if new and start is None:
            start = c
        elif not new and start is not None:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        ids: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(max(ids.values()), max(self.special.values(), default=0))
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for text, i in ids.items() if text.endswith(self.suffix)]] = True

    @cached_property
    def tokens(self) -> list[bytes]:
        """What each id decodes to; only `decode` needs it, so encoders don't hold it."""
        with open(self.path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        found = [b""] * self.size
        for text, i in [*ids.items(), *self.special.items()]:
            found[i] = text.encode()
        return found


class MergeRounds:
    """Merges many words at once in numpy."""

    def __init__(self, vocab: Vocabulary):
        with open(vocab.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letters = model["vocab"], byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.final = np.array([ids[c + vocab.suffix] for c in letters], dtype=np.int64)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.none = len(keys)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), self.none - 1)
        return np.where(self.keys[at] == want, self.ranks[at], self.none)

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        last = np.cumsum(sizes) - 1
        sym[last] = self.final[flat[last]]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_sym, done_word = [], []
        while len(sym):
            same = word[1:] == word[:-1]
            rank = np.full(len(sym), self.none)
            rank[:-1][same] = self.rank(sym[:-1][same], sym[1:][same])
            start = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, start)
            lowest = np.repeat(lowest, np.diff(np.r_[start, len(sym)]))
            over = lowest == self.none
            done_sym.append(sym[over])
            done_word.append(word[over])
            hit = (rank == lowest) & ~over
            # of overlapping hits (a pair of equal symbols) the 1st, 3rd, ... of a run is merged
            at = np.flatnonzero(hit)
            if len(at):
                run = np.cumsum(np.r_[True, np.diff(at) > 1])
                first = at[np.searchsorted(run, run)]
                at = at[(at - first) % 2 == 0]
                sym[at] = self.merged[rank[at]]
            keep = ~over
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        sym = sym[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(raw))) * 4
        return [sym[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


class LibraryMerges:
    """Gives words to the tokenizers library, many joined by spaces in each call."""

    def __init__(self, vocab: Vocabulary, group: int = 100):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; a pool's threads only hold memory
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.vocab, self.group = vocab, group
        self.tokenizer = Tokenizer.from_file(vocab.path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the words are normalised and cut already
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def __call__(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        found = self.tokenizer.encode_batch_fast([" ".join(words[i : i + self.group]) for i in range(0, len(words), self.group)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in found])
        ends = (np.flatnonzero(self.vocab.ends[ids]) + 1) * 4  # each word has one word-end token, its last
        if len(ends) != len(words):
            raise ValueError("the vocabulary doesn't mark word ends")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Cache:
    """Two generations of plain dicts: entries that were used since the last turn stay."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set) -> set:
        """Those of the keys that neither generation has; others are brought into the new one."""
        keys = keys.difference(self.new)
        old = self.old
        known = [k for k in keys if k in old]
        self.new.update(zip(known, map(old.__getitem__, known), strict=True))
        return keys.difference(known)

    def turn(self) -> None:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}


class Encoder:
    """encode(texts) gives for each text its ids as little-endian unsigned 32-bit bytes.

    cache_words: entries of each of two cache generations, which bounds memory, not results. One
    cache holds words and the pieces they are cut into: a piece by itself is a word of one piece."""

    def __init__(self, path: str, engine: str = "rounds", cache_words: int = 400_000):
        self.vocab = Vocabulary(path)
        self.merge = MergeRounds(self.vocab) if engine == "rounds" else LibraryMerges(self.vocab)
        self.library = None
        self.words = Cache(cache_words)
        special = sorted(self.vocab.special, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None

    @staticmethod
    def split(text: str) -> list[str]:
        """Normalised words between white space."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # lower case by letter, not by place in the word
        text = text.lower()
        if _SEPARATORS.search(text):
            return [w for w in _SPACES.split(text) if w]
        return text.split()

    def pieces(self, word: str) -> list[str]:
        core = word if word.isalpha() else word.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) < _NEWER):
            return [core, word[len(core) :]] if len(core) < len(word) else [core]
        if not word.isascii() and unassigned().search(word):
            return self.library_pieces(word)
        return PRE_TOKEN.findall(word)

    def library_pieces(self, word: str) -> list[str]:
        """The rare words with characters of newer Unicode versions are cut as the vocabulary's own
        library cuts them, so that both agree on what is a letter."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocab.path)
        word = self.library.normalizer.normalize_str(word)
        return [word[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(word)]

    def learn(self, words: set[str]) -> None:
        """Fills the cache for words that it hasn't."""
        cut = {w: self.pieces(w) for w in words}
        new = list(self.words.missing({p for ps in cut.values() for p in ps}))
        known = self.words.new
        known.update(zip(new, self.merge(new), strict=True))
        known.update((w, b"".join([known[p] for p in ps])) for w, ps in cut.items() if len(ps) != 1 or ps[0] != w)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = []
        segments: list[list] = []
        seen: set[str] = set()
        for t in texts:
            if self.special and "<|" in t and (found := self.special.split(t))[1:]:
                row = [s if i % 2 else self.split(s) for i, s in enumerate(found)]
            else:
                row = [self.split(t)]
            segments.append(row)
            for seg in row:
                if not isinstance(seg, str):
                    seen.update(seg)
        self.learn(self.words.missing(seen))
        words = self.words.new
        for row in segments:
            out.append(b"".join([self.vocab.special[seg].to_bytes(4, "little") if isinstance(seg, str) else b"".join([words[w] for w in seg]) for seg in row]))
        self.words.turn()
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens with a space between them: these vocabularies name no decoder."""
        tokens = self.vocab.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=4)
def encoder(path: str, engine: str, cache_words: int = 400_000) -> Encoder:
    """One for each Python worker, so that its cache serves all tasks of the worker."""
    return Encoder(path, engine, cache_words)


def encode_column(docs: DataFrame, path: str, engine: str = "rounds", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (array of int) and the decoded text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, engine)
        for batch in slices(batches, limit=BATCH):
            rows = enc.encode(texts_of(batch))
            lists = [np.frombuffer(r, "<u4").astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lists, pa.list_(pa.int32())), pa.array([enc.decode(r).decode() for r in rows], pa.string())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"`{key}` {kind}, ids array<int>, decoded string")


def digest_column(docs: DataFrame, path: str, engine: str = "rounds", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 (of ids as unsigned 32-bit little-endian), decoded_sha256: what
    `encode_column` gives, digested where it is made, so that the ids needn't leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, engine)
        for batch in slices(batches, limit=BATCH):
            rows = enc.encode(texts_of(batch))
            cols = [[len(r) // 4 for r in rows], [hashlib.sha256(r).hexdigest() for r in rows], [hashlib.sha256(enc.decode(r)).hexdigest() for r in rows]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, cols)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
