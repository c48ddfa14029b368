"""Alignment of two tokenizers' tokens over the same bytes.

A batch of texts is laid end to end: the byte ends of all A tokens are one running sum, those of all
B tokens another, and each is counted into its bytes once. Where both tokenizers end a token the
text is cut into groups; where either does, one A token and one B token overlap in the bytes just
before, so the ends of either kind are the links. Running sums over the bytes, taken at the
documents' ends, give back what belongs to each document, and taken before a link's end they name
its two tokens.

The corpus-wide count of an id pair needs all documents. Each document keeps its different pairs
with their numbers, compressed, in a reliable checkpoint, so that texts are encoded once. Tasks add
up their own pairs before they are shuffled. Documents then take the counts of the most frequent
pairs (at most `frequent` of them, a fixed bound) from a broadcast table, and those of all others by
a join on the pair; no rare pair has many rows, and the sums are exact for all.

Token bytes: A's pieces by the byte-level alphabet; B's in UTF-8 with U+2581 as space and <0xHH> as
a byte. A is encoded by the ranks of the same vocabulary (`ranks`) where a text has only characters
whose class all Unicode versions agree on, and else by the library that the vocabulary is for; both
give the same ids (a test compares them).

Defined results: texts that are null or empty, or whose joined A or B bytes differ from a space and
the text, have no tokens: zeros and an empty `groups_sha256`. Rows of one id, or of none, are
documents of their own; an empty table gives no row. Only id and text columns are read, so other
columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, map_batches, slices, texts_of

BATCH = 2 << 20  # bytes of text that are laid end to end
SHIFT = 32  # an id pair is b << SHIFT | a
#: Blocks in which letters, digits and white space have been the same for long; other texts go to the library.
SETTLED = re.compile("[\\x00-ͷЀ-ԯ -⁯₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*")


@dataclass(frozen=True)
class Tokenizers:
    """Where the vocabularies are. ranks and pattern: the A vocabulary as ranks of bytes, optional."""

    a: str
    b: str
    ranks: str | None = None
    pattern: str | None = None


def alphabet() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    def __init__(self, which: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(which.a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.ranks = None
        if which.ranks:
            import tiktoken

            with open(which.ranks, "rb") as f:
                ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=which.pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=which.b)
        with open(which.a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int32, len(x)) for x in (self.a_bytes, self.b_bytes))

    def a_ids(self, text: str) -> list[int]:
        if self.ranks and (text.isascii() or SETTLED.fullmatch(text)):
            return self.ranks.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both kinds; none where the bytes of either aren't those of a space and the text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole = " " + text
        raw = whole.encode()
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return none, none
        a = self.a_ids(whole)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=2)
def encoders(which: Tokenizers) -> Encoders:
    return Encoders(which)


class Aligned:
    """Tokens of many documents laid end to end, with their groups and links.

    a, b: ids; a_of, b_of, groups_of, links_of: how many each document has; group_a, group_b: tokens
    up to the end of each group; link_a, link_b: the tokens of each link, in order."""

    def __init__(self, a_rows: list[np.ndarray], b_rows: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray):
        empty = [np.zeros(0, np.int64)]
        self.a, self.b = np.concatenate(a_rows + empty), np.concatenate(b_rows + empty)
        self.a_of, self.b_of = (np.fromiter(map(len, rows), np.int64, len(rows)) for rows in (a_rows, b_rows))
        self.a_end, self.b_end = np.cumsum(a_sizes[self.a], dtype=np.int32), np.cumsum(b_sizes[self.b], dtype=np.int32)
        total = int(self.a_end[-1]) if len(self.a) else 0
        in_a, in_b = (np.bincount(x, minlength=total + 1) > 0 for x in (self.a_end, self.b_end))
        self.a_before, self.b_before, self.cuts_before = (np.cumsum(x, dtype=np.int32) for x in (in_a, in_b, in_a & in_b))
        either = np.cumsum(in_a | in_b, dtype=np.int32)
        # the byte at which each document ends, from the number of its A tokens
        last = np.cumsum(self.a_of)
        ends = np.r_[0, self.a_end][last]
        per = lambda sums: np.diff(np.r_[0, sums[ends]])
        self.groups_of, self.links_of = per(self.cuts_before).astype(np.int64), per(either).astype(np.int64)
        cut = np.flatnonzero(in_a & in_b)
        self.group_a, self.group_b = self.a_before[cut], self.b_before[cut]
        link = np.flatnonzero(in_a | in_b) - 1
        self.link_a, self.link_b = self.a_before[link], self.b_before[link]

    def written(self) -> tuple[bytes, np.ndarray]:
        """`a1,a2|b1;a3|b2,b3;` of all documents in one string, and where each document's part ends."""
        a_group, b_group = self.cuts_before[self.a_end - 1], self.cuts_before[self.b_end - 1]
        ids, sign = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        a_at = np.arange(len(self.a)) + np.r_[0, self.group_b][a_group]
        b_at = np.arange(len(self.b)) + self.group_a[b_group]
        ids[a_at], ids[b_at] = self.a, self.b
        sign[a_at[self.group_a - 1]], sign[b_at[self.group_b - 1]] = ord("|"), ord(";")
        width = len(str(int(ids.max()))) if len(ids) else 1
        digits = np.maximum(np.searchsorted(10 ** np.arange(1, width + 1), ids, side="right") + 1, 1)
        out = np.empty((len(ids), width + 1), np.uint8)
        left = ids
        for i in range(width - 1, -1, -1):  # right-aligned, the sign after the last digit
            left, out[:, i] = left // 10, left % 10 + ord("0")
        out[:, width] = sign
        shown = np.arange(width + 1) >= (width - digits)[:, None]
        ends = np.r_[0, np.cumsum(digits + 1)][np.cumsum(self.a_of + self.b_of)]
        return out[shown].tobytes(), ends

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different id pairs of each document, how often it has them, and how many pairs it has."""
        key = self.b[self.link_b] << SHIFT | self.a[self.link_a]
        names, at = np.unique(key, return_inverse=True)
        both, n = np.unique(np.repeat(np.arange(len(self.links_of)), self.links_of) * max(len(names), 1) + at, return_counts=True)
        doc, at = np.divmod(both, max(len(names), 1))
        return names[at] if len(both) else key, n, np.bincount(doc, minlength=len(self.links_of))


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys and their numbers, compressed."""
    raw = np.concatenate([[len(keys)], np.diff(keys, prepend=0), n]).astype("<i8").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), "<i8")
    m = int(x[0])
    return np.cumsum(x[1 : m + 1]), x[m + 1 :]


def batches_of(batches: Iterator[pa.RecordBatch], which: Tokenizers) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    enc = encoders(which)
    for batch in slices(batches, limit=BATCH):
        rows = [enc.encode(t) for t in texts_of(batch)]
        yield batch, Aligned([r[0] for r in rows], [r[1] for r in rows], enc.a_sizes, enc.b_sizes)


def align(docs: DataFrame, which: Tokenizers) -> DataFrame:
    """doc_id, a, b (ids), group_a, group_b: how many tokens of each kind lie before each group's end."""

    def lists(values: np.ndarray, sizes: np.ndarray, less: np.ndarray | None = None) -> pa.Array:
        values = values if less is None else values - np.repeat(less, sizes)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in batches_of(batches, which):
            before = [np.r_[0, np.cumsum(n)[:-1]] for n in (x.a_of, x.b_of)]
            cols = [lists(x.a, x.a_of), lists(x.b, x.b_of), lists(x.group_a, x.groups_of, before[0]), lists(x.group_b, x.groups_of, before[1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "a", "b", "group_a", "group_b"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, a array<int>, b array<int>, group_a array<int>, group_b array<int>")


def linked(docs: DataFrame, which: Tokenizers) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs (different id pairs with
    their numbers, packed) of each document; a checkpoint, so that row names a document for good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in batches_of(batches, which):
            text, ends = x.written()
            keys, n, sizes = x.pairs()
            at = np.r_[0, np.cumsum(sizes)].tolist()
            starts = [0, *ends[:-1].tolist()]
            sha = [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(starts, ends.tolist(), strict=True)]
            pairs = [packed(keys[i:j], n[i:j]) if j > i else None for i, j in zip(at, at[1:], strict=False)]
            cols = [*map(pa.array, (x.a_of, x.b_of, x.groups_of, x.links_of, sha)), pa.array(pairs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
    found = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
    return cut_lineage(found.select(F.monotonically_increasing_id().alias("row"), "*"))


class Sums:
    """Adds up numbers of keys, handing on what it has when it holds over `limit` keys."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.held, self.keys, self.n = limit, 0, [], []

    def add(self, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
        self.keys.append(keys)
        self.n.append(n)
        self.held += len(keys)
        if self.held < self.limit:
            return None
        keys, n = self.merged()
        if 2 * len(keys) > self.limit:
            self.__init__(self.limit)
            return self.batch(keys, n)
        self.keys, self.n, self.held = [keys], [n], len(keys)
        return None

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, at, np.concatenate(self.n))
        return keys, n

    @staticmethod
    def batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (links of all documents), best (n is the highest of its B id): what `linked` found,
    counted. The table that is joined has a row for each B id, as many as B's vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for raw in batch.column("pairs").to_pylist():
                if (out := sums.add(*unpacked(raw))) is not None:
                    yield out
        if sums.held:
            yield sums.batch(*sums.merged())

    counts = cut_lineage(map_batches(found.where("pairs is not null").select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.shiftright("pair", SHIFT).alias("b")
    highest = counts.groupBy(b).agg(F.max("n").alias("highest"))
    return counts.select("*", b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest number t such that at most `most` rows have n >= t."""
    total, t = 0, None
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(most + 1).toLocalIterator():
        if (total := total + r["count"]) > most:
            return r["n"] + 1
        t = r["n"]
    return t or 1


def alignment(docs: DataFrame, which: Tokenizers, frequent: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    found = linked(docs, which)
    counts = pair_counts(found)
    t = least_count(counts, frequent)
    top = counts.where(F.col("n") >= t).orderBy("pair").toArrow()
    keys, n, best = (top.column(c).to_numpy() for c in ("pair", "n", "best"))
    table = docs.sparkSession.sparkContext.broadcast((keys, n, best))
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for batch in batches:
            rare: tuple[list, list, list] = ([], [], [])
            sums, bests = [], []
            for row, raw in zip(batch.column("row").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                s = m = 0
                if raw is not None:
                    mine, times = unpacked(raw)
                    at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
                    known = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
                    s, m = int((n[at[known]] * times[known]).sum()), int(times[known][best[at[known]]].sum())
                    for c, x in zip(rare, (np.full((~known).sum(), row), mine[~known], times[~known]), strict=True):
                        c.append(x)
                sums.append(s)
                bests.append(m)
            own = [batch.column("row"), pa.array([-1 - r for r in batch.column("row").to_pylist()], pa.int64()), pa.array([0] * len(sums), pa.int64()), pa.array(sums, pa.int64()), pa.array(bests, pa.int64())]
            names = ["row", "pair", "times", "sum", "bests", *facts]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(c) for c in facts)], names=names)
            if rare[0] and (m := sum(map(len, rare[0]))):
                cols = [*(pa.array(np.concatenate(c)) for c in rare), *(pa.nulls(m, pa.int64()) for _ in range(2))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(m, batch.column(c).type) for c in facts)], names=names)

    # a document's own row has a negative pair, which no other row has, and joins nothing
    schema = "row long, pair long, times long, sum long, bests long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    asked = map_batches(found, look_up, schema)
    rest = counts.where(F.col("n") < t).withColumnRenamed("n", "count")
    joined = asked.join(rest, "pair", "left").select("*", F.coalesce("sum", F.col("count") * F.col("times")).alias("s"), F.coalesce("bests", F.when(F.col("best"), F.col("times")), F.lit(0)).alias("m"))
    whole = joined.groupBy("row").agg(*[F.max(c).alias(c) for c in facts], F.sum("m").alias("n_best"), F.sum("s").alias("count_sum"))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
