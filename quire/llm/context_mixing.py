"""Language-model scores by logistic mixing of bit predictors.

A token is a word (ASCII letters in lower case, cut at ASCII white space) or the end of its text.
Frequent words and the escape to all others have a prefix code by their counts, and each bit of a
token's code is predicted in turn. What predicts it:

* the counts of the code's own tree (order 0, exact);
* three hashed contexts, each with the place in the tree: the word before, the two words before,
  and the word before the last one. Slots hold how often a bit was 0 and 1 in the corpus;
* the token that followed the same two words earlier in this document.

Predictions are mixed as logits with weights that a gate picks: how well the two finer contexts are
known, and whether there is such an earlier token. Weights start as those of logistic regressions
(one a gate, by Newton steps over sums that Spark adds up) and follow the document online, 16 tokens
at a time; a last correction, by interval of the mixed logit, follows it too. Texts of over 1,024
tokens start anew with each 1,024 tokens, so that many stretches advance together in numpy.

Words outside the code are known by their counts over the whole corpus: after the escape a word
counted c times has the share (c + 1) / (n + v + 1), of the n tokens and v words that there are; an
unknown word takes the one share left, as the base score's unknown words do. So the order-0
predictor alone would give the base score, and both are about the same events.

Scale: word counts cover all training documents, are added up in tasks before they are shuffled, and
stay distributed; the rarer words of documents are joined to them by the word, and no such word has
many rows. Only the code (at most `dictionary` words of 65 bytes at most) and the contexts' slots
(2^`slots` each, added up over all training documents) are broadcast, both of a size that the
parameters fix. Slots that contexts share blur what they predict, which the gates and weights learn.

Texts are cut into words twice, to count them and to give each token its symbol; the passes after
that read symbols, which lie in a checkpoint. The LEVELS next levels of the code's tree below a place
lie side by side in a context's slots, so that they share a line of the processor's cache.

Weights are fitted on all training documents. These are in FOLDS folds by their text's hash, and a
document's contexts are looked up in slots that its own fold is left out of, so that copies don't
tell about each other; the slots used for scores have all folds. Newton steps over `tuning` documents
or some more give weights to start from, steps over sixteen times as many follow, and so on up to
steps over all, which end when one promises less than ENOUGH; so few of them are needed.

Defined results: null and empty texts have the end token alone; a null id counts as an empty one
for the division; rows are scored one by one, repeated or not; without training documents every
score is 0; an empty table gives no row. Only id and text columns are read, so other columns may
have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, map_batches, slices

END = b""  # no word is empty
LONGEST = 64
ORDERS, BLOCKS = 3, 1024
BATCH, PART, CHUNK = 1 << 19, 1 << 17, 1 << 16  # bytes of symbols, tokens and bits that are worked on together
COUNTED = 1 << 22  # tokens
SEGMENT, STEP = 1024, 16
INPUTS, GATES, INTERVALS = 5, 32, 24
RATE, DRIFT = 0.04, 0.02
FOLDS, ROUNDS, GROWTH, ENOUGH = 2, 12, 16, 1e-4  # the last in nats a bit
CLIP = 2.0**-16
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
LEVELS = 4
BELOW = np.uint32((1 << LEVELS) - 1 << 1)
_FOLD = np.uint32(0x9E3779B1)


def key_of(word: bytes) -> bytes:
    """A word as it is counted; long ones by a digest, which the tab tells from words."""
    return word if len(word) <= LONGEST else b"\t" + hashlib.sha256(word).hexdigest().encode()


def words_of(text: str) -> list[bytes]:
    """The words of a text, by their keys."""
    return words_in(pa.array([text]))[0].to_pylist()


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, end to end, by their keys, and how many each text has. Arrow's ascii_
    functions change and cut at ASCII only, as is wanted."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten().cast(pa.binary())
    length, starts = pc.binary_length(words).to_numpy(), split.offsets.to_numpy()
    found = np.r_[0, np.cumsum(length > 0)]
    if found[-1] < len(words):  # white space at an end leaves an empty one
        words = words.filter(pa.array(length > 0))
        length = length[length > 0]
    if (long := length > LONGEST).any():
        words = pc.replace_with_mask(words, pa.array(long), pa.array(map(key_of, words.filter(pa.array(long)).to_pylist()), pa.binary()))
    starts = found[starts - starts[0]]
    return words, np.diff(starts)


class Code:
    """A prefix code for symbols by weight. Per symbol: place and number of its bits in nodes/bits,
    and the bits left-aligned in 52; per place: the logit of bit 1 by weight."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        scaled = np.maximum(weights.astype(np.float64) * (2.0**28 / weights.sum()), 1)  # at most some 42 bits deep
        order = np.argsort(scaled, kind="stable").tolist()
        total, exact = [*scaled.tolist(), *[0.0] * (n - 1)], [*weights.tolist(), *[0] * (n - 1)]
        parent, side, leaf, made = [0] * (2 * n - 1), [0] * (2 * n - 1), 0, n
        logit = np.zeros(max(n - 1, 1), np.float32)
        for node in range(n, 2 * n - 1):
            pair = []
            for _ in range(2):
                if made == node or leaf < n and total[order[leaf]] <= total[made]:
                    pair.append(order[leaf])
                    leaf += 1
                else:
                    pair.append(made)
                    made += 1
            for bit, x in enumerate(pair):
                parent[x], side[x] = node, bit
            total[node], exact[node] = sum(total[x] for x in pair), sum(exact[x] for x in pair)
            logit[node - n] = math.log(exact[pair[1]] / exact[pair[0]])
        paths = []
        for x in range(n):
            path = []
            while x != 2 * n - 2:
                path.append((parent[x] - n, side[x]))
                x = parent[x]
            paths.append(path[::-1])
        self.size = np.array([len(p) for p in paths], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.nodes = np.array([x for p in paths for x, _ in p], np.int32)
        self.bits, self.logit = np.array([b for p in paths for _, b in p], np.int8), logit[self.nodes]
        # LEVELS levels below a place have its mark, their place below it, and beside that the bit
        tops, below = np.array([(p[i - i % LEVELS][0], sum(p[j][1] << (i - 1 - j) for j in range(i - i % LEVELS, i)) | 1 << i % LEVELS) for p in paths for i in range(len(p))], np.uint64).reshape(-1, 2).T
        marks = ((tops + np.uint64(1)) * _MIX[1] >> np.uint64(32)).astype(np.uint32)
        self.marks = marks & ~BELOW & ~np.uint32(1) | below.astype(np.uint32) << np.uint32(1) | self.bits.view(np.uint8)
        self.told = np.column_stack([self.marks, self.logit.view(np.uint32)]).view(np.uint64).ravel()  # looked up at once
        self.aligned = np.array([sum(b << (51 - i) for i, (_, b) in enumerate(p)) for p in paths], np.int64)


@lru_cache(maxsize=1)
def code_of(weights: bytes) -> Code:
    """One for each Python worker, for all models with these counts."""
    return Code(np.frombuffer(weights, np.int64))


@dataclass
class Model:
    """words: the dictionary, most frequent first; counts: theirs; n, v: training tokens and
    different ones, rest_n, rest_v those outside the dictionary. Symbol len(words) is the escape."""

    words: bytes
    counts: np.ndarray
    n: int
    v: int
    slots: int
    least: int
    tables: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None

    @property
    def rest(self) -> int:
        """n + v + 1 of the words outside the dictionary."""
        return self.n - int(self.counts.sum()) + self.v - len(self.counts) + 1

    @cached_property
    def dictionary(self) -> pa.Array:
        return pa.array(self.words.split(b"\n") if len(self.counts) else [], pa.binary())

    @cached_property
    def symbols(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.dictionary.to_pylist())}

    @cached_property
    def code(self) -> Code:
        return code_of(np.r_[self.counts + 1, self.rest].tobytes())

    @cached_property
    def logs(self) -> np.ndarray:
        return np.r_[np.log10(self.counts + 1), 0.0]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("dictionary", "symbols", "code", "logs")}


def symbols_of(model: Model, words: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(words, value_set=model.dictionary), len(model.counts)).to_numpy()


def ended(model: Model, sym: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words' symbols with an end after each text."""
    out = np.full(len(sym) + len(sizes), symbols_of(model, pa.array([END], pa.binary()))[0], np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    out[inside] = sym
    return out


class Tokens:
    """Symbols of many texts, end to end, each with its text's number, and the symbols before it."""

    def __init__(self, model: Model, rows: list[list[bytes]]):
        sizes = np.array([len(r) for r in rows], np.int64)
        self.take(model, ended(model, symbols_of(model, pa.array(chain.from_iterable(rows), pa.binary())), sizes), sizes + 1)

    @classmethod
    def stored(cls, model: Model, column: pa.Array, some: np.ndarray) -> Tokens:
        """Of the marked rows of a column of symbols."""
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
        sym, sizes = np.frombuffer(column.buffers()[2], np.int32)[ends[0] : ends[-1]], np.diff(ends).astype(np.int64)
        out = cls.__new__(cls)
        out.take(model, sym if some.all() else sym[np.repeat(some, sizes)], sizes[some])
        return out

    def take(self, model: Model, sym: np.ndarray, sizes: np.ndarray) -> None:
        self.sym, self.sizes, self.esc = sym, sizes, len(model.counts)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.arange(len(sym)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        before = lambda k: np.where(self.at >= k, np.roll(sym, k), self.esc + 1)
        self.one, self.two = before(1), before(2)

    def hashes(self, part: slice = slice(None)) -> list[np.ndarray]:
        one, two = self.one[part].astype(np.uint64), self.two[part].astype(np.uint64)
        return [(one + np.uint64(1)) * _MIX[0], (one * _MIX[1] + two + np.uint64(1)) * _MIX[0] + _MIX[2], (two + np.uint64(1)) * _MIX[1]]

    def parts(self) -> Iterator[slice]:
        """Tokens in parts of about PART, which begin where a stretch does: a long text isn't held as bits whole."""
        start = 0
        for i in np.flatnonzero(self.at % SEGMENT == 0).tolist():
            if i - start >= PART:
                yield slice(start, i)
                start = i
        yield slice(start, len(self.sym))

    @cached_property
    def earlier(self) -> np.ndarray:
        """The symbol that followed the same two at the last place before in the text, or -1."""
        key, low = self.hashes()[1] + self.doc.astype(np.uint64) * _MIX[3], np.uint64(len(self.sym).bit_length())
        key = np.sort((key * _MIX[0] >> low << low) + np.arange(len(self.sym), dtype=np.uint64))  # places below what is left of the hash
        at = (key & (np.uint64(1) << low) - np.uint64(1)).astype(np.intp)
        a, b = (x[np.flatnonzero(key[1:] >> low == key[:-1] >> low)] for x in (at[:-1], at[1:]))
        same = (self.one[a] == self.one[b]) & (self.two[a] == self.two[b]) & (self.doc[a] == self.doc[b])
        found = np.full(len(key), -1)
        found[b[same]] = self.sym[a[same]]
        return np.where((found == self.esc) | (self.at < 2), -1, found)


class Bits:
    """The bits of tokens, in the order that is asked for: place in the code and value of each."""

    def __init__(self, code: Code, sym: np.ndarray):
        self.size = code.size[sym]
        first = np.cumsum(self.size, dtype=np.int32) - self.size
        self.at = np.repeat((code.start[sym] - first).astype(np.intp), self.size)
        self.at += np.arange(len(self.at))
        told = code.told.take(self.at)
        mark, self.logit = told.view(np.uint32)[::2], told.view(np.float32)[1::2]
        self.bit = (mark & np.uint32(1)).astype(np.int8)
        self.below = (mark & BELOW) >> np.uint32(1)
        self.mark = mark & ~BELOW
        self.mark |= np.uint32(1)

    def slot(self, hashes: np.ndarray, slots: int) -> np.ndarray:
        """Where the bits' contexts lie in a table of 2^slots. LEVELS bits of a token lie side by side."""
        h = np.repeat((hashes * _MIX[3] >> np.uint64(32)).astype(np.uint32), self.size)
        h ^= self.mark
        h *= _FOLD
        h >>= np.uint32(32 - slots)
        h ^= self.below
        return h.astype(np.intp)


def is_training(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 7 != 2


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: how often training documents have each token. Tasks add up COUNTED tokens or some more at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in slices(batches):
            words, sizes = words_in(batch.column("text"))
            held += [words, pa.array([END] * len(sizes), pa.binary())]
            tokens += len(words) + len(sizes)
            if tokens > COUNTED:
                yield added_up(held)
                held, tokens = [], 0
        if held:
            yield added_up(held)

    def added_up(held: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(pc.value_counts(pa.chunked_array(held)).flatten(), names=["word", "n"])

    return cut_lineage(map_batches(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def skeleton(counts: DataFrame, dictionary: int, slots: int) -> Model:
    """The dictionary and the totals; at most `dictionary` words and the end token, by a count that
    all words of the dictionary have at least."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, least = 0, 1
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(dictionary + 1).toLocalIterator():
        if (total := total + r["count"]) > dictionary:
            least = r["n"] + 1
            break
    top = counts.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).orderBy(F.desc("n"), "word").toArrow()
    return Model(b"\n".join(top.column("word").to_pylist()), top.column("n").to_numpy().astype(np.int64), int(n), int(v), slots, least)


def context_slots(docs: DataFrame, model: Model) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """What the slots predict: without each of the folds, and with all of them. Rows of `docs` have
    sym and fold. Tasks add up their documents and hand on compressed blocks of slots."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    width = (2 << model.slots) // BLOCKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in slices(batches, "sym", BATCH):
            for fold, t in by_fold(m, batch):
                for some in t.parts():
                    bits = Bits(m.code, t.sym[some])
                    for order, h in enumerate(t.hashes(some)):
                        at = bits.slot(h, m.slots)
                        at <<= 1
                        at |= bits.bit
                        if (order, fold) not in held:
                            held[order, fold] = np.zeros(2 << m.slots, np.int32)
                        np.add.at(held[order, fold], at, np.int32(1))
        for (order, fold), x in held.items():
            blocks = [pa.compress(x[i * width : (i + 1) * width].tobytes(), codec="zstd", asbytes=True) for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS) + order * BLOCKS), pa.array([fold] * BLOCKS, pa.int32()), pa.array(blocks, pa.binary())], names=["block", "fold", "slots"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, fold, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(pa.decompress(raw, width * 4, codec="zstd", asbytes=True), np.int32)
                held.setdefault(block, np.zeros((FOLDS, width), np.int64))[fold] += x
        if held:
            cols = [[states(v.sum(0) - x).tobytes() for x in (*v, 0)] for v in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(c, pa.binary()) for c in zip(*cols, strict=True))], names=["block", *sides])

    sides = [*(f"without{k}" for k in range(FOLDS)), "whole"]
    parts = map_batches(docs.select("sym", "fold"), add, "block long, fold int, slots binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = map_batches(parts.repartition(n, "block"), merge, ", ".join(["block long", *(f"{x} binary" for x in sides)])).toArrow().to_pylist()
    out = []
    for side in sides:
        tables = [np.full(1 << model.slots, 512, np.uint16) for _ in range(ORDERS)]
        for r in merged:
            order, i = divmod(r["block"], BLOCKS)
            tables[order][i * width // 2 : (i + 1) * width // 2] = np.frombuffer(r[side], np.uint16)
        out.append(tables)
    return out[:-1], out[-1]


def by_fold(model: Model, batch: pa.RecordBatch) -> Iterator[tuple[int, Tokens]]:
    folds = batch.column("fold").to_numpy()
    for fold in np.unique(folds).tolist():
        yield fold, Tokens.stored(model, batch.column("sym"), folds == fold)


def states(pairs: np.ndarray) -> np.ndarray:
    """A slot's logit in 1/16, eight bits about 128, and two bits for how much it has seen."""
    zero, one = pairs[0::2], pairs[1::2]
    n = zero + one
    logit = np.clip(np.rint(16 * np.log((one + 0.4) / (zero + 0.4))), -127, 127).astype(np.int64) + 128
    return (logit << 2 | np.digitize(n, [1, 3, 20])).astype(np.uint16)


UPPER = [(i, j) for i in range(INPUTS) for j in range(i, INPUTS)]
WIDTH = INPUTS + len(UPPER) + 1


class Features:
    """What is known about each bit before it is seen. Tokens are ordered by step, so that the
    stretches of all texts advance together: a run is the bits of a stretch in a step, from starts on;
    runs of step i are edges[i] to edges[i + 1]."""

    def __init__(self, model: Model, tokens: Tokens, part: slice):
        at, code = tokens.at[part] % SEGMENT, model.code
        step = (at // STEP).astype(np.int16)
        order = np.argsort(step, kind="stable")
        segment = (np.cumsum(at == 0) - 1)[order]
        sym, guess, step = tokens.sym[part][order], tokens.earlier[part][order], step[order]
        bits = Bits(code, sym)
        found = [table.take(bits.slot(h[order], model.slots)) for table, h in zip(model.tables, tokens.hashes(part), strict=True)]
        self.x, self.bit = np.empty((INPUTS, len(bits.at)), np.float32), bits.bit
        self.x[0] = bits.logit
        for i, f in enumerate(found):
            self.x[1 + i] = f >> 2
        self.x[1:-1] -= 128
        self.x[1:-1] /= 16
        self.gate = ((found[1] & 3) << 3 | (found[0] & 3) << 1).astype(np.uint8)
        ends = np.r_[0, np.cumsum(bits.size, dtype=np.int64)]
        # bits up to the first in which the guess is wrong are told
        guessed = np.flatnonzero(guess >= 0)
        differ = code.aligned[guess[guessed]] ^ code.aligned[sym[guessed]]
        common = np.where(differ == 0, 64, 52 - np.frexp(differ.astype(np.float64))[1])
        size = np.minimum(common + 1, code.size[sym[guessed]])
        told = np.repeat(ends[guessed] - np.cumsum(size) + size, size) + np.arange(size.sum())
        wrong = (ends[guessed] + common)[common < size]
        self.gate[told] |= 1
        self.x[-1] = 0
        self.x[-1, told] = self.bit[told] * np.float32(4) - 2
        self.x[-1, wrong] *= -1
        self.segments = int(segment.max(initial=-1)) + 1
        self.doc_of_segment = tokens.doc[part][at == 0]
        first = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (step[1:] != step[:-1])]) if len(sym) else np.zeros(0, np.intp)
        self.starts, self.segment = ends[first], segment[first]
        self.lengths = np.diff(np.r_[self.starts, ends[-1]])
        self.edges = np.searchsorted(step[first], np.arange(int(step[-1]) + 2 if len(step) else 1))


def first_weights() -> np.ndarray:
    w = np.zeros((GATES, INPUTS))
    w[:, 0] = 1.0
    return w


def gated(f: Features, weights: np.ndarray) -> np.ndarray:
    """The mixed logit of each bit by its gate's weights."""
    out = np.empty(len(f.gate), np.float32)
    for a in range(0, len(out), CHUNK):
        gate = f.gate[a : a + CHUNK].astype(np.intp)
        out[a : a + CHUNK] = sum(w[gate] * x[a : a + CHUNK] for w, x in zip(weights.T.astype(np.float32), f.x, strict=True))
    return out


def mixed(f: Features, weights: np.ndarray) -> np.ndarray:
    """log2 of the probability of each bit. To the gate's weights come differences that follow each
    stretch, and to the mixed logit a correction by its interval that follows it too; both move once
    a step, down the gradient of the step's coding cost."""
    own = np.zeros((INPUTS, f.segments), np.float32)
    shift = np.zeros(f.segments * INTERVALS, np.float32)
    base = gated(f, weights)
    out = np.empty(len(f.bit), np.float32)
    for i, j in zip(f.edges, f.edges[1:], strict=False):
        here, n, first = f.segment[i:j], f.lengths[i:j], f.starts[i:j] - f.starts[i]  # a stretch's bits of a step lie together
        a, b = f.starts[i], f.starts[i] + n.sum()
        x, logit = f.x[:, a:b], base[a:b]
        for w, row in zip(own[:, here], x, strict=True):
            logit += np.repeat(w, n) * row
        place = logit * 2
        place += 12
        place = np.clip(place, 0, INTERVALS - 1, out=place).astype(np.intp)
        place += np.repeat(here * INTERVALS, n)
        p = logit + shift[place]
        np.exp(np.negative(p, out=p), out=p)
        p += 1
        np.clip(np.divide(1, p, out=p), CLIP, 1 - CLIP, out=p)
        err = f.bit[a:b] - p
        np.subtract(1, np.abs(err), out=out[a:b])
        own[:, here] += RATE / np.sqrt(n).astype(np.float32) * np.add.reduceat(err * x, first, axis=1)
        shift += DRIFT * np.bincount(place, err, minlength=len(shift)).astype(np.float32)
    return np.log2(out, out=out)


def regression_sums(f: Features, weights: np.ndarray) -> np.ndarray:
    """Of the bits of each gate: the gradient, the curvatures, and their number."""
    both, number, rows = np.zeros((GATES, INPUTS + 1, INPUTS)), np.zeros(GATES), weights.T.astype(np.float32)
    for a in range(0, len(f.gate), CHUNK):
        gates = f.gate[a : a + CHUNK]
        order, n = np.argsort(gates, kind="stable"), np.bincount(gates, minlength=GATES)
        x = f.x[:, a : a + CHUNK].take(order, axis=1)
        p = sum(np.repeat(w, n) * row for w, row in zip(rows, x, strict=True))
        np.exp(-np.clip(p, -30, 30, out=p), out=p)
        p += 1
        np.divide(1, p, out=p)
        left = np.empty((INPUTS + 1, len(p)), np.float32)
        np.multiply(p * (1 - p), x, out=left[:-1])
        np.subtract(f.bit[a : a + CHUNK].take(order), p, out=left[-1])
        ends = np.cumsum(n).tolist()
        for gate, (i, j) in enumerate(zip([0, *ends], ends, strict=False)):
            if j > i:
                both[gate] += left[:, i:j] @ x[:, i:j].T
        number += n
    return np.column_stack([both[:, -1], *(both[:, i, j] for i, j in UPPER), number])


def fitted(docs: DataFrame, model: Model, tables: list[list[np.ndarray]], every: int, ridge: float = 20.0) -> np.ndarray:
    """Weights of a logistic regression for each gate, over the bits of all `docs`, held to the
    first weights by a ridge. Rows have h, fold and sym. Tasks hand on sums of gradients and
    curvatures, a row a gate. Where the steps over all documents start is found by steps over one
    document in `every`, a power of GROWTH, then over GROWTH times as many, and so on; there are
    ROUNDS at most each time."""
    sent = docs.sparkSession.sparkContext.broadcast((model, tables))

    def step(docs: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, total = sent.value[0], np.zeros((GATES, WIDTH))
            without = [replace(m, tables=x) for x in sent.value[1]]
            for batch in slices(batches, "sym", BATCH):
                for fold, t in by_fold(m, batch):
                    for part in t.parts():
                        total += regression_sums(Features(without[fold], t, part), weights)
            yield pa.RecordBatch.from_arrays([pa.array(range(GATES), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["gate", "sums"])

        rows = map_batches(docs.select("sym", "fold"), sums, "gate long, sums array<double>").groupBy("gate").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(WIDTH)]).collect()
        after, gain, bits = weights.copy(), 0.0, 0.0
        for r in rows:
            s = [r[f"s{k}"] for k in range(WIDTH)]
            h = np.eye(INPUTS) * ridge
            for k, (i, j) in enumerate(UPPER):
                h[i, j] += s[INPUTS + k]
                h[j, i] = h[i, j]
            slope = np.array(s[:INPUTS]) - ridge * (weights[r.gate] - first_weights()[r.gate])
            move = np.linalg.solve(h, slope)
            after[r.gate] += move
            gain, bits = gain + slope @ move / 2, bits + s[-1]
        return np.round(after, 6), gain / max(bits, 1)  # sums in another order differ by less

    weights, tasks = first_weights(), 16
    while True:
        some = docs if every == 1 else cut_lineage(docs.where(F.pmod("h", F.lit(every)) == 0).select("sym", "fold").repartition(tasks))
        for _ in range(ROUNDS):
            weights, gain = step(some, weights)
            if gain < ENOUGH:
                break
        if every == 1:
            return weights
        every, tasks = every // GROWTH, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, held_out, h (a hash of the text), fold, n_tokens, n_bytes, n_code (tokens in the
    dictionary), base (sum of log10(c + 1) of those), sym (the tokens' symbols, four bytes each), rare
    and times (the other words and how often each) of each document, so that texts are cut into words
    once for all that follows; a checkpoint, so that row names a document for good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches):
            text = batch.column("text")
            words, sizes = words_in(text)
            sym, doc = symbols_of(m, words), np.repeat(np.arange(len(sizes)), sizes)
            outside = sym == len(m.counts)
            names = words.filter(pa.array(outside)).dictionary_encode()
            pairs, times = np.unique(doc[outside] * max(len(names.dictionary), 1) + names.indices.to_numpy(), return_counts=True)
            which, name = np.divmod(pairs, max(len(names.dictionary), 1))
            ends = pa.array(np.searchsorted(which, np.arange(len(sizes) + 1)), pa.int32())
            rare, times = pa.ListArray.from_arrays(ends, names.dictionary.take(pa.array(name))), pa.ListArray.from_arrays(ends, pa.array(times))
            sym = ended(m, sym, sizes)
            doc, starts = np.repeat(np.arange(len(sizes)), sizes + 1), np.r_[0, np.cumsum(sizes + 1)].astype(np.int32)
            known, base = (np.bincount(doc, x, minlength=len(sizes)) for x in (sym < len(m.counts), m.logs[sym]))
            stored = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(starts * 4), pa.py_buffer(sym)])
            cols = [pa.array(sizes + 1), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), stored, rare, times]
            kept = ("doc_id", "held_out", "h", "fold")
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *cols], names=[*kept, "n_tokens", "n_bytes", "n_code", "base", "sym", "rare", "times"])

    cols = docs.select("doc_id", "held_out", F.xxhash64("text", F.lit("tune")).alias("h"), "text").withColumn("fold", F.pmod(F.shiftright("h", 32), F.lit(FOLDS)).cast("int"))
    schema = "doc_id long, held_out boolean, h long, fold int, n_tokens long, n_bytes long, n_code long, base double, sym binary, rare array<binary>, times array<long>"
    return cut_lineage(map_batches(cols, run, schema).select(F.monotonically_increasing_id().alias("row"), "*"))


def learned(docs: DataFrame, model: Model, tuning: int) -> Model:
    """The model with slots and weights from the training documents, as encoded() gives them."""
    n_docs = int(model.counts[model.symbols[END]]) if END in model.symbols else 0
    if not n_docs:
        return replace(model, tables=[np.full(1 << model.slots, 512, np.uint16)] * ORDERS, weights=first_weights())
    every = 1
    while every * GROWTH * max(tuning, 1) <= n_docs:
        every *= GROWTH
    without, whole = context_slots(docs, model)
    return replace(model, tables=whole, weights=fitted(docs, model, without, every))


def train(docs: DataFrame, **options) -> tuple[Model, DataFrame]:
    """A model of the training documents (rows of text), and the counts of all their words."""
    return model_of(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"), **options)[:2]


def model_of(docs: DataFrame, dictionary: int = 65_536, slots: int = 21, tuning: int = 512) -> tuple[Model, DataFrame, DataFrame]:
    """A model of the documents that aren't held out (rows of doc_id, held_out and text), the counts
    of all their words, and all documents as encoded() gives them."""
    counts = count_words(docs.where("not held_out"))
    model = skeleton(counts, dictionary, slots)
    cols = encoded(docs, model)
    return learned(cols.where("not held_out"), model, tuning), counts, cols


def code_scores(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of encoded() without symbols and rarer words, with coded, the log10 probability of
    their codes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_code", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "sym", BATCH):
            t = Tokens.stored(m, batch.column("sym"), np.ones(batch.num_rows, bool))
            bits = np.zeros(batch.num_rows)
            for part in t.parts():
                f = Features(m, t, part)
                if len(f.bit):
                    bits += np.bincount(f.doc_of_segment[f.segment], np.add.reduceat(mixed(f, m.weights), f.starts, dtype=np.float64), minlength=len(bits))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(bits * math.log10(2))], names=[*kept, "coded"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_code long, base double, coded double"
    return cut_lineage(map_batches(docs.select(*kept, "sym"), run, schema))


def scores(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte
    (bits of the score by bytes of the text; null for empty texts)."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~is_training()).alias("held_out"), "text")
    model, counts, cols = model_of(cols, **options)
    coded = code_scores(cols, model)

    rare = cols.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times")
    rest = counts.where((F.col("n") < model.least) & (F.col("word") != F.lit(END)))
    asked = rare.join(rest, "word").groupBy("row").agg(F.sum("times").alias("n_rest"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rest"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("base") + zero("rest") - F.col("n_tokens") * F.lit(math.log10(model.n + model.v + 1))
    score = F.col("coded") + zero("rest") - (F.col("n_tokens") - F.col("n_code")) * F.lit(math.log10(model.rest))
    whole = coded.join(asked, "row", "left").withColumns({"base_score": base, "score": score, "n_known": F.col("n_code") + zero("n_rest"), "train_tokens": F.lit(model.n).cast("long")})
    bits = F.when(F.col("n_bytes") > 0, F.abs("score") / math.log10(2) / F.col("n_bytes"))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
