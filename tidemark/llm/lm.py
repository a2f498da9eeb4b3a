"""Corpus language model on a subword lattice.

The vocabulary's pieces are given; which pieces there are is never trained. The file at hand scores pieces by
merge rank, so a piece's prior weight is Zipf's 1/(rank + 10). ``rounds`` steps of expectation-maximisation over the distinct
words of the training rows (forward-backward on each word's lattice, weighted by the word's count) move the weights
from that prior, which stays as pseudo-counts; 0 rounds score by the file alone. A word's probability is the sum
over all its segmentations, by forward recursion in log space; pieces never cross white space, so a
text's probability is the product over its words and one end symbol. Bytes are pieces, so every word
has a segmentation.

``whole_words`` adds each training word to the lattice as one arc over the whole word, with its count as weight; the
pieces share the weight of as many tokens as there are training words (V). With count c, N training tokens and
lattice probability q, a token then has (c + (V+1) q) / (N + V+1), still a distribution over strings: what was
learned decides known words, the pieces decide new ones.

The same pass gives a word-unigram base score with add-one counts over all training rows. Words that are
at least 1/2^18 of all tokens (so at most 2^18 words) are broadcast; the rest reach their counts by a join, in
which no key is hot. Null or empty text is the end symbol alone. Rows are told apart by position, not
by id; only id and text are read; no training rows give add-one counts of zero.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

END = "\n"
HOT_WORDS = 1 << 18
FLUSH = 400_000
PRIOR_MASS = 32_000.0
_START = 255  # never a byte of UTF-8; stands before each word
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (word start: 0xFF) and prior probabilities from the file's scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    size = model.get_piece_size()
    for i in range(size):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            weight.setdefault(bytes([int(piece[3:-1], 16)]), 1.0 / (size + 10))
            continue
        raw = bytes([_START]) * piece.startswith("\u2581") + piece.removeprefix("\u2581").encode()
        if raw and "\u2581" not in piece[1:]:
            weight[raw] = 1.0 / (min(-score, size) + 10)
    weight.setdefault(bytes([_START]), 1.0 / (size + 10))
    pieces = list(weight)
    prior = np.array([weight[p] for p in pieces])
    return pieces, prior / prior.sum()


class Lattice:
    """Scores words of one length together; pieces are found by rolling hashes in an open table."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.lengths = sorted({len(p) for p in pieces})
        keys = []
        for p in pieces:
            h = 0
            for b in p:
                h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            keys.append(h)
        self.keys = np.zeros((1 << _SLOTS) + 64, dtype=np.uint64)
        self.ids = np.full((1 << _SLOTS) + 64, -1, dtype=np.int32)
        self.probes = 1
        for i, h in enumerate(keys):
            s = at = (h * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> (64 - _SLOTS)
            while self.ids[at] >= 0:
                at += 1
            self.keys[at], self.ids[at] = h, i
            self.probes = max(self.probes, at - s + 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.ids[slot], -1)
        for p in range(1, self.probes):
            out = np.where(self.keys[slot + p] == h, self.ids[slot + p], out)
        return out

    def arcs(self, words: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """(length, piece id at each start [words, starts]) for words of one length."""
        size = len(words[0]) + 1
        symbols = np.full((len(words), size), _START, dtype=np.uint64)
        symbols[:, 1:] = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), size - 1)
        sums = np.zeros((len(words), size + 1), dtype=np.uint64)
        for j in range(size):
            sums[:, j + 1] = sums[:, j] * _BASE + symbols[:, j] + np.uint64(1)
        out = []
        for n in self.lengths:
            if n <= size:
                ids = self.find(sums[:, n:] - sums[:, : size + 1 - n] * np.uint64(pow(int(_BASE), n, 1 << 64)))
                if (ids >= 0).any():
                    out.append((n, ids))
        return out

    def forward(self, arcs: list, logs: np.ndarray, rows: int, size: int) -> np.ndarray:
        alpha = np.full((size + 1, rows), -np.inf)
        alpha[0] = 0.0
        for j in range(1, size + 1):
            terms = np.stack([alpha[j - n] + logs[ids[:, j - n]] for n, ids in arcs if n <= j])
            top = terms.max(axis=0)
            alpha[j] = top + np.log(np.exp(terms - np.where(np.isfinite(top), top, 0.0)).sum(axis=0))
        return alpha

    def backward(self, arcs: list, logs: np.ndarray, rows: int, size: int) -> np.ndarray:
        beta = np.full((size + 1, rows), -np.inf)
        beta[size] = 0.0
        for i in range(size - 1, -1, -1):
            terms = np.stack([beta[i + n] + logs[ids[:, i]] for n, ids in arcs if i + n <= size])
            top = terms.max(axis=0)
            beta[i] = top + np.log(np.exp(terms - np.where(np.isfinite(top), top, 0.0)).sum(axis=0))
        return beta

    @staticmethod
    def batches(words: list[bytes]):
        """Places of words in groups of one length and bounded size."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, places in by.items():
            step = max(1, (1 << 17) // (n + 1))
            for at in range(0, len(places), step):
                yield places[at : at + step]

    def score(self, words: list[bytes], logs: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        padded = np.append(logs, -np.inf)
        out = np.zeros(len(words))
        with np.errstate(divide="ignore", invalid="ignore"):
            for places in self.batches(words):
                chosen = [words[i] for i in places]
                out[places] = self.forward(self.arcs(chosen), padded, len(chosen), len(chosen[0]) + 1)[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece."""
        padded = np.append(logs, -np.inf)
        out = np.zeros(self.n)
        with np.errstate(divide="ignore", invalid="ignore"):
            for places in self.batches(words):
                chosen = [words[i] for i in places]
                size, arcs = len(chosen[0]) + 1, self.arcs(chosen)
                alpha, beta = (f(arcs, padded, len(chosen), size) for f in (self.forward, self.backward))
                weight = np.log(counts[places]) - alpha[-1]
                for n, ids in arcs:
                    row, start = np.nonzero(ids >= 0)
                    piece = ids[row, start]
                    share = np.exp(alpha[start, row] + padded[piece] + beta[start + n, row] + weight[row])
                    out += np.bincount(piece, weights=np.nan_to_num(share), minlength=self.n)
        return out


@lru_cache(maxsize=2)
def _lattice(pieces: tuple[bytes, ...]) -> Lattice:
    return Lattice(list(pieces))


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, c, c_all): counts over training rows and over all rows; the end symbol is a word. Tasks count
    before the shuffle and never hold more than a bounded number of words."""

    def run(batches):
        train: Counter = Counter()
        rest: Counter = Counter()

        def flush():
            names = list(train.keys() | rest.keys())
            c = [train[w] for w in names]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(c, pa.int64()), pa.array([x + rest[w] for x, w in zip(c, names)], pa.int64())], names=["word", "c", "c_all"])
            train.clear(), rest.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                into = rest if held_out(i) else train
                into.update(_words(text))
                into[b"\n"] += 1
                if len(train) + len(rest) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, "word string, c bigint, c_all bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def piece_weights(counts: DataFrame, pieces: list[bytes], prior: np.ndarray, ends: int, rounds: int) -> tuple[np.ndarray, float]:
    """(natural logs of the pieces' weights, log10 of the end symbol's) after ``rounds`` of expectation-maximisation
    over ``counts`` (word, c). At most one sum a piece reaches the driver in a round."""
    sc = counts.sparkSession.sparkContext
    words = counts.where((F.col("c") > 0) & (F.col("word") != END)).select("word", "c")
    logs, uses = np.log(prior), None
    for _ in range(rounds):
        held = sc.broadcast((tuple(pieces), logs))

        def expect(batches, held=held):
            names, logs = held.value
            lattice, sums = _lattice(names), np.zeros(len(names))
            for batch in batches:
                sums += lattice.expected([w.encode() for w in batch.column(0).to_pylist()], batch.column(1).to_numpy().astype(float), logs)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["piece", "n"])

        got = words.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        uses = np.zeros(len(pieces))
        uses[got["piece"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
        held.unpersist()
        # the end symbol takes no part in the lattice: its share is set aside below
        logs = np.log((uses + PRIOR_MASS * prior) / (uses.sum() + PRIOR_MASS))
    mass = PRIOR_MASS + (0.0 if uses is None else uses.sum())
    whole = mass + ends + 1
    return logs + math.log(mass / whole), math.log10((ends + 1) / whole)


def corpus_scores(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 0, whole_words: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; scores are log10."""
    sc = docs.sparkSession.sparkContext
    counts = staged(count_words(docs, id_col, text_col))
    row = counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("v"), F.sum("c_all").alias("all"), F.sum(F.when(F.col("word") == END, F.col("c")).otherwise(0)).alias("ends")).first()
    total, distinct, everything, ends = (row[k] or 0 for k in ("n", "v", "all", "ends"))
    pieces, prior = vocabulary(vocabulary_path)
    logs, log_end = piece_weights(counts, pieces, prior, ends, rounds)
    model = sc.broadcast((tuple(pieces), logs))

    def score(batches):
        names, logs = model.value
        lattice = _lattice(names)
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            marginal = np.full(len(words), log_end)
            real = [i for i, w in enumerate(words) if w != END]
            marginal[real] = lattice.score([words[i].encode() for i in real], logs) / math.log(10)
            if whole_words:
                with np.errstate(divide="ignore"):  # a new word has no arc of its own
                    marginal = (np.logaddexp(np.log(c), math.log(distinct + 1) + marginal * math.log(10)) - math.log(total + distinct + 1)) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(c > 0), pa.array(np.log10(c + 1.0)), pa.array(marginal)], names=["word", "c_all", "known", "base", "marginal"])

    scored = staged(counts.select("word", "c", "c_all").mapInArrow(score, "word string, c_all bigint, known boolean, base double, marginal double"))
    floor = max(1, -(-everything // HOT_WORDS))
    top = scored.where(F.col("c_all") >= floor).toPandas()  # at most HOT_WORDS rows: each is 1/HOT_WORDS of all tokens
    hot = sc.broadcast((top["word"].tolist(), top["known"].to_numpy(), top["base"].to_numpy(), top["marginal"].to_numpy()))
    kind = docs.schema[id_col].dataType.simpleString()
    denominator = math.log10(total + distinct + 1)

    def weigh(batches):
        from pyspark import TaskContext

        words, known, base, marginal = hot.value
        place = {w.encode(): i for i, w in enumerate(words)}
        known = known.astype(np.int64)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            heads: list[tuple] = []
            tails: tuple[list, list, list] = ([], [], [])
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rid += 1
                found = Counter(_words(text))
                found[b"\n"] += 1
                at = [place.get(w, -1) for w in found]
                tf = list(found.values())
                far = [(w, c) for w, c, k in zip(found, tf, at) if k < 0]
                near, times = np.array(at), np.array(tf)
                near, times = (near[near >= 0], times[near >= 0]) if far else (near, times)
                n = sum(tf)
                heads.append((rid, f"\n{rid}", i, held_out(i), n, int(times @ known[near]), float(times @ base[near]) - n * denominator, float(times @ marginal[near])))
                if far:
                    words_, counts_ = zip(*far)
                    tails[0].extend([rid] * len(far))
                    tails[1].extend(words_)
                    tails[2].extend(counts_)
            names = ["rid", "word", "tf", "id", "held_out", "n_tokens", "n_known", "base_score", "score"]
            kinds = [pa.int64(), pa.string(), batch.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*heads) if heads else [()] * 8, kinds)]
            yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(np.zeros(len(heads), dtype=np.int64)), *columns[2:]], names=names)
            m = len(tails[0])
            zero, none = np.zeros(m, dtype=np.int64), np.zeros(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tails[0], pa.int64()), pa.array(tails[1], pa.string()), pa.array(tails[2], pa.int64()), pa.nulls(m, kinds[2]), pa.nulls(m, pa.bool_()), pa.array(zero), pa.array(zero), pa.array(none), pa.array(none)],
                names=names,
            )

    rows = docs.select(id_col, text_col).mapInArrow(weigh, f"rid bigint, word string, tf bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    rare = scored.where(F.col("c_all") < floor).select(F.col("word").alias("_w"), "known", "base", "marginal")
    joined = rows.join(rare, F.col("word") == F.col("_w"), "left")
    add = lambda c, more: F.sum(F.col(c) + F.coalesce(F.col("tf") * more, F.lit(0))).alias(c)
    by = joined.groupBy("rid").agg(F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), add("n_known", F.col("known").cast("bigint")), F.lit(total).cast("bigint").alias("train_tokens"), add("base_score", F.col("base")), add("score", F.col("marginal")))
    return by.drop("rid")
