"""LM scoring (1): masked pseudo-likelihood of a bidirectional window network trained in numpy on the whole corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, slices, stored, word_hashes

#: Words whose counts are gathered; those of the rest stay in a table and are joined.
VOCABULARY = 4096
#: Rows of the input table: one a word of the vocabulary, HASHED that the other words share by hash, and the pad.
HASHED = 4096
INPUTS = VOCABULARY + HASHED
PAD = INPUTS
#: The network predicts one of CLASSES: a frequent word each, clusters of the vocabulary's other words, shared by the rest.
OWN, SHARED, OUTSIDE = 64, 48, 16
CLASSES = OWN + SHARED + OUTSIDE
REACH, WIDTH = 2, 16
BATCH, RATE = 2048, 3.2
#: Rounds of averaging, each over its own share of the texts, and the words that a training part has about.
ROUNDS, PART_WORDS = 4, 1 << 22
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
SHAPES = [(INPUTS + 1, WIDTH), (len(OFFSETS), WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,)]
ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES])


@dataclass
class Words:
    """Hashes of the vocabulary (sorted), their input rows, classes and log P(word | class).

    Of the words outside, by class: log P of any, and what log n adds up with to the log P of a word seen n times.
    """

    hashes: np.ndarray
    rows: np.ndarray
    classes: np.ndarray
    logs: np.ndarray
    outside_logs: np.ndarray
    outside_masses: np.ndarray
    class_logs: np.ndarray
    total: int

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input row, class and log P(word | class) of each hashed word."""
        outside = (h % np.uint64(OUTSIDE)).astype(np.int64)
        rows = INPUTS - HASHED + (h // np.uint64(OUTSIDE) % np.uint64(HASHED)).astype(np.int64)
        classes, logs = OWN + SHARED + outside, self.outside_logs[outside]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            rows, classes, logs = np.where(known, self.rows[at], rows), np.where(known, self.classes[at], classes), np.where(known, self.logs[at], logs)
        return rows, classes, logs


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n: hashed words of all texts and how often they occur."""

    def run(batches):
        for batch in (s for b in batches for s in slices(b, 1 << 23)):
            h, n = np.unique(word_hashes(batch.column("text").to_pylist(), NOT_SPACE)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _neighbours(docs: DataFrame, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary stands beside each of the OWN most frequent words, or beside others."""
    wide = OWN + 1

    def run(batches):
        seen = np.zeros(VOCABULARY * wide, np.int64)
        for batch in (s for b in batches for s in slices(b)):
            h, counts = word_hashes(batch.column("text").to_pylist(), NOT_SPACE)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            row, places = _padded(np.where(hashes[at] == h, rows[at], VOCABULARY), counts, VOCABULARY)
            own = row[places]
            for step in (-1, 1):
                cells = own * wide + np.minimum(row[places + step], OWN)
                seen += np.bincount(cells[own < VOCABULARY], minlength=len(seen))
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(seen[cells])], ["cell", "n"])

    found = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY * wide)
    out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy()
    return out.reshape(VOCABULARY, wide)


def clusters(beside: np.ndarray, weights: np.ndarray, k: int = SHARED, rounds: int = 12) -> np.ndarray:
    """A cluster of each row of ``beside``: weighted k-means of the roots of its shares, from rows spread over the list."""
    share = np.sqrt(beside / np.maximum(beside.sum(1, keepdims=True), 1))
    centres = share[np.linspace(0, max(len(share) - 1, 0), k).astype(int)] if len(share) else np.zeros((k, beside.shape[1]))
    near = np.zeros(len(share), np.int64)
    for _ in range(rounds):
        near = (share @ centres.T - (centres**2).sum(1) / 2).argmax(1) if len(share) else near
        for c in range(k):
            if (near == c).any():
                centres[c] = np.average(share[near == c], axis=0, weights=weights[near == c])
    return near


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Words:
    """From the counts of all words; ``VOCABULARY`` rows with their neighbours and ``OUTSIDE`` sums come to the driver."""
    counts = stored(word_counts(docs), "words") if counts is None else counts
    top = counts.orderBy(F.desc("n"), "h").limit(VOCABULARY).toPandas()
    h, n = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.float64)
    rank, order = np.arange(len(h)), np.argsort(h)
    classes = rank.copy()
    if len(h) > OWN:
        beside = _neighbours(docs, h[order], rank[order])[OWN : len(h)]
        classes[OWN:] = OWN + clusters(beside, n[OWN:])
    mass = np.bincount(classes, n, CLASSES)
    bucket = F.pmod(F.col("h"), F.lit(OUTSIDE)).cast("int")
    rest = np.zeros((OUTSIDE, 2))
    known = counts.sparkSession.createDataFrame(top[["h"]], "h long")
    for r in counts.join(F.broadcast(known), "h", "left_anti").groupBy(bucket.alias("b")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect():
        rest[r.b] = r.kinds, r.n
    mass[OWN + SHARED :] = rest[:, 1]
    logs = np.log(n / mass[classes]) if len(h) else n
    class_logs = np.log((mass + 1) / (mass.sum() + CLASSES))
    outside = -np.log(np.maximum(rest[:, 0], 1)), -np.log(np.maximum(rest[:, 1], 1))
    return Words(h[order], rank[order], classes[order], logs[order], *outside, class_logs, int(mass.sum()))


def outside_words(counts: DataFrame, words: Words) -> DataFrame:
    """h, more: words outside the vocabulary, and their own log P(word | class) less that of any outside word."""
    known = counts.sparkSession.createDataFrame([(int(h),) for h in words.hashes.view(np.int64)], "h long")
    shift = F.array(*[F.lit(float(x)) for x in words.outside_masses - words.outside_logs])
    return counts.join(F.broadcast(known), "h", "left_anti").select("h", (F.log("n") + F.get(shift, F.pmod("h", F.lit(OUTSIDE)).cast("int"))).alias("more"))


def start_parameters(words: Words, seed: int = 7) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    table, scale, bias, output, _ = (rng.normal(0, 0.1, s).astype(np.float32) for s in SHAPES)
    return [table, scale + 1, bias * 0, output, words.class_logs.astype(np.float32)]


def _forward(p: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (offset, word, width), hidden layer and logits less their maximum; ``context`` has a row an offset."""
    table, scale, bias, output, base = p
    inputs = table[context]
    hidden = np.tanh(np.einsum("jbw,jw->bw", inputs, scale) + bias)
    z = hidden @ output
    z += base
    z -= z.max(1, keepdims=True)
    return inputs, hidden, z


def _padded(values: np.ndarray, counts: np.ndarray, pad: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one row with REACH pads around each, and the places of their words."""
    shift = REACH * (1 + np.repeat(np.arange(len(counts)), counts))
    at = np.arange(len(values)) + shift
    row = np.full(len(values) + REACH * (len(counts) + 1), pad)
    row[at] = values
    return row, at


def train_on(p: list[np.ndarray], rows: np.ndarray, classes: np.ndarray, counts: np.ndarray, rate: float = RATE) -> None:
    """One pass of mini-batch gradient steps, in place: each word's class is predicted from REACH words on both sides."""
    row, at = _padded(rows, counts)
    for a in range(0, len(at), BATCH):
        here = at[a : a + BATCH]
        context = np.stack([row[here + o] for o in OFFSETS])
        inputs, hidden, z = _forward(p, context)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(here)), classes[a : a + BATCH]] -= 1
        z *= rate / BATCH
        back = (z @ p[3].T) * (1 - hidden * hidden)
        p[3] -= hidden.T @ z
        p[4] -= z.sum(0)
        p[2] -= back.sum(0)
        step = back * p[1][:, None, :]
        p[1] -= np.einsum("jbw,bw->jw", inputs, back)
        # the table's rows are stepped once each: sums over the places that hold them
        at_row = context.ravel().astype(np.int16)
        order = np.argsort(at_row, kind="stable")
        first = np.flatnonzero(np.diff(at_row[order], prepend=-1))
        p[0][at_row[order][first]] -= np.add.reduceat(step.reshape(-1, WIDTH)[order], first)


def train(docs: DataFrame, words: Words, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Parameters after one pass over all texts in ``rounds`` of falling rate, each over the texts of its own share.

    A text belongs to a part by a hash of its id and itself, so parts, their order and the result do not depend on how
    ``docs`` is partitioned; there are as many parts as ``PART_WORDS`` asks for. Each part trains from the round's
    start, and parameters are averaged by words in a shuffle; the driver gets one value a parameter, whatever the input.
    """
    p = start_parameters(words)
    parts = max(1, round(words.total / rounds / PART_WORDS))
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).withColumn("part", F.pmod("h", F.lit(parts * rounds)).cast("int"))
    for number in range(rounds):

        def run(batches, p=p, rate=RATE / (1 + number)):
            part, own, n = None, None, 0

            def done():
                flat = np.concatenate([x.ravel() for x in own]).astype(np.float64)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * n), pa.array(np.full(len(flat), float(n)))], ["i", "v", "w"])

            for batch in (s for b in batches for s in slices(b, 1 << 20)):
                every = batch.column("part").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(every)) + 1), len(every)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if every[a] != part:
                        if n:
                            yield done()
                        part, own, n = every[a], [x.copy() for x in p], 0
                    h, counts = word_hashes(batch.column("text").slice(a, b - a).to_pylist(), NOT_SPACE)
                    train_on(own, *words.of(h)[:2], counts, rate)
                    n += len(h)
            if n:
                yield done()

        texts = hashed.where(F.col("part") % rounds == number)
        texts = texts.repartitionById(parts, F.floor(F.col("part") / rounds).cast("int")).sortWithinPartitions("part", "h")
        rows = texts.mapInArrow(run, "i long, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).toPandas()
        if len(rows):
            flat = rows.sort_values("i")["v"].to_numpy().astype(np.float32)
            p = [x.reshape(s) for x, s in zip(np.split(flat, ENDS[:-1]), SHAPES, strict=True)]
    return p


def text_scores(p: list[np.ndarray], words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and summed conditional log-probability of each text, outside words as any of their class."""
    h, counts = word_hashes(texts, NOT_SPACE)
    return counts, _sums(p, *words.of(h), counts)


def _sums(p: list[np.ndarray], rows: np.ndarray, classes: np.ndarray, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    row, at = _padded(rows, counts)
    total = logs.astype(np.float64)
    for a in range(0, len(at), BATCH):
        here = at[a : a + BATCH]
        z = _forward(p, np.stack([row[here + o] for o in OFFSETS]))[2]
        picked = z[np.arange(len(here)), classes[a : a + BATCH]].astype(np.float64)
        np.exp(z, out=z)
        total[a : a + BATCH] += picked - np.log(z.sum(1))
    sums = np.add.reduceat(np.append(total, 0.0), np.minimum(np.cumsum(counts) - counts, len(total))) if len(counts) else total
    return np.where(counts > 0, sums, 0.0)


def _outside(h: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Hashes of the outside words of each text."""
    out = classes >= OWN + SHARED
    upto = np.append(0, np.cumsum(out))[np.append(0, np.cumsum(counts))]
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(h[out].view(np.int64)))


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, pll, pll_per_token for every row of ``docs``.

    Each word is masked and predicted from ``REACH`` words on both sides: a softmax over word classes, times the
    word's share of its class. Counts and parameters come from all texts; every word has its own count, which is
    joined from the table of all counts where the word is outside the gathered vocabulary.

    Null or empty texts have n_tokens 0, pll 0 and a null mean. Very long texts are hashed in parts and scored in
    batches. Null ids stay null; repeated rows are scored each. An empty table gives an empty result. Other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = stored(word_counts(docs), "words")
    words = vocabulary(docs, counts)
    p = train(docs, words, rounds)

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in (s for b in batches for s in slices(b)):
            h, n = word_hashes(batch.column("text").to_pylist(), NOT_SPACE)
            inputs, classes, logs = words.of(h)
            rows = pa.array(np.arange(row, row + len(n)))
            row += len(n)
            sums = pa.array(_sums(p, inputs, classes, logs, n))
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), pa.array(n), sums, _outside(h, classes, n)], ["row", "doc_id", "n_tokens", "pll", "outside"])

    scored = stored(docs.mapInArrow(run, "row long, doc_id long, n_tokens long, pll double, outside array<long>"), "scores")
    more = scored.select("row", F.explode("outside").alias("h")).join(outside_words(counts, words), "h").groupBy("row").agg(F.sum("more").alias("more"))
    out = scored.drop("outside").join(more, "row", "left").select("doc_id", "n_tokens", (F.col("pll") + F.coalesce("more", F.lit(0.0))).alias("pll"))
    return out.withColumn("pll_per_token", F.col("pll") / F.nullif(F.col("n_tokens"), F.lit(0)))
