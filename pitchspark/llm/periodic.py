"""Periodic run detection (11): string synchronising sets at dyadic scales, with highly periodic regions apart.

A run is a maximal stretch of words with smallest period q and at least two periods. All runs of a text are found:

* Periods under ``DIRECT`` by comparing the text with itself shifted: these are the highly periodic regions of scale 4.
* Periods from 4t to under 8t, for t = 4, 8, 16, ...: a position is in the synchronising set where the smallest hash of a
  window of t words, among the t + 1 windows from it on, is the first or the last of them; windows inside a run of a period
  of at most t / 3 have no say. The choice depends on the next 2t words alone, so equal contexts are chosen alike, and
  equal contexts of chosen positions lie at least t / 3 apart. Every pair of equal contexts that are 4t to 8t apart proposes its
  distance as a period.
* A run whose first period holds no chosen position has a first period that is itself periodic with some q of at most
  t / 3. Then its two halves lie in two adjacent regions of one period q and one root, which propose every distance that
  keeps the phase of the root.

Proposals are extended to both sides by binary search on fingerprints of any length, from running sums modulo two primes. Of
equal stretches the smallest period stays. Scales rise, so the smaller periods that a scale asks for are known.

Many texts are worked on at once, longest first, one after the other with a separator of its own behind each.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices

#: Smallest period that is searched by synchronising sets, and the words that a reported run has at least.
DIRECT, LEAST = 16, 12
_PRIMES = (np.int64(2147483647), np.int64(2147483629))
_BASES = (np.int64(1103515245 % 2147483647), np.int64(907633385))
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Fingerprints:
    """Hashes of any stretch of ``words`` by two running sums modulo primes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums, self.powers = [], []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            power = np.ones(n + 1, np.int64)
            done = 1
            while done <= n:  # powers double: each step multiplies what is known by the next power
                step = min(done, n + 1 - done)
                power[done : done + step] = power[:step] * (power[done - 1] * base % prime) % prime
                done += step
            value = (words.view(np.uint64) % np.uint64(prime)).astype(np.int64)
            # n * prime stays under 2**63
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[:n] % prime)]) % prime)
            self.powers.append(power)

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` words from a and from b, a before b, agree."""
        same = np.ones(len(a), bool)
        for prime, sums, power in zip(_PRIMES, self.sums, self.powers, strict=True):
            same &= (sums[a + size] - sums[a]) % prime * power[b - a] % prime == (sums[b + size] - sums[b]) % prime
        return same

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a and from b on agree, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            ok = self.equal(a[open_], b[open_], middle)
            low[open_[ok]] = middle[ok]
            high[open_[~ok]] = middle[~ok] - 1
        return low

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words just before a and before b agree, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            ok = self.equal(a[open_] - middle, b[open_] - middle, middle)
            low[open_[ok]] = middle[ok]
            high[open_[~ok]] = middle[~ok] - 1
        return low


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` words (a power of two), from hashes of its halves."""
    h, width = mix(words.view(np.uint64) + np.uint64(1)), 1
    while width < size:
        h = mix(h[:-width] * _STEP + h[width:])
        width *= 2
    return h


def synchronising_set(windows: np.ndarray, t: int, apart: np.ndarray) -> np.ndarray:
    """Positions whose smallest window hash among the next t + 1 is the first or the last; ``apart`` windows have no say."""
    none = np.uint64(np.iinfo(np.uint64).max)
    ids = np.where(apart, none, windows)
    low, width = ids, 1
    while width < t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    last = ids[t:]
    low = np.minimum(low[: len(last)], last)
    return np.flatnonzero(((ids[: len(last)] == low) | (last == low)) & (low != none))


def _equal_contexts(at: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of all pairs of equal contexts from 4t to under 8t apart; ``at`` is ascending."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    starts, periods = [], []
    step = 1
    while step < len(at):
        same = context[step:] == context[:-step]
        gap = at[step:] - at[:-step]
        if not (same & (gap < 8 * t)).any():
            break  # places of one context ascend, so further ones are further apart
        good = same & (gap >= 4 * t) & (gap < 8 * t)
        starts.append(at[:-step][good])
        periods.append(gap[good])
        step += 1
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def _adjacent_regions(words: np.ndarray, runs: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of squares from 4t to under 8t whose halves lie in two adjacent regions of one root.

    ``runs`` are (start, end, period). The phase of a root is where its smallest rotation begins.
    """
    long = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= 4 * t)]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    met = np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 1]))
    starts, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in met:
        (b, x, q), (b2, x2, _) = long[k].tolist(), long[k + 1].tolist()
        phases, roots = [], []
        for begin in (b, b2):
            turns = words[begin : begin + q].tolist() * 2
            first = min(range(q), key=lambda i: turns[i : i + q]) if q <= 64 else _least_rotation(turns[:q])
            phases.append(begin + first)
            roots.append(turns[first : first + q])
        if roots[0] != roots[1]:
            continue
        most = min(x - b, x2 - b2, 8 * t - 1)
        rest = (phases[1] - phases[0]) % q
        p = np.arange(rest + -(-max(0, 4 * t - rest) // q) * q, most + 1, q)
        p = p[np.maximum(b, b2 - p) <= np.minimum(x - p, x2 - 2 * p)]
        starts.append(x - p)  # x is in the second half of every such square
        periods.append(p)
    return np.concatenate(starts), np.concatenate(periods)


def _least_rotation(s: list) -> int:
    """Where the smallest rotation of ``s`` begins, by comparing two candidates at a time."""
    n, i, j, k = len(s), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = s[(i + k) % n], s[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    return min(i, j)


def _stretches(equal: np.ndarray, p: int) -> np.ndarray:
    """(start, end, p) of the maximal runs of at least p true values, ends p further on."""
    edge = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= p
    return np.stack([start[long], end[long] + p, np.full(int(long.sum()), p)], axis=1)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of equal stretches that with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs


def all_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of every run of at least two periods in texts that stand one after the other, longest first.

    ``words``: their word hashes (int64), with one separator behind each text that equals no other word.
    """
    n = len(words)
    runs = [np.empty((0, 3), np.int64)]
    offs = np.concatenate([[0], np.cumsum(sizes + 1)])
    for p in range(1, min(DIRECT, int(sizes[0]) // 2 + 1)):
        upto = offs[np.searchsorted(-sizes, -2 * p, "right")]  # texts of fewer than 2p words have no such run
        runs.append(_stretches(words[: upto - p] == words[p:upto], p))
    found = _smallest(np.concatenate(runs))
    prints, t = None, DIRECT // 4
    while 8 * t <= sizes[0]:
        own = words[: offs[np.searchsorted(-sizes, -8 * t, "right")]]
        windows = _windows(own, t)
        calm = found[(found[:, 2] * 3 <= t) & (found[:, 1] - found[:, 0] >= t) & (found[:, 1] <= len(own))]
        depth = np.zeros(len(windows) + 1, np.int64)
        np.add.at(depth, calm[:, 0], 1)
        np.add.at(depth, calm[:, 1] - t + 1, -1)
        chosen = synchronising_set(windows, t, np.cumsum(depth)[:-1] > 0)
        context = mix(windows[:-t] * _STEP + windows[t:])[chosen]
        start, period = _equal_contexts(chosen, context, t)
        more = _adjacent_regions(words, found, t)
        start, period = np.concatenate([start, more[0]]), np.concatenate([period, more[1]])
        if len(start):
            prints = prints or Fingerprints(words)
            text = np.searchsorted(offs, start, "right") - 1
            inside = start + period < offs[text + 1] - 1
            start, period, text = start[inside], period[inside], text[inside]
            left = prints.backward(start, start + period, start - offs[text])
            right = prints.forward(start, start + period, offs[text + 1] - 1 - start - period)
            long = left + right >= period
            stretch = np.stack([start - left, start + period + right, period], axis=1)[long]
            found = _smallest(np.concatenate([found, stretch]))
        t *= 2
    return found


def periodised(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """``words`` with the planted tail of every tenth document: from word a on they repeat with period p."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


COLUMNS = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def _judge(ids: list, texts: list[str | None], planted: bool, outputs: bool) -> list[tuple]:
    """The rows of ``COLUMNS``; runs and collapsed texts are null without ``outputs``."""
    lists = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at ASCII white space alone
    if planted:
        lists = [periodised(w, i) for w, i in zip(lists, ids, strict=True)]
    order = sorted(range(len(lists)), key=lambda k: -len(lists[k]))
    sizes = np.array([len(lists[k]) for k in order], np.int64)
    offs = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.empty(offs[-1], np.int64)
    for k, at, size in zip(order, offs, sizes, strict=False):
        words[at : at + size] = np.fromiter(map(hash, lists[k]), np.int64, size)
        # a separator: no word hashes to it but by a chance of 2**-64
        words[at + size] = mix(np.array([at + 0x5EA5], np.uint64)).view(np.int64)[0]
    runs = all_runs(words, sizes) if len(sizes) and sizes[0] >= LEAST else np.empty((0, 3), np.int64)
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST]
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone)[:-1] == 0
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    bounds = np.searchsorted(runs[:, 0], offs)
    out = [None] * len(lists)
    for k, at, size, i, j in zip(order, offs, sizes, bounds[:-1], bounds[1:], strict=False):
        own = [(s - at, e - s, q) for s, e, q in runs[i:j].tolist()]
        best = max(own, key=lambda r: (r[1], -r[0], -r[2])) if own else None
        stay = lists[k] if not own else [w for w, keep in zip(lists[k], kept[at : at + size].tolist(), strict=True) if keep]
        text = b" ".join(stay)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
        out[k] = (
            ids[k], int(size), len(own), *((int(best[0]), best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
            [{"start": int(s), "length": n, "period": q} for s, n, q in own] if outputs else None, text.decode("utf-8", "replace") if outputs else None,
        )
    return out


def periodic_runs(docs: DataFrame, planted: bool = False, outputs: bool = True) -> DataFrame:
    """A row a row of ``docs`` (doc_id, text) with ``COLUMNS``: its runs of at least ``LEAST`` words, the longest one, and its words
    less those that any run repeats, joined by one space.

    ``planted`` periodises every tenth document first, as the benchmark of this operator asks; ``outputs`` adds runs and
    texts to their hashes. A null or empty text has no words and no run: nulls, and the hashes of the empty string. A very long
    text is one row of a task and takes some 150 bytes a word. Null and repeated ids are rows like others; a null id is never
    periodised. An empty table gives an empty result. Other columns are ignored.
    """
    names = [c.strip().split(" ")[0] for c in COLUMNS.split(", ")]

    def run(batches):
        for batch in (s for b in batches for s in slices(b)):
            rows = _judge(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), planted, outputs)
            fields = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(fields)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)
    return rows if outputs else rows.drop("runs", "collapsed")
