"""Shared helpers: tables, row numbers and vectorised word hashing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import dropped, scratch_dir, stored

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_STEP = _U(0xD6E8FEB86659FD93)
CHUNK = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stored tables of up to so many rows of a few numbers each are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """A ``stored`` table, marked for broadcast where its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: What tells rows apart, whose doc_id may be null or repeated: the id and 128 bits of the text. Rows that agree in all are alike.
ROW = ["_doc", "_text", "_more"]


def row_key() -> list[Column]:
    """The columns of ``ROW`` for a select on documents; whatever else these hold is not in their way."""
    return [F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"), F.xxhash64(F.lit(1), "text").alias("_more")]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of ``ROW``, and ``_row``: the whole row of ``docs``, whose columns may have any names."""
    return docs.select(*row_key(), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"))


def on_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins by ``ROW``, null ids included; the columns of ``ROW`` are those of ``left``."""
    right = right.withColumnsRenamed({c: f"_r{c}" for c in ROW})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in ROW])
    return left.join(right, same, how).drop(*[f"_r{c}" for c in ROW])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Word bytes: everything but ASCII white space; ASCII letters and digits with all non-ASCII bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def _hash_run(raw: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(raw, np.uint8)
    word = is_word[a]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lens = ends - starts
    powers = np.multiply.accumulate(np.full(int(lens.max()), _BASE, np.uint64))
    at = np.flatnonzero(word)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)
    values = _BYTE[a[at]] * powers[inside]
    sums = np.add.reduceat(values, np.cumsum(lens) - lens)
    return mix(sums + lens.astype(np.uint64)), starts


def word_hashes(texts: list[str | None], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` after lower-casing A-Z, and the number of words of each text.

    Works on about ``CHUNK`` bytes at once; a longer text is cut between words, so memory stays at
    eight bytes a word plus a constant.
    """
    parts, counts = [], np.zeros(len(texts), np.int64)
    held, size, first = [], 0, 0

    def flush(upto: int) -> None:
        nonlocal held, size, first
        if held:
            hashes, starts = _hash_run(b"\n".join(held), is_word)
            parts.append(hashes)
            bounds = np.cumsum([0] + [len(x) + 1 for x in held])
            counts[first:upto] += np.diff(np.searchsorted(starts, bounds))
        held, size, first = [], 0, upto

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if len(raw) <= CHUNK:
            held.append(raw)
            size += len(raw)
            if size > CHUNK:
                flush(i + 1)
            continue
        flush(i)
        at = 0
        while at < len(raw):
            end = min(at + CHUNK, len(raw))
            while end < len(raw) and is_word[raw[end]]:
                end += 1
            hashes, _ = _hash_run(raw[at:end], is_word)
            parts.append(hashes)
            counts[i] += len(hashes)
            at = end
        first = i + 1
    flush(len(texts))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), counts


def count_words(texts: list[str | None], is_word: np.ndarray) -> np.ndarray:
    """Number of words of each text; ``is_word`` has lower-case letters, so texts are lower-cased A-Z first."""
    out = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            word = is_word[np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)]
            out[i] = int(word[0]) + np.count_nonzero(word[1:] & ~word[:-1])
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive words of one text; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), _U(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += words[j : j + n] * factor
            factor = factor * _STEP
        return mix(total + _U(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text: ``k`` words each, or the whole text where it is shorter."""
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words


def slices(batch: pa.RecordBatch, most: int = 1 << 21):
    """Rows of a batch in runs of about ``most`` bytes of text, one row at least."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column("text")).to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most)))
        yield batch.slice(at, end - at)
        at = end
