"""Toxicity from averaged subword vectors and a linear softmax, trained jointly."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pieces import in_blocks
from .shingles import shingle_sets

WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 21
GRAMS = (3, 4, 5, 6)
#: A long text is as toxic as its strongest part of about so many words: a mean over thousands hides a few.
PART_WORDS = 250
#: Distinct words whose scores a task keeps.
TABLE_LIMIT = 200_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all character n-grams of each word between marks, and of the word itself."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(m) for m in marked])
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = end[owner] - np.arange(len(code))
    step, rows, buckets = np.uint64(0x9E3779B97F4A7C15), [], []
    value = _mix(code + np.uint64(1))
    for n in GRAMS:
        if len(code) < n:
            break
        at = np.flatnonzero(left[: len(code) - n + 1] >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * step + value[at + j]
        rows.append(owner[at]), buckets.append(_mix(h))
    # the whole word: order-dependent sum of its characters
    place = np.arange(len(code)) - (end - size)[owner]
    whole = np.add.reduceat(_mix(value + place.astype(np.uint64) * step), end - size) if len(words) else np.empty(0, np.uint64)
    rows.append(np.arange(len(words))), buckets.append(_mix(whole))
    return np.concatenate(rows), (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight): a text's share of each subword, the mean over words of the mean over a word's subwords."""
    known: dict[str, int] = {}
    text, word, weight = [], [], []
    for i, t in enumerate(texts):
        words = words_of(t)
        if words:
            ids, counts = np.unique([known.setdefault(w, len(known)) for w in words], return_counts=True)
            text.append(np.full(len(ids), i)), word.append(ids), weight.append(counts / counts.sum())
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    owner, bucket = subwords(list(known))
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    size = np.bincount(owner, minlength=len(known))
    first = np.cumsum(size) - size
    text, word, weight = np.concatenate(text), np.concatenate(word), np.concatenate(weight)
    many = size[word]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[word], many)
    keys, where = np.unique(np.repeat(text, many) * BUCKETS + bucket[at], return_inverse=True)
    return keys // BUCKETS, keys % BUCKETS, np.bincount(where, np.repeat(weight / many, many))


def train(texts: list[str], toxic: np.ndarray, size: int = 8, epochs: int = 150, rate: float = 0.4, min_z: float = 6.0, chunk: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(bucket, value, bias): the trained model, folded.

    A text is the mean of its words' vectors, a word the mean of its subword
    vectors; the softmax over two classes is linear in that, so the log odds are a
    bias plus the mean over words of the mean of one number per subword.

    Only subwords whose share of texts differs between the classes by `min_z`
    standard errors get a vector; the others, which say nothing beyond chance, stay
    at zero like those never seen. Vectors and softmax are trained together by
    momentum on the whole sample, each vector scaled by its subword's variance.
    """
    toxic = np.asarray(toxic).astype(int)
    n = np.array([max(1, (toxic == k).sum()) for k in (0, 1)])
    have = np.zeros((2, BUCKETS), np.int32)
    parts = range(0, len(texts), chunk)
    for i in parts:
        text, bucket, _ = features(texts[i : i + chunk])
        for k in (0, 1):
            have[k] += np.bincount(bucket[toxic[i + text] == k], minlength=BUCKETS).astype(np.int32)
    every = have.sum(axis=0) / n.sum()
    error = np.sqrt(np.maximum(every * (1 - every), 1e-9) * (1 / n[0] + 1 / n[1]))
    chosen = np.flatnonzero((np.abs(have[1] / n[1] - have[0] / n[0]) >= min_z * error) & (have.sum(axis=0) >= 3))
    prior = float(np.log(((toxic == 1).sum() + 1) / ((toxic == 0).sum() + 1)))
    if not len(chosen):
        return chosen, np.empty(0), prior
    number = np.full(BUCKETS, -1)
    number[chosen] = np.arange(len(chosen))
    kept = []
    for i in parts:
        text, bucket, weight = features(texts[i : i + chunk])
        some = number[bucket] >= 0
        kept.append((i + text[some], number[bucket[some]], weight[some]))
    text, column, weight = (np.concatenate(x) for x in zip(*kept))

    mean = np.bincount(column, weight, len(chosen)) / len(texts)
    step = rate / (np.bincount(column, weight**2, len(chosen)) / len(texts) - mean**2 + 1e-12) / np.sqrt(len(chosen))
    share = np.bincount(toxic, minlength=2) / len(toxic)
    importance = (1 / np.sqrt(np.maximum(share, 1e-6)))[toxic]
    importance /= importance.sum()
    rng = np.random.default_rng(seed)
    vectors, out, bias = np.zeros((len(chosen), size)), rng.normal(0, 1 / np.sqrt(size), (size, 2)), prior
    speed, out_speed = np.zeros_like(vectors), np.zeros_like(out)
    for _ in range(epochs):
        hidden = np.stack([np.bincount(text, weight * vectors[column, j], len(texts)) for j in range(size)], axis=1)
        odds = hidden @ (out[:, 1] - out[:, 0])
        for _ in range(5):
            p = 1 / (1 + np.exp(-np.clip(odds + bias, -50, 50)))
            bias -= np.clip((importance * (p - toxic)).sum() / ((importance * p * (1 - p)).sum() + 1e-9), -2, 2)
        g = importance * (1 / (1 + np.exp(-np.clip(odds + bias, -50, 50))) - toxic)
        both = np.stack([-g, g], axis=1)
        back = np.bincount(column, weight * g[text], len(chosen))
        direction = out[:, 1] - out[:, 0]
        speed = 0.9 * speed - (step * back)[:, None] * direction / (direction @ direction)
        out_speed = 0.9 * out_speed - 0.01 * rate * (hidden.T @ both) / (np.mean(hidden**2) + 1.0)
        vectors += speed
        out += out_speed
    return chosen, vectors @ (out[:, 1] - out[:, 0]), float(bias)


def _strongest(values: np.ndarray) -> float:
    """The mean of a text's words, or that of the strongest of its even parts of at most PART_WORDS words."""
    n = len(values)
    if not n:
        return 0.0
    parts = -(-n // PART_WORDS)
    start = np.arange(parts) * n // parts
    return max(float(values.mean()), float((np.add.reduceat(values, start) / np.diff(start, append=n)).max()))


class Scorer:
    """Scores texts; a distinct word is hashed once, and once per block of texts when the table is full."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, bias: float):
        self.values = np.zeros(BUCKETS, np.float32)
        self.values[buckets] = values
        self.bias, self.table = bias, {}

    def _learn(self, words: list[str]) -> dict[str, float]:
        if not words:
            return {}
        owner, bucket = subwords(words)
        return dict(zip(words, (np.bincount(owner, self.values[bucket], len(words)) / np.bincount(owner, minlength=len(words))).tolist()))

    def scores(self, texts: list[str]) -> list[float]:
        split = [words_of(t) for t in texts]
        learnt = self._learn([w for w in set().union(*split) if w not in self.table])
        table = self.table
        if len(table) + len(learnt) <= TABLE_LIMIT:
            table.update(learnt)
        else:
            table = table | learnt
        get = table.__getitem__
        odds = self.bias + np.array([_strongest(np.fromiter(map(get, words), np.float64, len(words))) for words in split])
        return (1 / (1 + np.exp(-np.clip(odds, -500, 500)))).tolist()


def held_out(doc_id: str) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def unlike(texts: list[str], looks: int = 4) -> list[int]:
    """Numbers of texts that share none of their smallest shingles, under `looks` orders, with a text before.

    A sample with a text and its many near copies would take their chance words for a sign of the class.
    """
    seen, kept = set(), []
    for i, tokens in enumerate(s for block in in_blocks(texts, 1 << 18) for s in shingle_sets(block)):
        marks = {(k, int(_mix(tokens + np.uint64(k)).min())) for k in range(looks)} if len(tokens) else {(0, 0)}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_chars: int = 200_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Train on at most `max_rows` labelled rows that aren't held out, half of them toxic where there are so many.

    The sample, which goes to the driver, takes the first ids by a hash, and whole
    texts; rows with a text beyond `max_chars` are not drawn, and of near copies one teaches. Null
    ids, texts and labels teach nothing; ids with two labels have the higher one.
    Without any row of one class the model is the prior alone.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("toxic")).where(~held_out("doc_id"))
    pick = lambda k, n: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    toxic_rows = pick(1, max_rows // 2).collect()
    ids = toxic_rows + pick(0, max_rows - len(toxic_rows)).collect()
    if not ids:
        return np.empty(0, np.int64), np.empty(0), 0.0
    spark = docs.sparkSession
    side = spark.createDataFrame(pa.table({"doc_id": pa.array([r["doc_id"] for r in ids]), "toxic": pa.array([r["toxic"] for r in ids], pa.int32())}))
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).join(F.broadcast(side), "doc_id")
    rows = sorted({r["text"]: (r["doc_id"], r["text"], r["toxic"]) for r in sample.select("doc_id", "text", "toxic").toLocalIterator()}.values())
    rows = [rows[i] for i in unlike([r[1] for r in rows])]
    return train([r[1] for r in rows], np.array([r[2] for r in rows]))


def score(text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """The score of a whole text; nothing else of the row is looked at.

    The model that goes to the tasks has one number for each subword that was
    chosen, at most BUCKETS. A text without words, empty or null, has the score of
    the bias. Equal texts have equal scores.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*model)
        for batch in batches:
            yield pd.Series([s for block in in_blocks(batch) for s in scorer.scores(block)], dtype="float64")

    return run(F.coalesce(text, F.lit("")))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    small_batches(docs)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(F.col("text"), fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
