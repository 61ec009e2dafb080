"""Toxicity: subword-bag embeddings, averaged, under a linear softmax, trained jointly in numpy.

A word's vector is the mean of its character n-gram vectors (hashed into buckets), so a
misspelling shares most of its vector with the word it spoils. Words are averaged over
short windows rather than over the whole text, where one insult among thousands of words
would vanish; the softmax gives each window's probability. Embeddings and softmax are
trained together by Adam on the likelihood of at least one toxic window (noisy or). A text
scores as its strongest window, since a noisy or over all windows rises to 1 with length.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwatch.llm.common import Spans, slices, small_batches

#: At most so many toxic and so many other labelled texts are fitted on, those with the smallest hash, and so many bytes of either.
FIT_TOXIC, FIT_OTHER, FIT_BYTES = 1000, 3000, 20_000_000
BUCKETS, DIM, WINDOW, NGRAMS = 1 << 18, 8, 8, (3, 6)
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def grams(words: list[str], lowest: int = NGRAMS[0], highest: int = NGRAMS[1], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of the character n-grams of words and of the words themselves, marked at both ends."""
    marked = [f"<{w.strip(_STRIP) or w}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    begin = np.cumsum(length) - length
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    spans = Spans(codes)
    word = np.repeat(np.arange(len(marked)), length)
    left = np.repeat(begin + length, length) - np.arange(len(codes))  # code points from here to the word's end
    found = [(np.arange(len(marked)), spans.hashes(begin, begin + length) ^ np.uint64(1))]
    for n in range(lowest, highest + 1):
        at = np.flatnonzero(left >= n)
        found.append((word[at], spans.hashes(at, at + n)))
    return np.concatenate([w for w, _ in found]), (np.concatenate([h for _, h in found]) & np.uint64(buckets - 1)).astype(np.int32)


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _informative(flat: np.ndarray, n: np.ndarray, words: np.ndarray, counts: np.ndarray, y: np.ndarray, least_z: float, least_texts: int) -> np.ndarray:
    """Flags of the n-grams whose share of texts differs by label beyond chance; others would only be memorised.

    flat: the n-grams of word after word, n of each; words: the texts' words, counts of each text.
    """
    at = np.cumsum(n) - n
    texts = np.zeros((2, BUCKETS), np.float64)
    begin = 0
    for label, count in zip(y.astype(int).tolist(), counts.tolist()):
        w = np.unique(words[begin : begin + count])
        inside = np.arange(n[w].sum()) - np.repeat(np.cumsum(n[w]) - n[w], n[w])
        texts[label, np.unique(flat[np.repeat(at[w], n[w]) + inside])] += 1
        begin += count
    total = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    share = texts.sum(0) / total.sum()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / total).sum())
    z = (texts[1] / total[1] - texts[0] / total[0]) / spread
    return (np.abs(z) >= least_z) & (texts.sum(0) >= least_texts)


@dataclass
class Model:
    """What scoring needs: each bucket's share of the logit, and the intercept."""

    bucket_logit: np.ndarray
    bias: float
    window: int = WINDOW

    def word_logits(self, words: list[str]) -> np.ndarray:
        word, bucket = grams(words, buckets=len(self.bucket_logit))
        return np.bincount(word, self.bucket_logit[bucket], len(words)) / np.bincount(word, minlength=len(words))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def fit(texts: list[str | None], toxic: list[int], weights: list[float] | None = None, epochs: int = 150, rate: float = 0.1, decay: float = 1e-3, least_z: float = 4.0, least_texts: int = 4, seed: int = 7) -> Model:
    """Trains on whole texts; weights stand for how many rows a text represents.

    Without both labels there is nothing to learn: the model then scores every text with
    the share of label 1 (0 without any labels).
    """
    y = np.asarray(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))), 0)
    vocabulary: dict[str, int] = {}
    coded, sizes = array("i"), []
    for t in texts:
        ws = tokens(t) or [""]
        coded.extend(vocabulary.setdefault(w, len(vocabulary)) for w in ws)
        sizes.append(len(ws))
    words, counts = np.frombuffer(coded, np.int32), np.array(sizes)
    every, listed, sizes = list(vocabulary), [], []
    del vocabulary
    for at in range(0, len(every), 20_000):  # in parts, for the driver's memory
        part = every[at : at + 20_000]
        word, bucket = grams(part)
        listed.append(bucket[np.argsort(word, kind="stable")])
        sizes.append(np.bincount(word, minlength=len(part)))
    flat, whole = np.concatenate(listed), np.concatenate(sizes)
    del every, listed
    kept = _informative(flat, whole, words, counts, y, least_z, least_texts)[flat]
    kept_n = np.add.reduceat(kept, np.cumsum(whole) - whole, dtype=np.int64)
    flat, kept_at = flat[kept], np.cumsum(kept_n) - kept_n
    n_windows = -(-counts // WINDOW)
    within = np.arange(len(words), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    window = np.repeat((np.cumsum(n_windows) - n_windows).astype(np.int32), counts) + within // np.int32(WINDOW)
    del within
    window_n = np.bincount(window, minlength=int(n_windows.sum())).astype(np.float32)
    doc_of = np.repeat(np.arange(len(counts)), n_windows)
    # Only windows that hold an informative n-gram have a vector; all others have the bias alone.
    told = np.flatnonzero(kept_n[words])
    weight = np.asarray(weights if weights is not None else np.ones(len(y)), np.float64)
    weight = weight / weight.sum()
    share = float((weight * y).sum())
    bias = float(np.log(share / max(1.0, n_windows.mean())))
    if not len(told):
        return Model(np.zeros(BUCKETS, np.float32), bias)
    spoken, word = np.unique(words[told], return_inverse=True)
    gram_n = kept_n[spoken]
    gram_at = np.cumsum(gram_n) - gram_n
    used, gram = np.unique(flat[np.repeat(kept_at[spoken] - gram_at, gram_n) + np.arange(gram_n.sum())], return_inverse=True)
    scale = 1 / whole[spoken]
    live, at = np.unique(window[told], return_inverse=True)
    doc, blank = doc_of[live], n_windows - np.bincount(doc_of[live], minlength=len(counts))
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.5, (DIM, 2)), np.array([0.0, bias])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        emb, soft, b = params
        word_vec = np.add.reduceat(emb[gram], gram_at, axis=0) * scale[:, None]
        mean = np.stack([np.bincount(at, word_vec[word, d], len(live)) for d in range(DIM)], 1) / window_n[live][:, None]
        diff = soft[:, 1] - soft[:, 0]
        z0 = b[1] - b[0]
        z = WINDOW * (mean @ diff) + z0
        total = np.maximum(np.bincount(doc, _softplus(z), len(counts)) + blank * _softplus(np.float64(z0)), 1e-9)
        clear = np.exp(-total)
        slope = weight * ((1 - y) - y * clear / np.maximum(1 - clear, 1e-9))
        g_z = slope[doc] / (1 + np.exp(-np.clip(z, -30, 30)))
        g_0 = g_z.sum() + (slope * blank).sum() / (1 + np.exp(-z0))
        g_diff = WINDOW * (mean.T @ g_z)
        g_mean = WINDOW * g_z / window_n[live]
        g_word = np.bincount(word, g_mean[at], len(spoken)) * scale
        g_gram = np.bincount(gram, np.repeat(g_word, gram_n), len(used))
        steps = (g_gram[:, None] * diff[None, :] + decay * emb * weight.max(), np.stack([-g_diff, g_diff], 1), np.array([-g_0, g_0]))
        for i, g in enumerate(steps):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.98 * second[i] + 0.02 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.98**step)) + 1e-9)
    emb, soft, b = params
    logit = np.zeros(BUCKETS, np.float32)  # buckets that no fitted text has stay neutral
    logit[used] = WINDOW * (emb @ (soft[:, 1] - soft[:, 0]))
    return Model(logit, float(b[1] - b[0]))


def score(model: Model, texts: list[str | None]) -> np.ndarray:
    """Each text's probability of its strongest window, whatever the text's length."""
    if not model.window:
        return np.full(len(texts), 1 / (1 + np.exp(-model.bias)))
    each = [tokens(t) or [""] for t in texts]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    flat = pa.array([w for ws in each for w in ws], pa.string()).dictionary_encode()
    del each
    logits = model.word_logits(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)]
    n_windows = -(-counts // model.window)
    doc_at = np.cumsum(n_windows) - n_windows
    within = np.arange(len(logits)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.repeat(doc_at, counts) + within // model.window
    win_at = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    z = np.add.reduceat(logits, win_at) / np.diff(np.r_[win_at, len(window)]) + model.bias
    return np.clip(-np.expm1(-_softplus(np.maximum.reduceat(z, doc_at))), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_other: int = FIT_OTHER) -> Model:
    """Fits on a bounded sample of the labelled rows that aren't held out.

    Rows without id, text or label are left out; of repeated labels the highest counts, of
    repeated ids the text of least hash. The sample is the rows of smallest id hash, at most
    fit_toxic and fit_other of each label and FIT_BYTES of their texts (a text that alone is
    longer is left out), weighted back to the labels' shares. An empty table, or labels of one
    kind, give a model that scores all texts alike.
    """
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    marked = marked.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = None
    for label, most in ((1, fit_toxic), (0, fit_other)):
        part = marked.where(F.col("toxic") == label).orderBy(*order).limit(most)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL")
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("t"))
    held = {0: 0, 1: 0}
    kept = []
    for r in sorted(found.select("doc_id", "toxic", "t.*", F.xxhash64("doc_id").alias("o")).collect(), key=lambda r: (r.o, r.doc_id)):  # fit_toxic + fit_other rows at most
        if held[r.toxic] + r.n <= FIT_BYTES:
            held[r.toxic] += r.n
            kept.append((r.doc_id, r.toxic, r.h))
    listed = docs.sparkSession.createDataFrame(kept, "doc_id long, toxic int, h long")
    whole = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(listed), ["doc_id", "h"]).dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.toxic, r.text) for r in whole.select("doc_id", "toxic", "text").collect())
    toxic = [r[1] for r in rows]
    share = {label: totals.get(label, 0) / max(1, toxic.count(label)) for label in (0, 1)}
    return fit([r[2] for r in rows], toxic, [share[t] for t in toxic])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row, nulls and empty texts included (they score as one empty word).

    A text of any length is scored whole, by its strongest window; repeated rows and null ids
    are rows like any other; columns beyond id and text are not read; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = score(shared.value, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs that score below the threshold, with all their columns, whatever their names.

    Null and empty texts score as one empty word and very long ones whole; rows that repeat
    go or stay alike; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep = score(shared.value, part.column("text").to_pylist()) < threshold
            yield part.filter(pa.array(keep)).select(columns)

    return docs.mapInArrow(run, docs.schema)
