"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are all byte n-grams (ORDERS) of its lower-cased words with a blank on either side, hashed to
BUCKETS. Every bucket has a learned vector; a text is the mean of its buckets' vectors, and a linear softmax
over that mean gives the languages' probabilities. Vectors and weights are both fitted by stochastic gradient
descent on the driver, over a bounded sample of documents of every label: about PER_LANGUAGE of each, fewer if that
made over ROWS in all, but never under RARE, chosen by a hash of doc_id among texts of LONGEST bytes at most (a label
that has none so short learns from its shortest). A fifth of the sample is kept from training and sets the
temperature that makes the probabilities honest and shows what share of n-grams is usual to be known from
training. A text is rejected if its calibrated probability is under CONFIDENCE, or if it knows less than KNOWN of
the share that all but a hundredth of the sample do: another language or no language at all.

For prediction vectors and weights are multiplied once if there are at most DIMENSIONS languages, and after the mean
otherwise, so a broadcast table of at most BUCKETS x DIMENSIONS is all a task needs; the kernel takes every byte of
every text, by portions.

Defined results: null texts and texts without a letter are `und`, score 0, rejected; with no labelled row
everything is `und`. Ties go to the first language in order of name. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import let_go, text_map, text_slices, utf8_view

ORDERS, BUCKETS, DIMENSIONS = (3, 4), 1 << 18, 16
PER_LANGUAGE, ROWS, RARE, LONGEST, CONFIDENCE, KNOWN = 400, 20_000, 20, 1 << 16, 0.4, 0.6
EPOCHS, RATE, SEED = 4, 4.0, 11
#: Bytes whose n-grams are looked up at once; they take some sixty times as much memory.
PORTION = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not 97 <= b <= 122]] = 32


def _padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a blank before each text and one after the last, so that words at the ends have borders, and
    the places of those blanks."""
    n = len(bounds) - 1
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    shifted = bounds + np.arange(n + 1)
    place = np.ones(len(padded), bool)
    place[shifted] = False
    padded[place] = _FOLD[data]
    return padded, shifted


def _portions(starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Consecutive portions, as numbers of texts and as places: whole texts that have PORTION bytes together at most, or
    so many bytes of a longer one."""
    k = 0
    while k < len(starts) - 1:
        to = max(k + 1, int(np.searchsorted(starts, starts[k] + PORTION, side="right")) - 1)
        for at in range(int(starts[k]), int(starts[to]), PORTION):
            yield k, to, at, min(at + PORTION, int(starts[to]))
        k = to


def _grams(padded: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin at places begin to end, in order of place, and their places."""
    some = padded[begin : end + max(ORDERS) - 1]
    blank = some == 32
    wide = some.astype(np.uint32)
    hashes, where = [], []
    code, inner = wide[:-1] * np.uint32(0x01000193) + wide[1:], None
    for order in range(3, max(ORDERS) + 1):
        count = len(some) - order + 1
        if count <= 0:
            break
        code = code[:count] * np.uint32(0x01000193) + wide[order - 1 :]
        inner = ~blank[1 : 1 + count] if order == 3 else inner[:count] & ~blank[order - 2 : order - 2 + count]
        if order in ORDERS:
            at = np.flatnonzero(inner[: end - begin])
            h = code[at] * np.uint32(0x9E3779B1)
            hashes.append((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))
            where.append(at)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate(where)
    order = np.argsort(at, kind="stable")
    return np.concatenate(hashes)[order].astype(np.int64), at[order] + begin


def subwords(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' n-grams in order of place, and each text's bounds there; data is lower-cased UTF-8."""
    padded, starts = _padded(data, bounds)
    buckets, at = _grams(padded, 0, len(padded))
    return buckets, np.searchsorted(at, starts)


def lowered(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts and their bounds, the same for training and prediction."""
    return utf8_view(pc.utf8_lower(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, or BUCKETS x DIMENSIONS if there are weights; float32
    bias: np.ndarray
    seen: np.ndarray  # BUCKETS, float32: 1 where training had it
    temperature: float = 1.0
    least_score: float = 0.0
    least_seen: float = 0.0
    weights: np.ndarray | None = None  # DIMENSIONS x languages

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities per text and the share of its n-grams that training had seen."""
        n = len(bounds) - 1
        sums, known, total = np.zeros((n, self.table.shape[1])), np.zeros(n), np.zeros(n)
        padded, starts = _padded(data, bounds)
        for first, last, begin, end in _portions(starts):
            buckets, at = _grams(padded, begin, end)
            edges = np.searchsorted(at, np.clip(starts[first : last + 1], begin, end))
            full = np.flatnonzero(edges[1:] > edges[:-1])
            if len(full):
                for column in range(self.table.shape[1]):
                    sums[first + full, column] += np.add.reduceat(self.table[:, column][buckets], edges[full], dtype=np.float64)
                known[first + full] += np.add.reduceat(self.seen[buckets], edges[full], dtype=np.float64)
                total[first:last] += np.diff(edges)
        mean = sums / np.maximum(total, 1)[:, None]
        logits = ((mean if self.weights is None else mean @ self.weights) + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), known / np.maximum(total, 1)


def train(rows: list[tuple[str, str]]) -> Model:
    """rows: (language, text) in a fixed order."""
    languages = sorted({x for x, _ in rows})
    number = {x: k for k, x in enumerate(languages)}
    truth = np.array([number[x] for x, _ in rows])
    features = []
    for _, text in rows:
        buckets, counts = np.unique(subwords(*lowered([text]))[0], return_counts=True)
        features.append((buckets, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.3, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    taught = np.isin(truth[held], truth[fit])  # a label's only rows are for training
    held, fit = held[taught], np.concatenate([fit, held[~taught]])
    seen = np.zeros(BUCKETS, np.float32)
    for i in fit:
        seen[features[i][0]] = 1
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = np.float32(RATE * (1 - step / steps))
            buckets, share = features[i]
            mean = share @ vectors[buckets]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[truth[i]] -= 1
            back = weights @ p
            weights -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.01 * p
            vectors[buckets] -= (rate * 4) * np.outer(share, back)
            step += 1
    if len(languages) <= DIMENSIONS:
        model = Model(languages, (vectors @ weights).astype(np.float32), bias, seen)
    else:
        model = Model(languages, vectors, bias, seen, weights=weights)
    return _calibrated(model, [rows[i][1] for i in held], truth[held]) if len(held) else model


def _calibrated(model: Model, texts: list[str], truth: np.ndarray) -> Model:
    data, bounds = lowered(texts)
    best, doubt = np.inf, 1 / (len(truth) + 2)
    fitted = 1.0
    for temperature in np.geomspace(0.05, 20, 60):
        model.temperature = float(temperature)
        p = model.scores(data, bounds)[0] if best == np.inf else _tempered(model, logits)
        if best == np.inf:
            logits = np.log(np.maximum(p, 1e-300)) * model.temperature
        # The sample can't show fewer errors than about one in its size.
        logs = np.log(np.maximum(p, 1e-300))
        loss = -((1 - doubt) * logs[np.arange(len(truth)), truth] + doubt * logs.mean(1)).mean()
        if loss < best:
            best, fitted = loss, model.temperature
    model.temperature = fitted
    model.least_score = max(CONFIDENCE, 1 / len(model.languages)) if len(model.languages) > 1 else 0.0
    model.least_seen = float(KNOWN * np.quantile(model.scores(data, bounds)[1], 0.01))
    return model


def _tempered(model: Model, logits: np.ndarray) -> np.ndarray:
    z = logits / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """About per_language labelled (language, text) of each label, fewer if labels are many; no held-out row."""
    open_ = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    size = F.octet_length("text")
    counts = open_.groupBy("lang").agg(F.count_if(size <= LONGEST).alias("n"), F.min(size).alias("least")).collect()  # as long as the list of labels
    if not counts:
        return []
    each = min(per_language, max(RARE, ROWS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / max(r.n, 1)), max(r.least, LONGEST)) for r in counts], "lang string, share double, most long")
    picked = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    chosen = open_.join(F.broadcast(shares), "lang").where((size <= F.col("most")) & picked).drop("share", "most")
    rows = chosen.collect()
    return [(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))]


SCHEMA = "doc_id long, lang_pred string, score double, accepted boolean"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (calibrated), accepted of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most BUCKETS x (DIMENSIONS + 1) floats and the weights

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        model, text = shared.value, part.column("text").fill_null("")
        n = len(text)
        letter = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
        if model is None:
            name, score, accepted = ["und"] * n, np.zeros(n), np.zeros(n, bool)
        else:
            p, known = model.scores(*lowered(text))
            score = np.where(letter, p.max(1), 0.0)
            name = [model.languages[k] if a else "und" for k, a in zip(p.argmax(1), letter, strict=True)]
            accepted = letter & (score >= model.least_score) & (known >= model.least_seen)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(name, pa.string()), pa.array(score), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "accepted"])

    return text_map(docs.select(F.col("doc_id").cast("long"), "text"), kernel, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows that are rejected; columns unchanged, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        let_go()
        for batch in batches:
            for part in text_slices(batch, "text"):
                text = part.column("text").fill_null("")
                letter = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                if shared.value is None:
                    keep = np.zeros(len(text), bool)
                else:
                    p, known = shared.value.scores(*lowered(text))
                    keep = letter & (p.max(1) >= shared.value.least_score) & (known >= shared.value.least_seen)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
