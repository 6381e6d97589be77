"""Toxicity by maximum-scoring segments of token log-odds.

1. Every document is scanned once for the document counts of its features (words of letters, and
   their first four and five letters); clean labelled documents of the training folds are also
   counted apart. Toxic ones are scanned once more and counted by kind, a 64-bit minwise key that
   copies share: a feature's toxic count, and their total, are numbers of distinct kinds. A feature's score is its log-odds under an informative Dirichlet prior, whose
   pseudo-counts follow the feature's share of all documents.
2. A feature enters the model, with its signed score, if the signed root of its likelihood ratio is at
   least ``least_root``, for or against. The model keeps all of them; the labelled rows, which are
   bounded, bound their number. A token has the score of its word, else of its longest beginning in the
   model; all other tokens share one score, the log-odds of a token outside the model (``-drift``). It's
   held below 0, at ``-LEAST_DRIFT`` at most, where clean texts have more of the model's words than toxic
   ones: segments would never end otherwise.
3. Extreme-value calibration, on the training rows: lambda solves E[exp(lambda * score)] = 1 over the
   tokens of clean documents, and K is the maximum-likelihood estimate from the best segments of clean
   documents, so that K * n * exp(-lambda * S) segments of score S are expected by chance in n tokens.
4. Each document is read once, in linear time: all maximal scoring segments are found, and the r best
   of them are joined by the Karlin-Altschul sum statistic, over r, to one p-value.
5. The score is a logistic function of the p-value's logarithm, fitted on the training rows: 0.5 where
   toxic and clean documents are equally likely.

The training sample is bounded: at most ``max_labelled`` labelled rows, those with the smallest
hash of their id. Labels, ids, sources and languages are never inputs of a score.

Defined cases: null and empty texts have no tokens and the lowest score; texts are read whole;
documents with equal texts have equal scores; several labels of one id count as toxic if any is;
null ids and labels are not learnt from; with no label, or one class only, nothing is toxic; an
empty table gives an empty result; other columns, whatever their names, are neither read nor
returned.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, pieces, table

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
#: Entries after which a task hands on its counts, or a worker forgets the scores it has cached.
TABLE_ENTRIES = 100_000
TOTAL = ""


def features(word: str) -> list[str]:
    """The word, then its longer and its shorter beginning, marked by a leading circumflex."""
    return [word, *(f"^{word[:k]}" for k in reversed(PREFIXES) if len(word) > k)]


def kind(words: list[str]) -> int:
    """A 64-bit key by the least hash of three words in a row, which copies share."""
    three = map(" ".join, zip(words, words[1:], words[2:], strict=False))
    least = min(((zlib.crc32(t.encode()), t) for t in three), default=(0, " ".join(words)))[1]
    return int.from_bytes(hashlib.blake2b(least.encode(), digest_size=8).digest(), "little", signed=True)


def _kinds(batches):
    """(feature, kind) of the toxic documents."""
    pairs: set[tuple[str, int]] = set()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([f for f, _ in pairs], pa.string()), pa.array([k for _, k in pairs], pa.int64())], ["feature", "kind"])
        pairs.clear()
        return out

    for batch in pieces(batches):
        for text in batch.column(0).to_pylist():
            words = TOKEN.findall((text or "").lower())
            k = kind(words)
            pairs.add((TOTAL, k))
            pairs.update((f, k) for w in set(words) for f in features(w))
            if len(pairs) > TABLE_ENTRIES:
                yield flush()
    if pairs:
        yield flush()


def _count(batches):
    """(feature, n_all, n_clean), counted by word and by beginning; the circumflex is set at the end."""
    sets = [(Counter(), Counter()) for _ in range(1 + len(PREFIXES))]

    def flush():
        names, every, clean = [], [], []
        for k, (n_all, n_clean) in enumerate(sets):
            names += [f"^{f}" for f in n_all] if k else n_all
            every += n_all.values()
            clean += map(n_clean.__getitem__, n_all)
            n_all.clear()
            n_clean.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(every, pa.int64()), pa.array(clean, pa.int64())], ["feature", "n_all", "n_clean"])

    for batch in pieces(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(TOKEN.findall((text or "").lower()))
            seen = [words, *({w[:k] for w in words if len(w) > k} for k in PREFIXES)]
            words.add(TOTAL)
            for (n_all, n_clean), features_ in zip(sets, seen, strict=True):
                n_all.update(features_)
                if label is False:
                    n_clean.update(features_)
            if sum(len(n_all) for n_all, _ in sets) > TABLE_ENTRIES:
                yield flush()
    if any(n_all for n_all, _ in sets):
        yield flush()


def fold(id_col) -> F.Column:
    """Whether a row is held out: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def labelled(labels: DataFrame, id_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """(id, label) of at most ``max_labelled`` training rows; the bound is part of the model."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~fold(F.col(id_col)))
    one = one.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("label"))
    return one.orderBy(F.xxhash64("id"), "id").limit(max_labelled)


#: Model without evidence: nothing is toxic.
NOTHING = {"scores": {}, "drift": 1.0, "lam": 1.0, "k": 1.0, "a": -10.0, "b": 0.0}
#: Bins of token scores and of logarithms of p-values that reach the driver: no more than labelled rows.
SCORE_BIN, LOG_P_BIN = 0.1, 0.25
#: A token outside the model costs this much at least.
LEAST_DRIFT = 1e-3


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", max_labelled=400_000, least_root=5.0, prior=10.0) -> dict:
    """The model: ``scores`` (feature -> log-odds), ``drift``, ``lam`` and ``k`` of the extreme values,
    ``a`` and ``b`` of the logistic function."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    # At most max_labelled rows of an id and a flag: the bound of what is broadcast here.
    lab = scratch.keep(labelled(labels, id_col, label_col, max_labelled), "labels")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Copies of one document are one piece of evidence: toxic documents are counted by their kinds.
    pairs = texts.join(F.broadcast(lab.where("label")), "id").select("text").mapInArrow(_kinds, "feature string, kind long")
    toxic = pairs.distinct().groupBy("feature").agg(F.count("*").alias("n_toxic"))
    counted = texts.join(F.broadcast(lab), "id", "left").select("text", "label").mapInArrow(_count, "feature string, n_all long, n_clean long")
    sums = counted.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n_all", "n_clean")))
    sums = sums.join(toxic.hint("shuffle_hash"), "feature", "left").fillna(0, ["n_toxic"])
    # Rows without label evidence can't pass a test of it.
    sums = scratch.keep(sums.where("n_toxic + n_clean > 0"), "features")
    total = sums.where(F.col("feature") == TOTAL).first()
    if total is None or not total["n_toxic"] or not total["n_clean"]:
        return NOTHING
    n, t, c = (float(total[k]) for k in ("n_all", "n_toxic", "n_clean"))
    # Pseudo-counts: prior documents spread as the feature is over the corpus, and half of one more.
    a = prior * F.col("n_all") / n + 0.5
    pt, pc_ = (F.col("n_toxic") + a) / (t + prior + 1), (F.col("n_clean") + a) / (c + prior + 1)
    odds = F.log(pt / (1 - pt)) - F.log(pc_ / (1 - pc_))  # the pseudo-counts keep shares below 1

    def part(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    seen = F.col("n_toxic") + F.col("n_clean")
    root = F.sqrt(2 * F.greatest(F.lit(0.0), part(F.col("n_toxic"), seen * t / (t + c)) + part(F.col("n_clean"), seen * c / (t + c))))
    rows = sums.where(F.col("feature") != TOTAL).select("feature", odds.alias("odds"), root.alias("root")).where(F.col("root") >= least_root).collect()
    scores = {r["feature"]: r["odds"] for r in rows if r["odds"]}
    return calibrated(texts.join(F.broadcast(lab), "id").select("text", "label"), scores, scratch) if scores else NOTHING


def _lists(values: list, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array([x for v in values for x in v], kind))


def _hits(scores: dict):
    def run(batches):
        scorer = Scorer({**NOTHING, "scores": scores})
        for batch in pieces(batches):
            got = [scorer.hits(t or "") for t in batch.column(0).to_pylist()]
            at, s = ([[x[k] for x in h] for _, h in got] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([g[0] for g in got], pa.int64()), _lists(at, pa.int32()), _lists(s, pa.float64())], ["label", "n", "at", "s"])

    return run


def _bins(batches):
    """(s, n): how many scores of a batch lie in the bin around s."""
    for batch in batches:
        s, n = np.unique(np.round(batch.column(0).flatten().to_numpy(zero_copy_only=False) / SCORE_BIN), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(s * SCORE_BIN), pa.array(n)], ["s", "n"])


def _best(drift: float):
    """(label, n, best): the scores of the maximal segments, from the best on."""
    def run(batches):
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            best = [sorted((x for *_, x in segments(list(zip(at, s, strict=True)), drift)), reverse=True) for at, s in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(best, pa.float64())], ["label", "n", "best"])

    return run


def _log_p(model: dict):
    def run(batches):
        for batch in batches:
            v = [p_value(best, n, model) for n, best in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.float64())], ["label", "v"])

    return run


def calibrated(train: DataFrame, scores: dict, scratch: Scratch) -> dict:
    """The model with drift, lambda, K and the logistic function fitted on ``train`` (text, label)."""
    hits = scratch.keep(train.mapInArrow(_hits(scores), "label boolean, n long, at array<int>, s array<double>"), "hits")
    # The log-odds of a token outside the model.
    share = {r["label"]: (r["h"], r["n"]) for r in hits.groupBy("label").agg(F.sum(F.size("at")).alias("h"), F.sum("n").alias("n")).collect()}
    (ht, nt), (hc, nc) = share.get(True, (0, 0)), share.get(False, (0, 0))
    if not nt or not nc:
        return NOTHING
    model = {"scores": scores, "drift": max(LEAST_DRIFT, math.log((1 - hc / (nc + 1)) / (1 - ht / (nt + 1))))}
    bins = hits.where("NOT label").select("s").mapInArrow(_bins, "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))
    model["lam"] = exponent([(r["s"], r["n"]) for r in bins.collect()] + [(-model["drift"], nc - hc)])
    best = scratch.keep(hits.mapInArrow(_best(model["drift"]), "label boolean, n long, best array<double>"), "best")
    top = F.coalesce(F.try_element_at("best", F.lit(1)), F.lit(0.0))
    mass = best.where("NOT label AND n > 0").agg(F.count("*").alias("d"), F.sum(F.col("n") * F.exp(-model["lam"] * top)).alias("m")).first()
    model["k"] = mass["d"] / mass["m"] if mass["d"] else 1.0
    log_p = best.mapInArrow(_log_p(model), "label boolean, v double")
    log_p = log_p.groupBy("label", (F.round(F.col("v") / LOG_P_BIN) * LOG_P_BIN).alias("x")).agg(F.count("*").alias("n")).collect()
    model["a"], model["b"] = logistic([(r["x"], bool(r["label"]), r["n"]) for r in log_p])
    return model


def exponent(bins: list[tuple[float, int]]) -> float:
    """The positive lambda with E[exp(lambda * score)] = 1, by bisection; scores are negative on average."""
    total = sum(n for _, n in bins)
    if not any(s > 0 and n for s, n in bins) or sum(s * n for s, n in bins) >= 0:
        return 1.0  # log-odds: the exponent in theory

    def above(x: float) -> bool:
        top = max(x * s for s, n in bins if n)
        return top + math.log(sum(n * math.exp(x * s - top) for s, n in bins if n) / total) > 0

    low, high = 1e-6, 1.0
    while not above(high):
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return low


def logistic(bins: list[tuple[float, bool, int]], ridge: float = 1.0) -> tuple[float, float]:
    """(a, b) of P(toxic) = 1 / (1 + exp(-(a - b * log p))), by Newton's method with a ridge on the slope."""
    x = np.array([-v / 10 for v, _, _ in bins])
    y, w = np.array([t for _, t, _ in bins], float), np.array([k for *_, k in bins], float)
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        g = design.T @ (w * (p - y)) + np.array([1e-6, ridge]) * beta
        h = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, ridge])
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(0.0, beta[1]) / 10)


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a sequence of which ``hits`` gives
    some places and scores, and whose other tokens score ``-drift``, in linear time (Ruzzo and Tompa)."""
    out: list[list] = []  # first, last, sum before, sum at the end
    total, last = 0.0, -1
    for at, s in hits:
        total -= drift * (at - last - 1)
        last = at
        left, total = total, total + s
        if s <= 0:
            continue
        seg = [at, at, left, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j -= 1
            if j < 0 or out[j][3] >= seg[3]:
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in out]


def p_value(best: list[float], n: int, model: dict) -> float:
    """Logarithm of the smallest p-value of the r best segments together, over r; each further
    segment is paid for by a factor of two. ``best``: scores from the best on."""
    least, total = 0.0, 0.0
    base = math.log(max(n, 1) * model["k"])
    for r, s in enumerate(best, 1):
        x = model["lam"] * s - base
        if x <= 0:
            break
        total += x
        log_p = -total + (r - 1) * math.log(max(total, 1.0)) - math.lgamma(r + 1) - math.lgamma(r)
        least = min(least, log_p + (r - 1) * math.log(2.0))
    return least


class Scorer:
    def __init__(self, model: dict) -> None:
        self.model, self.scores = model, model["scores"]
        self.cache: dict[str, float] = {}

    def token(self, word: str) -> float:
        for f in features(word):
            if (s := self.scores.get(f)) is not None:
                return s
        return 0.0

    def hits(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """Number of tokens, and place and score of those in the model."""
        words = TOKEN.findall(text.lower())
        if len(self.cache) > TABLE_ENTRIES:
            self.cache.clear()
        get = self.cache.get
        out = [*map(get, words)]
        if None in out:
            self.cache.update((w, self.token(w)) for w in {w for w, s in zip(words, out, strict=True) if s is None})
            out = [*map(get, words)]
        return len(words), [(i, s) for i, s in enumerate(out) if s]

    def score(self, text: str | None) -> tuple[float, float, list]:
        """(score, log of the p-value, segments of which fewer than one in twenty is expected by chance)."""
        m = self.model
        n, hits = self.hits(text or "")
        segs = segments(hits, m["drift"]) if hits else []
        log_p = p_value(sorted((x for *_, x in segs), reverse=True), n, m)
        good = [x for x in segs if m["lam"] * x[2] - math.log(max(n, 1) * m["k"]) > math.log(20)]
        return 1 / (1 + math.exp(max(-700.0, min(700.0, m["b"] * log_p - m["a"])))), log_p, good


def toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted, log_p and passages (first token, last
    token, score) of the significant segments. The model has a bounded size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("log_p", T.DoubleType()), T.StructField("passages", T.ArrayType(T.ArrayType(T.DoubleType())))]

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in pieces(batches):
            got = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64()), pa.array([[[float(v) for v in s] for s in g[2]] for g in got], pa.list_(pa.list_(pa.float64())))],
                ["id", "score", "predicted", "log_p", "passages"],
            )

    return df.mapInArrow(run, T.StructType([df.schema["id"], *names])).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns; a row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in pieces(batches):
            yield batch.filter(pa.array([scorer.score(t)[0] < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", "predicted")
