"""Operator 2: toxicity by non-negative positive-unlabelled learning.

Linear classifiers are trained in numpy from texts confirmed as toxic and from unlabelled texts,
which hold toxic ones too.  With the class prior p, the risk of calling a text clean is estimated as
``max(0, R_unlabelled - p * R_positive)``: where the difference turns negative, which a true risk
can't, a step is taken against it.  Several classifiers, each with its own part of the unlabelled
texts, are averaged.  No text is ever learnt from as a clean one: labels give the positive texts and,
as a bare count, the class prior.  Where the averaged classifiers find more toxic texts among the
unlabelled than the prior allows, which little data makes them do, the bias is lowered until the mean
of their scores is the prior.

Features are the distinct words of a text and their first 4, 5 and 6 letters.  Candidates are the
features of at least three sampled positive texts; how many texts hold them is counted over all
documents outside the held-out fold.  Kept are those that positive texts hold more often than the
documents by more than chance makes likely.  Whether their shares agree with the class prior is not
asked, as the prior may be wrong.  The gradient steps use bounded samples (POSITIVE and UNLABELLED rows
at most, by a hash of their ids); counting and scoring read every text whole, and broadcast the
candidates of the bounded sample and at most FEATURES weights.

LEAST_GAIN and the way of the bias were chosen by cross-validation within the learning folds, each of
which took its turn as the one that is scored; the held-out fold took no part.

Defined cases: null and empty texts get the score of a text without features; null labels and labels
of unknown documents count for nothing, and of conflicting labels the larger holds; rows with a null
id are scored but never learnt from; repeated rows are scored each; without positive labels every
score is 0; an empty table gives no rows; texts and words of any length are taken whole, but a word's
feature ends with its 40th letter; other columns are kept or not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import picked, release, table, tidied, written

POSITIVE, UNLABELLED = 3000, 9000
FEATURES, CLASSIFIERS, STEPS = 50_000, 3, 800
#: The likelihood ratio statistic of a feature's shares must be so large.
LEAST_GAIN = 8.0
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
PREFIXES = (4, 5, 6)
#: No more counts than KNOWN are held at a time, and of a batch PART texts are made strings at a time, so
#: that what a task holds is bounded.
KNOWN, PART = 50_000, 256
#: What is not a word's letter in ASCII texts becomes a space.
SPACED = {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i) == "_")}


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def words(text: str) -> set[str]:
    if text.isascii():
        return set(text.lower().translate(SPACED).split())
    import re

    return set(re.findall(r"\w+", text.lower()))


def described(word: str) -> list[str]:
    return [f"{word[:40]}$", *(word[:n] for n in PREFIXES if len(word) > n)]


def lookup(known: Iterable[str]) -> dict[int, set[str]]:
    """The known features by the letters they have of a word, whole words under 0."""
    out: dict[int, set[str]] = {0: set()} | {n: set() for n in PREFIXES}
    for f in known:
        if f.endswith("$"):
            out[0].add(f[:-1])
        else:
            out[len(f)].add(f)
    return out


def features(text: str, known: dict[int, set[str]]) -> list[str]:
    """The features of a text that a lookup has, each once, however many words share it."""
    own = words(text)
    found = [f"{w}$" for w in known[0] & {w[:40] for w in own}]
    for n in PREFIXES:
        found += known[n] & {w[:n] for w in own if len(w) > n}
    return found


def strings(texts: pa.Array) -> Iterator[str | None]:
    """The texts of an array, of which few at a time are strings of Python."""
    for a in range(0, len(texts), PART):
        yield from texts.slice(a, PART).to_pylist()


def _first(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("key"), "key").limit(n)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, float]:
    """role (p or u), text: a bounded sample of documents outside the held-out fold; and the class prior,
    from all labels outside it."""
    known = picked(labels, key=labels[key].cast("long"), label=labels[label].cast("int")).where("key IS NOT NULL AND label IS NOT NULL")
    known = written(known.where(fold(F.col("key")) != HELD_OUT).groupBy("key").agg(F.max("label").alias("label")))
    ids = docs.select(docs[key].cast("long").alias("key")).where("key IS NOT NULL")
    ids = ids.where(fold(F.col("key")) != HELD_OUT).distinct()
    # At most POSITIVE + UNLABELLED rows, so the broadcast is bounded.
    picks = _first(known.where("label = 1"), POSITIVE).select("key", F.lit("p").alias("role"))
    picks = written(picks.unionByName(_first(ids, UNLABELLED).select("key", F.lit("u").alias("role"))))
    # Of repeated ids any text will do: the longest, so that the choice is the same each time.
    own = picked(docs, key=docs[key].cast("long"), text=F.coalesce(docs[text], F.lit("")))
    found = own.join(F.broadcast(picks), "key")
    found = found.groupBy("key", "role").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    return written(found), float(np.clip((toxic + 1) / (n + 10), 0.005, 0.5))


def corpus_counts(docs: DataFrame, names: list[str], key: str, text: str) -> tuple[np.ndarray, int]:
    """How many texts hold each of the named features, and the number of texts, over all documents
    with an id outside the held-out fold; repeated rows count each."""
    held = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]):
        at = held.value
        known, total, texts = lookup(at), np.zeros(len(at), dtype=np.int64), 0
        for batch in batches:
            texts += len(batch)
            for t in strings(batch.column("text")):
                total[[at[f] for f in features(t, known)] if t else []] += 1
        some = np.flatnonzero(total)
        # The number of texts goes under -1.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], texts))], names=["at", "n"])

    own = picked(docs, key=docs[key].cast("long"), text=docs[text]).where("key IS NOT NULL")
    own = own.where(fold(F.col("key")) != HELD_OUT).select("text")
    out, texts = np.zeros(len(names), dtype=np.int64), 0
    for r in own.mapInArrow(tidied(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        if r.at < 0:
            texts = r.n
        else:
            out[r.at] = r.n
    held.destroy()
    return out, texts


def gains(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int) -> np.ndarray:
    """The likelihood ratio statistic of the shares p/n_p and u/n_u, negative where the first is the
    smaller one."""

    def part(x: np.ndarray, n: int) -> np.ndarray:
        return x * np.log(np.maximum(x, 1) * float(n_p + n_u) / ((p + u) * float(n)))

    p, u = np.asarray(p, dtype=float), np.asarray(u, dtype=float)
    return np.round(2 * (part(p, n_p) + part(u, n_u)), 6) * np.where(p * n_u >= u * n_p, 1, -1)


def vocabulary(sampled: DataFrame, docs: DataFrame, key: str, text: str) -> list[str]:
    """The features that positive texts hold more often than the documents, by more than chance makes
    likely: FEATURES at most, best first."""

    def count(batches: Iterator[pd.DataFrame]):
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                seen.update({f for w in words(t) for f in described(w)})
                if len(seen) > KNOWN:
                    yield pd.DataFrame({"f": list(seen), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"f": list(seen), "n": list(seen.values())})

    rows = sampled.where("role = 'p'").select("text")
    known = rows.mapInPandas(tidied(count), "f string, n long").groupBy("f").agg(F.sum("n").alias("p")).where("p >= 3").collect()
    if not known:
        return []
    names = sorted(r.f for r in known)
    by = {r.f: r.p for r in known}
    u, n_u = corpus_counts(docs, names, key, text)
    gain = gains(np.array([by[f] for f in names]), rows.count(), u, max(1, n_u))
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    return [names[i] for i in best if gain[i] >= LEAST_GAIN]


class _Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=w[self.at], minlength=self.n)[: self.n] if self.n else np.zeros(0)

    def gradient(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=per_row[self.of], minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def slope(positive: _Rows, unlabelled: _Rows, w: np.ndarray, b: float, prior: float, ridge: float) -> np.ndarray:
    """The direction of a step, for weights and bias: the gradient of the estimated risk under the
    logistic loss, or, where the part for clean texts is negative, against that part."""
    zp, zu = positive.scores(w) + b, unlabelled.scores(w) + b
    # Loss of calling x clean: log(1 + exp(z)), its slope sigmoid(z); of calling it toxic: log(1 + exp(-z)).
    clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up, uu = _sigmoid(zp) / positive.n, _sigmoid(zu) / unlabelled.n
    if clean >= 0:
        gp, gu = prior * (up - 1 / positive.n) - prior * up, uu
    else:  # a risk below zero is an artefact of fitting: step back
        gp, gu = prior * up, -uu
    return np.append(positive.gradient(gp) + unlabelled.gradient(gu) + ridge * w, gp.sum() + gu.sum())


def train(positive: _Rows, unlabelled: _Rows, prior: float, steps: int = STEPS, rate: float = 0.05, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk estimate."""
    w, b = np.zeros(positive.width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = slope(positive, unlabelled, w, b, prior, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def excess(z: np.ndarray, prior: float) -> float:
    """What must go off the log odds z of unlabelled texts for their mean score to be no more than the
    prior."""
    low, high = 0.0, 40.0
    if not len(z) or _sigmoid(z).mean() <= prior:
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(z - middle).mean() > prior else (low, middle)
    return high


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, float], float]:
    """(feature weights, bias): the log odds of a text are the bias and its features' weights."""
    sampled, prior = sample(docs, labels, key, text, label)
    names = vocabulary(sampled, docs, key, text)
    at = {f: i for i, f in enumerate(names)}
    known = lookup(at)

    def featurise(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            found = [sorted(at[f] for f in features(t, known)) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "role": batch["role"], "found": found})

    rows = sampled.mapInPandas(tidied(featurise), "key long, role string, found array<int>").toPandas().sort_values(["role", "key"])
    sets = {r: [np.asarray(x, dtype=np.int64) for x in rows.loc[rows["role"] == r, "found"]] for r in "pu"}
    if not names or not sets["p"] or not sets["u"]:
        return {}, float("-inf")
    positive, total, bias = _Rows(sets["p"], len(names)), np.zeros(len(names)), 0.0
    for i in range(CLASSIFIERS):
        w, b = train(positive, _Rows(sets["u"][i::CLASSIFIERS] or sets["u"], len(names)), prior)
        total, bias = total + w / CLASSIFIERS, bias + b / CLASSIFIERS
    bias -= excess(_Rows(sets["u"], len(names)).scores(total) + bias, prior)
    return {f: float(x) for f, x in zip(names, total)}, bias


def score(docs: DataFrame, weights: dict[str, float], bias: float, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column for the probability that a text is toxic."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import math

        own = held.value
        known = lookup(own)
        for batch in texts:
            out = np.empty(len(batch))
            for i, t in enumerate(strings(batch)):
                found = features(t, known) if t else ()
                z = bias + math.fsum(own[f] for f in found)
                out[i] = 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) if z > -700 else 0.0
            yield pa.array(out)
        release()

    rate.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(rate, "double")(docs[text]))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", name: str = "score") -> DataFrame:
    return score(docs, *fit(docs, labels, key, text, label), text=text, name=name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = toxicity(docs, table(spark, sf_dir, "labels"))
    return rated.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict = {}
