"""Co-training's exchange once more, in one process on dense matrices, without partitions, stored features or passes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailsieve.llm import cotrain
from tests.llm.test_llm import WORDS, docs

CONFIDENT, SHARE, ROUNDS, STEPS = 0.9, 0.1, 3, 12


def dense(rows, width):
    """A matrix of sparse feature rows."""
    out, start = np.zeros((len(rows.ends), width)), 0
    for i, end in enumerate(rows.ends):
        np.add.at(out[i], rows.slots[start:end], rows.weights[start:end])
        start = end
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Plain:
    """Logistic regression by AdaGrad on all rows at once."""

    def __init__(self, width):
        self.w, self.b, self.gw, self.gb, self.a, self.c = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8, 1.0, 0.0

    def learn(self, x, y, use, times):
        for _ in range(times):
            error = (sigmoid(x @ self.w + self.b) - y) * use / use.sum()
            grad, grad_b = x.T @ error + 1e-4 * self.w, error.sum()
            self.gw, self.gb = self.gw + grad**2, self.gb + grad_b**2
            self.w, self.b = self.w - 0.5 * grad / np.sqrt(self.gw), self.b - 0.5 * grad_b / np.sqrt(self.gb)

    def platt(self, x, y):
        """Slope and intercept by Newton's method on smoothed targets."""
        m, good = x @ self.w + self.b, y.sum()
        t, theta = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (len(y) - good + 2)), np.array([0.0, np.log((good + 1) / (len(y) - good + 1))])
        z = np.stack([m, np.ones(len(m))], 1)
        for _ in range(50):
            p = sigmoid(z @ theta)
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-6]), z.T @ (p - t) + np.array([1e-3 * theta[0], 0]))
            theta = theta - step
            if abs(step).max() < 1e-6:
                break
        self.a, self.c = max(theta[0], 0.0), theta[1]

    def logit(self, x):
        return np.clip(self.a * (x @ self.w + self.b) + self.c, -12, 12)


def surest(z, tie, salt, most):
    """Of the rows with a score above the bound, the highest `most`: bins from the top, of the last one a share by the rows' draws."""
    least = np.log(CONFIDENT / (1 - CONFIDENT))
    free = np.flatnonzero(z >= least)
    bins = np.minimum((z[free] - least) / (12 - least) * cotrain.BINS, cotrain.BINS - 1).astype(int)
    taken, left = [], most
    for b in sorted({*bins.tolist()}, reverse=True):
        own = free[bins == b]
        if len(own) >= left:
            taken.extend(own[cotrain._draw(tie[own], salt) < left / len(own)])
            break
        taken.extend(own)
        left -= len(own)
    return np.array(taken, int)


def exchanged(x, y, tie, known, pool):
    """Scores of all rows. x: both views' matrices; known: labelled rows by their place; pool: all others."""
    held = known[np.arange(len(known)) % 5 == 0]
    fitted = np.setdiff1d(known, held)
    views = [Plain(v.shape[1]) for v in x]
    prior = np.log((y[known].sum() + 1) / (len(known) - y[known].sum() + 1))
    good = sigmoid(prior)
    targets, uses = [np.zeros(len(y)), np.zeros(len(y))], [np.zeros(len(y)), np.zeros(len(y))]
    for k, v in enumerate(views):
        targets[k][fitted], uses[k][fitted] = y[fitted], 1
        v.learn(x[k][fitted], y[fitted], np.ones(len(fitted)), 120)
        v.platt(x[k][held], y[held])
    most = max(1, int(SHARE * len(pool)))
    for r in range(ROUNDS):
        logits = [v.logit(m) for v, m in zip(views, x, strict=True)]
        for k in (0, 1):
            for label in (1, 0):
                z = np.where((uses[1 - k] == 0) & np.isin(np.arange(len(y)), pool), logits[k] if label else -logits[k], -np.inf)
                rows = surest(z, tie, 4 * r + 2 * (1 - k) + label, max(1, int(most * (good if label else 1 - good))))
                targets[1 - k][rows], uses[1 - k][rows] = label, 0.5
        for k, v in enumerate(views):
            v.learn(x[k], targets[k], uses[k], STEPS)
            v.platt(x[k][held], y[held])
    return sigmoid(sum(v.logit(m) for v, m in zip(views, x, strict=True)) - prior), uses


def test_equals_plain_exchange(spark):
    r = np.random.default_rng(9)
    good, bad = WORDS.split(), "zz1 qq## 77$ buy!! click >>> win$$$ free".split()
    rows = [(i, " ".join(r.choice(good, 30 if i % 2 else 12)) + " " + " ".join(r.choice(bad, 2 if i % 2 else 25))) for i in range(500)]
    table = docs(spark, rows).withColumns({"source": F.concat(F.lit("s"), (F.col("doc_id") % 6).cast("string")), "n_chars": F.length("text").cast("long")})
    labels = spark.createDataFrame([(i, int(i % 2 or i % 37 == 0)) for i in range(120)], "doc_id long, quality int")
    model = cotrain.fit(table, labels, steps=STEPS)
    got = {x["doc_id"]: x["score"] for x in cotrain.score(table, labels).collect()}
    raw = cotrain._raw(table, "doc_id").withColumn("tie", F.xxhash64("id", "text", "source", "lang", "n_chars")).orderBy("id").toPandas()
    picked = cotrain.labelled_ids(table, labels).orderBy("n").collect()
    x = [dense(cotrain.text_features(pa.array(raw["text"])), 1 << cotrain.TEXT_BITS), dense(cotrain.Rows.of([cotrain.meta_features(*m) for m in zip(raw["source"], raw["lang"], raw["n_chars"], strict=True)], cotrain.META_BITS), 1 << cotrain.META_BITS)]
    known, y = np.array([p["id"] for p in picked]), np.zeros(len(raw))
    y[known] = [p["y"] for p in picked]
    want, uses = exchanged(x, y, raw["tie"].to_numpy(), known, np.setdiff1d(np.arange(len(raw)), known))
    assert np.abs(np.array([got[i] for i in raw["id"]]) - want).max() < 1e-4
    assert (model[3]["to_text"], model[3]["to_meta"]) == tuple(int((u == 0.5).sum()) for u in uses) and min(model[3]["to_text"], model[3]["to_meta"]) > 5
