"""Toxicity severity by cumulative-link ordinal regression.

``P(grade > k) = sigmoid(w.x - b_k)`` with one sparse weight vector and
ordered thresholds ``b``; the result carries the expected severity, the sum of
these probabilities.  Labels say only toxic or not, so toxic training texts
are graded by how much of the vocabulary that sets them apart they hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRADES = 4
STEM = 5
_EDGES = b".,;:!?\"'()[]"


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[bytes, float]
    thresholds: tuple[float, ...]


def terms(text: str | None) -> Counter[bytes]:
    """The words of a text, lower-cased and without punctuation at their edges,
    and the stems of ``STEM`` bytes of longer ones (ending in ``*``)."""
    if not text:
        return Counter()
    bag = Counter([w.strip(_EDGES) for w in text.lower().encode("utf-8", "replace").split()])
    for w, c in list(bag.items()):
        if len(w) > STEM:
            bag[w[:STEM] + b"*"] += c
    return bag


def toxic_terms(bags: list[Counter[bytes]], toxic: np.ndarray, least: int = 5, odds: float = 4.0) -> set[bytes]:
    """Words that stand in toxic texts ``exp(odds)`` times as often, by smoothed document odds."""
    yes: Counter[bytes] = Counter()
    no: Counter[bytes] = Counter()
    for bag, t in zip(bags, toxic, strict=True):
        (yes if t else no).update(bag.keys())
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    out = set()
    for w, c in yes.items():
        rest = no[w]
        if c >= least and math.log((c + 0.5) / (n1 + 1)) - math.log((rest + 0.5) / (n0 + 1)) >= odds:
            out.add(w)
    return out


def grade(bags: list[Counter[bytes]], toxic: np.ndarray) -> np.ndarray:
    """0 for clean texts, 1 to 3 for toxic ones by the thirds of their toxic words."""
    found = toxic_terms(bags, toxic)
    amount = np.array([sum(c for w, c in bag.items() if w in found) for bag in bags], dtype=float)
    out = np.zeros(len(bags), dtype=int)
    if toxic.any():
        cuts = np.quantile(amount[toxic], [1 / 3, 2 / 3])
        out[toxic] = 1 + (amount[toxic] > cuts[0]) + (amount[toxic] > cuts[1])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(texts: list[str | None], toxic: list[int], rounds: int = 300, rate: float = 0.1, l2: float = 1e-4, least: int = 4, screen: float = 6.0) -> OrdinalModel:
    """Adam on the mean log-likelihood; thresholds are a first one plus steps
    kept positive, so they stay ordered.  Words enter if the shares of toxic
    and of clean texts that hold them differ by ``screen`` standard errors:
    without that, a few thousand texts are told apart by their rare words."""
    flags = np.array(toxic, dtype=bool)
    bags = [terms(t) for t in texts]
    grades = grade(bags, flags)
    df: Counter[bytes] = Counter(w for bag in bags for w in bag)
    yes: Counter[bytes] = Counter(w for bag, t in zip(bags, flags, strict=True) if t for w in bag)
    n1, n0 = int(flags.sum()), int((~flags).sum())

    def apart(w: bytes) -> bool:
        c = df[w]
        share = c / (n1 + n0)
        error = math.sqrt(max(share * (1 - share), 1e-12) * (1 / max(n1, 1) + 1 / max(n0, 1)))
        return c >= least and abs(yes[w] / max(n1, 1) - (c - yes[w]) / max(n0, 1)) >= screen * error

    vocabulary = {w: i for i, w in enumerate(sorted(filter(apart, df)))}
    row, col, val = [], [], []
    for r, bag in enumerate(bags):
        for w, c in bag.items():
            i = vocabulary.get(w)
            if i is not None:
                row.append(r)
                col.append(i)
                val.append(1 + math.log(c))
    row, col, val = np.array(row, dtype=np.intp), np.array(col, dtype=np.intp), np.array(val)
    n, d = len(bags), len(vocabulary)
    theta = np.concatenate([np.zeros(d), [1.0], np.zeros(GRADES - 2)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1 if n else 1):
        w, b = theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
        s = np.bincount(row, weights=w[col] * val, minlength=n)
        above = np.concatenate([np.ones((n, 1)), _sigmoid(s[:, None] - b), np.zeros((n, 1))], axis=1)
        hit = np.arange(n), grades
        p = np.maximum(above[hit] - above[np.arange(n), grades + 1], 1e-12)
        up, down = above[hit] * (1 - above[hit]), above[np.arange(n), grades + 1] * (1 - above[np.arange(n), grades + 1])
        ds = (up - down) / p / n
        gb = np.zeros(GRADES + 1)
        np.add.at(gb, grades, -up / p / n)
        np.add.at(gb, grades + 1, down / p / n)
        gb = gb[1:GRADES]
        steps = np.exp(theta[d + 1 :])
        g = np.concatenate([np.bincount(col, weights=ds[row] * val, minlength=d) - l2 * w, [gb.sum()], [steps[k] * gb[k + 1 :].sum() for k in range(GRADES - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    b = theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
    return OrdinalModel({w: float(theta[i]) for w, i in vocabulary.items()}, tuple(float(x) for x in b))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[str | None], list[int]]:
    """At most ``per_class`` toxic and as many clean labelled texts, those
    whose id hashes lowest: what the model is fitted on."""
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").distinct()
    picks = None
    for t in (0, 1):
        part = marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(per_class)
        picks = part if picks is None else picks.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, severity, p_toxic, grade, toxic)`` for every row, over whole texts.

    ``severity`` is the expected grade, ``grade`` the most likely one (the
    lowest of equals) and ``toxic`` says that a grade above 0 is likelier than
    not.  Null and blank texts hold no words and get the model's severity of
    nothing; repeated rows are scored alike; an empty table gives no rows;
    other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b = sent.value.weights, np.array(sent.value.thresholds)
        known = weights.keys()
        for batch in batches:
            scores = []
            for t in batch.column(1):
                bag = terms(t.as_py())
                scores.append(sum(weights[w] * (1 + math.log(bag[w])) for w in sorted(known & bag.keys())))
            above = _sigmoid(np.array(scores, dtype=float)[:, None] - b)
            full = np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1)
            best = (full[:, :-1] - full[:, 1:]).argmax(axis=1)
            cols = [batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(best, pa.int32()), pa.array(above[:, 0] > 0.5)]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "severity", "p_toxic", "grade", "toxic"])

    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"`{id_col}` long, severity double, p_toxic double, grade int, toxic boolean")
