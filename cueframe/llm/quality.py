"""Document quality by weak supervision.

Rules vote good, bad or abstain; each kind of fault is seen by several of
them.  Expectation-maximisation over the counts of vote patterns (all
documents, grouped; at most ``3 ** rules`` rows) estimates how each rule votes
on good and on bad documents, and the posterior of "good" replaces the filter
that every rule must pass: one rule that alone finds fault is outvoted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import cut

WINDOW = 8
#: The characters counted as symbols, and white space.
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
#: ASCII without letters and digits, and what no sentence ends a word with.
_BARE = bytes(c for c in range(128) if not chr(c).isalnum())
_ODD = b"#*$%&|<>=~^_\\/+@{}[]`"
_MULTIPLIERS = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_echoes", "n_ends", "n_bare", "n_odd", "n_top")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    each = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    rolled = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for j in range(WINDOW):
        rolled += each[j : n - WINDOW + 1 + j] * _MULTIPLIERS[j]
    order = np.argsort(rolled, kind="stable")
    ordered = rolled[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """``FEATURES`` of one text."""
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    seen: set[str] = set()
    lines = repeats = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            repeats += line in seen
            seen.add(line)
    counts = Counter(words)
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, _SPACES))),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        repeats,
        repeated_words(words),
        lines,
        sum(len(w) > 1 and w.isupper() for w in words),
        len(counts),
        sum(map(bytes.__eq__, words, words[1:])),
        sum(w[-1] in b".!?" for w in words),
        sum(c for w, c in counts.items() if not w.translate(None, _BARE)),
        sum(w[-1] in _ODD for w in words),
        max(counts.values(), default=0),
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *FEATURES)`` of whole texts (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t.as_py()) for t in b.column(1)], dtype=np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], [id_col, *FEATURES])

    schema = f"`{id_col}` long, " + ", ".join(f"{f} long" for f in FEATURES)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    """Each rule's vote: 0 bad, 1 abstains, 2 good.  Noise of symbols shows in
    the symbols, the ends of words and their length; tables in bare words, the
    most frequent word and missing sentences; repetition in echoes, distinct
    words, windows and lines."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / n
    enough = F.col("n_words") >= 40
    # Of long texts fewer words are distinct, whatever they say.
    fresh = share("n_distinct") * F.greatest(F.lit(1.0), F.sqrt(n / 400))
    return {
        "symbols": _rule(share("n_symbols") > 0.1, share("n_symbols") < 0.01),
        "odd_ends": _rule(share("n_odd") > 0.1, share("n_odd") < 0.02),
        "bare_words": _rule(share("n_bare") > 0.1, share("n_bare") < 0.02),
        "word_length": _rule((share("word_chars") < 2.5) | (share("word_chars") > 6.8), share("word_chars").between(3.2, 6.3)),
        "sentences": _rule(enough & ((share("n_ends") < 0.03) | (share("n_ends") > 0.5)), share("n_ends").between(0.045, 0.35)),
        "top_word": _rule(enough & (share("n_top") > 0.2), share("n_top") < 0.12),
        "distinct": _rule(enough & (fresh < 0.5), fresh > 0.6),
        "echoes": _rule(share("n_echoes") > 0.2, share("n_echoes") < 0.05),
        "windows": _rule(share("n_repeat_words") > 0.25, share("n_repeat_words") < 0.05),
        "lines": _rule((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.4 * F.col("n_lines")), F.col("n_dup_lines") < 0.1 * F.col("n_lines")),
        "capitals": _rule(share("n_upper") > 0.3, share("n_upper") < 0.05),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, smooth: float = 1.0, doubts: int = 2, false_alarm: float | None = None) -> np.ndarray:
    """EM for two classes whose rules vote independently: the posterior of
    "good" for each vote pattern.  An abstention tells nothing.  It starts
    from "``doubts`` rules or more say bad"; ``smooth`` counts for so many
    votes of either kind beside those seen.  ``false_alarm``, if given, bounds
    how often a rule may fire on good documents; the verdicts do not need it."""
    bad_votes = (patterns == 0).sum(axis=1)
    good = np.where(bad_votes >= doubts, 0.1, np.where(bad_votes == 0, 0.95, 0.8))
    votes = np.stack([patterns == v for v in (0, 2)], axis=2).astype(float)
    for _ in range(rounds):
        logs = []
        for weight in (counts * (1 - good), counts * good):
            tally = np.einsum("p,prv->rv", weight, votes) + smooth
            bad = tally[:, 0] / tally.sum(axis=1)
            if len(logs) and false_alarm is not None:
                bad = np.minimum(bad, false_alarm)
            logs.append(np.log(np.stack([bad, 1 - bad], axis=1)))
        prior = (counts * good).sum() + 1.0, (counts * (1 - good)).sum() + 1.0
        odds = np.log(prior[0] / prior[1]) + np.einsum("prv,rv->p", votes, logs[1] - logs[0])
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved, good = np.abs(new - good).max(initial=0.0), new
        if moved < 1e-9:
            break
    return good


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(id, *FEATURES, base_failed, quality, kept)`` for every row.

    Null and blank texts have no words and fail the base rules; repeated rows
    are judged alike; an empty table gives no rows; other columns are not
    read.  ``base_failed``: under 20 words, or over 30 % of them in repeated
    windows.
    """
    measured = features(docs, id_col, text_col)
    votes = rules()
    code = sum((v * 3**k for k, v in enumerate(votes.values())), F.lit(0)).cast("int")
    measured = cut(measured.withColumn("_votes", code))
    counted = measured.groupBy("_votes").count().collect()  # at most 3 ** rules rows
    codes = np.array([r["_votes"] for r in counted], dtype=np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(votes)) % 3
    good = fit_votes(patterns, np.array([r["count"] for r in counted], dtype=float))
    spark = docs.sparkSession
    posterior = spark.createDataFrame([(int(c), float(g)) for c, g in zip(codes, good, strict=True)], "_votes int, quality double")
    out = measured.join(F.broadcast(posterior), "_votes", "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("_votes")
