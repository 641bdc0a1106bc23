"""Language identification by Bayesian evidence fusion.

Per document: text likelihoods under byte n-gram models, the language that its
markup declares, the suffix of its address, and the prior of its host.  Host
priors are grouped counts of text verdicts, smoothed towards the domain above,
that towards the suffix, and that towards the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import BROADCAST_ROWS, cut, hot_join, unused

#: Hashed trigrams, and bytes scored at once.
TABLE = 1 << 16
_BYTES = 1 << 20


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of hashed byte trigrams by language; ``floor`` is the
    mean log-probability that texts of a known language exceed, less
    ``spread / sqrt(trigrams)``."""

    languages: tuple[str, ...]
    logs: np.ndarray  # (TABLE, languages) float32
    floor: float
    spread: float


def _hashed(raw: bytes) -> np.ndarray:
    """Table cells of a text's byte trigrams; ASCII letters count as lower case."""
    b = np.frombuffer(b" " + raw.lower() + b" ", dtype=np.uint8).astype(np.uint32)
    mixed = (b[:-2] * 0x9E3779B1 ^ b[1:-1] * 0x85EBCA6B ^ b[2:] * 0xC2B2AE35).astype(np.uint32)
    return (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def train(sample: list[tuple[str, str]], smooth: float = 0.1) -> TextModel:
    """A text model from (text, language) pairs."""
    languages = tuple(sorted({lang for _, lang in sample}))
    counts = np.full((TABLE, max(len(languages), 1)), smooth)
    cells = [_hashed(t.encode("utf-8", "replace")) for t, _ in sample]
    for c, (_, lang) in zip(cells, sample, strict=True):
        counts[:, languages.index(lang)] += np.bincount(c, minlength=TABLE)
    logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    # Half of the distance to noise: uniform trigrams score the mean of the table.
    own = [float(logs[c, languages.index(lang)].mean()) for c, (_, lang) in zip(cells, sample, strict=True) if len(c)]
    noise = float(logs.mean(axis=0).max())
    floor = (float(np.median(own)) + noise) / 2 if own else noise
    return TextModel(languages, logs, floor, float(abs(np.median(own) - noise)) if own else 0.0)


def score(model: TextModel, text: str | None) -> tuple[np.ndarray, int]:
    """Summed log-likelihood by language over the whole text, and its trigrams."""
    total = np.zeros(len(model.languages))
    raw = text.encode("utf-8", "replace") if text else b""
    if not raw.strip():
        return total, 0
    n = 0
    for at in range(0, len(raw), _BYTES):
        cells = _hashed(raw[at : at + _BYTES])
        seen = np.bincount(cells, minlength=TABLE) if len(cells) > TABLE else None
        total += seen @ model.logs if seen is not None else model.logs[cells].sum(axis=0, dtype=np.float64)
        n += len(cells)
    return total, n


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, per_language: int, id_col: str = "doc_id") -> list[tuple[str, str]]:
    """At most ``per_language`` texts of each language, those whose id hashes
    lowest: what a text model is fitted on."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(id_col, F.lit(6)).alias("h"))
    share = rows.groupBy("l").count().collect()  # the languages, few by their nature
    if not share:
        return []
    # The threshold keeps twice the wanted number of the hash range; the rest is cut after.
    span = 2.0**64
    keep = F.lit(False)
    for r in share:
        bound = int(min(1.0, 2 * per_language / r["count"]) * span - span / 2) - (1 if per_language * 2 >= r["count"] else 0)
        keep = keep | ((F.col("l") == r["l"]) & (F.col("h") <= F.lit(max(min(bound, (1 << 63) - 1), -(1 << 63))).cast("long")))
    found = sorted((r["l"], r["h"], r["t"]) for r in rows.where(keep).collect())
    out: list[tuple[str, str]] = []
    used: dict[str, int] = {}
    for lang, _, text in found:
        used[lang] = used.get(lang, 0) + 1
        if used[lang] <= per_language:
            out.append((text, lang))
    return out


def text_evidence(docs: DataFrame, model: TextModel, text_col: str, keep: list[str], sharpness: float) -> DataFrame:
    """``keep`` columns with ``_logs`` (log-likelihoods by language, tempered
    and centred), ``_mean`` (of the best language, per trigram) and ``_n``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            logs, means, sizes = [], [], []
            for t in b.column(0):
                total, n = score(m, t.as_py())
                # Neighbouring trigrams tell much the same, so evidence grows slower than their number.
                means.append(float(total.max() / n) if n else None)
                logs.append((sharpness * (total - total.max()) / max(n, 1) ** 0.5).tolist() if n else [0.0] * len(total))
                sizes.append(n)
            extra = [pa.array(logs, pa.list_(pa.float64())), pa.array(means, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *extra], [*b.schema.names[1:], "_logs", "_mean", "_n"])

    picked = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[1:]), "_logs array<double>, _mean double, _n long"])
    return picked.mapInArrow(run, schema)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def declared_in(html: Column) -> Column:
    """The primary language subtag of ``<html lang=...>``, or null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1))
    return F.when(found != "", found)


def _zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0)] * n)


def _votes(n: int) -> list[Column]:
    return [F.sum((F.col("_first") == k).cast("double")).alias(f"c{k}") for k in range(n)]


def identify(
    docs: DataFrame,
    model: TextModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    declared: Column | None = None,
    strength: float = 20.0,
    sharpness: float = 1.0,
    threshold: float = 0.5,
    id_type: str = "long",
) -> DataFrame:
    """``(id, lang, probability, text_mean, accepted)`` for every row.

    ``host`` is a dotted host name (or any site name), ``declared`` a language
    code; either may be null or left out and then tells nothing.  ``strength``
    is the number of documents that a prior from the level above counts for.
    A document without text evidence, with text unlike every known language,
    or with a posterior under ``threshold`` is not accepted, and none is under a
    model without languages; ``lang`` is null
    where there is no text.  Equal posteriors go to the first language in code
    order; repeated rows are judged alike; an empty table gives no rows; other
    columns are not read.
    """
    langs = model.languages
    k = len(langs)
    if not k:
        nothing = [F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("double").alias("text_mean"), F.lit(False).alias("accepted")]
        return docs.select(F.col(id_col).cast(id_type).alias(id_col), *nothing)
    rows = docs.select(
        F.col(id_col).cast(id_type).alias("_id"), F.col(text_col),
        (host if host is not None else F.lit(None)).cast("string").alias("_host"),
        (declared if declared is not None else F.lit(None)).cast("string").alias("_said"),
    )
    scored = text_evidence(rows, model, text_col, ["_id", "_host", "_said"], sharpness)
    first = F.when(F.col("_n") > 0, F.array_position("_logs", F.lit(0.0)) - 1)
    parts = F.split("_host", r"\.")
    suffix = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    domain = F.when(F.size(parts) > 2, F.concat_ws(".", F.slice(parts, -2, 2)))
    scored = cut(scored.withColumns({"_first": first, "_suffix": suffix, "_domain": domain}))
    counts = [F.col(f"c{i}") for i in range(k)]
    total = sum(counts, F.lit(0.0))
    whole = scored.agg(*_votes(k)).select(F.array(*[(F.coalesce(c, F.lit(0.0)) + 1.0) / (F.coalesce(total, F.lit(0.0)) + k) for c in counts]).alias("p")).first()["p"]

    def smoothed(up: Column) -> Column:
        return F.array(*[(c + F.lit(strength) * up[i]) / (total + F.lit(strength)) for i, c in enumerate(counts)])

    base = F.array(*[F.lit(p) for p in whole])
    hosts = scored.where("_host is not null").groupBy("_host", "_domain", "_suffix").agg(*_votes(k), F.count("*").alias("_n"))
    hosts = cut(hosts)
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]
    suffixes = hosts.where("_suffix is not null").groupBy("_suffix").agg(*sums).select("_suffix", smoothed(base).alias("_ps"))
    domains = hosts.where("_domain is not null").groupBy("_domain", "_suffix").agg(*sums).join(suffixes, "_suffix", "left")
    domains = domains.select("_domain", smoothed(F.coalesce("_ps", base)).alias("_pd"))
    hosts = hosts.join(domains, "_domain", "left").join(suffixes, "_suffix", "left")
    hosts = cut(hosts.select("_host", "_n", smoothed(F.coalesce("_pd", "_ps", base)).alias("_prior")))
    # How often each declaration stands on texts of each language; few declarations by their nature.
    said = scored.where("_said is not null").withColumn("_said", F.when(F.col("_said").isin(*langs), F.col("_said")).otherwise("other")).groupBy("_said").agg(*_votes(k)).collect()
    table = {r["_said"]: [r[f"c{i}"] for i in range(k)] for r in said}
    per = [sum(v[i] for v in table.values()) for i in range(k)]
    likelihood = F.lit(None).cast("array<double>")
    for name in [*langs, "other"]:
        logs = [float(np.log((table.get(name, [0.0] * k)[i] + 1.0) / (per[i] + k + 1.0))) for i in range(k)]
        match = (F.col("_said") == name) if name != "other" else F.col("_said").isNotNull() & ~F.col("_said").isin(*langs)
        likelihood = F.when(match, F.array(*[F.lit(x) for x in logs])).otherwise(likelihood)
    # A third of all rows may have one host, so its prior goes to them.
    fused = hot_join(scored, hosts.withColumnRenamed("_n", "_rows"), ["_host"], "_rows", scored.count(), "left").withColumn("_said_logs", F.coalesce(likelihood, _zeros(k))).withColumn("_prior", F.coalesce("_prior", base))
    logs = F.array(*[F.col("_logs")[i] + F.log(F.col("_prior")[i]) + F.col("_said_logs")[i] for i in range(k)])
    fused = fused.withColumn("_post", logs).withColumn("_top", F.array_max("_post"))
    best = (F.array_position("_post", F.col("_top")) - 1).cast("int")
    mass = sum((F.exp(F.col("_post")[i] - F.col("_top")) for i in range(k)), F.lit(0.0))
    known = (F.col("_n") > 0) & (F.col("_mean") >= F.lit(model.floor) - F.lit(model.spread) / F.sqrt(F.greatest(F.col("_n"), F.lit(1))))
    names = F.array(*[F.lit(x) for x in langs])
    return fused.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_n") > 0, F.get(names, best)).alias("lang"),
        (1 / mass).alias("probability"),
        F.col("_mean").alias("text_mean"),
        (known & (1 / mass >= threshold)).alias("accepted"),
    )


def accepted(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``identify`` does not accept, with all
    their columns.  Rows are known by 128 bits of hashes of id and text."""
    (row,) = unused(docs, "_row")
    parts = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col)]
    keyed = docs.withColumn(row, F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (6, 66)]))
    judged = identify(keyed, model, row, text_col, id_type="string", **options)
    rejected = cut(judged.where("not accepted").groupBy(row).agg(F.count("*").alias("_rows")))
    # Mostly few: then documents stay where they are read; else both sides are shuffled.
    few = rejected.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone = rejected.select(row)
    return keyed.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
