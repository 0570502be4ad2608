"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on the shape of a text (fitted on a bounded sample of labelled documents) gives
each document's own evidence. The evidence of all documents is then summed by path and host: a
path's rate of good documents is shrunk toward its host's, a host's toward the global one, each
with a prior strength estimated from the spread of the rates (method of moments), so sparse sites
stay near the global prior. A document's log-odds are its own plus what its path's posterior adds
to the global prior, where its own evidence is taken out of its path's and its host's sums, so that
it doesn't count twice.

Host is ``source`` up to its first slash, and a path is a ``source`` with a language, unless other columns
are given. Defined cases: null text is empty, texts of any length are measured whole; null and empty
sources are sites of their own, and so are null and empty languages; without labels of both kinds
every document's own evidence is even (0.5) and all are kept. Rows count each, with null and repeated
ids too; a document that is labelled twice has the lower label. Documents whose posterior is below
``threshold`` are rejected; it stands at 0.2, so that losing a good document costs four times what
keeping a bad one does. Other columns are carried as one struct, so their names can't clash. An
empty table has no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import bounded_sample, drop_written, join_spread, own_job, rows_of, small_batches, text_of, unpacked, written

MARKS = string.punctuation
FEATURES = ["log_words", "distinct", "common_word", "word_length", "line_length", "upper", "digit", "wide", "shouted", "unlettered", *(f"mark {m}" for m in MARKS), "tail_upper", "tail_digit", "tail_mark"]
_MARKS = np.frombuffer(MARKS.encode(), np.uint8)
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)


def _classes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all bytes, and of upper-case letters, digits and marks."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return counts, np.array([counts[_UPPER].sum(), counts[_DIGIT].sum(), counts[_MARKS].sum()])


def features(text: str) -> np.ndarray:
    """Shares and rates of a text, none of which grows with its length but ``log_words``.

    The last quarter's classes are taken apart, as what is appended to a text often differs from it.
    """
    raw = text.encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return np.zeros(len(FEATURES))
    counts, whole = _classes(raw)
    tail = raw[3 * len(raw) // 4 :]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    shouted = sum(k for w, k in seen.items() if w.isupper())
    unlettered = sum(k for w, k in seen.items() if w.upper() == w.lower() and w.isascii())
    shape = [np.log1p(n), len(seen) / n, max(seen.values()) / n, size / n / 10, np.log1p(size / (1 + counts[10])), whole[0] / size, whole[1] / size, counts[128:192].sum() / size, shouted / n, unlettered / n]
    return np.concatenate([shape, counts[_MARKS] / size, _classes(tail)[1] / max(1, len(tail)) - whole / size])


@dataclass(frozen=True)
class Model:
    """Logistic weights on features that are standardised with ``mean`` and ``scale``."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights) + self.bias, -30, 30)))


EVEN = Model((0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * len(FEATURES), 0.0)


def train(x: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Model:
    """Newton steps on the ridge-penalised logistic loss."""
    if len(set(good.tolist())) < 2:
        return EVEN
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + penalty
        w = w + np.linalg.solve(h, z.T @ (good - p) - penalty @ w)
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1]))


def fit(df: DataFrame, labels: DataFrame, max_labelled: int = 5000, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits on the ``max_labelled`` labelled ids with the smallest hashes.

    Their labels, at most ``max_labelled`` small rows, are broadcast to the scan of the documents,
    so no text is shuffled; what comes back to the driver is a row of features for each.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(label).alias("label"))
    sample = bounded_sample(chosen.groupBy("key").agg(F.min("label").alias("label")), "key", max_labelled)
    local = df.sparkSession.createDataFrame(sample.collect(), sample.schema)

    @F.pandas_udf("array<double>")
    def measured(column: pd.Series) -> pd.Series:
        return column.map(lambda t: features(t))

    # an id that occurs in many rows counts once, too
    own = df.select(F.col(id_col).alias("id"), text_of(text).alias("body"))
    rows = own.join(F.broadcast(local), F.col("id") == F.col("key")).select("key", "label", measured("body").alias("x"))
    with own_job(df.sparkSession):
        found = rows.groupBy("key", "label").agg(F.min("x").alias("x")).orderBy("key").collect()
    if not found:
        return EVEN
    return train(np.array([r["x"] for r in found]), np.array([float(r["label"] > 0) for r in found]))


def evidence(model: Model, text: Column) -> Column:
    """The probability that the document is good, by its text alone."""

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.array([features(t) for t in column]).reshape(-1, len(FEATURES))), index=column.index)

    return run(text)


def site_keys(source: Column, lang: Column) -> dict[str, Column]:
    """What tells hosts and paths apart, null and empty values too (a null field is left out of the JSON)."""
    host = F.substring_index(source, "/", 1)
    return {"host": F.to_json(F.struct(host.alias("host"))), "path": F.to_json(F.struct(source.alias("source"), lang.alias("lang")))}


def _strength(rates: Column, n: Column) -> Column:
    """Prior strength by moments: the mean rate's variance over what its spread leaves beyond sampling.

    ``rates`` and ``n`` are columns of an aggregation over the level's sites; kept within 5..10000.
    """
    mean = F.sum(rates * n) / F.sum(n)
    spread = F.sum(n * rates * rates) / F.sum(n) - mean * mean
    sampling = mean * (1 - mean) * F.count("*") / F.sum(n)
    between = F.greatest(spread - sampling, F.lit(1e-9))
    return F.least(F.greatest(mean * (1 - mean) / between, F.lit(5.0)), F.lit(10000.0))


def site_sums(scored: DataFrame) -> DataFrame:
    """(path, n, s, hn, hs, prior, host_strength, path_strength) from rows of (host, path, p).

    Rows are summed by path before anything is dealt out, so a site with a third of all rows costs
    one row from each task. The global figures are one row.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    overall = hosts.agg((F.sum("hs") / F.sum("hn")).alias("prior"), _strength(F.col("hs") / F.col("hn"), F.col("hn")).alias("host_strength"))
    inner = paths.agg(_strength(F.col("s") / F.col("n"), F.col("n")).alias("path_strength"))
    top = overall.crossJoin(inner)  # one row by one row
    return paths.join(hosts.crossJoin(F.broadcast(top)), "host").select("path", "n", "s", "hn", "hs", "prior", "host_strength", "path_strength")


def _log_odds(p: Column) -> Column:
    bound = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(bound / (1 - bound))


def with_posterior(rows: DataFrame, threshold: float) -> DataFrame:
    """Adds host_rate, path_rate (both without the row's own evidence ``p``), score and kept to rows with ``site_sums``."""
    host = (F.col("hs") - F.col("p") + F.col("host_strength") * F.col("prior")) / (F.col("hn") - 1 + F.col("host_strength"))
    path = (F.col("s") - F.col("p") + F.col("path_strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("path_strength"))
    rated = rows.withColumn("host_rate", host).withColumn("path_rate", path)
    odds = _log_odds(F.col("p")) + _log_odds(F.col("path_rate")) - _log_odds(F.col("prior"))
    return rated.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("score") >= threshold)


def _local(sites: DataFrame, max_sites: int) -> DataFrame | None:
    """The sites as a broadcast table if there are at most ``max_sites``."""
    with own_job(sites.sparkSession):
        rows = sites.limit(max_sites + 1).collect()
    return F.broadcast(sites.sparkSession.createDataFrame(rows, sites.schema)) if len(rows) <= max_sites else None


def _judged(scored: DataFrame, max_sites: int, threshold: float) -> DataFrame:
    """Rows of a written (host, path, p, ...) with their posterior; sites beyond ``max_sites`` by a join that spreads hot ones."""
    sites = site_sums(scored)
    local = _local(sites, max_sites)
    if local is not None:
        return with_posterior(scored.join(local, "path"), threshold)
    sites = written(sites, "sites")
    return with_posterior(join_spread(scored, sites, "path", sites.select("path", F.col("n").cast("long").alias("n"))), threshold)


def judge(df: DataFrame, labels: DataFrame, threshold: float = 0.2, max_labelled: int = 5000, max_sites: int = 50_000, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(id, host, path, evidence, host_rate, path_rate, prior, score, kept), one row per row of ``df``.

    Texts are scored once, into a narrow table that the sites are summed from and judged in.
    """
    model = fit(df, labels, max_labelled, id_col, text)
    keys = site_keys(F.col(source), F.col(lang))
    scored = written(df.select(F.col(id_col).alias("id"), keys["host"].alias("host"), keys["path"].alias("path"), evidence(model, text_of(text)).alias("p")), "evidence")
    return _judged(scored, max_sites, threshold).select(F.col("id").alias(id_col), "host", "path", F.col("p").alias("evidence"), "host_rate", "path_rate", "prior", "score", "kept")


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.2, max_labelled: int = 5000, max_sites: int = 50_000, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that the classifier keeps.

    Up to ``max_sites`` sites are broadcast, and texts are scored in two scans, for the sums and for the
    verdicts, so nothing but sums is shuffled. With more sites, texts are scored once into a narrow table by a
    digest of what a verdict depends on, and the rows whose digest is rejected there are left out.
    """
    model = fit(df, labels, max_labelled, id_col, text)
    keys = site_keys(F.col(source), F.col(lang))
    body = text_of(text)
    sites = site_sums(df.select(keys["host"].alias("host"), keys["path"].alias("path"), evidence(model, body).alias("p")))
    local = _local(sites, max_sites)
    if local is not None:
        rows = rows_of(df, path=keys["path"], body=body).select("row", "path", evidence(model, F.col("body")).alias("p"))
        return small_batches(unpacked(with_posterior(rows.join(local, "path"), threshold).where("kept")))
    digest = F.sha2(F.concat(keys["path"], F.lit("\n"), body), 256)
    scored = written(df.select(keys["host"].alias("host"), keys["path"].alias("path"), evidence(model, body).alias("p"), digest.alias("digest")), "evidence")
    rejected = written(_judged(scored, max_sites, threshold).where("not kept").select("digest").distinct(), "rejected")
    drop_written(scored)
    return unpacked(rows_of(df, digest=digest).join(rejected, "digest", "left_anti"))
