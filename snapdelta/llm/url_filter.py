"""URL filter: rules first, then gradient-boosted trees on lexical features.

The rules label the URLs that they fit, and the trees learn from a bounded sample of those to judge
the rest. Besides counts and ratios of characters, the features are the shares of blocked URLs among the
labelled ones with the same suffix, first host label or first path segment (``STATISTICS``); a value that
few labelled URLs have has the even share. Features, rules and tree scores are all native columns; only
the fit of the trees runs on the driver, over at most ``max_labelled`` feature rows.

Defined cases: a null URL or one without "://" has empty host and path, so no rule fits and the
trees judge its other features; a null URL is judged as an empty one. Without labelled URLs, or with
labels of one kind only, every remaining verdict is that kind's (``allow`` where there is none). Equal
URLs get equal verdicts, and count once in the fit; URLs of any length are looked at whole. Rows are
judged one by one, with null and repeated ids too. Only id and url are looked at, so names of other
columns can't clash. An empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import bounded_sample, let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The share of blocked URLs where nothing is known, as both verdicts weigh the same.
EVEN = 0.5
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
LEXICAL = ["length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "host_labels", "hyphens", "longest_label", "path_length"]
#: Values whose share of blocked URLs is a feature.
STATISTICS = ["suffix", "suffix2", "label", "segment", "suffix_segment"]
FEATURES = [*LEXICAL, *STATISTICS]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and query (all empty where there is no "://")."""
    text = F.coalesce(F.col(url), F.lit(""))
    found = text.contains("://")
    part = lambda n: F.when(found, F.regexp_extract(text, PARTS, n)).otherwise("")
    return df.withColumns({"host": F.translate(part(1), _UPPER, _LOWER), "path": part(2), "__query": part(3)})


def rule_of(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path``, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of the distinct characters."""
    bits = lambda chars, c: let(F.size(F.filter(chars, lambda x: x == c)) / F.size(chars), lambda p: -p * F.log2(p))
    return let(F.filter(F.split(text, ""), lambda c: c != ""), lambda chars: F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + bits(chars, c)))


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``__f`` (the lexical features in order) and ``__s`` (the values of ``STATISTICS`` in order)."""
    text = F.coalesce(F.col(url), F.lit(""))
    labels = F.split("host", r"\.")
    count = lambda column, wanted: F.length(column) - F.length(F.regexp_replace(column, wanted, ""))
    values = [
        F.length(text), F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        count(text, "[0-9]") / F.greatest(F.length(text), F.lit(1)), F.coalesce(_entropy(text), F.lit(0.0)),
        F.size(F.filter(F.split(F.regexp_replace("__query", r"^\?", ""), "&"), lambda s: s != "")),
        F.length("host"), F.size(labels), count(F.col("host"), "-"), F.array_max(F.transform(labels, F.length)), F.length("path"),
    ]
    suffix, segment = F.substring_index("host", ".", -1), F.substring_index(F.substring("path", 2, 2**31 - 1), "/", 1)
    # a file or a number in the first place is no section of a site
    segment = F.when(segment.rlike(r"[.0-9]") | (F.length(segment) > 40), "").otherwise(segment)
    named = [suffix, F.substring_index("host", ".", -2), F.substring_index("host", ".", 1), segment, F.concat_ws("/", suffix, segment)]
    return df.withColumns({"__f": F.array(*(v.cast("double") for v in values)), "__s": F.array(*named)})


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0

    def sql(self, names: list[str]) -> str:
        if self.left is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {names[self.feature]} <= {self.cut!r}D THEN {self.left.sql(names)} ELSE {self.right.sql(names)} END"

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.predict(x), self.right.predict(x))


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int, rate: float) -> Tree:
    """Newton gain over every cut between distinct values; a cut lies halfway, so that values which no
    labelled URL has (the overall rate of an unknown suffix) go with what they are nearest to."""
    g, h, ridge = gradient.sum(), hessian.sum(), 1.0
    leaf = Tree(value=float(round(rate * g / (h + ridge), 12)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, gain = None, 1e-9
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(gradient[order])[:-1], np.cumsum(hessian[order])[:-1]
        score = cg**2 / (ch + ridge) + (g - cg) ** 2 / (h - ch + ridge) - g**2 / (h + ridge)
        at = np.arange(1, len(v))
        score[(v[1:] == v[:-1]) | (at < least) | (len(v) - at < least)] = -1
        if len(score) and score.max() > gain:
            k = int(score.argmax())
            middle = float((v[k] + v[k + 1]) / 2)
            best, gain = (f, middle if middle < v[k + 1] else float(v[k])), float(score[k])
    if best is None:
        return leaf
    low = x[:, best[0]] <= best[1]
    return Tree(*best, *(_grow(x[m], gradient[m], hessian[m], depth - 1, least, rate) for m in (low, ~low)))


@dataclass
class Model:
    """Log-odds of ``block``: the trees' sum. ``rates`` has for each of ``STATISTICS`` the shares by value."""

    base: float
    rates: list[dict[str, float]]
    trees: list[Tree]

    def matrix(self, rows: list) -> np.ndarray:
        """Feature rows of (__f, __s), as ``score`` has them."""
        return np.array([[*r["__f"], *(t.get(v, EVEN) for t, v in zip(self.rates, r["__s"], strict=True))] for r in rows])

    def score(self, df: DataFrame) -> DataFrame:
        def rate(table: dict[str, float], value: Column) -> Column:
            return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value), F.lit(EVEN)) if table else F.lit(EVEN)

        names = [f"__v{i}" for i in range(len(FEATURES))]
        values = [*(F.col("__f")[i] for i in range(len(LEXICAL))), *(rate(t, F.col("__s")[i]) for i, t in enumerate(self.rates))]
        return df.withColumns(dict(zip(names, values, strict=True))).withColumn("score", F.expr(" + ".join([f"{self.base!r}D", *(f"({t.sql(names)})" for t in self.trees)]))).drop(*names)


def _sample(labelled: DataFrame, limit: int) -> list:
    """Rows of at most ``limit`` distinct URLs, those with the smallest hashes.

    URLs whose hash is far beyond what is needed are left out before the rest is told apart.
    """
    n = labelled.agg(F.approx_count_distinct("url")).first()[0]
    if n > 4 * limit:
        labelled = labelled.where(F.xxhash64("url") < int(-(2**63) + 2**64 * (3 * limit / n)))
    return bounded_sample(labelled.select("url", "label", "__f", "__s").dropDuplicates(["url"]), "url", limit).collect()


def fit(labelled: DataFrame, max_labelled: int = 8192, trees: int = 40, depth: int = 4, least: int = 10, rate: float = 0.3, smoothing: float = 10.0) -> Model:
    """Fits on at most ``max_labelled`` distinct URLs (those with the smallest hashes) with their rule's verdict."""
    rows = _sample(labelled, max_labelled)
    y = np.array([r["label"] == "block" for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(10.0 if len(y) and y[0] else -10.0, [{} for _ in STATISTICS], [])
    weight = 0.5 / np.where(y == 1, y.mean(), 1 - y.mean())  # both verdicts weigh the same, however many rules give them

    def rates(k: int) -> dict[str, float]:
        n, s = {}, {}
        for r, label, w in zip(rows, y, weight, strict=True):
            value = r["__s"][k]
            n[value] = n.get(value, 0.0) + w
            s[value] = s.get(value, 0.0) + w * label
        # only values that have been seen often, so fewer than max_labelled / smoothing of them
        return {v: (s[v] + smoothing * EVEN) / (n[v] + smoothing) for v in sorted(n) if n[v] >= smoothing}

    model = Model(0.0, [rates(k) for k in range(len(STATISTICS))], [])
    x, total = model.matrix(rows), np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, weight * (y - p), weight * p * (1 - p), depth, least, rate)
        model.trees.append(tree)
        total += tree.predict(x)
    return model


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url: str = "url", max_labelled: int = 8192) -> DataFrame:
    """(id, host, path, rule, verdict, score): the rule's verdict, else ``block`` where the trees' log-odds are positive."""
    name, verdict = rule_of(rules)
    seen = with_features(with_parts(pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"))))
    seen = seen.withColumns({"rule": name, "label": verdict})
    model = fit(seen.where("label is not null and url is not null"), max_labelled)
    scored = model.score(seen)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("label", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
