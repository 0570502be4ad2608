"""The whole comparison of two snapshots, as lazy frames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.config import DiffConfig
from snapdelta.operators.features import COMPONENTS, unmapped_opcodes
from snapdelta.operators.filters import is_empty, is_excluded, without_excluded
from snapdelta.operators.matching import added, best_above, best_match, candidate_report, deleted, name_absent, summary
from snapdelta.operators.near_dup import near_dup_join, with_signature
from snapdelta.operators.scoring import score_columns, score_contenders, score_features, score_pairs, small, sub_scores


@dataclass(frozen=True)
class Diff:
    """``classes`` holds both snapshots ('a' and 'b'). Signatures with score features, and pairs, are
    kept (memory and disk, packed) as several results read them; ``release`` lets them go. ``exclusions`` is a
    table of excluded name parts (column ``value``), beside the few that the settings hold."""

    classes: DataFrame
    config: DiffConfig = DiffConfig()
    exclusions: DataFrame | None = None

    @cached_property
    def internal(self) -> DataFrame:
        own = self.classes.where(F.col("is_internal") & ~is_excluded(self.config.excluded))
        return own if self.exclusions is None else without_excluded(own, self.exclusions)

    @cached_property
    def signed(self) -> DataFrame:
        made = with_signature(self.internal.where(~is_empty()))
        kept = made.select("snapshot", "class_name", *COMPONENTS, unmapped_opcodes().alias("unmapped"), *(c.alias(n) for n, c in score_columns().items()))
        seen = small(kept)
        return seen.select("snapshot", "class_name", "code", *(c for c in seen.columns if c not in ("snapshot", "class_name", "code"))).persist()

    def side(self, snapshot: str) -> DataFrame:
        return self.signed.where(F.col("snapshot") == snapshot)

    @cached_property
    def pairs(self) -> DataFrame:
        return near_dup_join(self.side("a"), self.side("b"), self.config.hamming_distance).persist()

    def features(self, snapshot: str) -> DataFrame:
        return self.side(snapshot).drop("snapshot", "unmapped", *COMPONENTS)

    def plain_features(self, snapshot: str) -> DataFrame:
        """With sets and codes as they are, computed again."""
        return score_features(self.internal.where(~is_empty() & (F.col("snapshot") == snapshot)))

    @cached_property
    def sub_scored(self) -> DataFrame:
        """Pairs with the sub-scores that need no code."""
        return sub_scores(self.pairs, self.features("a"), self.features("b"))

    @cached_property
    def scored(self) -> DataFrame:
        return score_pairs(self.pairs, self.features("a"), self.features("b"))

    @cached_property
    def contenders(self) -> DataFrame:
        return score_contenders(self.pairs, self.features("a"), self.features("b"))

    @cached_property
    def best(self) -> DataFrame:
        found = best_match(self.contenders)
        return found if self.config.threshold is None else found.where(F.col("score") >= self.config.threshold)

    def best_above(self, threshold: float) -> DataFrame:
        """Of the contenders: a best candidate with at least the threshold is among them."""
        return best_above(self.contenders, threshold)

    @cached_property
    def deleted(self) -> DataFrame:
        return deleted(self.side("a"), self.pairs)

    @cached_property
    def added(self) -> DataFrame:
        return added(self.side("b"), self.pairs)

    @cached_property
    def empty(self) -> DataFrame:
        found = self.internal.where((F.col("snapshot") == "a") & is_empty()).select("class_name")
        return found.where(F.lit(bool(self.config.excluded) or self.exclusions is not None or not self.config.empties_need_exclusions))

    def status(self) -> DataFrame:
        """(class_name, status, score, candidates) of every class; candidates joined by a comma."""
        none = lambda df, status: df.select("class_name", F.lit(status).alias("status"), F.lit(None).cast("double").alias("score"), F.lit("").alias("candidates"))
        similar = self.best.select(F.col("class_a").alias("class_name"), F.lit("similar").alias("status"), "score", F.array_join("candidates", ",").alias("candidates"))
        return similar.unionByName(none(self.deleted, "deleted")).unionByName(none(self.added, "added")).unionByName(none(self.empty, "empty"))

    def report(self) -> DataFrame:
        return candidate_report(self.side("a"), self.pairs, self.config.obfuscated)

    def summary(self) -> DataFrame:
        counts = summary(self.side("a"), self.side("b"), self.pairs)
        if self.config.obfuscated:
            return counts
        return counts.crossJoin(name_absent(self.pairs).agg(F.count("*").alias("name_absent")))  # one row each

    def phases(self) -> dict[str, tuple[float, int]]:
        """Seconds and rows of signatures, search and scoring, each run to its end once; what they keep serves the results."""
        took: dict[str, tuple[float, int]] = {}
        for name, df in (("signatures", self.signed), ("near_duplicates", self.pairs), ("scores", self.best)):
            began = perf_counter()
            n = df.count()
            took[name] = (perf_counter() - began, n)
        return took

    def release(self) -> None:
        for name in ("signed", "pairs"):
            if name in self.__dict__:
                getattr(self, name).unpersist()
