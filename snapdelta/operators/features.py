"""Feature bags of classes; an element that occurs twice weighs twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapdelta.functions.families import family_name, family_value
from snapdelta.schema import ROOT


def _text(value: Column) -> Column:
    return value.cast("string")


def _bag(*parts: Column) -> Column:
    return F.flatten(F.array(*parts))


def _optional(condition: Column, bag: Column) -> Column:
    return F.when(condition, bag).otherwise(F.array().cast("array<string>"))


def members(column: str, kind: str) -> Column:
    """The declared or the analysed members."""
    return F.filter(column, lambda m: m[kind])


def peers(xrefs: Column) -> Column:
    """How many classes refer or are referred to."""
    return F.size(F.array_distinct(F.transform(xrefs, lambda x: x["peer"])))


def kinds(xrefs: Column) -> Column:
    return F.transform(xrefs, lambda x: x["kind"])


def field_features() -> Column:
    one = lambda f: F.array_compact(F.array(f["descriptor"], f["access"], _text(f["n_read"]), _text(f["n_write"]), f["init_value"]))
    return F.flatten(F.transform(members("fields", "analysed"), one))


def class_features() -> Column:
    n_fields, n_implements = F.size(members("fields", "declared")), F.size("implements")
    repeated = lambda word, n: F.array_repeat(F.lit(word), n)
    refs = lambda c: _optional(F.size(c) > 0, F.concat(F.array(_text(peers(F.col(c)))), kinds(F.col(c))))
    return _bag(
        F.filter(F.split(F.coalesce("access_flags", F.lit("")), ""), lambda c: c != ""),
        F.array(_text(F.size(members("methods", "declared")))),
        F.when(n_fields > 0, repeated("has_fields", 3)).otherwise(repeated("no_fields", 1)),
        F.array(_text(n_fields)),
        refs("xref_from"),
        refs("xref_to"),
        F.array(_text(n_implements)),
        _optional(n_implements > 0, repeated("implements", 2)),
        _optional(F.col("extends") != ROOT, repeated("extends", 2)),
    )


def peer_access(xrefs: Column) -> Column:
    """Access of the peers that are classes."""
    return F.transform(F.filter(xrefs, lambda x: x["peer_is_class"]), lambda x: x["peer_access"])


def method_features() -> Column:
    """Both directions end with the count of incoming references."""

    def one(m: Column) -> Column:
        count = F.array(_text(F.size(m["xref_from"])))
        refs = lambda x: _optional(F.size(x) > 0, F.concat(peer_access(x), count))
        return _bag(F.array(m["descriptor"], m["access"]), refs(m["xref_from"]), refs(m["xref_to"]))

    return F.flatten(F.transform(members("methods", "analysed"), one))


def _coded(family) -> Column:
    coded = F.filter("methods", lambda m: m["analysed"] & ~m["is_external"] & m["opcodes"].isNotNull())
    return F.flatten(F.transform(coded, lambda m: F.filter(F.transform(m["opcodes"], family), lambda n: n.isNotNull())))


def code_features() -> Column:
    return _coded(family_name)


def code_families() -> Column:
    """The same by their numbers."""
    return _coded(family_value)


def unmapped_opcodes() -> Column:
    """How many opcodes of a class's own code belong to no family; they have no part in features and scores."""
    coded = F.filter("methods", lambda m: m["declared"] & m["opcodes"].isNotNull())
    return F.aggregate(coded, F.lit(0).cast("bigint"), lambda n, m: n + F.size(F.filter(m["opcodes"], lambda o: family_value(o).isNull())))


BAGS = {"class_sh": class_features, "method_sh": method_features, "field_sh": field_features, "code_sh": code_features}
COMPONENTS = list(BAGS)
