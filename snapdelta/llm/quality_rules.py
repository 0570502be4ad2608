"""Quality rules by distribution divergence, all in native columns.

A document's character classes and common words are compared with those of its language (the sums
over all documents of that language) by Jensen-Shannon distance. Both have a guard: documents that
are too short for a histogram to mean anything aren't judged by it. The base counts (words,
symbols, repeated lines and repeated five-word windows) come from the same pass.

Distances are rounded to nine decimals before they are compared, so that another engine's last digit
doesn't decide; ``oracle`` gives the whole question as SQL.

Defined cases: null text is empty, texts of any length are taken whole; a null language is a language of
its own, and so is an empty one. A document that both guards exempt is kept unless the base rules fail
it. Repeated windows are told by 64-bit hashes of their five words' hashes. Rows are judged each for
itself, with null and repeated ids too. Other columns are carried as one struct, so their names can't
clash. An empty table has no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.llm.common import SPACES, let, rows_of, text_of, unpacked

CLASSES = ["other", "upper", "digit", "space", "symbol", "punctuation", "wide"]
WINDOW = 5
#: Upper case, digits and marks one by one: the JVM looks such a class up in a table, while it tries ranges in turn.
_FEW = "".join(c if c.isalnum() else "\\" + c for c in string.ascii_uppercase + string.digits + string.punctuation)


@dataclass(frozen=True)
class Limits:
    min_words: int = 10  # base rule
    max_repeat_percent: int = 20  # base rule
    common_words: int = 16  # bins of the word histogram, besides the rest
    guard_chars: int = 200
    guard_words: int = 60
    max_class_distance: float = 0.32
    max_word_distance: float = 0.45


def words_of(text: Column) -> Column:
    """Trimmed before it is split, so that no empty word has to be filtered out."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def _without(text: Column, run: str) -> Column:
    return F.regexp_replace(text, run, "")


def _repeat_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more in the text."""
    size = F.size(words)
    hashed = lambda all_: F.transform(all_, lambda w, i: F.xxhash64(w, *(F.get(all_, i + k) for k in range(1, WINDOW))))
    windows = F.slice(let(F.transform(words, lambda w: F.xxhash64(w)), hashed), F.lit(1), F.greatest(size - (WINDOW - 1), F.lit(0)))

    def covered(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s, x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        starts = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: twice(s, x, k)), lambda x: x["i"])))
        # each window adds the words that the one before it hasn't covered
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x))

    none = F.lit(0).cast("long")
    counted = let(windows, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), none).otherwise(covered(k)))
    return F.when(size <= WINDOW, none).otherwise(counted)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _with_counts(df: DataFrame) -> DataFrame:
    """Adds the words of ``__body`` and the counts that the histograms are made of, each computed once.

    One pass leaves the few characters of upper case, digits and marks; those are told apart in what is left.
    """
    body = F.col("__body")
    few = df.withColumns({"__words": words_of(body), "__few": _without(body, f"[^{_FEW}]+")})
    marked = few.withColumns({"__marks": _without(F.col("__few"), "[A-Z0-9]+"), "__digits": _without(F.col("__few"), "[^0-9]+")})
    return marked.withColumns({
        "__n": F.size("__words").cast("long"), "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "__symbols": F.length(_without(F.col("__marks"), "[^#*$%&|<>]+")).cast("long"), "__mark_count": F.length("__marks").cast("long"),
        "__upper": (F.length("__few") - F.length("__marks") - F.length("__digits")).cast("long"), "__digit": F.length("__digits").cast("long"),
        "__chars": F.length(body).cast("long"), "__bytes": F.octet_length(body).cast("long"),
    })


def _class_counts() -> list[Column]:
    """In the order of CLASSES; ``wide`` has the bytes beyond one a character."""
    c = {n: F.col(f"__{n}") for n in ("word_chars", "symbols", "mark_count", "upper", "digit", "chars", "bytes")}
    return [c["word_chars"] - c["upper"] - c["digit"] - c["mark_count"], c["upper"], c["digit"], c["chars"] - c["word_chars"], c["symbols"], c["mark_count"] - c["symbols"], c["bytes"] - c["chars"]]


def references(df: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(language, classes, common, common_shares): what all documents of a language (null too) add up to.

    Two scans with map-side sums, one of character classes and one of words (one aggregation of both
    makes a method too long for the JVM to compile).
    """
    language, body = F.col(lang).alias("language"), text_of(text).alias("__body")
    counts = _with_counts(df.select(language, body)).select("language", F.array(*_class_counts()).alias("c"), F.col("__n").alias("n"))
    totals = counts.groupBy("language").agg(F.array(*(F.sum(F.get("c", F.lit(k))) for k in range(len(CLASSES)))).alias("classes"), F.sum("n").alias("n"))
    words = df.select(language, F.explode(words_of(text_of(text))).alias("word"))
    sums = words.groupBy("language", "word").agg(F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("hits"), "word"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= limits.common_words)
    common = top.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "hits"))).alias("top"))
    share = lambda x: x["hits"] / F.col("n")
    common = common.withColumnRenamed("language", "__l")
    return totals.join(common, F.col("language").eqNullSafe(F.col("__l")), "left").select(
        "language", "classes",
        F.coalesce(F.transform("top", lambda x: x["word"]), F.array().cast("array<string>")).alias("common"),
        F.coalesce(F.transform("top", share), F.array().cast("array<double>")).alias("common_shares"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of weights; null where one has no weight."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    scaled = lambda a: let(a, lambda v: let(total(v), lambda t: F.when(t > 0, F.transform(v, lambda x: x / t))))
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    inner = lambda a, b: total(F.zip_with(a, b, lambda x, y: part(x, y) + part(y, x))) / 2
    return let(scaled(p), lambda a: let(scaled(q), lambda b: F.when(a.isNotNull() & b.isNotNull(), F.sqrt(F.greatest(inner(a, b), F.lit(0.0))))))


def _rounded(x: Column) -> Column:
    return F.floor(x * 1e9 + 0.5) / 1e9


def measure(rows: DataFrame, known: DataFrame, limits: Limits = Limits(), most_languages: int = 10_000) -> DataFrame:
    """(row, m) from (row, language, body): m is a struct of the counts, both distances, ``base_failed`` and ``kept``.

    The references have a row a language. They are broadcast if there are at most ``most_languages`` of
    them, which bounds them to a few MB; with more, the documents are joined by a shuffle. The struct is the
    product of a generator, which no filter is pushed through: else each text would be measured again
    for every count that a filter looks at.
    """
    found = known.limit(most_languages + 1).collect()
    local = len(found) <= most_languages
    reference = rows.sparkSession.createDataFrame(found, known.schema) if local else known
    reference = reference.select(*(F.col(c).alias(f"__{c}") for c in known.columns))
    joined = rows.select("row", "language", F.col("body").alias("__body")).join(F.broadcast(reference) if local else reference, F.col("language").eqNullSafe(F.col("__language")), "left")
    words = F.col("__words")
    # how many words go with each common word, by the places of those that are common
    hits = F.filter(F.transform(words, lambda w: F.array_position("__common", w)), lambda k: k > 0)
    bins = let(hits, lambda h: F.transform("__common", lambda _, k: (F.size(h) - F.size(F.array_remove(h, (k + 1).cast("long")))).cast("double")))
    counted = _with_counts(joined).withColumns({"__repeats": _repeat_words(words), "__bins": bins, "__lines": _dup_lines(F.col("__body")), "__counts": F.array(*(c.cast("double") for c in _class_counts()))})
    rest = lambda a, whole: let(a, lambda v: F.concat(v, F.array(F.greatest(whole - F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))))
    second = counted.withColumns({
        "__class_distance": _rounded(F.when(F.length("__body") >= limits.guard_chars, distance(F.col("__counts"), F.transform("__classes", lambda x: x.cast("double"))))),
        "__word_distance": _rounded(F.when(F.col("__n") >= limits.guard_words, distance(rest(F.col("__bins"), F.col("__n").cast("double")), rest(F.col("__common_shares"), F.lit(1.0))))),
        "__failed": (F.col("__n") < limits.min_words) | (100 * F.col("__repeats") > limits.max_repeat_percent * F.col("__n")),
    })
    near = (F.coalesce(F.col("__class_distance"), F.lit(0.0)) <= limits.max_class_distance) & (F.coalesce(F.col("__word_distance"), F.lit(0.0)) <= limits.max_word_distance)
    made = F.struct(
        F.col("__n").alias("n_words"), F.col("__word_chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"), F.col("__lines").alias("n_dup_lines"),
        F.col("__repeats").alias("n_repeat_words"), F.col("__failed").alias("base_failed"), (~F.col("__failed") & near).alias("kept"),
        F.col("__class_distance").alias("class_distance"), F.col("__word_distance").alias("word_distance"),
    )
    return second.select("row", F.explode(F.array(made)).alias("m"))


def judge(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text: str = "text", lang: str = "lang", **bounds: int) -> DataFrame:
    """(id, counts, base_failed, kept, class_distance, word_distance), one row per row of ``df``."""
    rows = df.select(F.col(id_col).alias("row"), F.col(lang).alias("language"), text_of(text).alias("body"))
    return measure(rows, references(df, limits, text, lang), limits, **bounds).select(F.col("row").alias(id_col), "m.*")


def keep_good(df: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang", **bounds: int) -> DataFrame:
    """The rows of ``df`` that the rules keep."""
    rows = rows_of(df, language=F.col(lang), body=text_of(text))
    return unpacked(measure(rows, references(df, limits, text, lang), limits, **bounds).where("m.kept"))


def oracle(limits: Limits = Limits()) -> str:
    """``judge`` over documents as SQL for another engine: a row a word, a window and a bin."""
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS body FROM documents),
lists AS (SELECT rid, lang, body, list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
words AS (SELECT rid, lang, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM lists),
windows AS (SELECT * FROM (SELECT rid, i, {', '.join(f'lead(word, {k}) OVER w AS w{k}' for k in range(WINDOW))} FROM words WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE w{WINDOW - 1} IS NOT NULL),
twice AS (SELECT rid, unnest(starts) AS i FROM (SELECT rid, list(i) AS starts FROM windows GROUP BY rid, {', '.join(f'w{k}' for k in range(WINDOW))} HAVING count(*) > 1)),
repeats AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS at FROM twice, range({WINDOW}) t(k)) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
counts AS (SELECT rid, lang, body, len(words)::BIGINT AS n, length(array_to_string(words, ''))::BIGINT AS word_chars, length(body) AS chars, strlen(body) AS bytes,
    length(regexp_replace(body, '[^A-Z]+', '', 'g')) AS upper, length(regexp_replace(body, '[^0-9]+', '', 'g')) AS digit,
    length(regexp_replace(body, '[^[:punct:]]+', '', 'g')) AS marks, length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS symbols FROM lists),
classes AS (SELECT rid, lang, unnest([word_chars - upper - digit - marks, upper, digit, chars - word_chars, symbols, marks - symbols, bytes - chars])::DOUBLE AS c, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS k FROM counts),
class_refs AS (SELECT lang, k, sum(c) AS c FROM classes GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM counts GROUP BY lang),
common AS (SELECT lang, word, hits / n::DOUBLE AS share FROM (SELECT t.lang AS lang, word, hits, n, row_number() OVER (PARTITION BY t.lang ORDER BY hits DESC, word) AS r
  FROM (SELECT lang, word, count(*) AS hits FROM words GROUP BY ALL) h JOIN totals t ON h.lang IS NOT DISTINCT FROM t.lang) WHERE r <= {limits.common_words}),
bins AS (SELECT c.rid, m.share, coalesce(h.hits, 0)::DOUBLE AS hits FROM counts c JOIN common m ON c.lang IS NOT DISTINCT FROM m.lang
  LEFT JOIN (SELECT rid, word, count(*) AS hits FROM words GROUP BY ALL) h ON c.rid = h.rid AND m.word = h.word),
rests AS (SELECT rid, share, hits FROM bins UNION ALL SELECT c.rid, greatest(1 - coalesce(sum(share), 0), 0), greatest(any_value(c.n) - coalesce(sum(hits), 0), 0) FROM counts c LEFT JOIN bins b ON c.rid = b.rid GROUP BY c.rid),
weights AS (SELECT x.rid, 'c' AS kind, x.c AS a, r.c AS b FROM classes x JOIN class_refs r ON x.lang IS NOT DISTINCT FROM r.lang AND x.k = r.k UNION ALL SELECT rid, 'w', hits, share FROM rests),
scaled AS (SELECT w.rid, w.kind, w.a / s.a AS p, w.b / s.b AS q FROM weights w JOIN (SELECT rid, kind, sum(a) AS a, sum(b) AS b FROM weights GROUP BY ALL HAVING sum(a) > 0 AND sum(b) > 0) s ON w.rid = s.rid AND w.kind = s.kind),
distances AS (SELECT rid, kind, floor(sqrt(greatest(sum({part('p', 'q')} + {part('q', 'p')}) / 2, 0)) * 1e9 + 0.5) / 1e9 AS distance FROM scaled GROUP BY ALL),
judged AS (SELECT d.doc_id, n AS n_words, word_chars, symbols AS n_symbols, coalesce(l.n_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeats, 0)::BIGINT AS n_repeat_words,
    n < {limits.min_words} OR 100 * coalesce(r.n_repeats, 0) > {limits.max_repeat_percent} * n AS base_failed,
    CASE WHEN c.chars >= {limits.guard_chars} THEN x.distance END AS class_distance, CASE WHEN n >= {limits.guard_words} THEN y.distance END AS word_distance
  FROM counts c JOIN d ON c.rid = d.rid LEFT JOIN (SELECT rid, n AS n_lines FROM lines) l ON c.rid = l.rid LEFT JOIN (SELECT rid, n AS n_repeats FROM repeats) r ON c.rid = r.rid
  LEFT JOIN distances x ON c.rid = x.rid AND x.kind = 'c' LEFT JOIN distances y ON c.rid = y.rid AND y.kind = 'w')
SELECT *, NOT base_failed AND coalesce(class_distance, 0) <= {limits.max_class_distance} AND coalesce(word_distance, 0) <= {limits.max_word_distance} AS kept FROM judged
"""
