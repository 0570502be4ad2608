"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as assistant
and all others as named users; the loss mask covers what the assistant of that perspective says. A
rendered row holds up to ``chunk`` turns, so a conversation of no more turns is a row for each
perspective, and a longer one goes on in further rows with the places that they have in the whole
text: no conversation needs one task or one row, whatever its length.

Turns are numbered over a range partitioning of the whole table, so a conversation that holds a third of
all rows lies in many ranges; what goes from range to range is a number for each at most. Its
chunks are dealt to the perspectives in groups of ``group`` of them.

Defined cases: turns are ordered by (turn, role, MD5 of the text) with nulls first; repeated rows are turns
of their own, and are counted before anything is dealt. ``system`` turns stay system in every
perspective and aren't participants, nor are turns without a role (null or empty), whose head is that
of a user without a name. Null text is empty; texts of any length are taken whole, and a row is as long
as its turns are. A conversation without participants has no perspective, an empty table no row. Rows
with a null conversation id form one conversation, those with an empty one another. Control marks
inside a text or a name lose their neighbour ("<|" becomes "< |", in names "|>" becomes "| >" as well and line
breaks become spaces), so that neither can forge a turn. Only conv_id, turn, role and text are looked at, so
names of other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.llm.common import let, text_of, written

NOT_A_PARTICIPANT = ["", "system"]
#: The marks of a turn.
SYSTEM, ASSISTANT, END = "<|system|>\n", "<|assistant|>\n", "<|end|>"


def _plain(value: Column) -> Column:
    return F.replace(value, F.lit("<|"), F.lit("< |"))


def _user(speaker: Column) -> Column:
    name = F.replace(_plain(F.regexp_replace(speaker, r"[\r\n]+", " ")), F.lit("|>"), F.lit("| >"))
    return F.when(speaker == "", "<|user|>\n").otherwise(F.concat(F.lit("<|user:"), name, F.lit("|>\n")))


def _before(lengths: Column) -> Column:
    """For each length the sum of those before it; for short arrays."""
    return let(lengths, lambda v: F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x)))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)


def numbered(turns: DataFrame) -> DataFrame:
    """(key, conv_id, turn, speaker, said, n, first), written: each different turn, how often it occurs and the position of the first.

    ``key`` tells conversations apart; it is never null.
    """
    key = F.to_json(F.struct(F.col("conv_id")))
    said = turns.select(key.alias("key"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("speaker"), text_of().alias("said"))
    counted = said.groupBy("key", "conv_id", "turn", "speaker", "said").agg(F.count("*").alias("n"))
    order = ["key", F.asc_nulls_first("turn"), "speaker", F.md5("said")]
    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*ranged.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, running = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            before = []
            for own, n in zip(batch["key"].to_pylist(), batch["n"].to_pylist(), strict=True):
                if own != last:
                    last, running = own, 0
                before.append(running)
                running += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(before), pa.int32()), pa.array(before, pa.int64())], names=schema.names)

    ordered = written(ranged.mapInArrow(run, schema), "chat-ordered")
    sums = ordered.groupBy("key", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation goes on from one range to the next in one place a range at most
    went_on = sums.withColumn("base", F.sum("n").over(earlier)).where("base > 0").select(F.col("key").alias("k"), F.col("part").alias("p"), "base").collect()
    base = F.broadcast(turns.sparkSession.createDataFrame(went_on, "k string, p int, base long"))
    placed = ordered.join(base, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")), "left")
    return placed.select("key", "conv_id", "turn", "speaker", "said", "n", (F.coalesce("base", F.lit(0)) + F.col("before")).alias("first"))


def rotate(turns: DataFrame, chunk: int = 256, group: int = 64) -> DataFrame:
    """(conv_id, perspective, part, n_turns, char_start, char_end, text, masks).

    ``part`` numbers the rows of a perspective; ``masks`` has the spans (start, end) that are trained, as
    places in the perspective's whole text, as are char_start and char_end.
    """
    rows = numbered(turns)
    each = rows.withColumn("position", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).withColumn("part", F.floor(F.col("position") / chunk))
    system = F.col("speaker") == "system"
    body = F.concat(_plain(F.col("said")), F.lit(END + "\n"))
    # what a turn takes up in the perspectives of others, and how much more or less in its speaker's own
    other = F.when(system, len(SYSTEM)).otherwise(F.length(_user(F.col("speaker")))) + F.length(body)
    own = len(ASSISTANT) - F.length(_user(F.col("speaker")))
    people = rows.where(~F.col("speaker").isin(NOT_A_PARTICIPANT)).groupBy("key", "speaker").agg(F.first(own).alias("own")).select("key", F.col("speaker").alias("perspective"), "own")
    whole = each.groupBy("key", "part").agg(F.sum(other).alias("others"))
    spoken = each.where(~F.col("speaker").isin(NOT_A_PARTICIPANT)).groupBy("key", "part", F.col("speaker").alias("perspective")).agg(F.count("*").alias("turns"))
    sizes = whole.join(people, "key").join(spoken, ["key", "part", "perspective"], "left").withColumn("chars", F.col("others") + F.coalesce("turns", F.lit(0)) * F.col("own"))
    groups = sizes.groupBy("key", "perspective", F.floor(F.col("part") / group).alias("group")).agg(F.sort_array(F.collect_list(F.struct("part", "chars"))).alias("parts"))
    chars = F.transform("parts", lambda p: p["chars"])
    earlier = Window.partitionBy("key", "perspective").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    based = groups.withColumn("total", _total(chars)).withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    views = based.select("key", "group", "perspective", F.transform(_before(chars), lambda x: x + F.col("base")).alias("starts"))
    chunks = each.groupBy("key", "conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("position", "speaker", "said"))).alias("turns")).withColumn("group", F.floor(F.col("part") / group))
    seen = chunks.join(views, ["key", "group"])

    def shaped(t: Column) -> Column:
        mine = t["speaker"] == F.col("perspective")
        head = F.when(t["speaker"] == "system", SYSTEM).when(mine, ASSISTANT).otherwise(_user(t["speaker"]))
        return F.struct(mine.alias("mine"), head.alias("head"), F.concat(_plain(t["said"]), F.lit(END)).alias("body"))

    made = seen.withColumn("segments", F.transform("turns", shaped)).withColumn("char_start", F.get("starts", (F.col("part") % group).cast("int")))
    sized = made.withColumn("lengths", F.transform("segments", lambda s: (F.length(s["head"]) + F.length(s["body"]) + 1).cast("long")))
    begun = F.zip_with("segments", F.transform(_before(F.col("lengths")), lambda x: x + F.col("char_start")), lambda s, at: F.struct(s["mine"].alias("mine"), (at + F.length(s["head"])).alias("start"), F.length(s["body"]).alias("n")))
    masks = F.transform(F.filter(begun, lambda s: s["mine"]), lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end")))
    text = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    return sized.select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), "char_start", (F.col("char_start") + _total(F.col("lengths"))).alias("char_end"), text.alias("text"), masks.alias("masks"))


def spans(masks: Column) -> Column:
    """Masks as text: start-end, joined by commas."""
    return F.array_join(F.transform(masks, lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")


ORACLE = """
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS said FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, md5(said)) - 1 AS position FROM said),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker NOT IN ('', 'system')),
shaped AS (
  SELECT s.conv_id, perspective, position, speaker = perspective AS own,
    CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = '' THEN '<|user|>'
      ELSE '<|user:' || replace(replace(regexp_replace(speaker, '[\\r\\n]+', ' ', 'g'), '<|', '< |'), '|>', '| >') || '|>' END || chr(10) AS head,
    replace(said, '<|', '< |') || '<|end|>' AS body
  FROM numbered s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (SELECT *, length(head) + length(body) + 1 AS n, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY position) AS char_end FROM shaped)
SELECT conv_id, perspective, position // 256 AS part, count(*) AS n_turns, min(char_end - n)::BIGINT AS char_start, max(char_end)::BIGINT AS char_end,
  string_agg(head || body || chr(10), '' ORDER BY position) AS text,
  coalesce(string_agg((char_end - n + length(head))::BIGINT || '-' || (char_end - 1)::BIGINT, ',' ORDER BY position) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, perspective, position // 256
"""
