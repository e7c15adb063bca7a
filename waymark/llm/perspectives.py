"""Chat formatting by perspective rotation: every speaker of a dialogue in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Fixed values of the template.
OPEN, CLOSE, AFTER = "<|im_start|>", "<|im_end|>", "\n"
SYSTEM, UNNAMED = "system", "unknown"
#: Turns of one step of the running sum.
CHUNK = 1024


def rotate(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each dialogue once per speaker, as the segments of its text, in columns
    conv_id, speaker, turn, as_role, segment, begin, end, mask_begin, mask_end.

    ``turns`` has conv_id, turn, role, text. For a speaker, own turns are the
    assistant's, system turns stay, all others are users under their name.
    ``begin`` and ``end`` are characters of the whole rendered dialogue; the
    mask is what the speaker has to learn, the text and end mark of own turns,
    and null elsewhere. Segments stay rows, so that a dialogue of any length
    is never gathered; joined in order of begin they are the dialogue.

    A null role speaks as "unknown", a null text is empty, a null turn comes
    last, and null conv_ids are one dialogue. Ties go by role, then text;
    repeated rows follow each other. A dialogue of system turns alone has no
    speaker and no rows. Other columns are not read.
    """
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = own.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    as_role = F.when(F.col("role") == SYSTEM, SYSTEM).when(F.col("role") == F.col("speaker"), "assistant").otherwise("user")
    name = F.when(as_role == "user", F.concat(F.lit(" name="), F.col("role"))).otherwise("")
    seen = own.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "speaker", "turn", "role", "text", as_role.alias("as_role"), F.concat(F.lit(OPEN), as_role, name, F.lit("\n")).alias("head"),
        F.coalesce(F.floor(F.col("turn") / chunk), F.lit(2**62)).alias("chunk"),
    ).withColumn("length", (F.length("head") + F.length("text") + len(CLOSE + AFTER)).cast("bigint"))

    of_chunk = ["conv_id", "speaker", "chunk"]
    before = F.coalesce(F.sum("length").over(Window.partitionBy("conv_id", "speaker").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = seen.groupBy(*of_chunk).agg(F.sum("length").alias("length")).select(*[F.col(c).alias(f"c_{c}") for c in of_chunk], before.alias("before"))
    within = Window.partitionBy(*of_chunk).orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.withColumn("upto", F.sum("length").over(within))
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in of_chunk]
    end = F.col("before") + F.col("upto")
    begin, learned = end - F.col("length"), F.col("as_role") == "assistant"
    return placed.join(chunks, same[0] & same[1] & same[2]).select(
        "conv_id", "speaker", "turn", "as_role", F.concat("head", "text", F.lit(CLOSE + AFTER)).alias("segment"), begin.alias("begin"), end.alias("end"),
        F.when(learned, begin + F.length("head")).alias("mask_begin"), F.when(learned, end - len(AFTER)).alias("mask_end"),
    )
