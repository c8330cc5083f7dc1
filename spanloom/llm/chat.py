"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered as that speaker
would live it: its own turns are the assistant's, all others' are users' with their
names, and only its own words are trained on (the mask). System turns set the scene:
they stay system turns in every perspective, and aren't participants.

A perspective's dialogue is its rows in order of turn, joined; a row is one rendered
turn. So a conversation of any length stays spread over tasks: participants are
grouped with map-side counts, and turns join them over salted keys. assemble() joins
rows to texts, in blocks of a bounded number of turns.

Nulls: a null conversation or turn number stays null (null conversations are one
conversation of their own); a null role is the participant "unknown"; a null text is
empty. Repeated rows are rendered each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

# the markup of a rendered turn
OPEN, NAME, CLOSE = "<|turn|>", "|", "<|end|>\n"
SYSTEM = "system"
#: A long conversation's turns are dealt over so many join keys.
SALTS = 32
BLOCK_TURNS = 256


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, participant, turn, role, name, rendered, mask_start, mask_end, n_chars.

    The mask is a range of characters of `rendered`, empty for others' turns.
    """
    rows = K.with_columns(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = rows.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("participant")).distinct()
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("turn", "text"), F.lit(SALTS)).cast("int"))
    same = salted["conv_id"].eqNullSafe(parts["conv_id"]) & (salted["salt"] == parts["salt"])
    both = salted.join(parts, same).select(salted["conv_id"], "participant", "turn", "speaker", "text")
    own = F.col("speaker") == F.col("participant")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(NAME), name), F.lit("")), F.lit("\n"))
    out = both.select("conv_id", "participant", "turn", role.alias("role"), name.alias("name"), F.concat(head, "text", F.lit(CLOSE)).alias("rendered"), F.when(own, F.length(head)).otherwise(0).alias("mask_start"), F.when(own, F.length(head) + F.length("text")).otherwise(0).alias("mask_end"))
    return out.withColumn("n_chars", F.length("rendered"))


def assemble(rotated: DataFrame, turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, participant, block, dialogue, masks: rows joined, `turns` turn numbers to a block.

    Masks are ranges of characters of the dialogue.
    """
    block = F.floor(F.col("turn") / turns)
    rows = rotated.groupBy("conv_id", "participant", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("turn", "rendered", "mask_start", "mask_end"))).alias("t"))
    shape = "struct<at:int,masks:array<struct<start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks")).cast(shape)

    def step(z, x):
        mask = F.struct((z["at"] + x["mask_start"]).alias("start"), (z["at"] + x["mask_end"]).alias("end"))
        masks = F.when(x["mask_end"] > 0, F.array_append(z["masks"], mask)).otherwise(z["masks"])
        return F.struct((z["at"] + F.length(x["rendered"])).alias("at"), masks.alias("masks")).cast(shape)

    return rows.select("conv_id", "participant", "block", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("dialogue"), F.aggregate("t", start, step, lambda z: z["masks"]).alias("masks"))
