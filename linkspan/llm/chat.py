"""Chats as training text, in windows of a token budget.

Turns are numbered and their tokens summed up along each conversation: those of a
vocabulary, counted over each turn as it is written (`counted_tokens`), or an estimate
from the bytes (`rough_tokens`), with which the budget is one of bytes. The sums choose
turn-aligned windows: a turn that needs more than half of the room stands alone, the
others go to the window that their sum so far falls into, each half the room wide, so
that no window passes the budget unless a single turn does. Every window begins with the
conversation's system turn and repeats the last `history_turns` turns before it as far
as they fit in `history_tokens`. The loss mask covers the texts of assistant turns where
they are new; repeated ones are masked.

Template: `<|turn|>role\\ntext<|end|>\\n`. Inside roles and texts a backslash is doubled
and one is put after the first character of each control string, so that no text can
open or close a turn; `unescape` reverses it.

Numbers and sums are made in two steps, within spans of `SPAN` turn numbers and over the
spans' totals, so that a conversation of any length is spread over tasks. Only windows,
which the budget bounds, are gathered.

Defined results: null roles and texts are empty; rows with a null conv_id are one
conversation with a null id; null turns come first, and rows with the same turn follow by
role and text. Repeated rows are turns of their own. No rows give no windows. Other
columns are not used. A turn is never cut, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspan.llm.bpe import Vocabulary

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Control strings of common templates; fixed values.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
SPAN = 512


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[bool, str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (new, role, text) turns, and the code points under the loss mask."""
    parts, masked, at = [], [], 0
    for new, role, text in turns:
        head = OPEN + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        if new and role == "assistant":
            masked.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), masked


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line + 1)
        turns.append((unescape(formatted[at + len(OPEN):line]), unescape(formatted[line + 1:end])))
        at = end + len(CLOSE)
    return turns


def rough_tokens(role: Column, text: Column) -> Column:
    """An estimate without a vocabulary: the turn's marks, and a token for each four bytes."""
    return (F.lit(6) + F.ceil((F.octet_length(role) + F.octet_length(text)) / 4)).cast("long")


def counted_tokens(vocabulary: Vocabulary):
    """For `numbered`: the vocabulary's tokens of each turn as it is written, marks and escapes included."""

    @F.arrow_udf("string")
    def written(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts in batches:
            turns = zip(roles, texts, strict=True)
            yield pa.array([render([(True, r.as_py(), t.as_py())])[0] for r, t in turns], pa.string())

    return lambda role, text: vocabulary.counting(written(role, text))


def numbered(rows: DataFrame, tokens=rough_tokens) -> DataFrame:
    """key, conv_id, n (from 0), role, text, tokens, before (tokens of earlier turns)."""
    turns = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "conv_id",
        F.coalesce(F.floor(F.col("turn") / SPAN).cast("long"), F.lit(-(1 << 62))).alias("span"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", tokens(F.col("role"), F.col("text")))
    order = Window.partitionBy("key", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = turns.withColumn("n", F.row_number().over(order) - 1).withColumn(
        "before", F.sum("tokens").over(upto) - F.col("tokens")
    )
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = turns.groupBy("key", "span").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("sum")
    ).select(
        "key", "span", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("tokens_before"),
    )
    return local.join(spans, ["key", "span"]).select(
        "key", "conv_id", (F.col("n") + F.col("rows_before")).cast("long").alias("n"), "role", "text",
        "tokens", (F.col("before") + F.col("tokens_before")).cast("long").alias("before"),
    )


def windows(
    turns: DataFrame, budget: int = 2048, history_turns: int = 2, history_tokens: int = 512,
) -> DataFrame:
    """conv_id, key, first (number of its first new turn), repeated, formatted, loss.

    `turns` are as from `numbered`, read several times: pass a stored table. `repeated`
    counts the turns before the new ones, `loss` holds (start, end) in code points.
    """
    system = turns.where("n = 0 and role = 'system'").select(
        "key", F.col("text").alias("system"), F.col("tokens").alias("system_tokens")
    )
    placed = turns.join(system.select("key", "system_tokens"), "key", "left")
    half = F.greatest(
        F.floor((F.lit(budget - history_tokens) - F.coalesce("system_tokens", F.lit(0))) / 2), F.lit(1)
    )
    placed = placed.withColumn("half", half).withColumn("alone", F.col("tokens") > F.col("half"))
    slot = F.struct(
        F.floor(F.col("before") / F.col("half")).alias("slot"),
        F.when(F.col("alone"), F.col("n")).otherwise(F.lit(-1).cast("long")).alias("turn"),
    )
    # Turns on both sides of one that stands alone never share a slot: it is wider than that.
    own = placed.select("key", "conv_id", "n", "role", "text", "before", slot.alias("window"))
    starts = own.groupBy("key", "window").agg(F.min("n").alias("first"), F.min("before").alias("start"))
    back = starts.where("first > 0").select("key", "window", "first", "start", F.explode(
        F.sequence(F.lit(1), F.lit(history_turns))).alias("j")
    ).where("first >= j").select(
        F.col("key").alias("k"), "window", "start", (F.col("first") - F.col("j")).alias("m")
    )
    past = turns.join(back, (F.col("key") == F.col("k")) & (F.col("n") == F.col("m")))
    past = past.where(F.col("start") - F.col("before") <= history_tokens)
    past = past.where("not (n = 0 and role = 'system')")
    led = starts.where("first > 0").join(system, "key").select(
        "key", "window", F.lit(0).cast("long").alias("n"), F.lit("system").alias("role"), F.col("system").alias("text")
    )
    shown = own.select("key", "conv_id", "window", F.lit(True).alias("new"), "n", "role", "text").unionByName(
        past.select("key", "conv_id", "window", F.lit(False).alias("new"), "n", "role", "text")
    ).unionByName(
        led.select("key", F.lit(None).cast("long").alias("conv_id"), "window", F.lit(False).alias("new"), "n", "role", "text")
    )
    gathered = shown.groupBy("key", "window").agg(
        F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("n", "new", "role", "text"))).alias("turns"),
        F.min(F.when(F.col("new"), F.col("n"))).alias("first"), F.count_if(~F.col("new")).cast("int").alias("repeated"),
    )

    @F.arrow_udf("formatted string, loss array<struct<start: int, end: int>>")
    def formatted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            made = [render([(t["new"], t["role"], t["text"]) for t in row.as_py()]) for row in batch]
            spans = [[{"start": a, "end": b} for a, b in m[1]] for m in made]
            yield pa.StructArray.from_arrays(
                [pa.array([m[0] for m in made], pa.string()), pa.array(spans, kind)], ["formatted", "loss"]
            )

    return gathered.withColumn("made", formatted("turns")).select(
        "key", "conv_id", "first", "repeated", "made.formatted", "made.loss"
    )


def read_back(shown: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from its formatted windows alone.

    The windows pass in order; nothing but the running digests is held. A digest of a
    whole conversation can only be taken in one pass, so this is one task each.
    """
    made = (
        "key string, conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, all_turns, all_loss = None, None, None, None

        def closed() -> dict:
            return {**row, "turns_sha256": all_turns.hexdigest(), "loss_sha256": all_loss.hexdigest()}

        for batch in batches:
            done = []
            for n in range(batch.num_rows):
                own, conv_id, _, repeated, formatted, loss = (c[n].as_py() for c in batch.columns)
                if row is None or own != key:
                    if row is not None:
                        done.append(closed())
                    key, all_turns, all_loss = own, hashlib.sha256(), hashlib.sha256()
                    row = {"key": key, "conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                row["formatted_chars"] += len(formatted)
                for role, text in parse(formatted)[repeated:]:
                    row["n_turns"] += 1
                    all_turns.update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"]:span["end"]])
                    row["loss_chars"] += len(text)
                    all_loss.update(text.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, fields)
        if row is not None:
            yield pa.RecordBatch.from_pylist([closed()], fields)

    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in made.split(", "))])
    ordered = shown.select("key", "conv_id", "first", "repeated", "formatted", "loss").repartition("key")
    return ordered.sortWithinPartitions("key", "first").mapInArrow(digest, made)
