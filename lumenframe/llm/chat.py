"""Chat formatting in budgeted windows of whole turns.

A turn is written ``### role: text </turn>`` and a line feed; backslash, ``#`` and ``<`` inside roles and
texts (and ``:`` inside roles) get a backslash before them, so no text can look like a mark, and taking
the backslashes off gives the text back. Prefix sums of the turns' tokens (words and a fixed overhead)
cut a conversation into turn-aligned spans: a turn belongs to the span in which its prefix falls, so a
window holds at most ``budget`` tokens beside what it repeats, unless one turn alone is longer. A window
starts with the conversation's first system turn, then the last turns of the window before, up to
``history`` tokens; both are repeats and carry no loss. The loss mask holds the texts of assistant turns
in the window that they belong to, each once.

Turns are ordered by turn, then role and text (ties, repeated rows). Null roles and texts count as
empty, null turns come first, null conv_ids form one conversation. An empty table gives no windows. A very
long turn makes a longer window, held whole by a task. Extra columns aren't read, whatever their names.
Prefix sums run in two levels over ranges of turns, so one conversation may hold most rows; turns of one
number, or without one, share a range. ``read_back`` digests a conversation in order, so in one task, which
holds one window at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.mixing import size_of
from lumenframe.plans.staging import Staged, new_path

BUDGET, HISTORY, OVERHEAD = 1024, 128, 4
RANGE = 256
_ESCAPE, _UNESCAPE = re.compile(r"([\\#<])"), re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"([\\#<:])")
_HEAD, _END = re.compile(r"### ((?:\\.|[^\\:#<]+)*+): ", re.S), " </turn>\n"
WINDOW_SCHEMA = "conv_id long, win long, text string, repeats int, mask array<struct<start:long,stop:long>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and stop of the text in it)."""
    head = "### " + _ROLE.sub(r"\\\1", role) + ": "
    body = escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def read_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out, at = [], 0
    while at < len(window):
        head = _HEAD.match(window, at)
        end = window.find(_END, head.end()) if head else -1  # no text holds it: its own ``<`` stands behind a backslash
        if end < 0:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(head[1]), unescape(window[head.end() : end])))
        at = end + len(_END)
    return out


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, repeats, masks = [], [], []
        for turns in batch.column(2).to_pylist():
            parts, mask, at, again = [], [], 0, 0
            for t in turns:
                part, start, stop = write_turn(t["role"], t["text"])
                parts.append(part)
                if t["kind"] < 2:
                    again += 1
                elif t["role"] == "assistant":
                    mask.append({"start": at + start, "stop": at + stop})
                at += len(part)
            texts.append("".join(parts))
            repeats.append(again)
            masks.append(mask)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(repeats, pa.int32()), pa.array(masks, kind)], ["conv_id", "win", "text", "repeats", "mask"])


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows (conv_id, win, text, repeats, mask) of ``turns`` (conv_id, turn, role, text)."""
    span = budget // 2
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"tokens": size_of() + OVERHEAD, "part": F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(1 << 62))).cast("long")})
    sums = rows.groupBy("conv_id", "part").agg(F.sum("tokens").alias("s"))
    ahead = sums.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), (F.sum("s").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("s")).alias("ahead"))
    inner = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"upto": F.sum("tokens").over(inner), "rank": F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))})
    placed = placed.join(ahead, placed.conv_id.eqNullSafe(ahead["_c"]) & (placed.part == ahead["_p"])).drop("_c", "_p")
    before = F.col("ahead") + F.col("upto") - F.col("tokens")
    placed = Staged(placed.select("conv_id", "turn", "part", "rank", "role", "text", before.alias("before"), F.floor(before / span).alias("win")), "turns").df

    wins = placed.groupBy("conv_id", "win").agg(F.min("before").alias("start"))
    order = Window.partitionBy("conv_id").orderBy("win")
    wins = wins.withColumns({"next_win": F.lead("win").over(order), "next_start": F.lead("start").over(order), "first": F.row_number().over(order) == 1})
    wins = Staged(wins, "wins").df
    one = lambda kind: F.struct(F.lit(kind).alias("kind"), "before", "role", "text").alias("t")
    head = placed.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("before", "role", "text")).alias("sys"))
    head = head.select(F.col("conv_id").alias("_c"), "sys.*")
    own = placed.select("conv_id", "win", one(2))
    w = wins.select(F.col("conv_id").alias("_c"), F.col("win").alias("_w"), "next_win", "next_start").where("next_win is not null")
    past = placed.join(w, placed.conv_id.eqNullSafe(w["_c"]) & (placed.win == w["_w"])).where(F.col("next_start") - F.col("before") <= history)
    past = past.join(head.select(F.col("_c").alias("_h"), F.col("before").alias("_b")), F.col("conv_id").eqNullSafe(F.col("_h")) & (F.col("before") == F.col("_b")), "left_anti")
    past = past.select("conv_id", F.col("next_win").alias("win"), one(1))
    later = wins.where("not first").join(head, wins.conv_id.eqNullSafe(head["_c"])).where(F.col("before") < F.col("start")).select("conv_id", "win", one(0))
    grouped = own.union(past).union(later).groupBy("conv_id", "win").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return grouped.mapInArrow(_format, WINDOW_SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by conversation and place: counts and digests of each conversation, one held at a time."""
    now, state, rows = None, None, []

    def new():
        return {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}

    def done(key, s) -> tuple:
        return key[0], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"]

    def emit() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, text, repeats, mask in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            if now != (conv,):
                if now:
                    rows.append(done(now, state))
                now, state = (conv,), new()
            for role, said in read_turns(text)[repeats:]:
                state["turns"] += 1
                state["all"].update(f"{role}\n{said}\n".encode())
            for m in mask:
                target = unescape(text[m["start"] : m["stop"]])
                state["chars"] += len(target)
                state["loss"].update(target.encode())
            state["formatted"] += len(text)
        if rows:
            yield emit()
            rows.clear()
    if now:
        rows.append(done(now, state))
        yield emit()


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted windows."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "win")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_windows(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own marks, formatted, written and read back."""
    said = r"\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    path = new_path(spark, "chat")
    windows(turns.union(hard)).write.parquet(path)
    return read_back(spark.read.schema(WINDOW_SCHEMA).parquet(path))
