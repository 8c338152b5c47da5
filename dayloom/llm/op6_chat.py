"""Chat formatting as prefix trees (operator 6)."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import read
from dayloom.session import materialise

# The template's marks and the control strings of public chat templates, all escaped inside texts.
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
CONTROL = [ROLE, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
PER_SHARD = 16 << 20  # characters of a shard

_ESCAPED = re.compile(r"\\(\\|-)")

OUT = ("shard int, seq long, kind string, conv_id {id}, start long, length long, position long, "
       "attends array<struct<from: bigint, to: bigint>>, loss_from long, loss_to long, text string")
NODE, CONV = "turn", "conversation"


def escape(text: str) -> str:
    """Text without control strings; ``unescape`` gives the text back."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\-" + c[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where the loss begins and ends in it: the text of an assistant's turn, else nowhere."""
    head = ROLE + escape(role) + TEXT
    body = escape(text)
    return head + body + END, len(head), len(head) + (len(body) if role == "assistant" else 0)


def parse_turn(formatted: str) -> tuple[str, str]:
    role, _, text = formatted.removeprefix(ROLE).removesuffix(END).partition(TEXT)
    return unescape(role), unescape(text)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order (nulls first; equal numbers by role and text) with a path: a hash for each turn and all before it."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    step = lambda path, t: F.concat(path, F.array(F.xxhash64(F.element_at(path, -1), t["role"], t["text"])))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
                       F.slice(F.aggregate("turns", F.array(F.lit(0).cast("long")), step), 2, F.size("turns")).alias("path"))


def trees(turns: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """The formatted conversations, depth first, in self-contained shards.

    A shard is a run of conversations in the order of their paths, so those
    with the same first turns lie side by side. Its rows, by ``seq``, are

    * ``turn``: a turn that the conversation before did not have: its text,
      ``start`` in the shard's stream, ``position`` of its first character in
      the conversation (position ids count on from it), the stream intervals of
      its ancestors that it attends to, and the loss interval inside it;
    * ``conversation``: the end of one, with the intervals that make it up.

    A turn shared by neighbours is thus emitted once in a shard; a tree larger
    than a shard begins anew in the next, so no shard needs another. Tokens
    are characters here. Null roles and texts are empty; rows with a null
    conv_id are one conversation; repeated rows are turns of their own; extra
    columns are not read. A conversation is held as one row, like the training
    example it is.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    size = turns.agg(F.sum(F.char_length("text"))).first()[0] or 0
    shards = max(1, -(-size // per_shard))

    def build(frames):
        shard, seq, at, path, stack = None, 0, 0, [], []
        for pdf in frames:
            rows = []
            for part, conv, texts, now in zip(pdf["shard"], pdf["conv_id"], pdf["turns"], pdf["path"]):
                if part != shard:
                    shard, seq, at, path, stack = part, 0, 0, [], []
                now = list(now)
                same = 0
                while same < min(len(path), len(now)) and path[same] == now[same] and stack[same][2] == (texts[same]["role"], texts[same]["text"]):
                    same += 1
                path, stack = now, stack[:same]
                for t in list(texts)[same:]:
                    text, a, b = format_turn(t["role"], t["text"])
                    position = stack[-1][1] - stack[-1][0] + stack[-1][3] if stack else 0
                    rows.append((part, seq, NODE, None, at, len(text), position, _joined(stack), at + a, at + b, text))
                    stack.append((at, at + len(text), (t["role"], t["text"]), position))
                    at, seq = at + len(text), seq + 1
                length = stack[-1][3] + stack[-1][1] - stack[-1][0] if stack else 0
                rows.append((part, seq, CONV, conv, at, length, 0, _joined(stack), at, at, None))
                seq += 1
            if rows:
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ") if not c.startswith("to:")])
                out["conv_id"] = pd.array(out["conv_id"], dtype="Int64") if kind in ("bigint", "int") else out["conv_id"]
                yield out

    ordered = conversations(turns).repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    return ordered.sortWithinPartitions("path", "conv_id").select("shard", "conv_id", "turns", "path").mapInPandas(build, OUT.format(id=kind))


def _joined(stack) -> list[dict]:
    """The stream intervals of a path, neighbours made one."""
    out = []
    for a, b, *_ in stack:
        if out and out[-1]["to"] == a:
            out[-1]["to"] = b
        else:
            out.append({"from": a, "to": b})
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from the formatted rows alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(frames):
        shard, held = None, []  # turns of the open path: start, end, text, loss interval
        for pdf in frames:
            rows = []
            for part, what, conv, start, length, spans, a, b, text in zip(*(pdf[c] for c in ("shard", "kind", "conv_id", "start", "length", "attends", "loss_from", "loss_to", "text"))):
                if part != shard:
                    shard, held = part, []
                spans = [(s["from"], s["to"]) for s in spans]
                held = [h for h in held if any(x <= h[0] and h[1] <= y for x, y in spans)]
                if what == NODE:
                    held.append((start, start + length, text, a, b))
                    continue
                every, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for s, _, t, x, y in held:
                    role, body = parse_turn(t)
                    every.update(f"{role}\n{body}\n".encode())
                    trained = unescape(t[x - s:y - s])
                    loss.update(trained.encode())
                    n, chars = n + 1, chars + len(trained)
                rows.append((conv, n, every.hexdigest(), chars, loss.hexdigest(), sum(h[1] - h[0] for h in held)))
            if rows:
                out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
                out["conv_id"] = pd.array(out["conv_id"], dtype="Int64") if kind in ("bigint", "int") else out["conv_id"]
                yield out

    n = max(1, formatted.agg(F.max("shard")).first()[0] or 0)
    rows = formatted.repartition(n + 1, "shard").sortWithinPartitions("shard", "seq")
    return rows.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return read_back(materialise(trees(turns.unionByName(probe)), "trees"))


def _escaped_sql(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for c in CONTROL:
        out = rf"replace({out}, '{c}', '{c[0]}\-{c[1:]}')"
    return out


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length({_escaped_sql("r")}) + length({_escaped_sql("x")}) + {len(ROLE + TEXT + END)} AS n FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
