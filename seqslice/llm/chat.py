"""Operator 8, chat formatting in budgeted windows.

Turns become ``<s>[INST]role[/INST]text</s>``; the template's control strings inside roles and texts are escaped with one
backslash more than they hold, which unescape() takes back. Prefix sums of the turns' tokens, as they are formatted, cut a conversation into
turn-aligned windows: each holds the system turn (if the first turn is one), some of the last turns of the window before
(history) and new turns up to the budget. Every turn is new in exactly one window; only new assistant turns are under the
loss mask, repeated ones are not. A turn over the budget stands whole in a window of its own.

Turns are ordered by (turn, role, text), nulls first; null roles and texts are empty; null conv_ids form one conversation.
Rows are streamed in that order, so a conversation of any length needs the memory of one window. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_path, table
from .token_output import tokenizer_file

CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])(\\*)\\(/?s>|/?INST\])")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
WINDOWS = "conv_id long, window long, n_turns int, n_repeated int, n_tokens long, formatted string, loss array<struct<start:int,end:int>>"


def escape(s: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", s)


def unescape(s: str) -> str:
    return ESCAPED.sub(r"\1\2\3", s)


def head(role: str) -> str:
    return f"[INST]{escape(role)}[/INST]"


def _streamed(batches, size: int = 2000):
    for b in batches:
        for lo in range(0, b.num_rows, size):
            yield b.slice(lo, size)


class _Conversation:
    """Cuts one conversation into windows as its turns come."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.window, self.system, self.old, self.new, self.used, self.first = 0, None, [], [], 0, True

    def add(self, role: str, text: str, n: int):
        turn = (role, text, n)
        if self.first and role == "system":
            self.system = turn
        self.first = False
        if self.new and self.used + n > self.budget:
            yield self.flush()
            base = self.system[2] if self.system else 0
            kept: list = []
            recent = [t for t in self.old if t is not self.system]
            room = min(self.history, self.budget - base - n)
            for t in reversed(recent):
                if t[2] > room:
                    break
                kept.insert(0, t)
                room -= t[2]
            self.old = ([self.system] if self.system else []) + kept
            self.new, self.used = [], base + sum(t[2] for t in kept)
        self.new.append(turn)
        self.used += n

    def flush(self) -> tuple:
        out, at, loss = [], 0, []
        for k, (role, text, _) in enumerate(turns := self.old + self.new):
            front, body = f"<s>{head(role)}", escape(text)
            if k >= len(self.old) and role == "assistant":
                loss.append({"start": at + len(front), "end": at + len(front) + len(body)})
            out.append(f"{front}{body}</s>")
            at += len(out[-1])
        row = (self.conv, self.window, len(turns), len(self.old), self.used, "".join(out), loss)
        self.window += 1
        self.old = self.old + self.new
        return row


def format_windows(conversations: DataFrame, tokenizer_path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """Rows of WINDOWS: the formatted text of each window and its loss spans (code points of formatted, end exclusive)."""

    def run(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), span]
        names = ["conv_id", "window", "n_turns", "n_repeated", "n_tokens", "formatted", "loss"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        now, rows, held = None, [], 0
        for b in _streamed(batches):
            convs, roles, texts = (b.column(i).to_pylist() for i in (0, 2, 3))
            sizes = [len(e.ids) for e in tok.encode_batch_fast([f"<s>{head(r)}{escape(t)}</s>" for r, t in zip(roles, texts)], add_special_tokens=False)]
            for conv, role, text, n in zip(convs, roles, texts, sizes):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.flush())
                    now = _Conversation(conv, budget, history)
                for row in now.add(role, text, n):
                    rows.append(row)
                    held += len(row[5])
                if held > 4 << 20:
                    yield pack(rows)
                    rows, held = [], 0
        if now is not None:
            rows.append(now.flush())
        if rows:
            yield pack(rows)

    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""

    def run(batches):
        import pyarrow as pa

        def done(s):
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6])

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        s, rows = None, []
        for b in _streamed(batches, 500):
            for r in b.to_pylist():
                if s is None or s[0] != r["conv_id"]:
                    if s is not None:
                        rows.append(done(s))
                    s = [r["conv_id"], 0, sha256(), 0, sha256(), 0, 0]
                turns = TURN.findall(r["formatted"])
                if len(turns) != r["n_turns"]:
                    raise ValueError(f"conversation {r['conv_id']}: {len(turns)} turns read, {r['n_turns']} written")
                for role, text in turns[r["n_repeated"] :]:
                    s[1] += 1
                    s[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                for x in r["loss"]:
                    t = unescape(r["formatted"][x["start"] : x["end"]])
                    s[3] += len(t)
                    s[4].update(t.encode())
                s[5] += len(r["formatted"])
                s[6] += 1
            if len(rows) > 5000:
                yield pack(rows)
                rows = []
        if s is not None:
            rows.append(done(s))
        if rows:
            yield pack(rows)

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, out)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = c.unionByName(spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"))
    path = new_path(spark, "chat")
    format_windows(c, tokenizer_file("byte_bpe_50k.json")).write.option("compression", "zstd").parquet(path)
    return read_back(spark.read.schema(WINDOWS).parquet(path)).drop("n_windows")
