"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted
spans of its assistant turns are intersected with the token spans by binary
search.  The markers of the template are tokens of their own, so no token
reaches across the border of a turn.

Inside texts and roles every control string is broken by a backslash after its
first character and every backslash is doubled, so rendering can be undone.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file of the tokenizer: a byte-level BPE in the format of the tokenizers library.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# The template's own markers and the control strings of common templates.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])")
_BROKEN = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation and the sorted ``(start, end)`` spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@lru_cache(maxsize=2)
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
    return t


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for the tokens that overlap one of the sorted spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    at = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    inside = at < len(spans)
    at = np.minimum(at, len(spans) - 1)
    return inside & (offsets[:, 1] > spans[at, 0])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """What the loss sees: the union of the masked tokens' spans, unescaped turn by turn."""
    out, run = [], None
    for s, e in offsets[mask].tolist():
        if run is not None and s <= run[1]:
            run[1] = max(run[1], e)
        else:
            if run is not None:
                out.append(unescape(formatted[run[0] : run[1]]))
            run = [s, e]
    if run is not None:
        out.append(unescape(formatted[run[0] : run[1]]))
    return "".join(out)


FORMATTED = "conv_id long, formatted string, token_ids array<int>, loss array<boolean>, starts array<int>, ends array<int>"


def _conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order; ties of ``turn`` go by role, then text."""
    turn = F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def chat_format(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per ``conv_id`` of ``conversations(conv_id, turn, role, text, ...)``: formatted text, tokens, mask, offsets.

    Null roles and texts are empty; rows with a null turn come last; repeated
    rows are turns of their own; rows with a null ``conv_id`` form one
    conversation; other columns are not read.  A conversation is one row and one
    encoding, so it has to fit in a task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                rendered = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
                cols: list[list] = [[], [], [], []]
                for (text, spans), e in zip(rendered, enc.encode_batch([r[0] for r in rendered], add_special_tokens=False), strict=True):
                    off = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
                    for c, v in zip(cols, (np.array(e.ids, dtype=np.int32), loss_mask(off, spans), off[:, 0], off[:, 1]), strict=True):
                        c.append(v)
                types = [pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r[0] for r in rendered], pa.string()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                    names=["conv_id", "formatted", "token_ids", "loss", "starts", "ends"],
                )

    return _conversations(conversations).mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of ``chat_format``, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, loss, s, e in zip(*(b.column(k).to_pylist() for k in (1, 3, 4, 5)), strict=True):
                turns = parse(text)
                seen = masked_text(text, np.stack([np.array(s, dtype=np.int64), np.array(e, dtype=np.int64)], axis=1), np.array(loss, dtype=bool))
                joined = "".join(f"{r}\n{t}\n" for r, t in turns)
                for c, v in zip(out, (len(turns), _sha(joined), len(seen), _sha(seen), len(text)), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose turns consist of control strings."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(*(F.col(c).cast(t).alias(c) for c, t in probe.dtypes)).unionByName(probe)
