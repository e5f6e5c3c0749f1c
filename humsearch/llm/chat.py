"""Chat formatting: spans of turns found by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Nothing
about its marks is assumed: the operator renders successive prefixes of a
conversation and compares consecutive outputs. What the longer output adds is
the new turn's span; if it doesn't begin with the shorter one, the template has
rewritten history, which is reported with the turn. Where an assistant's text
lies within its span is found by rendering the same prefix with a probe text.

Conversations are laid out by range, in turn order, so a long one is spread
over several tasks. For that a template says how many turns back it looks
(``context_turns``); with None every conversation stays in one task and is
rendered from its first turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Turn = tuple[str, str]
_CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>")
_ESCAPED = re.compile("|".join(map(re.escape, _CONTROLS)) + r"|\\")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
#: Texts to find where a template puts a text; the second serves if the first stands in the frame.
_PROBES = ("\ue000\ue001", "\uf8f0\uf8f1\uf8f2")


def escape(text: str) -> str:
    """Text without any control string: a backslash breaks each of them, and is doubled itself."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _UNESCAPE.sub(r"\1", text)


def instruct_template(turns: list[Turn]) -> str:
    """``[INST]role[/INST]text</s>`` for each turn, with control strings inside escaped."""
    return "".join(f"[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


def parse_turns(formatted: str) -> list[Turn]:
    """The (role, text) of each turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


@dataclass(frozen=True)
class Template:
    render: Callable[[list[Turn]], str]
    #: Turns before a turn that its rendering depends on; None: all of them.
    context_turns: int | None = None
    #: Turns from one fresh start of prefixes to the next, where the context allows.
    prefix_turns: int = 16


INSTRUCT = Template(instruct_template, 0)


def locate(render: Callable[[list[Turn]], str], before: list[Turn], turn: Turn, shorter: str) -> tuple[str, str, int, int, bool]:
    """(whole output, span, mask start, mask end, rewritten) of one more turn.

    The mask marks the turn's text within the span. After a rewrite the span is
    what follows the longest common beginning.
    """
    whole = render([*before, turn])
    rewritten = not whole.startswith(shorter)
    common = len(shorter)
    if rewritten:
        low, high = 0, min(len(whole), len(shorter))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if whole[:mid] == shorter[:mid] else (low, mid - 1)
        common = low
    span = whole[common:]
    start, end = 0, 0
    for probe in _PROBES:
        probed = render([*before, (turn[0], probe)])
        at = probed.find(probe)
        if at >= common and probed.find(probe, at + 1) < 0:
            tail = len(probed) - at - len(probe)
            if whole[:at] == probed[:at] and whole[len(whole) - tail :] == probed[len(probed) - tail :]:
                start, end = at - common, len(whole) - tail - common
                break
    return whole, span, start, end, rewritten


FORMATTED = "conv_id long, turn long, role string, text string, span string, mask_start int, mask_end int, rewritten boolean"


def format_turns(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row for each turn with its formatted span, the place of its text in it
    (mask_start, mask_end) and whether the template rewrote earlier output.

    Turns are in order of (turn, role, text), nulls first. Null roles and texts
    are empty; a null conv_id is one conversation. Repeated rows are turns of
    their own. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, context = template.render, template.context_turns
        now: object = run  # no conversation
        before: list[Turn] = []
        shorter = ""
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            spans, starts, ends, rewrites = [], [], [], []
            for conv, role, text in zip(cols[0], cols[2], cols[3], strict=True):
                turn, fresh = (role or "", text or ""), False
                if conv != now:
                    now, before, shorter = conv, [], render([])
                elif context is not None and len(before) >= template.prefix_turns + context:
                    long_span = locate(render, before, turn, shorter)[1]
                    before = before[len(before) - context :]
                    shorter = render(before)
                    fresh = True
                shorter, span, a, b, rewritten = locate(render, before, turn, shorter)
                if fresh:
                    # a template that looks further back than it says is found out here
                    rewritten = rewritten or span != long_span
                before.append(turn)
                for out, value in ((spans, span), (starts, a), (ends, b), (rewrites, rewritten)):
                    out.append(value)
            made = [pa.array(spans, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(rewrites, pa.bool_())]
            yield pa.record_batch([*batch.columns, *made], [x.split()[0] for x in FORMATTED.split(", ")])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    # sampled range bounds go to the driver: a hash stands for the text
    dealt = rows.repartitionByRange(*keys[:3], F.xxhash64("text")) if template.context_turns == 0 else rows.repartition("conv_id")
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, FORMATTED)


def formatted_conversations(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, formatted): whole conversations as one string. One conversation must fit into a row."""
    key = F.struct("turn", "role", "text", "span")
    return format_turns(conversations, template).groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(key)), lambda x: x["span"])).alias("formatted"))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    rewritten_turns, read back from formatted turns.

    A hash over a whole conversation is sequential, so its turns stream through
    one task; memory holds one batch of them, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                conv, n, turns, chars, loss, formatted_chars, rewritten = state
                rows.append([conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars, rewritten])

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_turns"])

        for batch in batches:
            for conv, span, a, b, rewritten in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "span", "mask_start", "mask_end", "rewritten")), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse_turns(span):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        masked = unescape(span[a:b])
                        state[3] += len(masked)
                        state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(span)
                state[6] += rewritten
            if rows:
                yield out()
                rows.clear()
        close()
        yield out()

    keys = ["conv_id", "turn", "role", "text"]
    rows = formatted.repartition("conv_id").sortWithinPartitions(*keys).drop("turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_turns long")
