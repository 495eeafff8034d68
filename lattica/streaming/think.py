"""A stream of answer fragments, told apart into thinking and saying.

State for each response is whether it is thinking, and the end of the last fragment that could be part of a tag, so tags
that are split over fragments or micro-batches are found. A null fragment ends a response: what is held back comes out then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TAGS = ("<think>", "</think>")


def split(fragment: str, thinking: bool, held: str) -> tuple[list[tuple[str, bool]], bool, str]:
    """Pieces (text, thinking), the new state, and what may be the beginning of a tag."""
    text, out = held + fragment, []
    while True:
        at, tag = min(((text.find(t), t) for t in TAGS if t in text), default=(-1, ""))
        if at < 0:
            break
        if at:
            out.append((text[:at], thinking))
        thinking, text = tag == TAGS[0], text[at + len(tag):]
    keep = next((n for n in range(min(7, len(text)), 0, -1) if any(t.startswith(text[-n:]) for t in TAGS)), 0)
    said, held = text[:len(text) - keep], text[len(text) - keep:]
    if said:
        out.append((said, thinking))
    return out, thinking, held


def pieces(tokens: DataFrame) -> DataFrame:
    """tokens (response_id, seq, fragment; each response in order within a micro-batch) → response_id, piece_no, piece, is_thinking."""

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        thinking, held, n = state.get if state.exists else (False, "", 0)
        rows = []
        for fragment in pd.concat(list(frames)).sort_values("seq")["fragment"]:
            if pd.isna(fragment):
                got, held = [(held, thinking)] if held else [], ""
            else:
                got, thinking, held = split(fragment, thinking, held)
            for text, is_thinking in got:
                rows.append((key[0], n, text, is_thinking))
                n += 1
        state.update((thinking, held, n))
        yield pd.DataFrame(rows, columns=["response_id", "piece_no", "piece", "is_thinking"])

    return tokens.groupBy("response_id").applyInPandasWithState(
        fn, "response_id long, piece_no long, piece string, is_thinking boolean", "thinking boolean, held string, n long", "append", GroupStateTimeout.NoTimeout)
