"""Streaming form of the conversation buffer: state per conversation, bounded by its size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern import fixed_values as V
from lectern.config import DEFAULT

OUTPUT = "conv_id long, n_messages int, history string"
STATE = "turns array<long>, lines array<string>"


def history_stream(messages: DataFrame, max_turns: int = DEFAULT.memory_turns, max_chars: int = DEFAULT.memory_chars) -> DataFrame:
    """Current history text of each conversation that got messages (conv_id, turn, role, text)."""
    size = 2 * max_turns

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            for turn, role, text in zip(batch["turn"], batch["role"], batch["text"]):
                who = V.USER_LABEL if role == "user" else V.ASSISTANT_LABEL
                kept.append((int(turn), f"{who}: {text[:max_chars]}..." if len(text) > max_chars else f"{who}: {text}"))
            # cut after each batch: the state and this list stay small however long the talk is
            kept = sorted(kept)[-size:] if size else []
        state.update(([t for t, _ in kept], [line for _, line in kept]))
        text = "\n".join([V.HISTORY_TITLE, *(line for _, line in kept)]) if kept else ""
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [len(kept)], "history": [text]})

    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandasWithState(
        update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout
    )
