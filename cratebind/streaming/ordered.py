"""A run's log in order: messages that arrive in any order go out by their sequence numbers, each once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "run string, seq long, text string, processed long, percent int"


def in_sequence(messages: DataFrame, total: int) -> DataFrame:
    """messages(run, seq, text), a stream, as run, seq, text, processed, percent in the order of seq, which begins at 1.

    Messages wait in the run's state until all before them have come; one that came before is left out. The state holds what waits and
    the next number, so a restart goes on where the stream ended. total: how many messages a run has, for the percentage done.
    """

    def release(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nth, waiting = (state.get[0], {int(k): v for k, v in json.loads(state.get[1]).items()}) if state.exists else (1, {})
        for batch in batches:
            for seq, text in zip(batch["seq"].tolist(), batch["text"].tolist(), strict=True):
                if seq >= nth:
                    waiting.setdefault(seq, text)
        rows = []
        while nth in waiting:
            rows.append((key[0], nth, waiting.pop(nth), nth, max(0, min(100, round(nth / total * 100))) if total > 0 else 0))
            nth += 1
        state.update((nth, json.dumps(waiting)))
        yield pd.DataFrame(rows, columns=["run", "seq", "text", "processed", "percent"]).astype({"run": "object", "seq": "int64", "text": "object", "processed": "int64", "percent": "int32"})

    return messages.groupBy("run").applyInPandasWithState(release, RESULT, "nth long, waiting string", "append", GroupStateTimeout.NoTimeout)
