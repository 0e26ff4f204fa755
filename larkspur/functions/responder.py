"""Stand-in for a model: answers come from a function of the prompt, run over Arrow batches. Plug in a client to ask a real one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def dummy(prompt: str) -> str:
    """One of four letters, by the md5 of the prompt."""
    return "ABCD"[hashlib.md5(prompt.encode()).digest()[0] % 4]


def answered(prompts: DataFrame, prompt_col: str = "prompt", respond: Callable[[str], str] = dummy) -> DataFrame:
    """Adds ``response`` and ``error``; a prompt whose call fails keeps its row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said, errors = [], []
            for p in frame[prompt_col]:
                try:
                    said.append(respond(p or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a client belongs to its row
                    said.append(None)
                    errors.append(str(e))
            yield frame.assign(response=said, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, fields + ", response string, error string")
