"""Model calls as injected functions: scorer, embedder, entity finder, translator.

Each wraps a plain function of one text in a pandas UDF. The results are marked as not
deterministic, so that the optimizer neither repeats a call nor moves it before a cheaper filter.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY_TEXT = 6000  # characters that an entity finder is given; fixed value


def scorer(answer: Callable[[str], str]) -> Callable[[Column], Column]:
    """A model's raw answer for a prompt; an error gives an empty answer, which is then unreadable."""

    @F.pandas_udf("string")
    def call(prompts: pd.Series) -> pd.Series:
        def one(prompt: str | None) -> str:
            try:
                return answer(prompt or "")
            except Exception:
                return ""

        return prompts.map(one)

    return call.asNondeterministic()


def embedder(embed: Callable[[str], list[float]], prefix: str = "") -> Callable[[Column], Column]:
    """A vector for a text, null for a failure; `prefix` is what the model wants before queries."""

    @F.pandas_udf("array<float>")
    def call(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float] | None:
            try:
                return [float(x) for x in embed(prefix + (text or ""))]
            except Exception:
                return None

        return texts.map(one)

    return call.asNondeterministic()


def entity_finder(find: Callable[[str], str]) -> Callable[[Column], Column]:
    """A model's raw list of entities for a text; '' for a failure."""

    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str:
            try:
                return find((text or "")[:ENTITY_TEXT])
            except Exception:
                return ""

        return texts.map(one)

    return call.asNondeterministic()


def mean_pooled(vectors: list[list[float]], mask: list[int]) -> list[float]:
    """The mean of the token vectors that count, at unit length."""
    import numpy as np

    weights = np.asarray(mask, np.float64)[:, None]
    mean = (np.asarray(vectors, np.float64) * weights).sum(0) / max(weights.sum(), 1e-9)
    length = np.linalg.norm(mean)
    return (mean / length if length else mean).tolist()


#: Tokens that a heavy backend is given at least, since it thinks before it answers; fixed value.
HEAVY_TOKENS = 4096


def synthesizer(backends: dict[str, Callable[[str, int], str]], name: str, tokens: int = 800) -> Callable[[Column], Column]:
    """An article for a prompt, by the backend of that name; a `heavy` one gets HEAVY_TOKENS at least. An error gives null."""
    if name not in backends:
        raise ValueError(f"no backend {name!r}: {', '.join(sorted(backends))}")
    answer, most = backends[name], max(tokens, HEAVY_TOKENS) if name == "heavy" else tokens

    @F.pandas_udf("string")
    def call(prompts: pd.Series) -> pd.Series:
        def one(prompt: str | None) -> str | None:
            try:
                return answer(prompt or "", most)
            except Exception:
                return None

        return prompts.map(one)

    return call.asNondeterministic()


def translator(translate: Callable[[str], str]) -> Callable[[Column], Column]:
    """A translation of a text; a text without anything to translate stays as it is, and an error fails the job."""

    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: translate(text).strip() if text and text.strip() else text)

    return call.asNondeterministic()
