"""An expensive predicate behind a memo: what is known is looked up, a bounded number of the rest is asked, the others wait."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[str, list[str]], list[bool | None]]


def filter_key(instruction: str, mode: str = "strict") -> str:
    """The memo's key of an instruction, the same for any case and spacing."""
    return hashlib.sha1(f"{mode}::{' '.join(instruction.lower().split())}".encode()).hexdigest()[:16]


def words_provider(instruction: str, texts: list[str]) -> list[bool | None]:
    """A stand-in without a model, for tests and offline use: a text passes if it holds every word of the instruction. An empty text gets no verdict."""
    wanted = instruction.lower().split()
    return [all(w in t.lower() for w in wanted) if t else None for t in texts]


def ask(candidates: DataFrame, instruction: str, provider: Provider, batch: int = 8) -> DataFrame:
    """``id, passes`` for ``candidates`` (``id, text``), asked in batches; a batch whose call fails stays without verdict."""
    kind = candidates.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    verdicts = provider(instruction, part["text"].fillna("").tolist())
                except Exception:  # noqa: BLE001 - whatever a provider raises: fail closed, and ask again next time
                    verdicts = [None] * len(part)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "passes": pd.array(verdicts, dtype="boolean")})

    return candidates.select("id", "text").mapInPandas(run, f"id {kind}, passes boolean").where("passes is not null")


def apply_judged(candidates: DataFrame, memo: DataFrame, instruction: str, provider: Provider, order: list[Column], most: int = 24) -> tuple[DataFrame, DataFrame]:
    """(verdict of each candidate, new memo rows).

    candidates: ``id, text``. memo: ``id, passes`` of the same instruction. At most ``most`` unknown candidates, the first by
    ``order``, are asked; the rest, and those without verdict, are ``deferred`` and thereby withheld.
    Verdicts: ``id, state`` with passing, rejected or deferred. The new rows must be written before the verdicts are read twice.
    """
    fresh = ask(candidates.join(memo.select("id"), "id", "left_anti").orderBy(*order).limit(most), instruction, provider)
    known = memo.select("id", "passes").unionByName(fresh)
    state = F.when(F.col("passes"), "passing").when(~F.col("passes"), "rejected").otherwise("deferred")
    return candidates.join(known, "id", "left").select("id", state.alias("state")), fresh
