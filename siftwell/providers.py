"""Pluggable models: what a provider is, how it runs on executors, and deterministic mocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.vectors import rolling_hash


class EmbeddingProvider(Protocol):
    dims: int

    def embed(self, texts: list[str], query: bool) -> list[list[float]]: ...


class TextProvider(Protocol):
    """Summaries, judgements and extractions: a prompt in, a text out."""

    def complete(self, prompts: list[str]) -> list[str]: ...


class MockEmbedding:
    """Sines of multiples of a rolling hash; a query and a document of one text have the same vector."""

    def __init__(self, dims: int = 128) -> None:
        self.dims = dims

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.sin(float(rolling_hash(t)) * np.arange(1, self.dims + 1) * 0.0001)
            out.append((v / max(np.linalg.norm(v), 1e-300)).tolist())
        return out


class MockText:
    """Answers with the first words of the prompt's last line."""

    def __init__(self, words: int = 12) -> None:
        self.words = words

    def complete(self, prompts: list[str]) -> list[str]:
        return [" ".join(p.strip().split("\n")[-1].split()[: self.words]) for p in prompts]


def embed(df: DataFrame, text: str, make: Callable[[], EmbeddingProvider], batch: int = 50, query: bool = False) -> DataFrame:
    """Adds embedding and error. A provider is made once per task and asked in batches; a batch that fails gives nulls and
    its error instead of stopping the job. Null texts give null."""
    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], "embedding array<double>, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for b in batches:
            vectors: list = [None] * len(b)
            errors: list = [None] * len(b)
            at = [i for i, t in enumerate(b[text]) if t is not None]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                try:
                    for i, v in zip(part, provider.embed([b[text].iloc[i] for i in part], query)):
                        vectors[i] = v
                except Exception as e:  # noqa: BLE001 - whatever a provider raises becomes the row's error
                    for i in part:
                        errors[i] = str(e)
            yield b.assign(embedding=vectors, error=errors)

    return df.mapInPandas(run, schema)


def complete(df: DataFrame, prompt: str, make: Callable[[], TextProvider], batch: int = 20, tries: int = 3) -> DataFrame:
    """Adds response and error; a batch is tried again before it is given up."""
    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], "response string, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for b in batches:
            out: list = [None] * len(b)
            errors: list = [None] * len(b)
            at = [i for i, t in enumerate(b[prompt]) if t is not None]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for _ in range(tries):
                    try:
                        for i, r in zip(part, provider.complete([b[prompt].iloc[i] for i in part])):
                            out[i], errors[i] = r, None
                        break
                    except Exception as e:  # noqa: BLE001
                        for i in part:
                            errors[i] = str(e)
            yield b.assign(response=out, error=errors)

    return df.mapInPandas(run, schema)


# --- What models answer -------------------------------------------------------------------------


def score(response: Column) -> Column:
    """A score of 0 to 10 in an answer; 5 if there is none."""
    n = F.regexp_extract(response, r"(\d+(?:\.\d+)?)", 1)
    return F.when(n == "", 5.0).otherwise(F.least(F.lit(10.0), n.cast("double")))


def labelled(response: Column, label: str) -> Column:
    """Text after ``LABEL:`` up to the next label in capitals."""
    return F.trim(F.regexp_extract(response, rf"(?s){re.escape(label)}:\s*(.*?)(?=\n[A-Z][A-Z _]+:|$)", 1))


def items(response: Column, label: str) -> Column:
    """Lines of a labelled list without their bullets."""
    lines = F.transform(F.split(labelled(response, label), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*]|\d+\.)\s*", "")))
    return F.filter(lines, lambda x: x != "")


def summary(response: Column) -> Column:
    """struct<overview, topics, decisions, code_references, key_points> of an answer."""
    return F.struct(
        labelled(response, "OVERVIEW").alias("overview"), items(response, "TOPICS").alias("topics"), items(response, "DECISIONS").alias("decisions"),
        items(response, "CODE_REFERENCES").alias("code_references"), items(response, "KEY_POINTS").alias("key_points"),
    )


def decisions(response: Column) -> Column:
    """array<struct<description, context, alternatives>> of an answer's DECISION blocks."""
    blocks = F.regexp_extract_all(response, F.lit(r"(?s)(DECISION:.*?)(?=DECISION:|$)"), F.lit(1))
    return F.transform(blocks, lambda b: F.struct(labelled(b, "DECISION").alias("description"), labelled(b, "CONTEXT").alias("context"), items(b, "ALTERNATIVES").alias("alternatives")))


def entities(response: Column) -> Column:
    """array<struct<name, type, confidence>> of a JSON array in an answer; confidences are kept within 0 and 1; null if there is none."""
    body = F.regexp_extract(response, r"(?s)(\[.*\])", 1)
    x = F.from_json(body, "array<struct<name:string,type:string,confidence:double>>")
    return F.transform(F.filter(x, lambda e: e["name"].isNotNull()), lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(e["confidence"], F.lit(0.5)))).alias("confidence")))


def gate(response: Column) -> Column:
    """struct<retrieve, confidence> of a gate's JSON answer; retrieves with 0.5 if it can't be read."""
    x = F.from_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1), "retrieve boolean, confidence double")
    return F.struct(F.coalesce(x["retrieve"], F.lit(True)).alias("retrieve"), F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence"))


def wants_hypothesis(text: Column, n_mentions: Column, intent: Column) -> Column:
    """Whether a query is worth a hypothetical answer to search by."""
    return (F.length(text) >= 10) & (n_mentions == 0) & intent.isin("explain", "how", "why", "general")
