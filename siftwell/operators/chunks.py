"""Cutting texts into overlapping chunks in the ways that entities, code and sections are embedded.

A cut depends on the one before, so that a text is cut in one go, in Arrow batches; texts of one chunk never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import split_identifier

#: Characters of a chunk, of its overlap, and the least that a last chunk has.
ENTITY, OVERLAP, LEAST = 4000, 200, 100
CODE, CODE_OVERLAP = 1024, 150
#: Characters from which a section is cut, aimed at, shared, and below which a piece is merged.
SECTION_MAX, SECTION_TARGET, SECTION_OVERLAP, SECTION_MIN = 3000, 1500, 200, 200

_SENTENCE = re.compile(r"[.!?]\s")


def boundary(text: str, a: int, e: int) -> int:
    """Where to cut between ``a`` and ``e``: after the last blank line, line, sentence or space, or else at ``e``."""
    i = text.rfind("\n\n", a, e)
    if i >= 0:
        return i + 2
    i = text.rfind("\n", a, e)
    if i >= 0:
        return i + 1
    last = None
    for last in _SENTENCE.finditer(text, a, e):  # noqa: B007
        pass
    if last:
        return last.end()
    i = text.rfind(" ", a, e)
    return i + 1 if i >= 0 else e


def spans(text: str, most: int = ENTITY, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """Start and end of the chunks of a text."""
    n = len(text)
    if n <= most:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    a = 0
    while a < n:
        e = min(a + most, n)
        if e < n:
            e = boundary(text, max(a, e - overlap), e)
        if out and e - a < least:
            out[-1] = (out[-1][0], e)
            break
        out.append((a, e))
        if e >= n:
            break
        a = e - overlap if e - overlap > a else e
    return out


def estimate_count(length: Column, most: int = ENTITY, overlap: int = OVERLAP) -> Column:
    """About how many chunks a text of that length makes."""
    return F.when(length <= most, 1).otherwise(F.ceil((length - overlap) / (most - overlap))).cast("int")


def chunk(df: DataFrame, key: str, text: str, most: int | str = ENTITY, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """key, chunk_index, start, end, piece of every text; ``most`` may be a column. A null text counts as empty: one empty chunk."""
    kind = df.schema[key].dataType.simpleString()
    size = F.col(most) if isinstance(most, str) else F.lit(most)
    rows = df.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t"), size.cast("int").alias("_m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, a, e, t[a:e]) for k, t, m in zip(b["_k"], b["_t"], b["_m"]) for i, (a, e) in enumerate(spans(t, int(m), overlap, least))]
            yield pd.DataFrame(out, columns=[key, "chunk_index", "start", "end", "piece"])

    schema = f"`{key}` {kind}, chunk_index int, start int, end int, piece string"
    long = rows.where(F.length("_t") > F.col("_m")).mapInPandas(run, schema)
    zero = F.lit(0)
    short = rows.where(F.length("_t") <= F.col("_m")).select(F.col("_k").alias(key), zero.alias("chunk_index"), zero.alias("start"), F.length("_t").alias("end"), F.col("_t").alias("piece"))
    return long.unionByName(short)


def header(path_parts: int = 2) -> Column:
    """What stands before every chunk of an entity: type and name parts, the end of its path, its summary."""
    path = F.split("file_path", "/")
    tail = F.array_join(F.slice(path, F.greatest(F.lit(1), F.size(path) - path_parts + 1), F.lit(path_parts)), "/")
    return F.concat_ws(
        "\n",
        F.concat(F.col("type"), F.lit(": "), F.array_join(split_identifier(F.col("name")), " ")),
        F.when(F.length("file_path") > 0, F.concat(F.lit("in "), tail)),
        F.when(F.length("summary") > 0, F.col("summary")),
    )


def code_chunks(entities: DataFrame, most: int = CODE, overlap: int = CODE_OVERLAP) -> DataFrame:
    """id, chunk_index, total, text: chunks of entities, each beginning with the entity's header."""
    from pyspark.sql import Window

    x = entities.withColumn("_h", header()).withColumn("_room", F.greatest(F.lit(overlap + 1), most - F.length("_h") - 2))
    c = chunk(x, "id", "content", "_room", overlap).join(x.select("id", "_h"), "id")
    text = F.when(F.length("piece") > 0, F.concat("_h", F.lit("\n\n"), "piece")).otherwise(F.col("_h"))
    return c.select("id", "chunk_index", F.count("*").over(Window.partitionBy("id")).alias("total"), text.alias("text"))


def section_pieces(text: str) -> list[str]:
    """A long section cut between paragraphs, small later pieces merged with the one before."""
    pieces: list[str] = []
    held = ""
    for p in re.split(r"\n\n+", text):
        if held and len(held) + len(p) > SECTION_TARGET:
            pieces.append(held.strip())
            held = held[-SECTION_OVERLAP:] + "\n\n" + p
        else:
            held = f"{held}\n\n{p}" if held else p
    if held.strip():
        pieces.append(held.strip())
    merged: list[str] = []
    for i, p in enumerate(pieces):
        if i and len(merged[-1]) < SECTION_MIN:
            merged[-1] += "\n\n" + p
        else:
            merged.append(p)
    return merged


def section_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_index, piece of sections; those of at most SECTION_MAX characters stay whole."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, p) for k, t in zip(b["_k"], b["_t"]) for i, p in enumerate(section_pieces(t))], columns=[key, "chunk_index", "piece"])

    long = rows.where(F.length("_t") > SECTION_MAX).mapInPandas(run, f"`{key}` {kind}, chunk_index int, piece string")
    return long.unionByName(rows.where(F.length("_t") <= SECTION_MAX).select(F.col("_k").alias(key), F.lit(0).alias("chunk_index"), F.col("_t").alias("piece")))
