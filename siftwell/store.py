"""Projects and their tables: Parquet partitioned by project, with versions of the schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schemas

TABLES = {
    "entities": schemas.ENTITIES, "relationships": schemas.RELATIONSHIPS, "vectors": schemas.VECTORS, "sessions": schemas.SESSIONS, "messages": schemas.MESSAGES,
    "summaries": schemas.SUMMARIES, "decisions": schemas.DECISIONS, "feedback": schemas.FEEDBACK, "memory": schemas.MEMORY, "reflections": schemas.REFLECTIONS,
    "subscriptions": schemas.SUBSCRIPTIONS, "suggestions": schemas.SUGGESTIONS, "checkpoints": schemas.CHECKPOINTS,
}
#: A project's name: up to 64 lower-case letters, digits and hyphens.
NAME = re.compile(r"[a-z0-9][a-z0-9-]{0,63}")


class Store:
    """Tables under one folder, partitioned by project_id: a project is added or dropped as partitions, and every read prunes to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str, project: str | None = None) -> str:
        if table not in TABLES:
            raise KeyError(table)
        return f"{self.root}/{table}" + (f"/project_id={project}" if project else "")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, table: str, project: str) -> bool:
        fs, p = self._fs(self._path(table, project))
        return fs.exists(p)

    def read(self, table: str, project: str) -> DataFrame:
        """The project's rows; empty if it has none."""
        self._recover(table, project)
        if not self.exists(table, project):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(self._path(table, project))

    def _write(self, table: str, project: str, rows: DataFrame, path: str) -> None:
        if not NAME.fullmatch(project):
            raise ValueError(f"not a project name: {project!r}")
        missing = schemas.invalid(rows, TABLES[table])
        if missing:
            raise ValueError(f"{table}: wrong or missing columns {missing}")
        columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", TABLES[table])]
        rows.select(columns).write.mode("append").parquet(path)

    def append(self, table: str, project: str, rows: DataFrame) -> None:
        self._recover(table, project)
        self._write(table, project, rows, self._path(table, project))

    def replace(self, table: str, project: str, rows: DataFrame) -> None:
        """Write the whole state anew; ``rows`` may be a plan on the present state.

        The new state is written beside the old one, which then makes way for it by two renames; a failure between
        them is mended at the next access (``_recover``), so that either state is there, whole.
        """
        self._recover(table, project)
        fs, p = self._fs(self._path(table, project))
        new, old = (self._fs(f"{self.root}/{table}/_{x}-{project}")[1] for x in ("new", "old"))
        fs.delete(new, True)
        self._write(table, project, rows, new.toString())
        if fs.exists(p):
            fs.rename(p, old)
        fs.rename(new, p)
        fs.delete(old, True)

    def _recover(self, table: str, project: str) -> None:
        fs, p = self._fs(self._path(table, project))
        old = self._fs(f"{self.root}/{table}/_old-{project}")[1]
        if fs.exists(old):
            if fs.exists(p):
                fs.delete(old, True)
            else:
                fs.rename(old, p)

    def projects(self) -> list[str]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        found = set()
        for t in fs.listStatus(p):
            if t.isDirectory():
                found |= {c.getPath().getName().removeprefix("project_id=") for c in fs.listStatus(t.getPath()) if c.getPath().getName().startswith("project_id=")}
        return sorted(found)

    def drop(self, project: str) -> None:
        for table in TABLES:
            fs, p = self._fs(self._path(table, project))
            fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        if not NAME.fullmatch(new):
            raise ValueError(f"not a project name: {new!r}")
        for table in TABLES:
            if self.exists(table, old):
                fs, p = self._fs(self._path(table, old))
                fs.rename(p, self._fs(self._path(table, new))[1])

    def status(self, project: str) -> DataFrame:
        """table_name, n_rows of a project."""
        from functools import reduce

        return reduce(DataFrame.unionByName, [self.read(t, project).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in TABLES])


def as_inserts(df: DataFrame, table: str) -> DataFrame:
    """line: an SQL INSERT for every row; nested values as JSON text."""

    def literal(c: str, t: str):
        simple = F.col(c).cast("string")
        text = simple if t == "string" or "<" not in t else F.to_json(c)
        quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        plain = simple if t in ("int", "bigint", "double", "float", "boolean", "smallint") else quoted
        return F.coalesce(plain, F.lit("NULL"))

    values = [literal(c, t) for c, t in df.dtypes]
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *values), F.lit(");")).alias("line"))
