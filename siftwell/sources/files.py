"""Reading file trees: ignore rules as one path predicate, whole files as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is never read.
EXCLUDED = (
    "node_modules/**", ".git/**", "dist/**", "build/**", "coverage/**", "__pycache__/**", ".next/**", ".cache/**", "*.min.js",
    "*.bundle.js", ".env*", "*.lock", "package-lock.json",
)
#: Extensions of source files and their languages.
SOURCE_LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp",
}


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for a whole path: ``**`` is anything, ``*`` anything but ``/``, ``?`` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "."}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def ignore_globs(text: str) -> list[str]:
    """Globs of the lines of an ignore file. Comments and negations are left out; a name without a slash matches at any
    depth, a trailing slash stands for a folder and all in it."""
    globs = []
    for line in filter(None, map(str.strip, text.splitlines())):
        if line[0] in "#!":
            continue
        bare = line.removesuffix("/").removeprefix("/")
        tops = [bare] if "/" in bare or line.startswith("/") else [bare, f"**/{bare}"]
        globs += [g + end for g in tops for end in (("", "/**") if line.endswith("/") else ("",))]
    return globs


def default_globs() -> list[str]:
    """Globs of EXCLUDED, at any depth."""
    return [g for x in EXCLUDED for g in (x, f"**/{x}")]


def ignored(path: Column, globs: list[str]) -> Column:
    """True where a relative path fits one of the globs: one alternation, no join."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def read_tree(spark: SparkSession, root: str, ignore_files: tuple[str, ...] = (".gitignore",), extra: tuple[str, ...] = (), most_bytes: int = 500_000) -> DataFrame:
    """path (relative), content, language, size, md5 of the text files under a folder that no rule excludes.

    Rules are EXCLUDED, the ignore files at the root and ``extra`` globs. Hidden files are not listed.
    Larger files than ``most_bytes`` come with null content.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
    globs = [*default_globs(), *extra]
    for name in ignore_files:
        rules = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        fs = rules.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(rules):  # read by the file system, as Spark's readers pass over hidden files
            stream = fs.open(rules)
            globs += ignore_globs(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
    kept = files.where(~ignored(path, globs))
    lang = F.create_map(*[F.lit(x) for p in SOURCE_LANGUAGES.items() for x in p])[F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))]
    small = F.col("length") <= most_bytes
    return kept.select(
        path.alias("path"), F.when(small, F.decode("content", "utf-8")).alias("content"), lang.alias("language"), F.col("length").alias("size"), F.md5("content").alias("md5")
    )
