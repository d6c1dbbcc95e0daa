"""Descriptions of code: summaries by type, names of types, what is private or external."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import split_identifier, truncate


def is_private(name: Column, visibility: Column | None = None) -> Column:
    """Marked private or protected, or named with a leading underscore; names between double underscores are public."""
    marked = F.lit(False) if visibility is None else F.coalesce(visibility.isin("private", "protected"), F.lit(False))
    return marked | (name.startswith("_") & ~name.rlike("^__.*__$"))


def is_external(module: Column) -> Column:
    """A module that is not given by a path."""
    return ~module.startswith(".") & ~module.startswith("/")


def node_type(id_: Column) -> Column:
    """What an id of a code graph stands for: a symbol (``file::name``), a file, or a module."""
    return F.when(F.instr(id_, "::") > 0, "symbol").when(id_.rlike(r"\.[A-Za-z0-9]+$"), "file").otherwise("module")


def type_names(c: Column) -> Column:
    """Names of the types in an annotation, without generics' brackets, arrays, unions and built-in types."""
    built_in = (
        "string", "number", "boolean", "void", "any", "unknown", "never", "null", "undefined", "object", "int", "str", "float", "bool", "bytes", "None",
        "list", "dict", "set", "tuple", "List", "Dict", "Set", "Tuple", "Optional", "Union", "Promise", "Array", "Record", "Map", "Partial", "Readonly",
    )
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1)), lambda n: ~n.isin(*built_in)))


def meaningful_lines(content: Column, most: int = 60) -> Column:
    """The first lines that are neither blank nor comments nor brackets alone."""
    keep = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*(//|#|/\*|\*|\*/)") & ~x.rlike(r"^\s*[{}()\[\];,]+\s*$"))
    return F.array_join(F.slice(keep, 1, most), "\n")


def embedding_text(type_: Column, name: Column, summary: Column, content: Column) -> Column:
    """What an entity is embedded by: its type and the parts of its name, its summary, and the lines that matter."""
    head = F.concat(type_, F.lit(": "), F.array_join(split_identifier(name), " "))
    return F.concat_ws("\n", head, F.when(F.length(summary) > 0, summary), F.when(F.length(content) > 0, meaningful_lines(content)))


def summarize(type_: Column, content: Column) -> Column:
    """Short form of a declaration: of a class its comment, head, fields and signatures of members; of a function
    what comes before its body; of an interface, type or enum its first 30 lines; of others the first 10."""
    lines = F.split(content, "\n")
    doc = F.filter(lines, lambda x: x.rlike(r"^\s*(/\*\*|\*|\*/)"))
    head = F.slice(F.filter(lines, lambda x: x.rlike(r"(^|\s)(class|struct|record)\s")), 1, 1)
    member = F.filter(lines, lambda x: x.rlike(r"^(\t|  {0,2}|    )[A-Za-z_@#]") & ~x.rlike(r"^\s*(return|if|for|while|switch|throw|else|try|catch)\b"))
    signature = F.transform(member, lambda x: F.regexp_replace(x, r"\s*\{.*$", ""))
    of_class = F.array_join(F.concat(doc, head, F.filter(F.array_except(signature, F.transform(head, lambda x: F.regexp_replace(x, r"\s*\{.*$", ""))), lambda x: x != "")), "\n")
    of_function = F.trim(F.regexp_extract(content, r"(?s)^(.*?)(?:\{|:\s*\n|$)", 1))
    return (
        F.when(type_ == "class", of_class)
        .when(type_.isin("function", "method"), of_function)
        .when(type_.isin("interface", "type", "enum"), F.array_join(F.slice(lines, 1, 30), "\n"))
        .otherwise(F.array_join(F.slice(lines, 1, 10), "\n"))
    )


def describe(type_: Column, name: Column, doc: Column, signature: Column) -> Column:
    """One sentence on a symbol: the first line of its documentation, or its type, name and signature."""
    first = F.trim(F.split(doc, "\n")[0])
    said = F.concat(F.initcap(type_), F.lit(" "), name, F.coalesce(F.concat(F.lit(" "), truncate(signature, 120)), F.lit("")))
    return F.when(F.length(first) > 0, first).otherwise(said)
