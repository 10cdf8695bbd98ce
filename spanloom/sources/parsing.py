"""Structural chunks of source files.

Python files are parsed with the standard library. For C and C++ the syntax
parser is optional; without it, functions are found by matching braces, which
is an approximation.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

try:
    from tree_sitter_language_pack import get_parser
except ImportError:
    get_parser = None

_NODE = pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
PARSED = pa.schema([
    ("path", pa.string()), ("source_role", pa.string()), ("language", pa.string()), ("chunk_index", pa.int64()),
    ("chunk_id", pa.string()), ("node_type", pa.string()), ("symbol", pa.string()), ("start_line", pa.int64()),
    ("end_line", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()),
    ("parent_route", pa.list_(pa.string())), ("parent_context", pa.string()), ("content", pa.string()),
    ("nodes", pa.list_(_NODE)), ("error", pa.string()),
])

_NOISE = re.compile(rb'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_FUNCTION = re.compile(rb"([A-Za-z_~][\w:~]*)\s*\([^;{}]*\)[^;{}()]*$")
_SCOPE = re.compile(rb"\b(namespace|class|struct)\s+([A-Za-z_]\w*)[^;{}()]*$")
_TYPES = {b"namespace": "namespace_definition", b"class": "class_specifier", b"struct": "struct_specifier"}


def _blank(source: bytes) -> bytes:
    """The source with comments and literals blanked out, offsets kept."""
    return _NOISE.sub(lambda m: re.sub(rb"[^\n]", b" ", m.group()), source)


def cpp_units(source: bytes) -> list[tuple[str, str, int, int, list[str]]]:
    """(node_type, name, start, end, route) of namespaces, types and functions."""
    code, units, open_units, statement = _blank(source), [], [], 0
    for at, char in enumerate(code):
        if char == ord("{"):
            head = code[statement:at]
            lead = statement + len(head) - len(head.lstrip())
            scope, function = _SCOPE.search(head), _FUNCTION.search(head)
            if scope:
                unit = (_TYPES[scope.group(1)], scope.group(2).decode(), lead)
            elif function and not any(u and u[0] == "function_definition" for u in open_units):
                unit = ("function_definition", function.group(1).decode(), lead)
            else:
                unit = None
            open_units.append(unit)
            statement = at + 1
        elif char == ord("}"):
            unit = open_units.pop() if open_units else None
            if unit:
                route = [f"{u[0]}:{u[1]}" for u in open_units if u] + [f"{unit[0]}:{unit[1]}"]
                units.append((unit[0], unit[1], unit[2], at + 1, route))
            statement = at + 1
        elif char == ord(";"):
            statement = at + 1
    return sorted(units, key=lambda u: (u[2], -u[3]))


def body_nodes(function: bytes) -> list[dict]:
    """Top-level statements, blocks and comments of a function's body."""
    code, nodes, depth, start = _blank(function), [], 0, None
    for match in _NOISE.finditer(function):
        if match.group()[:2] in (b"//", b"/*"):
            before = code[: match.start()]
            if before.count(b"{") - before.count(b"}") == 1:
                nodes.append({"type": "comment", "start": match.start(), "end": match.end()})
    for at, char in enumerate(code):
        if depth == 1 and start is None and not chr(char).isspace() and char not in b"}":
            start = at
        if char == ord("{"):
            depth += 1
        elif char == ord("}"):
            depth -= 1
        if depth == 1 and start is not None and char in b";}":
            kind = "expression_statement" if char == ord(";") else "compound_statement"
            nodes.append({"type": kind, "start": start, "end": at + 1})
            start = None
    return sorted(nodes, key=lambda n: n["start"])


def python_units(source: bytes) -> list[tuple[str, str, int, int, list[str]]]:
    """(node_type, name, start, end, route) of functions and classes."""
    starts, units = [0], []
    for line in source.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)

    def visit(node: ast.AST, route: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            here = route
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                here = [*route, f"{kind}:{child.name}"]
                units.append((
                    kind, child.name, starts[child.lineno - 1] + child.col_offset,
                    starts[child.end_lineno - 1] + child.end_col_offset, here,
                ))
            visit(child, here)

    visit(ast.parse(source), [])
    return sorted(units, key=lambda u: (u[2], -u[3]))


def _has_error(language: str, source: bytes) -> str | None:
    """Parse-health of a file, where a parser can tell."""
    if get_parser is not None and language in ("cpp", "python"):
        return "Tree-sitter reported a parse error" if get_parser(language).parse(source).root_node.has_error else None
    if language == "cpp":
        code = _blank(source)
        return None if code.count(b"{") == code.count(b"}") else "unbalanced braces"
    return None


def _chunks(row: dict, repository: str) -> list[dict]:
    source, language = row["content"].encode("utf-8"), row["language"]
    base = {"path": row["path"], "source_role": row["source_role"], "language": language}
    try:
        found = (python_units if language == "python" else cpp_units)(source)
        error = _has_error(language, source)
    except (SyntaxError, ValueError) as problem:
        return [{**base, "error": f"{type(problem).__name__}: {problem}"}]
    rows = []
    for index, (kind, name, start, end, route) in enumerate(found):
        piece = source[start:end]
        identity = f"{repository}:{row['path']}:{kind}:{start}:{end}".encode()
        is_case = kind == "function_definition" and language == "cpp"
        rows.append({
            **base, "chunk_index": index, "chunk_id": hashlib.sha1(identity).hexdigest(), "node_type": kind,
            "symbol": name, "start_line": source.count(b"\n", 0, start) + 1,
            "end_line": source.count(b"\n", 0, max(start, end - 1)) + 1, "byte_start": start, "byte_end": end,
            "parent_route": route[:-1], "parent_context": route[-2].split(":")[0] if len(route) > 1 else "",
            "content": piece.decode("utf-8", "replace"), "nodes": body_nodes(piece) if is_case else [], "error": error,
        })
    return rows or ([{**base, "error": error}] if error else [])


def parse_files(files: DataFrame, repository: str) -> DataFrame:
    """Structural chunks of decoded files of a repository: one Arrow batch of files at a time.

    A file that cannot be parsed gives one row with `error` and no chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(_chunks(row, repository), schema=PARSED)

    wanted = files.filter(F.col("language").isin("cpp", "python"))
    return wanted.select("path", "source_role", "language", "content").mapInArrow(run, from_arrow_schema(PARSED))
