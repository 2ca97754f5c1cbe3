"""Source files to chunks, symbols and imports: the one step that needs Python on the executors.

A file is parsed once, into one row that holds its chunks, symbols and imports in order; everything
after that is relational. Python files go through their syntax tree, other languages through line
patterns, and all else through line windows. Parsers for further languages can be registered.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.declarations import DECLARATIONS, IMPORTS, block_end, declaration_at, declares, imported_modules
from lodestrata.functions.native_windows import window_rows
from lodestrata.functions.windows import line_windows
from lodestrata.schemas import PARSED

MAX_CHUNK_CHARS = 2400
#: Files whose parsed rows a task holds at once.
FILES_AT_ONCE = 256
SIGNATURE_CHARS, DOCSTRING_CHARS, ID_TEXT_CHARS = 200, 500, 64

#: (path, source, language, max_chunk_chars) -> {"chunks", "symbols", "imports"}
Parser = Callable[[str, str, str, int], dict]
_PARSERS: dict[str, Parser] = {}


def register_parser(language: str, parser: Parser) -> None:
    """Use ``parser`` for a language; if it raises, the file is parsed as if there were none."""
    _PARSERS[language] = parser


def id_of(*parts: object) -> str:
    return hashlib.sha1("\0".join(map(str, parts)).encode("utf-8", "replace")).hexdigest()[:16]


def decode(data: bytes) -> str:
    """UTF-8, or else Latin-1, which never fails."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _chunk(path: str, language: str, start: int, end: int, text: str, kind: str, chunk_id: str, symbol: str | None = None, docstring: str | None = None) -> dict:
    return {"chunk_id": chunk_id, "file_path": path, "language": language, "start_line": start, "end_line": end, "text": text, "kind": kind, "symbol": symbol, "docstring": docstring}


def window_chunks(path: str, lines: list[str], language: str, first: int = 0, header: str = "", symbol: str | None = None) -> list[dict]:
    """Chunks of line windows; ``first`` lines come before these in the file."""
    out = []
    for a, b in line_windows([not x.strip() for x in lines]):
        text = "\n".join(lines[a:b])
        if text.strip():
            out.append(_chunk(path, language, first + a + 1, first + b, f"{header}\n{text}" if header else text, "block", id_of(path, first + a, text[:ID_TEXT_CHARS]), symbol))
    return out


def parse_by_lines(path: str, source: str, language: str, budget: int = MAX_CHUNK_CHARS) -> dict:
    """Declarations become chunks and symbols, all between them windows."""
    lines = source.splitlines()
    found = {"chunks": [], "symbols": [], "imports": imported_modules(source, language) if lines else []}
    if not declares(language):
        found["chunks"] = window_chunks(path, lines, language)
        return found
    loose = at = 0
    while at < len(lines):
        hit = declaration_at(lines[at], language)
        if not hit:
            at += 1
            continue
        kind, name = hit
        found["chunks"] += window_chunks(path, lines[loose:at], language, loose)
        last = block_end(lines, at, language)
        body = lines[at : last + 1]
        text, head = "\n".join(body), lines[at].strip()
        found["symbols"].append({"name": name, "qualified_name": name, "kind": kind, "file_path": path, "start_line": at + 1, "end_line": last + 1, "signature": head[:SIGNATURE_CHARS], "docstring": "", "bases": [], "calls": []})
        if len(text) > 2 * budget:
            found["chunks"] += window_chunks(path, body, language, at, f"// context: {head}", name)
        else:
            found["chunks"].append(_chunk(path, language, at + 1, last + 1, text, kind, id_of(path, name, at + 1), name))
        loose = at = last + 1
    found["chunks"] += window_chunks(path, lines[loose:], language, loose)
    return found


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _plain_name(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


class _PythonFile:
    """Walks a module's statements once, collecting chunks and symbols."""

    def __init__(self, path: str, source: str, budget: int) -> None:
        self.path, self.budget = path, budget
        self.lines = source.splitlines()
        self.chunks: list[dict] = []
        self.symbols: list[dict] = []

    def text(self, start: int, end: int) -> str:
        return "\n".join(self.lines[start - 1 : end])

    def runs(self, body: list[ast.stmt]) -> Iterator[tuple[ast.stmt | None, int, int]]:
        """Definitions one by one; other statements as runs of lines, ended where they fill the budget."""
        start = end = 0
        for stmt in body:
            if isinstance(stmt, _DEFS):
                if start:
                    yield None, start, end
                yield stmt, 0, 0
                start = end = 0
                continue
            start = start or stmt.lineno
            end = max(end, stmt.end_lineno or stmt.lineno)
            if len(self.text(start, end)) >= self.budget:
                yield None, start, end
                start = end = 0
        if start:
            yield None, start, end

    def body(self, body: list[ast.stmt], owner: str = "", context: str = "") -> None:
        for definition, start, end in self.runs(body):
            if definition is not None:
                self.definition(definition, owner, context)
            elif self.text(start, end).strip():
                self.block(start, end, context)

    def block(self, start: int, end: int, context: str) -> None:
        """A run of statements, halved by lines while it exceeds one and a half budgets; a single line is never cut."""
        open_ = [(start, end)]
        while open_:
            a, b = open_.pop()
            text = self.text(a, b)
            if len(text) > 1.5 * self.budget and a < b:
                middle = a + (b - a) // 2
                open_ += [(middle + 1, b), (a, middle)]
            else:
                self.chunks.append(_chunk(self.path, "python", a, b, context + text, "block", id_of(self.path, a, b, text[:ID_TEXT_CHARS])))

    def symbol(self, node: ast.stmt, qualified: str, kind: str) -> dict:
        calls = (_plain_name(n.func) for n in ast.walk(node) if isinstance(n, ast.Call))
        bases = map(_plain_name, node.bases) if isinstance(node, ast.ClassDef) else ()
        row = {
            "name": node.name,
            "qualified_name": qualified,
            "kind": kind,
            "file_path": self.path,
            "start_line": min((d.lineno for d in node.decorator_list), default=node.lineno),
            "end_line": node.end_lineno or node.lineno,
            "signature": self.lines[node.lineno - 1].strip()[:SIGNATURE_CHARS],
            "docstring": (ast.get_docstring(node) or "")[:DOCSTRING_CHARS],
            "bases": [b for b in bases if b],
            "calls": list(dict.fromkeys(c for c in calls if c)),
        }
        self.symbols.append(row)
        return row

    def definition(self, node: ast.stmt, owner: str, context: str) -> None:
        qualified = f"{owner}.{node.name}" if owner else node.name
        is_class = isinstance(node, ast.ClassDef)
        row = self.symbol(node, qualified, "class" if is_class else "method" if context or owner else "function")
        start, end, doc = row["start_line"], row["end_line"], row["docstring"] or None
        text = self.text(start, end)
        if not is_class or len(text) <= self.budget:
            self.chunks.append(_chunk(self.path, "python", start, end, context + text, row["kind"], id_of(self.path, qualified, start), qualified, doc))
            self.inner(node, qualified)
            return
        # A class beyond the budget: its head by itself, then its members, each under the class's first line.
        first = node.body[0]
        told = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
        head = max(start, (first.end_lineno if told else 0) or first.lineno - 1)
        self.chunks.append(_chunk(self.path, "python", start, head, self.text(start, head), "class", id_of(self.path, qualified, "header"), qualified, doc))
        self.body(node.body, qualified, f"# context: {row['signature']}\n")

    def inner(self, node: ast.stmt, owner: str) -> None:
        """Symbols of definitions directly inside one that is a chunk as a whole."""
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _DEFS):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                self.inner(child, self.symbol(child, f"{owner}.{child.name}", kind)["qualified_name"])


def parse_python(path: str, source: str, budget: int = MAX_CHUNK_CHARS) -> dict:
    """By syntax tree; a source that doesn't parse gives nothing."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"chunks": [], "symbols": [], "imports": []}
    imports = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.append("." * node.level + node.module)
    file = _PythonFile(path, source, budget)
    file.body(tree.body)
    return {"chunks": file.chunks, "symbols": file.symbols, "imports": imports}


def parse_source(path: str, source: str, language: str, budget: int = MAX_CHUNK_CHARS) -> dict:
    """Chunks, symbols and imports of one file, each in order."""
    if language == "python":
        found = parse_python(path, source, budget)
        # What doesn't parse is still worth searching, as text.
        return found if found["chunks"] or not source.strip() else parse_by_lines(path, source, "text", budget)
    if own := _PARSERS.get(language):
        try:
            return own(path, source, language, budget)
        except Exception:  # noqa: BLE001  a parser's failure must not fail the index
            pass
    return parse_by_lines(path, source, language, budget)


def parse_files(files: DataFrame, budget: int = MAX_CHUNK_CHARS) -> DataFrame:
    """(file_path, language, content binary or string) -> one row for each file: its chunks, symbols, imports.

    Texts without declarations are cut into windows by expressions; only the others leave the JVM.
    """
    parsed = F.coalesce(F.col("language").isin("python", *DECLARATIONS, *IMPORTS, *_PARSERS), F.lit(False))
    own = files.select("file_path", "language", "content")
    return window_rows(own.where(~parsed)).unionByName(_parsed_rows(own.where(parsed), budget))


def _parsed_rows(files: DataFrame, budget: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Chunks and symbols of a few files at a time: they take many times their files' space.
            for begin in range(0, len(batch), FILES_AT_ONCE):
                part, made = batch.iloc[begin : begin + FILES_AT_ONCE], []
                for path, language, content in zip(part["file_path"], part["language"], part["content"], strict=True):
                    source = decode(bytes(content)) if isinstance(content, (bytes, bytearray, memoryview)) else content or ""
                    made.append({"file_path": path} | parse_source(path, source, language, budget))
                yield pd.DataFrame(made, columns=["file_path", "chunks", "symbols", "imports"])

    return files.mapInPandas(run, PARSED)
