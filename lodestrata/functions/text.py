"""Column expressions for identifiers, search terms, paths and ids; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in source text.
STOPWORDS = tuple(
    """
    the a an and or not in of to for with is are was be this that it as at
    on by from if else elif return def class import function var let const
    public private protected static void int str bool true false none null
    self cls new pass raise try except finally while do switch case break
    continue
    """.split()
)
# What an identifier is, and its parts.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
SUBWORD = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
# File extensions and their languages.
LANGUAGES = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".go": "go",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".scala": "scala",
    ".swift": "swift",
    ".sh": "shell",
    ".bash": "shell",
    ".sql": "sql",
    ".md": "markdown",
    ".rst": "markdown",
    ".txt": "text",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".json": "json",
    ".tf": "terraform",
    ".proto": "proto",
}
DEFINITIONS = ("function", "method", "class")
TEXT_BUDGET = 4000


def split_identifier(ident: Column) -> Column:
    """Lower-case subwords of an identifier in any of the usual cases."""
    return F.transform(F.regexp_extract_all(ident, F.lit(SUBWORD), F.lit(0)), F.lower)


def _telling(word: Column) -> Column:
    return ~word.isin(*STOPWORDS)


def tokenize(text: Column) -> Column:
    """Search terms in order: every identifier, lowered, then those of its subwords that differ from it."""

    def terms(ident: Column) -> Column:
        whole = F.lower(ident)
        parts = F.filter(split_identifier(ident), lambda s: (s != whole) & (F.length(s) > 1) & _telling(s))
        return F.concat(F.when(_telling(whole), F.array(whole)).otherwise(F.array().cast("array<string>")), parts)

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), terms))


#: How often the terms of a chunk's columns count.
TERM_TIMES = {"text": 1, "symbol": 3, "docstring": 2, "file_path": 1}


def boosted_terms(text: Column, symbol: Column, docstring: Column, path: Column) -> Column:
    """Terms of a chunk: its symbol counts three times, its docstring twice."""
    return F.concat(tokenize(text), F.flatten(F.array_repeat(tokenize(symbol), 3)), F.flatten(F.array_repeat(tokenize(docstring), 2)), tokenize(path))


def embedded_text(path: Column, symbol: Column, docstring: Column, text: Column) -> Column:
    """What a vector is made of: path, symbol, docstring and the beginning of the text, as far as they are there."""
    present = lambda c: F.when(c != "", c)
    return F.concat_ws("\n", path, present(symbol), present(docstring), F.substring(F.coalesce(text, F.lit("")), 1, TEXT_BUDGET))


def chunk_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\0", *[p.cast("string") for p in parts])), 1, 16)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    """Language by extension, null if there is none; leading dots begin a name, not an extension."""
    ext = F.lower(F.regexp_extract(file_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def module_of(path: Column) -> Column:
    """Dotted module name of a Python file; null for other files."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", "")
    segments = F.filter(F.split(stem, "/"), lambda s: ~s.isin("", ".", "src"))
    return F.when(path.endswith(".py") & (F.size(segments) > 0), F.array_join(segments, "."))


def symbol_node(path: Column, qualified: Column) -> Column:
    return F.concat(F.lit("sym:"), path, F.lit("::"), qualified)


def file_node(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)
