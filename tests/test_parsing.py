"""Chunks, symbols and imports of sources."""

from lodestrata.functions.parsing import decode, parse_source, register_parser
from lodestrata.functions.windows import line_windows

BIG = "class Big:\n    \"\"\"Head.\"\"\"\n" + "".join(f"    def m{k}(self):\n" + "".join(f"        value_{k}_{i} = {i} * {i}\n" for i in range(8)) + "\n" for k in range(10))


def test_windows_cover_all_lines():
    found = list(line_windows([False] * 200))
    assert found[0][0] == 0 and found[-1][1] == 200 and len(found) > 1
    assert all(b > c for (_, b), (c, _) in zip(found, found[1:]))
    assert list(line_windows([])) == []


def test_windows_end_on_blank_lines():
    blank = [False] * 100
    blank[44] = blank[20] = True
    assert list(line_windows(blank))[0] == (0, 45)


def test_large_class_is_parted():
    found = parse_source("big.py", BIG, "python", 800)
    kinds = [(c["kind"], c["symbol"]) for c in found["chunks"]]
    assert kinds[0] == ("class", "Big") and len([k for k in kinds if k[0] == "method"]) == 10
    assert all(c["text"].startswith("# context: class Big:\n") for c in found["chunks"][1:])
    assert {s["qualified_name"] for s in found["symbols"]} == {"Big", *(f"Big.m{k}" for k in range(10))}


def test_unparsable_python_becomes_text():
    found = parse_source("bad.py", "def broken(:\n", "python")
    assert [c["language"] for c in found["chunks"]] == ["text"] and not found["symbols"]
    assert parse_source("e.py", "", "python")["chunks"] == []
    assert parse_source("nul.py", "x = 1\0", "python")["chunks"][0]["language"] == "text"


def test_very_long_line_is_kept_whole():
    found = parse_source("l.py", "x = [" + "1, " * 3000 + "]\ny = 2\n", "python")
    assert max(len(c["text"]) for c in found["chunks"]) > 3600


def test_statements_are_merged_up_to_the_budget():
    source = "".join(f"name_{k} = {k}\n" for k in range(100))
    chunks = parse_source("s.py", source, "python", 300)["chunks"]
    assert len(chunks) > 3 and chunks[0]["start_line"] == 1 and chunks[-1]["end_line"] == 100


def test_oversized_block_keeps_its_declaration():
    body = "function big() {\n" + "  call();\n" * 700 + "}\n"
    found = parse_source("b.js", body, "javascript")
    assert len(found["symbols"]) == 1 and len(found["chunks"]) > 2
    assert all(c["kind"] == "block" and c["symbol"] == "big" and c["text"].startswith("// context: function big() {") for c in found["chunks"])


def test_interface_without_body_and_strings():
    found = parse_source("a.ts", "interface A { x: string }\nfunction f() { return '}'; }\nfunction g() { // {\n}\n", "typescript")
    assert [(s["name"], s["start_line"], s["end_line"]) for s in found["symbols"]] == [("A", 1, 1), ("f", 2, 2), ("g", 3, 4)]


def test_decode_never_fails():
    assert decode("é".encode()) == "é" and decode(b"\xe9") == "é"


def test_registered_parser_and_its_failure():
    register_parser("toml", lambda *a: {"chunks": [], "symbols": ["x"], "imports": []})
    assert parse_source("a.toml", "a = 1", "toml")["symbols"] == ["x"]
    register_parser("toml", lambda *a: 1 / 0)
    assert len(parse_source("a.toml", "a = 1", "toml")["chunks"]) == 1
