"""Command line: index, search, symbol, callers, impact, outline, stats, ask, serve, tools, repos."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("lodestrata").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _index(args):
    from lodestrata.engine import CodeIndex

    return CodeIndex(_session(), args.path)


def _print_rows(df, line) -> None:
    rows = df.collect()
    print("\n".join(line(r) for r in rows) if rows else "nothing found")


def show_hits(hits: list[dict], preview: int, as_json: bool) -> None:
    if as_json:
        print(json.dumps(hits, indent=1))
        return
    for n, hit in enumerate(hits, 1):
        c = hit["chunk"]
        print(f"{n}. {c['file_path']}:{c['start_line']}-{c['end_line']}  {c['symbol'] or c['kind']}  {hit['score']:.4f}  [{'+'.join(hit['sources'])}]")
        for line in c["text"].splitlines()[:preview]:
            print(f"      {line}")
        for r in hit["related"]:
            print(f"      {r['relation']}: {r['symbol']} ({r['file']}:{r['line']})")
    if not hits:
        print("nothing found")


def _build(args) -> None:
    from lodestrata.sources.index import IndexOptions, build_index

    options = IndexOptions(embedder=args.embedder, exclude=tuple(args.exclude or ()), include=tuple(args.include or ()))
    print(json.dumps(build_index(_session(), args.path, full=args.full, options=options)))


def _search(args) -> None:
    show_hits(_index(args).search(args.query, k=args.k, language=args.lang, kind=args.kind, use_dense=not args.no_dense), args.preview, args.json)


def _symbol(args) -> None:
    _print_rows(_index(args).find_symbol(args.name), lambda r: f"{r.kind} {r.qualified_name}  {r.file_path}:{r.start_line}  {r.signature}")


def _callers(args) -> None:
    _print_rows(_index(args).callers(args.name), lambda r: f"{r.symbol}  {r.file}:{r.line}")


def _impact(args) -> None:
    _print_rows(_index(args).impact(args.name, args.depth), lambda r: f"{'  ' * (r.depth - 1)}{r.name}  {r.via}  {r.file}:{r.line}")


def _outline(args) -> None:
    _print_rows(_index(args).outline(args.file), lambda r: f"{r.line:5d}  {r.kind:8s} {r.name}  {r.signature}")


def _stats(args) -> None:
    print(json.dumps(_index(args).stats(), indent=1))


def _ask(args) -> None:
    from lodestrata.answer import ask

    found = ask(_index(args), args.question, k=args.k, provider=args.provider)
    print(json.dumps(found, indent=1) if args.json else found["answer"])


def _serve(args) -> None:
    from lodestrata.http_api import serve

    serve(_index(args), args.port)


def _tools(args) -> None:
    from lodestrata.tools import serve_stdio

    serve_stdio(_session(), args.path)


def _repos(args) -> None:
    from lodestrata.sources.index import IndexOptions, build_index
    from lodestrata.sources.repos import RepoMirror

    mirror = RepoMirror(_session(), token=args.token, workspace=args.workspace)
    if args.action == "list":
        for r in mirror.list_repos(args.user, args.include_forks):
            print(f"{r['full_name']}  {r['pushed_at']}  {r['size_kb']} KB{'  private' if r['private'] else ''}")
    elif args.action == "sync":
        print(json.dumps(mirror.sync(args.user, args.include_forks)))
        if not args.no_index:
            print(json.dumps(build_index(_session(), mirror.workspace, options=IndexOptions(embedder=args.embedder))))
    else:
        args.path = mirror.workspace
        _search(args)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, help_: str, *positional: str, path: bool = True, parent=commands) -> argparse.ArgumentParser:
        sub = parent.add_parser(name, help=help_)
        for p in positional:
            sub.add_argument(p)
        if path:
            sub.add_argument("--path", default=".", help="root of the indexed tree")
        sub.set_defaults(run=run)
        return sub

    def search_options(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--k", type=int, default=10)
        sub.add_argument("--lang")
        sub.add_argument("--kind", choices=["function", "method", "class", "block"])
        sub.add_argument("--no-dense", action="store_true")
        sub.add_argument("--json", action="store_true")
        sub.add_argument("--preview", type=int, default=4)

    sub = command("index", _build, "build or refresh an index", path=False)
    sub.add_argument("path", nargs="?", default=".")
    sub.add_argument("--full", action="store_true", help="build anew")
    sub.add_argument("--embedder", default="hash")
    sub.add_argument("--exclude", action="append")
    sub.add_argument("--include", action="append")
    search_options(command("search", _search, "hybrid search", "query"))
    command("symbol", _symbol, "find a symbol", "name")
    command("callers", _callers, "who calls a symbol", "name")
    command("impact", _impact, "what depends on a symbol", "name").add_argument("--depth", type=int, default=4)
    command("outline", _outline, "symbols of a file", "file")
    command("stats", _stats, "counts of an index")
    sub = command("ask", _ask, "answer a question", "question")
    sub.add_argument("--k", type=int, default=8)
    sub.add_argument("--provider", default="auto", help="a registered model, 'auto' or 'none'")
    sub.add_argument("--json", action="store_true")
    command("serve", _serve, "HTTP interface").add_argument("--port", type=int, default=8377)
    command("tools", _tools, "tools for agents, over standard input and output")
    repos = commands.add_parser("repos", help="mirror and search the repositories of an account").add_subparsers(dest="action", required=True)
    for name in ("list", "sync", "search"):
        sub = command(name, _repos, f"{name} repositories", *["query"] * (name == "search"), path=False, parent=repos)
        sub.add_argument("--user")
        sub.add_argument("--token")
        sub.add_argument("--workspace")
        sub.add_argument("--include-forks", action="store_true")
        if name == "sync":
            sub.add_argument("--no-index", action="store_true")
            sub.add_argument("--embedder", default="hash")
        if name == "search":
            search_options(sub)
    return parser


def main(argv: Sequence[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
