"""Names and modules to the symbols and files they mean, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import file_node, module_of, symbol_node
from lodestrata.operators.graph import typed_edges

#: A name with more candidates than this, none of them in the same file, is left open.
MOST_CANDIDATES = 3
# What a relative import may leave out, in the order in which it is tried.
SUFFIXES = ("", ".py", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts", "/__init__.py")


def resolve_names(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, file_path, name) -> (src, dst): the first candidate of the same file, else the first of at most three.

    ``symbols``: (name, file_path, qualified_name, ord). Candidates are brought down to two numbers
    a name and one row a file before anything is joined, so a name that occurs everywhere costs one
    row for each file.
    """
    target = symbol_node(F.col("file_path"), F.col("qualified_name"))
    anywhere = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("ord", target.alias("dst"))).getField("dst").alias("first"))
    here = symbols.groupBy("name", "file_path").agg(F.min(F.struct("ord", target.alias("dst"))).getField("dst").alias("own"))
    asked = pending.distinct().join(anywhere, "name").join(here, ["name", "file_path"], "left")
    dst = F.coalesce("own", F.when(F.col("n") <= MOST_CANDIDATES, F.col("first")))
    return asked.select("src", dst.alias("dst")).where(F.col("dst").isNotNull())


def _normalised(path):
    """A path without ``.`` and, as far as there is something before them, without ``..`` segments."""
    step = lambda done, s: (
        F.when(s.isin("", "."), done)
        .when((s == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, module) -> (file_path, module, target).

    ``./`` and ``../`` are looked up as paths beside the importing file, with the first suffix that
    exists; anything else by its longest dotted prefix that is a Python module.
    """
    own = imports.select("file_path", F.trim("module").alias("module")).distinct()
    relative = F.col("module").startswith("./") | F.col("module").startswith("../")
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    places = own.where(relative).withColumn("place", _normalised(F.concat(folder, F.lit("/"), F.col("module"))))
    probes = places.select("file_path", "module", F.posexplode(F.array(*[F.concat("place", F.lit(s)) for s in SUFFIXES])).alias("pos", "probe"))
    by_path = probes.join(files.select(F.col("file_path").alias("probe")), "probe").groupBy("file_path", "module").agg(F.min_by("probe", "pos").alias("target"))

    modules = files.select(module_of(F.col("file_path")).alias("probe"), "file_path").where("probe is not null").groupBy("probe").agg(F.max("file_path").alias("target"))
    parts = F.split(F.regexp_replace("module", r"^\.+", ""), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    dotted = own.where(~relative).select("file_path", "module", F.posexplode(prefixes).alias("pos", "probe"))
    by_name = dotted.join(modules, "probe").groupBy("file_path", "module").agg(F.max_by("target", "pos").alias("target"))
    return by_path.unionByName(by_name)


def build_graph(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_path, language, imports) and symbols -> nodes, edges."""
    none = lambda kind: F.lit(None).cast(kind)
    file_nodes = files.select(file_node(F.col("file_path")).alias("node_id"), F.lit("file").alias("type"), F.col("file_path").alias("path"), "language", *[none("string").alias(c) for c in ("name", "qualified", "kind")], none("int").alias("line"))
    sid = symbol_node(F.col("file_path"), F.col("qualified_name"))
    facts = F.struct("ord", F.col("file_path").alias("path"), "name", F.col("qualified_name").alias("qualified"), "kind", F.col("start_line").alias("line"))
    last = symbols.groupBy(sid.alias("node_id")).agg(F.max(facts).alias("f"))
    symbol_nodes = last.select("node_id", F.lit("symbol").alias("type"), "f.path", none("string").alias("language"), "f.name", "f.qualified", "f.kind", "f.line")

    contains = symbols.select(file_node(F.col("file_path")).alias("src"), sid.alias("dst"), F.lit("contains").alias("edge_type"))
    targets = resolve_modules(files.select("file_path", F.explode("imports").alias("module")), files)
    imports = targets.select(file_node(F.col("file_path")).alias("src"), file_node(F.col("target")).alias("dst"), F.lit("imports").alias("edge_type"))
    asked = lambda column: symbols.select(sid.alias("src"), "file_path", F.explode(column).alias("name"))
    calls = resolve_names(asked("calls"), symbols).withColumn("edge_type", F.lit("calls"))
    inherits = resolve_names(asked("bases"), symbols.where("kind = 'class'")).withColumn("edge_type", F.lit("inherits"))
    return reduce(DataFrame.unionByName, (file_nodes, symbol_nodes)), typed_edges(contains, imports, calls, inherits)


