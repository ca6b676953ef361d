"""Sources to a graph: one pass over the files, one task for several files, then resolution of names by joins."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.extract.facts import consumer_facts, python_facts, skipped
from graphloom.model import EDGES, NODES, PropertyGraph, ancestry, canonical_order, conform, parent, short, union
from graphloom.session import cut

SKIPPED = ("__pycache__", ".venv", ".git", "node_modules")
FACTS = "fact string, id string, target string, data string, n long"
SHAPE = "posargs int, kwargs array<string>, splat boolean"
DEFINITION = (
    "kind string, file string, visibility string, docstring string, lineno int, endlineno int, signature string, decorators array<string>, is_deprecated boolean, "
    "extras struct<annotation:string,params:array<struct<name:string,type:string>>,returns:string,control:struct<branches:bigint,loops:bigint,try:boolean,generator:boolean,async:boolean>,is_dataclass:boolean,registry:struct<decorator:string,key:string>>"
)


def sources(spark: SparkSession, folder: str, glob: str, only: set[str] | None = None) -> DataFrame:
    """``(path, text)`` of the files of a folder, or a URI of one, and those below; path begins with the folder's own name.

    Spark's own file sources leave out names that begin with an underscore, as ``__init__.py`` does. So the driver lists the paths
    and the tasks read the files. The text of a file that isn't UTF-8 is null. only: the paths to keep, as a repository lists them.
    """
    system, root = fs.FileSystem.from_uri(folder if "://" in folder else str(Path(folder).resolve()))
    base = root.rstrip("/").rpartition("/")[0]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    paths = sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, glob))
    paths = [p[len(base) + 1 :] for p in paths if not set(p[len(base) + 1 :].split("/")) & set(SKIPPED)]
    paths = [p for p in paths if only is None or p in only]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 16 + 1, 4096)))
    uri = folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fs.FileSystem.from_uri(uri if "://" in uri else base or "/")[0]
        for batch in batches:
            out = []
            for p in batch.column("path").to_pylist():
                with own.open_input_stream(f"{base}/{p}") as f:
                    try:
                        out.append((p, f.read().decode("utf-8-sig")))
                    except UnicodeDecodeError:
                        out.append((p, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["path", "text"])

    out = rows.mapInArrow(read, "path string, text string")
    out._graphloom_spread = True
    return out


def spread(files: DataFrame) -> DataFrame:
    """The files over all cores. Those that a query makes come in one or two partitions, as they are few bytes; parsing takes a second for a few hundred classes."""
    return files if getattr(files, "_graphloom_spread", False) else files.repartition(3 * files.sparkSession.sparkContext.defaultParallelism)


def _facts(files: DataFrame, worker) -> DataFrame:
    """Facts of files ``(path, text)``; n keeps the order within a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                rows = [skipped(path, "not UTF-8")] if text is None else worker(path, text)
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.string()) for c in cols], pa.array(range(len(rows)), pa.int64())], ["fact", "id", "target", "data", "n"])

    return spread(files).select("path", "text").mapInArrow(run, FACTS)


def _core_worker(path: str, text: str):
    stem = path.removesuffix(".py")
    package = stem.endswith("/__init__")
    return python_facts(stem.removesuffix("/__init__").replace("/", "."), text, package, path)


def longest_module(paths: DataFrame, modules: DataFrame, c: str) -> DataFrame:
    """Adds ``module``: of modules ``(module)``, the longest that the path in column c is or lies under; rows without any go."""
    some = paths.select(c).distinct().withColumn("module", F.explode(ancestry(c))).join(modules, "module").groupBy(c).agg(F.max_by("module", F.length("module")).alias("module"))
    return paths.join(some, c)


def resolve_paths(nodes: DataFrame, exports: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, id)``: the node that a path in the core names, through exports ``(path, target)``, else by its longest known prefix."""
    known = nodes.select("id")
    cuts = paths.select("path").distinct().withColumn("prefix", F.explode(ancestry("path")))
    both = cuts.join(exports.groupBy(F.col("path").alias("prefix")).agg(F.max("target").alias("exported")), "prefix", "left").join(known.withColumn("own", F.lit(True)).withColumnRenamed("id", "prefix"), "prefix", "left")
    whole = F.col("prefix") == F.col("path")
    base = F.when(whole, F.when(F.col("own"), F.col("prefix")).otherwise(F.col("exported"))).otherwise(F.coalesce("exported", F.when(F.col("own"), F.col("prefix"))))
    best = both.withColumn("base", base).where("base is not null").groupBy("path").agg(F.max_by(F.struct("base", "prefix"), F.length("prefix")).alias("b"))
    found = best.select("path", "b.base", F.concat("b.base", F.expr("substring(path, length(b.prefix) + 1)")).alias("candidate"), (F.col("b.prefix") == F.col("path")).alias("whole"))
    out = found.join(known.withColumnRenamed("id", "candidate").withColumn("is", F.lit(True)), "candidate", "left")
    return out.select("path", F.when(F.col("whole") | F.col("is").isNull(), F.col("base")).otherwise(F.col("candidate")).alias("id"))


def contract(df: DataFrame, *keys: str) -> DataFrame:
    """Groups calls with the struct ``s`` of their shape: callsites, posargs, kwargs, splat; what is empty or false is null."""
    own = df.groupBy(*keys).agg(F.count("*").alias("callsites"), F.array_sort(F.collect_set("s.posargs")).alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("s.kwargs", F.expr("cast(array() as array<string>)")))))).alias("k"), F.bool_or("s.splat").alias("sp"))
    return own.select(*keys, "callsites", F.when(F.size("p") > 0, F.col("p")).alias("posargs"), F.when(F.size("k") > 0, F.col("k")).alias("kwargs"), F.when(F.col("sp"), True).alias("splat"))


def sized(names: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table of names, of registries or protocols, broadcast while it is small; pairs of names are matched by parts of them, so no key can join them."""
    kept = cut(names)
    return F.broadcast(kept) if kept.count() <= rows else kept


def family_of(decorator: Column) -> tuple[Column, Column]:
    """(registry class, token) of a registering decorator's path."""
    registry = F.when(decorator.contains("."), F.substring_index(F.substring_index(decorator, ".", -2), ".", 1)).otherwise("")
    token = F.regexp_replace(short(decorator), "^(register_|register)", "")
    return registry, F.trim(F.replace(F.replace(token, F.lit("_strategy"), F.lit("")), F.lit("strategy"), F.lit("")), F.lit("_"))


def extract(spark: SparkSession, package: str, deep: bool = False) -> PropertyGraph:
    """The graph of a package's folder. deep: methods called on local names, new objects and attributes of self are resolved by their types."""
    if "://" not in package and not Path(package).is_dir():
        raise NotADirectoryError(f"not a package's folder: {package}")
    return extract_files(sources(spark, package, "*.py"), package.rstrip("/").rpartition("/")[2], deep)


def extract_files(files: DataFrame, target: str, deep: bool = False) -> PropertyGraph:
    """The graph of a package whose files are rows ``(path, text)``, the paths beginning with the package's name.

    Its ``skipped`` has ``(path, reason)`` of the files that couldn't be read or parsed.
    """
    facts = cut(_facts(files, _core_worker))
    of = lambda fact: facts.where(F.col("fact") == fact)
    edges: list[DataFrame] = []

    def edge(df: DataFrame, kind: str, **extras: Column) -> None:
        more = [F.struct(*[v.alias(k) for k, v in extras.items()]).alias("extras")] if extras else []
        edges.append(conform(df.select(F.lit(kind).alias("type"), "source", "target", F.col("n").alias("ord") if "n" in df.columns else F.lit(0).alias("ord"), *more), EDGES))

    rows = of("node").select("id", "n", F.from_json("data", DEFINITION).alias("d"))
    nodes = rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n")))).where("k = 1").select("id", "d.*")
    nodes = cut(nodes)
    modules = nodes.where("kind = 'module'").select(F.col("id").alias("module"))
    inner = target + "."
    pairs = lambda fact: of(fact).select(F.col("id").alias("source"), "target", "data", "n")

    # contains, inherits, decorated_by, export, imports
    edge(pairs("contains").groupBy("source", "target").agg(F.min("n").alias("n")), "contains")
    edge(modules.where(F.col("module").contains(".")).select(parent("module").alias("source"), F.col("module").alias("target")), "contains")
    edge(pairs("decorated_by"), "decorated_by")
    edge(pairs("inherits"), "inherits", external=F.when(F.get_json_object("data", "$.external") == "true", True))
    reached = pairs("import").where((F.col("target") == target) | F.col("target").startswith(inner))
    edge(reached, "export", **{"as": F.get_json_object("data", "$.name"), "public": F.get_json_object("data", "$.public").cast("boolean")})
    imports = longest_module(reached.select("source", "target"), modules, "target").where("module <> source").select("source", F.col("module").alias("target")).distinct()
    edge(imports, "imports")

    # calls by name; those on self need the members of the class and of its bases in the package
    contains = pairs("contains").select("source", "target")
    scope = contains.select(F.col("source").alias("class_id"), short("target").alias("name"))
    bases = pairs("inherits").where(F.col("target").startswith(inner)).select(F.col("source").alias("class_id"), F.col("target").alias("base"))
    scope = scope.union(bases.join(scope.withColumnRenamed("class_id", "base"), "base").select("class_id", "name")).distinct().withColumn("has", F.lit(True))
    functions = nodes.select(F.col("id").alias("source"))
    shape = F.from_json("data", SHAPE)
    called = pairs("call").join(functions, "source", "left_semi").select("source", "target", shape.alias("s"), *[F.get_json_object("data", f"$.{k}").alias(a) for k, a in (("how", "how"), ("class_id", "class_id"), ("name", "name"), ("otherwise.how", "other_how"), ("otherwise.target", "other_target"), ("typed", "typed"), ("method", "method"))])
    called = called.join(scope, ["class_id", "name"], "left")
    fails = (F.col("how") == "self") & F.col("has").isNull()
    called = called.select("source", "s", "typed", "method", F.when(fails, F.col("other_how")).otherwise(F.col("how")).alias("how"), F.when(fails, F.col("other_target")).otherwise(F.col("target")).alias("target"))
    if deep:
        called = _by_type(called, nodes, reached, scope)
    called = cut(called)
    resolved = F.col("how").isin("deep", "module", "self", "imported")
    by_name = contract(called.where(resolved), "source", "target").join(called.where(resolved).groupBy("source", "target").agg(F.first("how").alias("resolution")), ["source", "target"])
    edge(by_name, "calls", resolution=F.col("resolution"), callsites=F.col("callsites"), posargs=F.col("posargs"), kwargs=F.col("kwargs"), splat=F.col("splat"))
    coverage = called.groupBy(F.col("source").alias("id")).agg(F.struct(F.count("*").alias("out"), F.count_if(resolved).alias("resolved"), *[F.count_if(F.col("how") == h).alias(h) for h in ("external", "unresolved", "dynamic")]).alias("calls"))

    # registries: families of classes, calls that dispatch to them, the protocols that they implement
    registry, token = family_of(F.col("decorator"))
    registered = nodes.where("extras.registry is not null").select("id", F.col("extras.registry.decorator").alias("decorator"), F.col("extras.registry.key").alias("key")).withColumn("registry", registry).withColumn("token", token)
    members = cut(registered.groupBy("registry", "token", "key").agg(F.max("id").alias("member")))
    families = sized(members.select("registry", "token").distinct())
    ways = of("dispatch").union(of("bind")).select("fact", "id", "target", "n", *[F.get_json_object("data", f"$.{k}").alias(k) for k in ("receiver", "name", "key")])
    fits = F.when(F.col("receiver").isNotNull(), (F.col("receiver") == F.col("registry")) & F.col("name").contains(F.col("token"))).otherwise((F.col("token") != "") & F.col("name").contains(F.col("token")))
    matched = ways.join(families, fits).withColumn("k", F.row_number().over(Window.partitionBy("fact", "id", "target", "n", "receiver", "name").orderBy("registry", "token"))).where("k = 1")
    direct = matched.where("fact = 'dispatch'").select(F.col("id").alias("source"), "registry", "token", F.col("key").alias("asked"))
    direct = direct.join(members, ["registry", "token"]).withColumn("exact", F.max(F.col("key") == F.col("asked")).over(Window.partitionBy("source", "registry", "token", "asked")))
    direct = direct.where(~F.coalesce("exact", F.lit(False)) | (F.col("key") == F.col("asked"))).select("source", F.col("member").alias("target"), F.coalesce("exact", F.lit(False)).alias("exact"))
    bound = matched.where("fact = 'bind'").groupBy(F.col("id").alias("class_id"), F.col("target").alias("attribute")).agg(F.max_by(F.struct("registry", "token"), "n").alias("f"))
    through = of("through").select(F.col("id").alias("source"), F.col("target").alias("method"), F.get_json_object("data", "$.class_id").alias("class_id"), F.get_json_object("data", "$.attribute").alias("attribute"))
    through = through.join(bound, ["class_id", "attribute"]).select("source", "method", "f.*").join(members, ["registry", "token"]).select("source", F.concat_ws(".", "member", "method").alias("target")).join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    bridged = direct.union(through.select("source", "target", F.lit(False))).join(functions, "source", "left_semi").groupBy("source", "target").agg(F.bool_or("exact").alias("exact"))
    edge(bridged, "calls", resolution=F.when(F.col("exact"), "registry").otherwise("registry-candidate"))
    protocols = pairs("inherits").where("target = 'typing.Protocol'").select(F.col("source").alias("protocol"), F.lower(short("source")).alias("lower")).distinct()
    stem = F.lower(F.regexp_replace("registry", "Registry$", ""))
    match = F.when((F.col("token") != "") & F.col("lower").contains(F.col("token")), 1).when((stem != "") & F.col("lower").contains(stem), 2)
    chosen = families.join(sized(protocols), match.isNotNull()).withColumn("way", match).groupBy("registry", "token").agg(F.min(F.struct("way", "lower", "protocol")).alias("m"))
    implements = members.join(chosen, ["registry", "token"]).select(F.col("member").alias("source"), F.col("m.protocol").alias("target")).distinct()
    edge(implements, "implements", via=F.lit("registry"))

    # string keys
    keys = of("key").select(F.col("id").alias("source"), F.col("target").alias("key"), F.get_json_object("data", "$.writes").cast("boolean").alias("writes"), F.get_json_object("data", "$.subscript").cast("boolean").alias("subscript")).join(functions, "source", "left_semi")
    used = keys.select("source", F.concat(F.lit("column:"), "key").alias("target"), "writes", F.when(F.col("subscript"), "subscript").otherwise("dict-literal").alias("access")).distinct()
    for kind in ("reads", "writes"):
        edge(used.where(F.col("writes") == (kind == "writes")), kind, resolution=F.lit("string-key"), access=F.col("access"))
    columns = keys.groupBy("key").agg(F.bool_or("subscript").alias("subscripted")).select(F.concat(F.lit("column:"), "key").alias("id"), F.lit("column").alias("kind"), F.struct(F.lit("core").alias("root"), "key", "subscripted").alias("extras"))

    none = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("out", "resolved", "external", "unresolved", "dynamic")])
    full = nodes.join(coverage, "id", "left").withColumn("extras", F.struct(F.lit("core").alias("root"), "extras.annotation", "extras.params", "extras.returns", F.when(F.col("kind") == "function", F.coalesce("calls", none)).alias("calls"), "extras.control", "extras.is_dataclass", "extras.registry"))
    graph = PropertyGraph(target, cut(conform(full, NODES).union(conform(columns, NODES))), cut(canonical_order(union(edges))))
    graph.skipped = _skipped(facts)
    return graph


def _skipped(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'skipped'").select(F.col("id").alias("path"), F.get_json_object("data", "$.reason").alias("reason"))


def _by_type(called: DataFrame, nodes: DataFrame, reached: DataFrame, scope: DataFrame) -> DataFrame:
    """Calls with the methods of known types resolved: the type's path must name a class, here or by a re-export, and the class or a base of it
    have the method. Every call that ends in the package is then marked ``deep``."""
    exports = reached.select(F.concat_ws(".", "source", F.get_json_object("data", "$.name")).alias("path"), "target")
    classes = nodes.where("kind = 'class'").select(F.col("id").alias("owner"))
    types = resolve_paths(nodes, exports, called.where("typed is not null").select(F.col("typed").alias("path"))).select(F.col("path").alias("typed"), F.col("id").alias("owner")).join(classes, "owner", "left_semi")
    found = called.join(types, "typed", "left").join(scope.select(F.col("class_id").alias("owner"), F.col("name").alias("method"), F.lit(True).alias("fits")), ["owner", "method"], "left")
    ways = F.col("how").isin("module", "self", "imported")
    by = F.coalesce("fits", F.lit(False)) & ~ways
    return found.select("source", "s", F.when(by | ways, "deep").otherwise(F.col("how")).alias("how"), F.when(by, F.concat_ws(".", "owner", "method")).otherwise(F.col("target")).alias("target"))


def extract_repo(spark: SparkSession, core: str, consumers: tuple[str, ...] = (), docs: tuple[str, ...] = (), mode: str = "thin", deep: bool = False) -> PropertyGraph:
    """The graph of a package with what uses it: folders of Python files (each a root of its own name) and of Markdown files. Folders that
    don't exist are passed over."""
    if mode not in ("thin", "full"):
        raise ValueError(f"consumers are read thin or full, not {mode!r}")
    there = lambda folder: "://" in folder or Path(folder).is_dir()
    users = [(f.rstrip("/").rpartition("/")[2], sources(spark, f, "*.py")) for f in consumers if there(f)]
    return with_users(extract(spark, core, deep), users, [sources(spark, f, "*.md") for f in docs if there(f)], mode)


def with_users(graph: PropertyGraph, consumers: list[tuple[str, DataFrame]], docs: list[DataFrame], mode: str = "thin") -> PropertyGraph:
    """A package's graph with what uses it: (root, files) of Python files, and Markdown files, all as rows ``(path, text)``."""
    package = graph.target
    exports = graph.of("export").select(F.concat_ws(".", "source", "extras.as").alias("path"), "target")
    modules = graph.nodes.where("kind = 'module'").select(F.col("id").alias("module"))
    nodes, edges, lost = [graph.nodes], [graph.edges], graph.skipped
    for label, files in consumers:

        def worker(path: str, text: str, full: bool = mode == "full"):
            return consumer_facts(path.removesuffix(".py").removesuffix("/__init__").replace("/", "."), text, path, package, full)

        facts = cut(_facts(files, worker))
        lost = lost.union(_skipped(facts))
        root = F.struct(F.lit(label).alias("root")).alias("extras")
        own = facts.where("fact = 'consumer'").select("id", F.lit("module").alias("kind"), F.get_json_object("data", "$.file").alias("file"), root)
        defs = facts.where("fact = 'consumer_def'").select("id", F.get_json_object("data", "$.kind").alias("kind"), F.get_json_object("data", "$.lineno").cast("int").alias("lineno"), root, "target")
        nodes += [conform(own, NODES), conform(defs.drop("target").dropDuplicates(["id"]), NODES)]
        edges.append(conform(defs.select(F.lit("contains").alias("type"), F.col("target").alias("source"), F.col("id").alias("target")), EDGES))
        found = resolve_paths(graph.nodes, exports, facts.where("fact in ('use', 'consumer_import')").select(F.col("target").alias("path")))
        imports = facts.where("fact = 'consumer_import'").select(F.col("id").alias("source"), F.col("target").alias("path")).join(found, "path")
        as_module = imports.join(modules.withColumnRenamed("module", "id").withColumn("is", F.lit(True)), "id", "left")
        direct = as_module.where("is").select("source", F.col("id").alias("target"))
        above = longest_module(as_module.where("is is null").select("source", "path"), modules, "path").select("source", F.col("module").alias("target"))
        edges.append(conform(direct.union(above).distinct().withColumn("type", F.lit("imports")), EDGES))
        uses = facts.where("fact = 'use'").select(F.col("id").alias("source"), F.col("target").alias("path"), F.get_json_object("data", "$.called").cast("boolean").alias("called"), F.from_json("data", SHAPE).alias("s")).join(found, "path").withColumnRenamed("id", "target")
        how = contract(uses.where("called"), "source", "target")
        edges.append(conform(how.select(F.lit("calls").alias("type"), "source", "target", F.struct(F.lit("imported").alias("resolution"), "callsites", "posargs", "kwargs", "splat").alias("extras")), EDGES))
        plain = uses.groupBy("source", "target").agg(F.bool_or("called").alias("called")).where("not called")
        edges.append(conform(plain.select(F.lit("references").alias("type"), "source", "target", F.struct(F.lit("imported").alias("resolution")).alias("extras")), EDGES))
    for texts in map(spread, docs):
        lost = lost.union(texts.where("text is null").select("path", F.lit("not UTF-8")))
        refs = doc_references(texts.where("text is not null"), graph.nodes, exports, package)
        nodes.append(conform(refs.select(F.col("source").alias("id"), F.lit("doc").alias("kind"), F.col("source").alias("file"), F.struct(F.lit("docs").alias("root")).alias("extras")).distinct(), NODES))
        edges.append(conform(refs.select(F.lit("references").alias("type"), "source", "target", F.struct(F.lit("doc").alias("resolution")).alias("extras")), EDGES))
    out = PropertyGraph(package, cut(union(nodes)), cut(canonical_order(union(edges))))
    out.skipped = lost
    return out


def doc_references(files: DataFrame, nodes: DataFrame, exports: DataFrame, package: str) -> DataFrame:
    """``(source, target)``: the symbols of a package that texts ``(path, text)`` import in examples or name in full."""
    name = package.replace(".", r"\.")
    line = rf"(from\s+{name}[\w.]*\s+import\s+[^\n#]+)"
    imports = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(line), F.lit(1))).alias("line"))
    module = F.regexp_extract("line", rf"from\s+({name}[\w.]*)\s+import\s+([^\n#]+)", 1)
    names = F.split(F.translate(F.regexp_extract("line", rf"from\s+({name}[\w.]*)\s+import\s+([^\n#]+)", 2), "()", "  "), ",")
    single = imports.select("path", module.alias("module"), F.explode(names).alias("raw")).where((F.col("module") == package) | F.col("module").startswith(package + "."))
    single = single.withColumn("name", F.trim(F.split(F.trim("raw"), " as ")[0])).where("name not in ('', '*')").select("path", F.concat_ws(".", "module", "name").alias("wanted"))
    found = resolve_paths(nodes, exports, single.select(F.col("wanted").alias("path"))).withColumnRenamed("path", "wanted")
    first = single.join(found, "wanted").select(F.col("path").alias("source"), F.col("id").alias("target"))
    mentions = files.select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(rf"\b({name}(?:\.[A-Za-z_]\w*)+)\b"), F.lit(1))).alias("token"))
    exact = mentions.join(nodes.select(F.col("id").alias("token")), "token", "left_semi").select("source", F.col("token").alias("target"))
    exported = mentions.join(nodes.select(F.col("id").alias("token")), "token", "left_anti").join(exports.groupBy(F.col("path").alias("token")).agg(F.max("target").alias("target")), "token").select("source", "target")
    return first.union(exact).union(exported).distinct()
