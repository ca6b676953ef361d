"""A property graph over ordinary tables: regions and nations are modules, customers and suppliers classes, orders functions.

* every part is a module ``w.L<0-6>.M<part>``, which imports the next of its dozen (the last one the first), and those of every fourth dozen one of the next;
* modules ``w``, ``w.R<region>``, ``w.R<region>.N<nation>``; classes ``<nation>.C<customer>`` and ``<nation>.S<supplier>``; functions
  ``<customer>.O<order>`` in the file ``N<nation>.py``; ``ev.U<user>`` for the users of events; ``reg.P<part>`` for parts up to size 40;
* an order calls the order that next ships one of its parts; a nation's suppliers import the two nations that buy most from them;
* customers inherit from their market segment, orders are decorated with their priority, parts implement the protocol of their type, a class;
  every fiftieth customer's class is named like a logger's;
* events, and some orders, read and write the columns ``column:k<n>`` of their properties; documents refer to the benchmark items with which they share a line.

``TABLES`` says the same in DuckDB's SQL, as common table expressions ``nodes`` and ``edges``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import EDGES, NODES, PropertyGraph, conform, schema, union
from graphloom.session import Folder, held, rows_of, table

LINE = 20  # characters that a shared line has at least
FEW = 50_000  # rows of a table that joins may broadcast


def _nation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.format_string("w.R%d.N%d", "n_regionkey", "n_nationkey").alias("module"), F.format_string("w/R%d/N%d.py", "n_regionkey", "n_nationkey").alias("file"))


def _root(segment: Column) -> Column:
    return F.when(segment == "MACHINERY", "tests").when(segment == "HOUSEHOLD", "docs").otherwise("core")


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return c.join(F.broadcast(_nation(spark, sf)), c.c_nationkey == F.col("n_nationkey")).select(F.col("c_custkey").alias("custkey"), F.concat("module", F.when(F.col("c_custkey") % 50 == 0, ".Log").otherwise(".C"), F.col("c_custkey").cast("string")).alias("class_id"), "module", "file", F.col("c_mktsegment").alias("segment"))


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.join(F.broadcast(_nation(spark, sf)), s.s_nationkey == F.col("n_nationkey")).select("s_suppkey", "s_acctbal", "s_nationkey", "module", "file", F.concat("module", F.lit(".S"), F.col("s_suppkey").cast("string")).alias("class_id"))


def _library(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a module, with its dozen."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(key.alias("k"), F.format_string("w.L%d.M%d", key % 7, key).alias("module"), F.floor(key / 12).alias("dozen"))


def _touching(spark: SparkSession, sf: str) -> DataFrame:
    """``(source, key, writes)`` of the orders that touch a column."""
    o, key = _orders(spark, sf), F.col("o_orderkey")
    return o.where(key % 8 == 0).select(F.col("id").alias("source"), F.lit("status").alias("key"), F.lit(True).alias("writes")).union(o.where(key % 12 == 0).select("id", F.lit("priority"), F.lit(False)))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every order with its function's id and place in the nation's file. Spark would broadcast a million orders, as a few columns of their file look small."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = _customers(spark, sf)
    rows = o.join(c.hint("merge") if rows_of(spark, sf, "customer") > FEW else F.broadcast(c), o.o_custkey == F.col("custkey"))
    return rows.withColumn("id", F.concat("class_id", F.lit(".O"), F.col("o_orderkey").cast("string")))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    def make(df: DataFrame, node: Column, kind: str, root: Column | str = "core", **more: Column) -> DataFrame:
        fields = {k: v for k, v in more.items() if k in schema(NODES).fieldNames()}
        extras = {"root": root if isinstance(root, Column) else F.lit(root)} | {k: v for k, v in more.items() if k not in fields}
        return conform(df.select(node.alias("id"), F.lit(kind).alias("kind"), *[v.alias(k) for k, v in fields.items()], F.struct(*[v.alias(k) for k, v in extras.items()]).alias("extras")), NODES)

    col = F.col
    nation = _nation(spark, sf)
    orders = _orders(spark, sf)
    place = F.row_number().over(Window.partitionBy("file").orderBy("o_orderkey"))
    located = orders.withColumn("line", (place * 10).cast("int"))
    level = F.substring("o_orderpriority", 1, 1)
    events = table(spark, sf, "events")
    keyed = events.select(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("key"), (col("event_type") != "signup").alias("subscript")).where("key is not null")
    keyed = keyed.union(_touching(spark, sf).select("key", F.lit(True)))
    parts = [
        make(table(spark, sf, "region").limit(1), F.lit("w"), "module", file=F.lit("w/__init__.py"), lineno=F.lit(1)),
        make(table(spark, sf, "region"), F.format_string("w.R%d", "r_regionkey"), "module", file=F.format_string("w/R%d/__init__.py", "r_regionkey"), lineno=F.lit(1)),
        make(nation, col("module"), "module", file=col("file"), lineno=F.lit(1)),
        make(_library(spark, sf), col("module"), "module"),
        make(table(spark, sf, "part").select("p_type").distinct(), F.concat(F.lit("proto."), col("p_type")), "class"),
        make(_customers(spark, sf), col("class_id"), "class", _root(col("segment"))),
        make(_suppliers(spark, sf), col("class_id"), "class", file=col("file")),
        make(
            located,
            col("id"),
            "function",
            _root(col("segment")),
            file=col("file"),
            lineno=col("line"),
            endlineno=(col("line") + 5 + col("o_orderkey") % 10).cast("int"),
            visibility=F.when(col("o_orderstatus") == "F", "private").otherwise("public"),
            signature=F.concat(F.lit("O"), col("o_orderkey").cast("string"), F.lit("(customer: Seg_"), col("segment"), F.lit(") -> Optional[Prio_"), level, F.lit("]")),
            decorators=F.array(F.concat(F.lit("prio."), col("o_orderpriority"))),
            docstring=F.concat(F.lit("Order of status "), col("o_orderstatus")),
            params=F.array(F.struct(F.lit("customer").alias("name"), F.concat(F.lit("List[Seg_"), col("segment"), F.lit("]")).alias("type"))),
            returns=F.concat(F.lit("Optional[Prio_"), level, F.lit("]")),
        ),
        make(table(spark, sf, "part").where("p_size <= 40"), F.concat(F.lit("reg.P"), col("p_partkey").cast("string")), "class", registry=F.struct(F.concat(F.lit("register_"), F.lower("p_type")).alias("decorator"), col("p_brand").alias("key"))),
        make(events.select("user_id").distinct(), F.concat(F.lit("ev.U"), col("user_id").cast("string")), "function", visibility=F.when(col("user_id") % 2 == 1, "private").otherwise("public")),
        make(keyed.groupBy("key").agg(F.bool_or("subscript").alias("subscript")), F.concat(F.lit("column:"), col("key")), "column", key=col("key"), subscripted=col("subscript")),
        make(_doc_references(spark, sf).select("source").distinct(), col("source"), "doc", "docs"),
    ]
    return union(parts)


def _doc_references(spark: SparkSession, sf: str) -> DataFrame:
    def lines(name: str, key: str) -> DataFrame:
        return table(spark, sf, name).select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= LINE)

    return lines("documents", "doc_id").join(lines("benchmark", "item_id").distinct(), "line").select(F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.concat(F.lit("bench.I"), F.col("item_id").cast("string")).alias("target")).distinct()


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", F.col("l_quantity").cast("int").alias("quantity"), "l_returnflag", (F.col("l_discount") == 0).alias("free"))
    following = F.lead("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber"))
    pairs = lines.withColumn("next", following).where("next is not null and next <> l_orderkey").drop("l_partkey", "l_linenumber", "l_shipdate")
    # By order: grouped and joined with the orders in one place. Few lines of an order share the next one, so nothing is combined before.
    rows = pairs.repartition("l_orderkey").groupBy("l_orderkey", "next").agg(F.count("*").alias("callsites"), F.array_sort(F.collect_set("quantity")).alias("posargs"), F.array_sort(F.collect_set("l_returnflag")).alias("kwargs"), F.bool_or("free").alias("splat"))
    orders = _orders(spark, sf).select("o_orderkey", "id")
    orders = orders.hint("merge") if rows_of(spark, sf, "orders") > FEW else orders
    ids = rows.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("id").alias("source")), "l_orderkey").join(orders.select(F.col("o_orderkey").alias("next"), F.col("id").alias("target")), "next")
    return ids.select(F.lit("calls").alias("type"), "source", "target", F.struct(F.when(F.col("splat"), "module").otherwise("imported").alias("resolution"), "callsites", "posargs", "kwargs", "splat").alias("extras"))


def _imports(spark: SparkSession, sf: str) -> DataFrame:
    sold = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    placed = lambda df, name: df.hint("merge") if rows_of(spark, sf, name) > FEW else df
    bought = sold.join(placed(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "orders"), sold.l_orderkey == F.col("o_orderkey"))
    bought = bought.join(placed(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "customer"), F.col("o_custkey") == F.col("c_custkey"))
    bought = bought.join(placed(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = bought.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").count()
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("count"), "c_nationkey"))).where("k <= 2")
    nation = _nation(spark, sf)
    own = top.join(F.broadcast(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("module").alias("source"))), "s_nationkey")
    return own.join(F.broadcast(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("module").alias("target"))), "c_nationkey").select(F.lit("imports").alias("type"), "source", "target").union(_part_imports(spark, sf))


def _part_imports(spark: SparkSession, sf: str) -> DataFrame:
    parts = _library(spark, sf)
    dozen = Window.partitionBy("dozen").orderBy("k")
    ring = parts.select(F.col("module").alias("source"), F.coalesce(F.lead("module").over(dozen), F.first("module").over(dozen)).alias("target")).where("source <> target")
    ahead = parts.select(F.col("module").alias("source"), (F.col("k") + 13).alias("k"), "dozen").where("dozen % 4 = 0").drop("dozen").join(parts.select("k", F.col("module").alias("target")), "k").select("source", "target")
    return ring.union(ahead).select(F.lit("imports").alias("type"), "source", "target")


def _by_type(spark: SparkSession, sf: str) -> dict[str, Callable[[], DataFrame]]:
    col, lit = F.col, F.lit

    def make(df: DataFrame, kind: str, source: Column, target: Column, **extras: Column) -> DataFrame:
        more = [F.struct(*[v.alias(k) for k, v in extras.items()]).alias("extras")] if extras else []
        return conform(df.select(lit(kind).alias("type"), source.alias("source"), target.alias("target"), *more), EDGES)

    def contains() -> DataFrame:
        return union([
            make(table(spark, sf, "region"), "contains", lit("w"), F.format_string("w.R%d", "r_regionkey")),
            make(_nation(spark, sf), "contains", F.substring_index("module", ".", 2), col("module")),
            make(_customers(spark, sf), "contains", col("module"), col("class_id")),
            make(_suppliers(spark, sf), "contains", col("module"), col("class_id")),
            make(_orders(spark, sf), "contains", col("class_id"), col("id")),
        ])

    def touches(kind: str) -> DataFrame:
        own = table(spark, sf, "events").withColumn("key", F.get_json_object("props", "$.k")).where("key is not null").where(col("event_type").isin("purchase", "signup") == (kind == "writes"))
        orders = _touching(spark, sf).where(col("writes") == (kind == "writes")).select("source", F.concat(lit("column:"), "key").alias("target"), lit("subscript").alias("access"))
        used = own.select(F.concat(lit("ev.U"), col("user_id").cast("string")).alias("source"), F.concat(lit("column:k"), col("key")).alias("target"), F.when(col("event_type") == "signup", "dict-literal").otherwise("subscript").alias("access")).union(orders).distinct()
        return make(used, kind, col("source"), col("target"), resolution=lit("string-key"), access=col("access"))

    return {
        "contains": contains,
        "imports": lambda: conform(_imports(spark, sf), EDGES),
        "export": lambda: make(_suppliers(spark, sf), "export", col("module"), col("class_id"), **{"as": F.concat(lit("A"), col("s_suppkey").cast("string")), "public": col("s_acctbal") > 0}),
        "calls": lambda: conform(_calls(spark, sf), EDGES),
        "inherits": lambda: make(_customers(spark, sf), "inherits", col("class_id"), F.concat(lit("seg."), col("segment")), external=lit(True)),
        "decorated_by": lambda: make(_orders(spark, sf), "decorated_by", col("id"), F.concat(lit("prio."), col("o_orderpriority"))),
        "implements": lambda: make(table(spark, sf, "part"), "implements", F.concat(lit("reg.P"), col("p_partkey").cast("string")), F.concat(lit("proto."), col("p_type")), via=lit("registry")),
        "writes": lambda: touches("writes"),
        "reads": lambda: touches("reads"),
        "references": lambda: make(_doc_references(spark, sf), "references", col("source"), col("target"), resolution=lit("doc")),
    }


def project(spark: SparkSession, sf: str, keep: bool = False) -> PropertyGraph:
    """The graph over a folder of tables; types of edges that a query doesn't ask for aren't even planned. keep: nodes and each type of edges
    are stored as tables in the shared folder when they are first asked for, so that a projection is made once for all questions."""
    sf = Folder(sf)
    kept = held if keep else lambda df: df
    return PropertyGraph("w", lambda: kept(_nodes(spark, sf)), by_type={k: lambda f=f: kept(f()) for k, f in _by_type(spark, sf).items()})


TABLES = f"""
nat AS (SELECT n_nationkey, printf('w.R%d.N%d', n_regionkey, n_nationkey) AS module, printf('w/R%d/N%d.py', n_regionkey, n_nationkey) AS file, n_regionkey FROM nation),
cus AS (SELECT c_custkey, module || CASE WHEN c_custkey % 50 = 0 THEN '.Log' ELSE '.C' END || c_custkey AS class_id, module, file, c_mktsegment AS segment,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'tests' WHEN 'HOUSEHOLD' THEN 'docs' ELSE 'core' END AS root FROM customer JOIN nat ON c_nationkey = n_nationkey),
sup AS (SELECT s_suppkey, s_acctbal, module, file, module || '.S' || s_suppkey AS class_id FROM supplier JOIN nat ON s_nationkey = n_nationkey),
ord AS MATERIALIZED (SELECT o_orderkey, class_id || '.O' || o_orderkey AS id, class_id, file, segment, root, o_orderstatus, o_orderpriority,
  (10 * row_number() OVER (PARTITION BY file ORDER BY o_orderkey))::INT AS line FROM orders JOIN cus ON o_custkey = c_custkey),
lib AS (SELECT p_partkey AS k, printf('w.L%d.M%d', p_partkey % 7, p_partkey) AS module, p_partkey // 12 AS dozen FROM part),
evk AS (SELECT 'ev.U' || user_id AS source, 'column:k' || json_extract_string(props, '$.k') AS target, event_type IN ('purchase', 'signup') AS writes, event_type <> 'signup' AS subscript FROM events
  UNION ALL SELECT id, 'column:status', true, true FROM ord WHERE o_orderkey % 8 = 0 UNION ALL SELECT id, 'column:priority', false, true FROM ord WHERE o_orderkey % 12 = 0),
dref AS MATERIALIZED (SELECT DISTINCT 'docs/d' || doc_id || '.md' AS source, 'bench.I' || item_id AS target
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) JOIN (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) USING (line) WHERE length(line) >= {LINE}),
nodes AS MATERIALIZED (
  SELECT 'w' AS id, 'module' AS kind, 'core' AS root, 'w/__init__.py' AS file, 1 AS lineno, NULL::INT AS endlineno, 'public' AS visibility, NULL AS signature, NULL AS docstring, NULL AS param, NULL AS returns, NULL AS reg_decorator, NULL AS reg_key, NULL AS key, NULL::BOOLEAN AS subscripted
  UNION ALL SELECT printf('w.R%d', r_regionkey), 'module', 'core', printf('w/R%d/__init__.py', r_regionkey), 1, NULL, 'public', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region
  UNION ALL SELECT module, 'module', 'core', file, 1, NULL, 'public', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nat
  UNION ALL SELECT module, 'module', 'core', NULL, NULL, NULL, 'public', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lib
  UNION ALL SELECT DISTINCT 'proto.' || p_type, 'class', 'core', NULL, NULL, NULL, 'public', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT class_id, 'class', root, NULL, NULL, NULL, 'public', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cus
  UNION ALL SELECT class_id, 'class', 'core', file, NULL, NULL, 'public', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sup
  UNION ALL SELECT id, 'function', root, file, line, (line + 5 + o_orderkey % 10)::INT, CASE WHEN o_orderstatus = 'F' THEN 'private' ELSE 'public' END,
    'O' || o_orderkey || '(customer: Seg_' || segment || ') -> Optional[Prio_' || o_orderpriority[1] || ']', 'Order of status ' || o_orderstatus, 'List[Seg_' || segment || ']', 'Optional[Prio_' || o_orderpriority[1] || ']', NULL, NULL, NULL, NULL FROM ord
  UNION ALL SELECT 'reg.P' || p_partkey, 'class', 'core', NULL, NULL, NULL, 'public', NULL, NULL, NULL, NULL, 'register_' || lower(p_type), p_brand, NULL, NULL FROM part WHERE p_size <= 40
  UNION ALL SELECT DISTINCT 'ev.U' || user_id, 'function', 'core', NULL, NULL, NULL, CASE WHEN user_id % 2 = 1 THEN 'private' ELSE 'public' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events
  UNION ALL SELECT target, 'column', 'core', NULL, NULL, NULL, 'public', NULL, NULL, NULL, NULL, NULL, NULL, target[8:], bool_or(subscript) FROM evk GROUP BY target
  UNION ALL SELECT DISTINCT source, 'doc', 'docs', NULL, NULL, NULL, 'public', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dref),
nxt AS (SELECT *, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS next FROM lineitem),
cal AS (SELECT l_orderkey, next, count(*) AS callsites, list_sort(list(DISTINCT l_quantity::INT)) AS posargs, list_sort(list(DISTINCT l_returnflag)) AS kwargs, bool_or(l_discount = 0) AS splat
  FROM nxt WHERE next IS NOT NULL AND next <> l_orderkey GROUP BY ALL),
trade AS (SELECT s_nationkey, c_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, c_nationkey) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey),
calls AS MATERIALIZED (SELECT a.id AS source, b.id AS target, callsites, posargs, kwargs, splat, CASE WHEN splat THEN 'module' ELSE 'imported' END AS resolution FROM cal JOIN ord a ON a.o_orderkey = l_orderkey JOIN ord b ON b.o_orderkey = next),
imports AS (SELECT a.module AS source, b.module AS target FROM trade JOIN nat a ON a.n_nationkey = s_nationkey JOIN nat b ON b.n_nationkey = c_nationkey WHERE k <= 2
  UNION ALL SELECT * FROM (SELECT module AS source, coalesce(lead(module) OVER d, first_value(module) OVER d) AS target FROM lib WINDOW d AS (PARTITION BY dozen ORDER BY k)) WHERE source <> target
  UNION ALL SELECT a.module, b.module FROM lib a JOIN lib b ON b.k = a.k + 13 WHERE a.dozen % 4 = 0),
edges AS MATERIALIZED (
  SELECT 'contains' AS type, 'w' AS source, printf('w.R%d', r_regionkey) AS target FROM region
  UNION ALL SELECT 'contains', printf('w.R%d', n_regionkey), module FROM nat
  UNION ALL SELECT 'contains', module, class_id FROM cus
  UNION ALL SELECT 'contains', module, class_id FROM sup
  UNION ALL SELECT 'contains', class_id, id FROM ord
  UNION ALL SELECT 'imports', source, target FROM imports
  UNION ALL SELECT 'export', module, class_id FROM sup
  UNION ALL SELECT 'calls', source, target FROM calls
  UNION ALL SELECT 'inherits', class_id, 'seg.' || segment FROM cus
  UNION ALL SELECT 'decorated_by', id, 'prio.' || o_orderpriority FROM ord
  UNION ALL SELECT 'implements', 'reg.P' || p_partkey, 'proto.' || p_type FROM part
  UNION ALL SELECT CASE WHEN writes THEN 'writes' ELSE 'reads' END, source, target FROM (SELECT DISTINCT writes, subscript, source, target FROM evk)
  UNION ALL SELECT 'references', source, target FROM dref)
"""
