"""How much queries shuffle, broadcast and send, on small graphs of awkward shape."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.model import EDGES, NODES, PropertyGraph, conform
from graphloom.operators import communities, lookup, neighbors, traverse
from graphloom.sinks import rag, symbols

DEEP, CALLERS = 40, 400


@pytest.fixture
def unbroadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def shuffled(spark, df) -> int:
    """The records that all stages wrote to shuffles while df was computed, and its rows."""

    def total():
        jvm = spark.sparkContext._jvm
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none).iterator()
        out = 0
        while stages.hasNext():
            out += stages.next().shuffleWriteRecords()
        return out

    before = total()
    df().count()
    return total() - before


def deep(spark):
    """A function under 40 nested nodes, called by 400 others, each of which is called by one."""
    up = [".".join(f"n{i}" for i in range(k)) for k in range(1, DEEP + 1)]
    far = [f"u.c{i}" for i in range(CALLERS)], [f"v.d{i}" for i in range(CALLERS)]
    nodes = spark.createDataFrame([(i,) for i in [*up, *far[0], *far[1]]], "id string").withColumn("kind", F.lit("function"))
    edges = spark.createDataFrame([("calls", a, up[-1]) for a in far[0]] + list(zip(["calls"] * CALLERS, far[1], far[0])), "type string, source string, target string")
    return PropertyGraph("n0", conform(nodes, NODES).cache(), conform(edges, EDGES).cache())


def test_impact_shuffles_no_row_for_each_symbol(unbroadcast):
    """16,000 rows of each distance go to the 40 nested nodes, and 400 to the callers."""
    g = deep(unbroadcast)
    assert traverse.impact(g, depth=2).count() == 2 * DEEP * CALLERS + CALLERS
    assert shuffled(unbroadcast, lambda: traverse.impact(g, depth=2)) < DEEP * CALLERS


def test_counts_of_impact_are_those_of_its_rows(spark):
    g = deep(spark)
    for depth, count in ((2, traverse.impact_by_root), (2, traverse.impact_summary), (3, traverse.impact_by_distance)):
        assert sorted(traverse.impact_counted(g, depth, count).collect()) == sorted(count(traverse.impact(g, depth=depth)).collect())


def test_large_stored_tables_are_not_broadcast(spark):
    """A few columns of a wide, compressed table look small to Spark, which would send millions of calls through the driver."""
    from graphloom.session import held

    df = spark.range(1000).select("id", F.lit("same").alias("text"))
    for rows, broadcast in ((100, False), (1000, True)):
        joined = spark.range(5000).join(held(df, rows).select("id").distinct(), "id")
        assert joined.count() == 1000
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == broadcast


def test_flow_does_not_broadcast_calls(spark):
    from graphloom.session import held

    calls = spark.range(300_000).select(F.lit("calls").alias("type"), F.format_string("u.f%d", "id").alias("source"), F.format_string("u.f%d", F.col("id") + 1).alias("target"))
    g = PropertyGraph("u", conform(spark.createDataFrame([("u", "module")], "id string, kind string"), NODES), by_type={"calls": lambda: held(conform(calls, EDGES))})
    flow = traverse.flow(g, max_depth=2)
    assert "BroadcastHashJoin source" not in flow._jdf.queryExecution().executedPlan().toString() and flow.count() == 2
    assert "Join Inner, (source" in flow._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in flow._jdf.queryExecution().optimizedPlan().toString()


def test_sibling_families_lose_no_pair(spark):
    """Classes of one, of several and of overlapping protocols; 300 of one family are 300 rows, not 90,000 pairs."""
    own = {f"k.c{i}": ("P",) for i in range(300)} | {"k.a": ("P", "Q"), "k.b": ("Q", "R"), "k.d": ("P", "Q"), "k.e": ("S",), "k.f": ("R", "P")}
    edges = spark.createDataFrame([("implements", c, p) for c, ps in own.items() for p in ps] * 2, "type string, source string, target string")
    g = PropertyGraph("k", conform(spark.createDataFrame([("k", "module")], "id string, kind string"), NODES), conform(edges, EDGES))
    want = {c: (sorted(ps), sum(bool({*ps} & {*o}) for o in own.values()) - 1) for c, ps in own.items()}
    assert {r["class"]: (r["family"], r["n_siblings"]) for r in neighbors.sibling_families(g).collect()} == want


def test_calls_are_grouped_where_their_orders_are(unbroadcast):
    """Grouping by order and next order apart from the join with orders would shuffle every line once more."""
    from graphloom.plans import projection

    plan = projection._calls(unbroadcast, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", next#" not in "".join(line for line in plan.splitlines() if "hashpartitioning(l_orderkey" in line)


def test_call_contract_shuffles_no_row_for_each_symbol(unbroadcast):
    g = deep(unbroadcast)
    sites = F.struct(F.lit(1).cast("bigint").alias("callsites"))
    g = PropertyGraph("n0", g.nodes, conform(g.edges.drop("extras").withColumn("extras", sites), EDGES))
    assert neighbors.call_contract(g).count() == DEEP * CALLERS + CALLERS
    assert shuffled(unbroadcast, lambda: neighbors.call_contract(g)) < DEEP * CALLERS


def test_class_outward_calls_shuffle_no_row_for_each_prefix(unbroadcast):
    """Functions nested 30 deep in one class: their calls meet the classes above, not every prefix of an id."""
    at = ".".join(f"m{i}" for i in range(30))
    ids = [("m0", "module"), (f"{at}.K", "class")] + [(f"{at}.K.f{i}", "function") for i in range(200)]
    nodes = unbroadcast.createDataFrame(ids, "id string, kind string")
    edges = unbroadcast.createDataFrame([("calls", f"{at}.K.f{i}", f"x.y{i}") for i in range(200)] * 2, "type string, source string, target string")
    g = PropertyGraph("m0", conform(nodes, NODES).cache(), conform(edges, EDGES).cache())
    assert sorted(neighbors.class_outward_calls(g).collect()) == sorted((f"{at}.K", f"x.y{i}", f"{at}.K.f{i}") for i in range(200))
    assert shuffled(unbroadcast, lambda: neighbors.class_outward_calls(g)) < 200 * 10


def sent(spark, df) -> int:
    """The bytes that all stages sent to the driver while df was computed, broadcast tables among them."""

    def total():
        jvm = spark.sparkContext._jvm
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none).iterator()
        out = 0
        while stages.hasNext():
            out += stages.next().resultSize()
        return out

    before = total()
    df().count()
    return total() - before


def test_members_and_descriptors_shuffle_no_row_for_each_prefix(unbroadcast):
    """200 functions nested 40 deep: what is above them is found once, not for each."""
    at = [".".join(f"m{i}" for i in range(k)) for k in range(1, DEEP + 1)]
    nodes = unbroadcast.createDataFrame([(a, "module") for a in at] + [(f"{at[-1]}.f{i}", "function") for i in range(200)], "id string, kind string")
    g = PropertyGraph("m0", conform(nodes, NODES).cache(), conform(unbroadcast.createDataFrame([], "type string, source string, target string"), EDGES))
    assert lookup.members(g).count() == DEEP * (DEEP + 1) // 2 + 200 * (DEEP + 1)
    assert shuffled(unbroadcast, lambda: lookup.members(g)) < 5000
    assert {r.id: r.descriptor for r in symbols.descriptors(g).collect()}[f"{at[-1]}.f7"] == at[-1].replace(".", "/") + "/f7()."
    assert shuffled(unbroadcast, lambda: symbols.descriptors(g)) < 5000


def test_resolution_shuffles_no_row_for_each_candidate(unbroadcast):
    """100 requests for one name of 300 ids: repeated ids and equal scores included, as before."""
    ids = [f"p{i % 7}.q{i:03}.f" for i in range(300)] + ["p1.q001.f"]
    g = PropertyGraph("p", conform(unbroadcast.createDataFrame([(i, "function") for i in ids], "id string, kind string"), NODES).cache(), conform(unbroadcast.createDataFrame([], "type string, source string, target string"), EDGES))
    asked = unbroadcast.createDataFrame([(f"p{i % 7}.z{i}.f",) for i in range(100)], "input string").cache()
    got = {r.input: r for r in lookup.resolve(g, asked).collect()}
    for r in asked.collect():
        near = [i for i in ids if i.split(".")[0] == r.input.split(".")[0]]
        best = min(near, key=lambda i: (len(i), i))
        rest = sorted(ids)
        rest.remove(best)
        assert (got[r.input].id, got[r.input].ambiguous, got[r.input].alternatives) == (best, len(near) > 1, rest)
    assert shuffled(unbroadcast, lambda: lookup.resolve(g, asked)) < 5000


def test_import_cycles_send_no_arcs_to_the_driver(spark):
    """12,000 rings of two modules: each level's joins would broadcast them all."""
    n = F.format_string("m%05d", "id")
    rings = spark.range(12_000).select(F.lit("imports").alias("type"), F.concat(F.lit("a."), n).alias("source"), F.concat(F.lit("b."), n).alias("target"))
    edges = conform(rings.union(rings.select("type", "target", "source")), EDGES).cache()
    g = PropertyGraph("a", conform(spark.createDataFrame([("a", "module")], "id string, kind string"), NODES), edges)
    assert traverse.import_cycles(g).count() == 12_000
    assert sent(spark, lambda: traverse.import_cycles(g)) < 2_000_000


def test_communities_go_by_component(spark):
    """The groups of all components together are those of each, for the number of imports of all."""
    rng = random.Random(5)
    pairs = {(f"k.c{c}.m{min(a, b)}", f"k.c{c}.m{max(a, b)}") for c in range(12) for a, b in (rng.sample(range(9), 2) for _ in range(14))}
    parts = [communities.greedy_modularity([], [p for p in pairs if f".c{c}." in p[0]], len(pairs)) for c in range(12)]
    whole = communities.greedy_modularity([], list(pairs))
    assert sorted(g for part in parts for g in part) == sorted(whole)
    ids = sorted({m for p in pairs for m in p} | {"k.alone"})
    nodes = spark.createDataFrame([(i, "module") for i in ids], "id string, kind string")
    g = PropertyGraph("k", conform(nodes, NODES), conform(spark.createDataFrame([("imports", *p) for p in pairs], "type string, source string, target string"), EDGES))
    assert sorted(r.modules for r in communities.communities(g).collect()) == sorted([*whole, ["k.alone"]])


def test_members_of_asked_symbols_shuffle_no_row_for_each_prefix(unbroadcast):
    """Of 200 functions nested 40 deep, those under one symbol; a symbol that is no node has no members."""
    at = [".".join(f"m{i}" for i in range(k)) for k in range(1, DEEP + 1)]
    nodes = unbroadcast.createDataFrame([(a, "module") for a in at] + [(f"{at[-1]}.f{i}", "function") for i in range(200)], "id string, kind string")
    g = PropertyGraph("m0", conform(nodes, NODES).cache(), conform(unbroadcast.createDataFrame([], "type string, source string, target string"), EDGES))
    asked = unbroadcast.createDataFrame([(at[-1],), (f"{at[-1]}.f3",), ("m0.gone",), (at[-1],)], "symbol string")
    want = sorted([(at[-1], at[-1]), (f"{at[-1]}.f3", f"{at[-1]}.f3"), *((f"{at[-1]}.f{i}", at[-1]) for i in range(200))])
    assert sorted(tuple(r) for r in neighbors.members_of(g, asked).collect()) == want
    assert shuffled(unbroadcast, lambda: neighbors.members_of(g, asked)) < 3000


def test_chunks_shuffle_each_call_once_for_each_end(unbroadcast):
    """Calls that repeat are listed once; each is shuffled by its source, by its target and to the classes above, but not to drop repetitions first."""
    n, name = 2000, lambda c: F.concat(F.lit("k.f"), F.format_string("%04d", c))
    ids = unbroadcast.range(n).select(name(F.col("id")).alias("id"), F.lit("function").alias("kind"))
    calls = unbroadcast.range(3 * n).select(F.lit("calls").alias("type"), name(F.col("id") % n).alias("source"), name((F.col("id") * 7 + 1) % n).alias("target"))
    g = PropertyGraph("k", conform(ids, NODES).cache(), conform(calls, EDGES).cache())
    assert {tuple(r.calls) for r in rag.chunks(g).select("calls").collect()} == {(f"k.f{(i * 7 + 1) % n:04d}",) for i in range(n)}
    assert shuffled(unbroadcast, lambda: rag.chunks(g).select("id", "calls", "called_by")) < 2 * 3 * n + 2 * n


def test_flow_shuffles_no_call_for_each_level(unbroadcast):
    """Few entries: each level reads the calls where they are; only finding the entries shuffles their ends."""
    n, name = 3000, lambda c: F.concat(F.lit("u.f"), F.format_string("%04d", c))
    calls = unbroadcast.range(n).select(F.lit("calls").alias("type"), name(F.col("id")).alias("source"), name(F.col("id") + 1).alias("target"))
    g = PropertyGraph("u", conform(unbroadcast.createDataFrame([("u", "module")], "id string, kind string"), NODES).cache(), conform(calls, EDGES).cache())
    flow = traverse.flow(g, max_depth=5).collect()
    assert sorted(tuple(r) for r in flow) == [("u.f0000", f"u.f{i:04}", f"u.f{i + 1:04}", i + 1) for i in range(5)]
    assert shuffled(unbroadcast, lambda: traverse.flow(g, max_depth=5)) < 3 * n


def test_orders_are_not_broadcast(spark, monkeypatch):
    """A few columns of the orders' file look small to Spark; beyond so many customers, orders and customers merge."""
    from graphloom.plans import projection

    shown = lambda: projection._orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in shown() and "BuildLeft" not in shown()
    monkeypatch.setattr(projection, "FEW", 10)
    assert "SortMergeJoin [o_custkey" in shown()


def test_files_are_parsed_by_all_cores(spark):
    """40 files of one partition, and as many texts: each pass over them is spread; files of a folder are placed when they are listed."""
    from graphloom.extract import build

    made = spark.range(40).coalesce(1).select(F.format_string("k/m%02d.py", "id").alias("path"), F.format_string("def f%d(): ...\n", "id").alias("text"))
    at = build._facts(made, build._core_worker).where("fact = 'node'").select(F.spark_partition_id().alias("p"), "id").collect()
    assert len(at) == 80 and len({r.p for r in at}) > 8
    assert build.spread(made).rdd.getNumPartitions() == 12
    read = build.sources(spark, str(__import__("pathlib").Path(build.__file__).parent), "*.py")
    assert build.spread(read) is read


def test_edges_are_counted_without_being_stored(spark, monkeypatch):
    """Counting them takes neither what calls carry nor the ids of their ends."""
    from graphloom import catalog
    from graphloom.plans import projection

    monkeypatch.setattr(projection, "held", None)
    plan = catalog.QUERIES["graph_stats_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "l_quantity" not in plan and "l_returnflag" not in plan
