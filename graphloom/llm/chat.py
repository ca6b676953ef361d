"""Chat formatting as a prefix tree.

Conversations that begin with the same turns (role and text) share them: a node of the tree is a turn together with all turns before
it. The tree is emitted once, depth-first: conversations are put in the order of their paths of node hashes, so that those with a common
beginning stand together, and a conversation adds the nodes that the one before it doesn't have. Every node carries

* ``tokens``: start token, role and text by the tokenizer, end token; shared tokens occur once;
* ``start``: the place of its first token in its tree's stream, and ``position``, the position id of that token (the tokens of its
  ancestors); both count up within the node;
* ``ancestors``: the intervals of the stream that its tokens attend to beside the node itself up to their own place;
* ``attended_until``: tokens at places from the node's up to this one are its descendants, so that a mask by keys needs one number.

Two shuffles carry the texts: one brings a conversation's turns together, one orders the conversations. A range of that order is walked
with a stack, as if nothing came before it: places count from the range's own beginning of a tree, and the first path is emitted as a whole. What
ranges share is only the path between two neighbours: the driver reads the first and the last path of every range, without texts, and
works out which nodes of a first path an earlier range has, where they stand there, and by how much the range's places in that tree move. Two
small tables of that (a row a range, and a row a shared node) are joined to the stored nodes. So nothing is gathered by tree: one opening
turn shared by all conversations is no bottleneck, and a task holds one conversation and one path.

Defined results: null roles and texts are empty ones; rows without conv_id or turn are ignored; turns are ordered by turn, then role and
text; turns that repeat in all columns count once; conversations that are the same, or a beginning of another, add no nodes and
are counted in ``n_conversations``, and the one with the smallest conv_id of the first that has a node is named; an empty table gives none; a
very long turn or conversation is one row of a task, and takes time in proportion to its length; other columns are ignored.
"""

from __future__ import annotations

import base64
import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import stored

#: How texts are cut before pairs are merged: the published pattern of the byte-pair vocabularies that these files hold.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, END = 50257, 50258
BATCH = 1 << 20  # tokens
NODE = (
    "range int, tree binary, node binary, conv_id long, depth int, role string, n_conversations long, start long, n_tokens long, position long, "
    "ancestors array<struct<start:bigint,end:bigint>>, until long, first boolean, last boolean, tokens array<int>"
)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ordered(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, the hashes of its paths, and its turns; in ranges of the order of paths, each of them sorted."""
    rows = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("turn", "role", "text")))).alias("turns"))
    hashes = F.transform("turns", lambda t: F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])))
    empty = F.struct(F.lit("").alias("last"), F.expr("array()").cast("array<binary>").alias("ids"))

    def step(acc, h):
        node = F.md5(F.concat(acc["last"], h))
        return F.struct(node.alias("last"), F.array_append(acc["ids"], F.unhex(node)).alias("ids"))

    ids = F.aggregate(hashes, empty, step, lambda acc: acc["ids"])
    return own.select("conv_id", ids.alias("ids"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts")).repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")


@dataclasses.dataclass
class _Open:
    """A node of the path that is being walked."""

    node: bytes
    row: list
    seen: list[tuple[int, int]]  # intervals of the path up to and with the node
    conversations: int = 0
    until: int = 0


def _walk(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=vocabulary.value, special_tokens={})
        part = TaskContext.get().partitionId()
        path: list[_Open] = []
        rows: list[list] = []
        place, first = 0, True
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pair, pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int32())]
        names = [f.split()[0] for f in NODE.split(", ")]

        def leave(depth: int, last: bool) -> None:
            """The nodes from a depth on are complete."""
            while len(path) > depth:
                n = path.pop()
                rows.append([*n.row[:6], n.conversations, *n.row[6:10], n.until, n.row[10], last, n.row[11]])
                if path:
                    path[-1].conversations += n.conversations
                    path[-1].until = max(path[-1].until, n.until)

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
            rows.clear()
            return out

        size = 0
        for batch in batches:
            for conv, ids, roles, texts in zip(*[batch.column(c) for c in ("conv_id", "ids", "roles", "texts")]):
                ids = ids.as_py()
                if not ids:
                    continue
                shared = 0
                while shared < min(len(ids), len(path)) and path[shared].node == ids[shared]:
                    shared += 1
                leave(shared, False)
                if not shared:
                    place = 0
                for d in range(shared, len(ids)):
                    role = roles[d].as_py()
                    tokens = [START, *encoding.encode_ordinary(f"{role}\n{texts[d].as_py()}"), END]
                    above = path[-1].seen if path else []
                    position = path[-1].row[8] + path[-1].row[7] if path else 0
                    seen = [*above[:-1], (above[-1][0], place + len(tokens))] if above and above[-1][1] == place else [*above, (place, place + len(tokens))]
                    row = [part, ids[0], ids[d], conv.as_py(), d, role, place, len(tokens), position, [{"start": a, "end": b} for a, b in above], first, tokens]
                    place += len(tokens)
                    path.append(_Open(ids[d], row, seen, 0, place))
                    size += len(tokens)
                path[len(ids) - 1].conversations += 1
                first = False
                if size > BATCH:
                    yield made()
                    size = 0
        leave(0, True)
        yield made()

    return run


def _joints(paths: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """From the first and last paths of all ranges: (range, tree, shift, own, mapping) of each range whose first tree began before it, with the places
    below ``own`` given by the mapping [(start here, tokens, start in the tree)]; and (node, conversations, until) to add to nodes of earlier ranges."""
    ranges, more = [], {}
    by: dict[int, list[dict]] = {}
    for r in paths:
        by.setdefault(r["range"], []).append(r)
    before: list[tuple[bytes, int]] = []  # node and place of the last path so far
    total = 0  # tokens of its tree
    for part in sorted(by):
        head = sorted((r for r in by[part] if r["first"]), key=lambda r: r["depth"])
        last = sorted((r for r in by[part] if r["last"]), key=lambda r: r["depth"])
        k = 0
        while k < min(len(head), len(before)) and head[k]["node"] == before[k][0]:
            k += 1
        own = sum(r["n_tokens"] for r in head[:k])
        shift = total - own if k else 0
        if k:
            ranges.append((part, head[0]["tree"], shift, own, [(r["start"], r["n_tokens"], g) for r, (_, g) in zip(head[:k], before)], k))
            for r in head[:k]:
                n, until = more.get(r["node"], (0, 0))
                more[r["node"]] = n + r["n_conversations"], max(until, r["until"] + shift if r["until"] > own else 0)
        same = k and last[0]["tree"] == head[0]["tree"]
        moved = shift if same else 0
        total = last[0]["until"] + moved if not same or last[0]["until"] > own else total
        place = {n: g for n, g in before[:k]}
        before = [(r["node"], place[r["node"]] if same and r["node"] in place else r["start"] + moved) for r in last]
    return ranges, [(n, *x) for n, x in more.items()]


def prefix_tree(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """``(tree, node, conv_id, depth, role, n_conversations, start, n_tokens, position, ancestors, attended_until, tokens)``.

    tokenizer: the file of a byte-pair vocabulary, which the driver reads. tree and node are hashes; conv_id is the first
    conversation, in the order of emission, that has the node.
    """
    spark = conversations.sparkSession
    vocabulary = spark.sparkContext.broadcast(ranks(tokenizer))
    nodes = stored(_ordered(conversations).mapInArrow(_walk(vocabulary), NODE))
    edge = nodes.where("first or last").select("range", "tree", "node", "depth", "n_conversations", "start", "n_tokens", "until", "first", "last")
    ranges, more = _joints(edge.toArrow().to_pylist())
    moves = spark.createDataFrame(ranges, "range int, tree binary, shift long, own long, mapping array<struct<here:long,n:long,there:long>>, shared int")
    added = spark.createDataFrame(more, "node binary, more_conversations long, more_until long")
    rows = nodes.join(F.broadcast(moves), ["range", "tree"], "left").where("not (first and depth < coalesce(shared, 0))").join(F.broadcast(added), "node", "left")
    # An interval below ``own`` lies in nodes of earlier ranges, one above it is the range's own and moves.
    pieces = (
        "if(shift is null, ancestors, flatten(transform(ancestors, x -> concat("
        "transform(filter(mapping, m -> m.here < x.end and m.here + m.n > x.start), m -> struct(m.there as start, m.there + m.n as end)), "
        "if(x.end > own, array(struct(greatest(x.start, own) + shift as start, x.end + shift as end)), cast(array() as array<struct<start:bigint,end:bigint>>))))))"
    )
    kind = "array<struct<start:bigint,end:bigint>>"
    merged = (
        f"if(shift is null, ancestors, aggregate(pieces, cast(array() as {kind}), (acc, x) -> if(size(acc) > 0 and try_element_at(acc, -1).end = x.start, "
        "concat(slice(acc, 1, size(acc) - 1), array(struct(try_element_at(acc, -1).start as start, x.end as end))), concat(acc, array(x)))))"
    )
    shift = F.coalesce("shift", F.lit(0))
    return rows.withColumn("pieces", F.expr(pieces)).select(
        F.lower(F.hex("tree")).alias("tree"), F.lower(F.hex("node")).alias("node"), "conv_id", "depth", "role",
        (F.col("n_conversations") + F.coalesce("more_conversations", F.lit(0))).alias("n_conversations"), (F.col("start") + shift).alias("start"), "n_tokens", "position",
        F.expr(merged).alias("ancestors"), F.greatest(F.col("until") + shift, F.coalesce("more_until", F.lit(0))).alias("attended_until"), "tokens",
    )
