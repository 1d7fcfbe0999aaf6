"""Operator 13, conversation prefix trie by truncation peeling.

A node is a distinct sequence of first turns. Peeling starts at the deepest level: conversations
that end there are merged with the nodes that survive from the level below, equal sequences become
one node, its counts are final, its last turn is stripped, and what is left goes up one
level. So nodes are found and aggregated in one pass from the leaves to the root.

A sequence is a chain of digests, one per turn, each of the turn and the digest before it; the last
one names the node. Equal conversations are merged first. The end of a conversation that no
other sequence shares is a chain of nodes with one child each; it is written out at once, so a
round is needed only for each level that two different sequences share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm.repeats import stored

#: Name of the root, the sequence of no turns.
ROOT = b""
#: Bytes of a digest in a chain.
DIGEST = 16
#: Members of one piece of a list of conversations.
PIECE = 4096
#: Rows of work of one task, about, where the number of tasks follows the data.
TASK_ROWS = 500_000

NODE = "key binary, parent binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def conversation_turns(rows: DataFrame) -> DataFrame:
    """Columns conv_id, turns: each conversation as an array of (turn, digest, size), in order; 40 bytes a turn.

    Turns are ordered by ``turn``, null first, ties by digest. Null role or text is empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return (rows.filter("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"),
                    F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
                             F.octet_length(text).cast("long").alias("size")).alias("turn"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")))


def rebuilt(turns: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """``turns`` with shared beginnings: the first h turns of conversation c - c % ``every``, then its own after its first h.

    h = crc32(decimal c) % ``heads``.
    """
    c = F.col("conv_id")
    head = (turns.filter(c % every == 0)
            .select(c.alias("base"), F.slice("turns", 1, heads - 1).alias("head")) if heads > 1 else None)
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    if head is None:
        return turns
    own = turns.withColumns({"base": c - c % every, "h": h})
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(head, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def chains(turns: DataFrame) -> DataFrame:
    """Columns conv_id, keys, sizes: the chained digest and the bytes of text of each turn."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 512):
                batch = whole.slice(low, 512)
                lists = batch.column(1)
                flat = lists.flatten()
                digests, sizes = flat.field(1).to_pylist(), flat.field(2)
                counts = np.asarray(lists.value_lengths(), np.int64)
                keys, at = [], 0
                for n in counts.tolist():
                    key = ROOT
                    for digest in digests[at:at + n]:
                        key = hashlib.sha256(key + digest).digest()[:DIGEST]
                        keys.append(key)
                    at += n
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(keys, pa.binary())),
                     pa.ListArray.from_arrays(offsets, sizes)], names=["conv_id", "keys", "sizes"])

    return turns.select("conv_id", "turns").mapInArrow(kernel, "conv_id long, keys array<binary>, sizes array<long>")


def _last(keys: str):
    return F.when(F.size(keys) > 0, F.element_at(keys, -1)).otherwise(F.lit(bytearray(ROOT)))


def _cut_tails(batches: Iterator[pa.RecordBatch], nodes: bool) -> Iterator[pa.RecordBatch]:
    """Of distinct sequences (conv_id, n_convs, keys, sizes, private): the nodes of the last ``private`` turns, or what is left."""
    for whole in batches:
        for low in range(0, len(whole), 512):
            rows: list[tuple] = []
            for conv, count, keys, sizes, private in zip(*[c.to_pylist() for c in whole.slice(low, 512).columns]):
                n = len(keys)
                saved = np.cumsum(np.array(sizes[::-1], np.int64) * (count - 1))[::-1] if n else np.zeros(0, np.int64)
                shared = n - private
                if nodes:
                    rows += [(keys[d - 1], keys[d - 2] if d > 1 else ROOT, d, conv, count, int(d < n), 1, int(saved[d - 1]))
                             for d in range(shared + 1, n + 1)]
                else:
                    rows.append((shared, keys[:shared], sizes[:shared], conv, count, int(private > 0), int(private > 0),
                                 int(saved[shared]) if private else 0))
            schema = _NODE_SCHEMA if nodes else _OPEN_SCHEMA
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                             [pa.array([], f.type) for f in schema], schema=schema)


OPEN = "depth int, keys array<binary>, sizes array<long>, conv_id long, n_convs long, child long, leaves long, saved long"
_NODE_SCHEMA = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()),
                          *[(c, pa.int64()) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]])
_OPEN_SCHEMA = pa.schema([("depth", pa.int32()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())),
                          *[(c, pa.int64()) for c in ("conv_id", "n_convs", "child", "leaves", "saved")]])


def peeled(sequences: DataFrame) -> DataFrame:
    """The nodes (``NODE``) of the trie over conversations (conv_id, keys, sizes); the root is among them if there are any."""
    merged = stored(sequences.groupBy(_last("keys").alias("key")).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("keys").alias("keys"),
        F.first("sizes").alias("sizes")), "sequences")
    # turns at the end of a sequence whose node no other sequence passes
    passing = merged.select(F.explode("keys").alias("node"), "key").groupBy("node").agg(
        F.count("*").alias("n"), F.min("key").alias("key"))
    private = passing.filter("n = 1").groupBy("key").agg(F.count("*").cast("int").alias("private"))
    cut = stored(merged.join(private, "key", "left").select(
        "conv_id", "n_convs", "keys", "sizes", F.coalesce("private", F.lit(0)).alias("private")), "tails")
    found = [cut.filter("private > 0").mapInArrow(lambda b: _cut_tails(b, True), NODE)]
    waiting = stored(cut.mapInArrow(lambda b: _cut_tails(b, False), OPEN).sortWithinPartitions("depth"), "open")
    deepest = waiting.agg(F.max("depth")).first()[0]
    if deepest is None:
        return found[0]
    survivors = None
    for depth in range(deepest, -1, -1):
        here = waiting.filter(F.col("depth") == depth)
        if survivors is not None:
            here = here.unionByName(survivors)
        sums = [F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"),
                F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
        if depth:
            met = here.groupBy(F.element_at("keys", depth).alias("key")).agg(
                *sums, F.first("keys").alias("keys"), F.first("sizes").alias("sizes"))
            last, parent = F.element_at("sizes", depth), (F.element_at("keys", depth - 1) if depth > 1 else F.lit(bytearray(ROOT)))
        else:
            met = here.groupBy(F.lit(bytearray(ROOT)).alias("key")).agg(*sums)
            last, parent = F.lit(0), F.lit(None).cast("binary")
        met = stored(met.withColumns({
            "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long"),
            "saved_tokens": (F.col("saved") + (F.col("n_convs") - 1) * last).cast("long"), "parent": parent,
            "depth": F.lit(depth)}), f"level{depth}")
        found.append(met.select(*[c.split()[0] for c in NODE.split(", ")]))
        if depth:
            survivors = met.select(
                F.lit(depth - 1).alias("depth"), F.slice("keys", 1, depth - 1).alias("keys"), F.slice("sizes", 1, depth - 1).alias("sizes"),
                "conv_id", "n_convs", F.lit(1).cast("long").alias("child"), F.col("n_leaves").alias("leaves"),
                F.col("saved_tokens").alias("saved"))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def list_digests(members: DataFrame) -> DataFrame:
    """Columns key, ends_sha256: SHA-256 of each key's conv_ids in ascending order, comma-joined.

    Ids are joined to pieces in ranges of (key, conv_id), so those of a hot key are spread over
    tasks; the digest then streams over the pieces of a key.
    """
    tasks = max(1, -(-members.count() // TASK_ROWS))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == PIECE):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(c)
                if len(out) == 4096:
                    yield pieces(out)
                    out = []
        if ids:
            out.append((key, ids[0], ",".join(map(str, ids))))
        if out:
            yield pieces(out)

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))],
                                          names=["key", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            keys, digests = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if running is not None and k == key:
                    running.update(b",")
                else:
                    if running is not None:
                        keys.append(key)
                        digests.append(running.hexdigest())
                    key, running = k, hashlib.sha256()
                running.update(ids.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], names=["key", "ends_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])

    joined = (members.select("key", "conv_id").repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(join, "key binary, first long, ids string"))
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key.

    ``turns``: conv_id, turns, as ``conversation_turns`` gives them, one row per conversation; a
    conversation without turns is a member of the root alone. An empty table has no nodes.
    """
    sequences = stored(chains(turns), "chains")
    nodes = stored(peeled(sequences), "nodes")
    ends = list_digests(sequences.select(_last("keys").alias("key"), "conv_id"))
    root = nodes.filter("depth = 0").select("conv_id").first()
    if root is None:
        root = (None,)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # the root's children need no join, and are its hot key
    low = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root[0])).cast("long"))
    nodes = low.unionByName(nodes.filter("depth > 1").join(above, "parent"))
    return nodes.join(ends, "key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "key")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, with shared beginnings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(rebuilt(stored(conversation_turns(rows), "turns"))).drop("key")


PREFIX_TRIE_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
code AS MATERIALIZED (SELECT i, c FROM bits WHERE k = 8),
own AS MATERIALIZED (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
crc(conv_id, name, c) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM own
  UNION ALL SELECT conv_id, name[2:], xor(code.c, crc.c >> 8) FROM crc JOIN code ON code.i = xor(crc.c, ascii(name)) & 255 WHERE name <> ''),
heads AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE name = ''),
seqs AS MATERIALIZED (
  SELECT own.conv_id, coalesce(base.turns[1:h], []) || own.turns[h + 1:] AS turns
  FROM own JOIN heads ON heads.conv_id = own.conv_id LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 5),
prefixes AS MATERIALIZED (
  SELECT conv_id, d, sha256(CAST(to_json(turns[1:d]) AS VARCHAR)) AS key, len(turns) AS n, coalesce(strlen(turns[d].text), 0) AS size
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
  FROM prefixes GROUP BY d, key),
lines AS MATERIALIZED (
  SELECT n.key, n.d, n.saved, p.key AS above, p.d AS upper FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d),
parents AS (SELECT above AS key, upper AS d, count(*) AS n_children FROM lines WHERE upper = d - 1 GROUP BY 1, 2),
below AS (
  SELECT above AS key, upper AS d, sum(saved) AS saved_tokens, count(*) FILTER (p.key IS NULL) AS n_leaves
  FROM lines LEFT JOIN parents p ON p.key = lines.key AND p.d = lines.d GROUP BY 1, 2)
SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN below ON below.key = nodes.key AND below.d = nodes.d
LEFT JOIN parents ON parents.key = nodes.key AND parents.d = nodes.d
LEFT JOIN lines ON lines.key = nodes.key AND lines.d = nodes.d AND lines.upper = nodes.d - 1
LEFT JOIN nodes up ON up.key = lines.above AND up.d = lines.upper
"""
