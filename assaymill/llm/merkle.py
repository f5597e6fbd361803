"""A Merkle manifest of a data set: one tree per source, one tree over the sources, a proof for every row.

Rows are numbered within their source, dealt in aligned blocks, and each block is a task's work by itself: its root
goes up, and the path from there to the root of all comes down again. Within a block, the authentication path of each
leaf follows from that of the leaf before it: for each level, a treehash takes one leaf a step, so that the run of
siblings that comes next is ready when it is needed. What is held is a run of nodes a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill.llm.common import BATCH_ROWS, pick, rows_of, table, written

#: Nodes that make one node of the next level.
FANOUT = 16
#: Levels of a block: FANOUT ** BLOCK_LEVELS leaves, or fewer at the end, are walked in one go.
BLOCK_LEVELS = 3
BLOCK = FANOUT**BLOCK_LEVELS

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Path = list[tuple[str, str]]
PATH = "array<struct<before:string,after:string>>"
ARROW_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(total: int) -> int:
    """Levels above the leaves of a tree, or of a block of a larger one."""
    levels = 0
    while total > 1 and levels < BLOCK_LEVELS:
        total, levels = -(-total // FANOUT), levels + 1
    return levels


class Treehash:
    """The nodes of one level, from leaves that are given one by one. Holds a run of nodes a level, at most."""

    def __init__(self, level: int):
        self.waiting: list[list[str]] = [[] for _ in range(level + 1)]

    def push(self, node: str, level: int = 0) -> None:
        run = self.waiting[level]
        run.append(node)
        if len(run) == FANOUT and level + 1 < len(self.waiting):
            self.waiting[level] = []
            self.push(digest("".join(run)), level + 1)

    def finish(self) -> list[str]:
        """The nodes, when no more leaves come: runs that aren't full are hashed as they are."""
        for level in range(len(self.waiting) - 1):
            run = self.waiting[level]
            if run:
                self.waiting[level] = []
                self.push(digest("".join(run)), level + 1)
        return self.waiting[-1]


def top_of(leaves: Iterable[str], levels: int) -> str:
    """The root of a block, ``levels`` above its leaves."""
    tree = Treehash(levels)
    for leaf in leaves:
        tree.push(leaf)
    (root,) = tree.finish()
    return root


def traverse(leaves: Sequence[str], levels: int) -> Iterator[Path]:
    """For each leaf, what stands before and after its ancestor in the run of each level, from below."""
    spans = [FANOUT ** (level + 1) for level in range(levels)]
    runs, coming = [], [Treehash(level) for level in range(levels)]
    for level, span in enumerate(spans):
        first = Treehash(level)
        for leaf in leaves[:span]:
            first.push(leaf)
        runs.append(first.finish())
    for i in range(len(leaves)):
        path = []
        for run, span in zip(runs, spans, strict=True):
            own = i % span // (span // FANOUT)
            path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        yield path
        for level, span in enumerate(spans):
            if i + span < len(leaves):
                coming[level].push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[level], coming[level] = coming[level].finish(), Treehash(level)


def fold(node: str, path: Path) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        node = digest(before + node + after)
    return node


def leaf_of(fields: list[Column]) -> Column:
    """The digest of fields: ``-`` for a null, else the UTF-8 byte count, a colon and the value."""

    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.when(field.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.unhex(F.sha2(F.concat(*map(part, fields)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """key (of the source: null first in order), doc_id, node and tampered (null where nothing is changed)."""
    rows = pick(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    fields = {f: F.col(f) for f in FIELDS}
    changed = F.translate("text", UPPER, LOWER)
    due = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").rlike("[A-Z]")
    tampered = F.when(due, leaf_of(list((fields | {"text": changed}).values())))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return rows.select(key.alias("key"), "doc_id", leaf_of(list(fields.values())).alias("node"), tampered.alias("tampered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with pos (from 0, within ``key`` by ``order``) and total (rows of the key).

    Rows are dealt by ranges of key and order, so a key of any size is spread; a range knows how many rows of its
    first key stand in ranges before it. Rows that are equal in all of ``order`` may be numbered either way.
    """
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    dealt = written(dealt.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    runs = dealt.groupBy("key", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("key", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    return dealt.join(runs, ["key", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def blocks_of(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[list[dict]]:
    """The rows of one key and block after another; a block has FANOUT ** BLOCK_LEVELS rows at most, and a header."""
    rows = (dict(zip(columns, r, strict=True)) for batch in batches for r in rows_of(batch, *columns))
    for _, block in groupby(rows, lambda r: (r["key"], r["block"])):
        yield list(block)


def in_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def roots(nodes: DataFrame) -> DataFrame:
    """key, node, pos and total one block higher: the root of each block of ``nodes``."""
    columns = ["key", "block", "pos", "total", "node"]
    schema = pa.schema([("key", pa.string()), ("node", pa.binary()), ("pos", pa.int64()), ("total", pa.int64())])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block in blocks_of(batches, columns):
                total = block[0]["total"]
                root = top_of((r["node"].hex() for r in block), height(total))
                yield block[0]["key"], bytes.fromhex(root), block[0]["block"], -(-total // BLOCK)

        return in_batches(rows(), schema)

    dealt = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).select(*columns)
    return by_block(dealt).mapInArrow(hashed, "key string, node binary, pos long, total long")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes that blocks are made of, and those of the blocks' roots, till each key has one. A few rounds: each
    has 4,096 times fewer rows than the one before."""
    rounds = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        rounds.append(written(roots(rounds[-1]), "merkle-roots"))
        most = -(-most // BLOCK)
        if most <= 1:
            return rounds


def descend(nodes: DataFrame, headers: DataFrame, carried: list[str], kinds: str, schema: pa.Schema,
            finish: Callable[[dict, Path, str | None], tuple]) -> DataFrame:
    """What ``finish`` makes of each row of ``nodes`` and its path to the root.

    headers: key, block, path and subroot of each block of ``nodes``: the siblings above it, that its rows share.
    """
    columns = ["key", "block", "pos", "total", "node", *carried]
    dealt = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).select(*columns)
    heads = headers.select("key", "block", F.lit(-1).cast("long").alias("pos"), "path", "subroot")
    dealt = dealt.unionByName(heads, allowMissingColumns=True)
    names = dealt.columns

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for head, *block in blocks_of(batches, names):
                above = [(p["before"], p["after"]) for p in head["path"]]
                paths = traverse([r["node"].hex() for r in block], height(block[0]["total"]))
                for row, path in zip(block, paths, strict=True):
                    yield finish(row, path + above, head["subroot"])

        return in_batches(rows(), schema)

    return by_block(dealt).mapInArrow(walked, kinds)


def paths_down(rounds: list[DataFrame], headers: DataFrame) -> DataFrame:
    """Headers of the blocks of the lowest round, from those of the highest."""
    kinds = f"key string, block long, path {PATH}, subroot string"
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("path", ARROW_PATH), ("subroot", pa.string())])

    def finish(row: dict, path: Path, subroot: str | None) -> tuple:
        return row["key"], row["pos"], [dict(zip(("before", "after"), p, strict=True)) for p in path], subroot

    for nodes in reversed(rounds[1:-1]):
        headers = descend(nodes, headers, [], kinds, schema, finish)
    return headers


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``
    (doc_id, source, lang, n_chars, text).

    A leaf is the digest of a row's fields, null ones as ``-``, empty ones as ``0:``. Leaves of a source stand by
    doc_id, null ones first, rows of one doc_id by their leaf; a null source is one of its own, before all others.
    Every 16 nodes of a level make one of the next, the last ones of a level as they are. Equal rows are leaves of
    their own. An empty table gives no rows; other columns are ignored. proof_sha256 is the digest of all siblings
    on the way to the root; folded_root is what they give for the row after tampering (A to Z of the text
    lower-cased where 5 divides the CRC-32 of doc_id; a null doc_id is never tampered with).
    """
    rounds = climb(numbered(written(leaves(docs), "merkle-leaves"), "doc_id", "node"))
    subroots = rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), "node")
    tops = climb(written(numbered(subroots, "name"), "merkle-top"))
    found = tops[-1].first()  # one row
    root = found["node"].hex() if found else ""

    spark = docs.sparkSession
    summit = spark.createDataFrame([("", 0, [], None)], f"key string, block long, path {PATH}, subroot string")
    kinds = f"key string, block long, path {PATH}, subroot string"
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("path", ARROW_PATH), ("subroot", pa.string())])

    def of_source(row: dict, path: Path, _: str | None) -> tuple:
        return row["name"], 0, [dict(zip(("before", "after"), p, strict=True)) for p in path], row["node"].hex()

    headers = summit.limit(0) if not found else descend(tops[0], paths_down(tops, summit), ["name"], kinds, schema, of_source)

    def proven(row: dict, path: Path, subroot: str | None) -> tuple:
        leaf = row["node"].hex()
        seen = row["tampered"].hex() if row["tampered"] else leaf
        proof = digest("".join(before + after for before, after in path))
        folded = fold(seen, path)
        return row["doc_id"], leaf, subroot, root, proof, folded, folded == root

    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    out = pa.schema([("doc_id", pa.int64()), *[(n, pa.string()) for n in names], ("verified", pa.bool_())])
    kinds = "doc_id long, " + ", ".join(f"{n} string" for n in names) + ", verified boolean"
    return descend(rounds[0], paths_down(rounds, headers), ["doc_id", "tampered"], kinds, out, proven)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    return manifest(table(spark, sf_dir, "documents"))


def _tree_sql(name: str, base: str) -> str:
    """Nodes of all levels of the trees of ``base`` (k, pos, h, n), and their runs."""
    return f"""
{name}(k, lvl, pos, h, n) AS (
    SELECT k, 0, pos, h, n FROM {base}
    UNION ALL
    SELECT k, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16)
    FROM {name} WHERE n > 1 GROUP BY k, lvl, pos // 16
),
{name}_runs AS (
    SELECT k, lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY k, lvl, pos // 16
)"""


def _part_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_LOW = f"translate(text, '{UPPER}', '{LOWER}')"
_BITS = "CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
_BYTES = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"

OP11_SQL = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce('=' || source, '') AS k,
        sha256({" || ".join(map(_part_sql, FIELDS))}) AS leaf,
        sha256({" || ".join(map(_part_sql, FIELDS[:-1]))} || {_part_sql(_LOW)}) AS low,
        xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda c, b: {_BITS}), 4294967295) % 5 = 0 AS due
    FROM documents
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM docs
),
leaf_nodes AS (SELECT k, pos, leaf AS h, n FROM placed),
{_tree_sql("tree", "leaf_nodes")},
subroots AS (SELECT k AS name, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top_nodes AS (SELECT '' AS k, pos, h, n FROM subroots),
{_tree_sql("top", "top_nodes")},
levels AS (
    SELECT k, lvl, run, hs FROM tree_runs
    UNION ALL
    SELECT s.name, 100 + r.lvl, NULL, list_value(array_to_string(r.hs[1 : i], ''), array_to_string(r.hs[i + 2 :], ''))
    FROM (SELECT name, x.lvl, pos // (16 ** x.lvl)::BIGINT // 16 AS run, (pos // (16 ** x.lvl)::BIGINT % 16)::BIGINT AS i
          FROM subroots, (SELECT DISTINCT lvl FROM top_runs) x) s
    JOIN top_runs r ON r.lvl = s.lvl AND r.run = s.run
),
around AS (
    SELECT p.doc_id, p.k, p.pos, l.lvl,
        CASE WHEN l.run IS NULL THEN l.hs[1] ELSE array_to_string(l.hs[1 : p.pos // (16 ** l.lvl)::BIGINT % 16], '') END AS before,
        CASE WHEN l.run IS NULL THEN l.hs[2] ELSE array_to_string(l.hs[p.pos // (16 ** l.lvl)::BIGINT % 16 + 2 :], '') END AS after,
        row_number() OVER (PARTITION BY p.k, p.pos ORDER BY l.lvl) AS step
    FROM placed p JOIN levels l ON l.k = p.k
    WHERE l.run IS NULL OR l.run = p.pos // (16 ** l.lvl)::BIGINT // 16
),
folded(k, pos, step, h) AS (
    SELECT k, pos, 0, CASE WHEN due THEN low ELSE leaf END FROM placed
    UNION ALL
    SELECT f.k, f.pos, f.step + 1, sha256(a.before || f.h || a.after)
    FROM folded f JOIN around a ON a.k = f.k AND a.pos = f.pos AND a.step = f.step + 1
),
ends AS (SELECT k, pos, arg_max(h, step) AS h FROM folded GROUP BY k, pos),
proofs AS (SELECT k, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM around GROUP BY k, pos),
root AS (SELECT h FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.h AS root, coalesce(pr.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM placed p JOIN subroots s ON s.name = p.k JOIN ends e ON e.k = p.k AND e.pos = p.pos CROSS JOIN root
LEFT JOIN proofs pr ON pr.k = p.k AND pr.pos = p.pos
"""
