"""A Merkle manifest of a dataset: a hash tree over the rows of each group, and one over the groups.

Rows are ranked in their group by a radix trie, not by a sort of the whole: histograms of prefixes of their keys' hex digits
are summed level by level, each under its parent prefix, which gives the number of rows before each prefix; only the
rows below one of the longest prefixes are put in order together.  Prefixes that hold too many rows get more digits.
The digits of a rank in base `fanout` are its path in the tree.  Nodes that share all but their
last digits, `BLOCK` at most, are one block; blocks are reduced from the longest prefix to the empty one, each
level as one grouped job, and siblings are handed down the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcorpus.llm.scratch import Scratch

#: Most leaves of a block; the largest power of the fanout below that is taken.
BLOCK = 512
#: Hex digits by which prefixes grow, digits that the ids of a bucket may differ in, and rows that are put in order together.
STEP, LAST, TOGETHER = 4, 2, 50_000
PATH = "array<struct<left: string, right: string>>"
ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of values in order, each `-` if null, else the bytes of its text in UTF-8, `:` and the text."""
    parts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def order_key(column: Column, kind: T.DataType) -> Column:
    """Text of which the order is that of the values: nulls first, then whole numbers by value, others bytewise as texts."""
    if isinstance(kind, T.IntegralType):
        return F.when(column.isNull(), "0").otherwise(F.concat(F.lit("1"), F.lpad(F.hex(column.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))
    return F.when(column.isNull(), "0").otherwise(F.concat(F.lit("1"), F.hex(column.cast("string")), F.lit(" ")))


def offsets(buckets: DataFrame, length: int) -> DataFrame:
    """`buckets` (g, p, n), prefixes p of at most `length` digits, with `before`: the sum of n of smaller prefixes in the group.

    Sums go up to shorter prefixes and their offsets come down; a window never holds more than the children of one prefix.
    """
    up = length - STEP
    if up <= 0:
        return buckets.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    children = buckets.withColumn("q", F.substring("p", 1, up))
    parents = offsets(children.groupBy("g", F.col("q").alias("p")).agg(F.sum("n").alias("n")), up)
    own = F.sum("n").over(Window.partitionBy("g", "q").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    return children.join(parents.select("g", F.col("p").alias("q"), "before"), ["g", "q"]).select("g", "p", "n", (F.col("before") + F.coalesce(own, F.lit(0))).alias("before"))


def ranked(entries: DataFrame, scratch: Scratch, first: int, name: str, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """`entries` (g, key, n and others; different keys in a group) with `rank`, the sum of n of smaller keys of the group; and (g, total) of groups.

    Each round of digits sees only rows whose prefix had over `together` rows in the round before.
    """
    placed, closed, length, now = [], [], first, entries
    while True:
        now = now.withColumn("p", F.substring("key", 1, length))
        counts = now.groupBy("g", "p").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.max(F.length("key")).alias("longest"))
        counts = scratch.keep(counts.withColumn("open", (F.col("rows") > together) & (F.col("longest") > length)), f"{name}-counts-{length}")
        closed.append(counts.filter(~F.col("open")).select("g", "p", "n"))
        opened = counts.filter("open").select("g", "p")
        more = not opened.isEmpty()
        placed.append((now.join(opened, ["g", "p"], "left_anti") if more else now, length))
        if not more:
            break
        now = scratch.keep(now.join(opened, ["g", "p"], "left_semi").select(*entries.columns), f"{name}-open-{length}")
        length += STEP
    buckets = closed[0]
    for x in closed[1:]:
        buckets = buckets.unionByName(x)
    before = scratch.keep(offsets(buckets, length), f"{name}-offsets")
    out = None
    inside = Window.partitionBy("g", "p").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    for rows, _ in placed:
        part = rows.join(before.select("g", "p", "before"), ["g", "p"])
        part = part.withColumn("rank", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("p", "before")
        out = part if out is None else out.unionByName(part)
    return out, scratch.keep(before.groupBy("g").agg(F.sum("n").alias("total")), f"{name}-totals")


def in_blocks(entries: DataFrame, block: int) -> DataFrame:
    """A row for each block that an entry's n equal leaves reach into, with the ranks lo up to hi that lie in it."""
    end = F.col("rank") + F.col("n")
    reach = entries.withColumn("block", F.explode(F.sequence(F.expr(f"rank div {block}"), F.expr(f"(rank + n - 1) div {block}"))))
    return reach.withColumn("lo", F.greatest("rank", F.col("block") * block)).withColumn("hi", F.least(end, (F.col("block") + 1) * block)).drop("rank", "n", "key")


def expanded(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of a block in order, and the row of each of its leaves."""
    table = table.sort_by("lo").combine_chunks()
    size = table.column("hi").to_numpy() - table.column("lo").to_numpy()
    return table, np.repeat(np.arange(table.num_rows), size)


class Tree:
    """How blocks of a fanout are reduced."""

    def __init__(self, fanout: int, most: int = BLOCK):
        if fanout < 2:
            raise ValueError("a node has two children at least")
        self.fanout, self.height, self.block = fanout, 1, fanout
        while self.block * fanout <= most:
            self.block, self.height = self.block * fanout, self.height + 1

    def levels(self, leaves: list[str], many: bool) -> list[list[str]]:
        """Nodes from the leaves up to one node; if the block is one of many, up to its full height."""
        f, out = self.fanout, [leaves]
        while len(out[-1]) > 1 or many and len(out) <= self.height:
            out.append([sha("".join(out[-1][i : i + f])) for i in range(0, len(out[-1]), f)])
        return out

    def siblings(self, levels: list[list[str]], i: int) -> list[tuple[str, str]]:
        """What stands left and right of leaf i and of each node above it, below the top."""
        f, out = self.fanout, []
        for nodes in levels[:-1]:
            run = i - i % f
            out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + f])))
            i //= f
        return out

    def build(self, leaves: DataFrame, totals: DataFrame, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
        """The tables of nodes of each level of blocks, leaves first, and (g, subroot)."""
        levels_of, height = self.levels, self.height

        def reduce(key, table):
            table, of = expanded(table.select(["lo", "hi", "leaf"]))
            hashes = table.column("leaf").to_pylist()
            top = levels_of([hashes[i] for i in of], False)
            raised = top[-1][0]
            for _ in range(height - len(top) + 1):
                raised = sha(raised)
            return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "top": [top[-1][0]], "raised": [raised]})

        most = totals.agg(F.max("total")).first()[0]
        tables, subroots, span = [leaves], None, 1
        while True:
            made = tables[-1].select("g", "block", "lo", "hi", "leaf").groupBy("g", "block").applyInArrow(reduce, "g string, block long, top string, raised string")
            span *= self.block
            made = made.join(totals, "g").select("g", "block", F.when(F.col("total") > span, F.col("raised")).otherwise(F.col("top")).alias("leaf"), "total")
            made = scratch.keep(made, f"{name}-nodes-{len(tables)}")
            tops = made.filter(F.col("total") <= span).select("g", F.col("leaf").alias("subroot"))
            subroots = tops if subroots is None else subroots.unionByName(tops)
            if most <= span:
                return tables, subroots
            tables.append(made.filter(F.col("total") > span).select("g", F.expr(f"block div {self.block}").alias("block"), F.col("block").alias("lo"), (F.col("block") + 1).alias("hi"), "leaf", F.lit(None).cast("string").alias("name")))

    def block_paths(self, tables: list[DataFrame], totals: DataFrame, above: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """(g, block, many, path) of the blocks of leaves: what stands beside each node between a block's top and the root.  `above` has (g, path) from each group's top."""
        start, paths = totals.join(above, "g"), None
        for level in range(len(tables) - 1, -1, -1):
            low, high = self.block**level if level else 0, self.block ** (level + 1)
            tops = start.filter((F.col("total") > low) & (F.col("total") <= high)).select("g", F.lit(0).cast("long").alias("block"), F.lit(False).alias("many"), "path")
            paths = tops if paths is None else self.child_paths(tables[level + 1], paths).select("g", F.col("lo").alias("block"), F.lit(True).alias("many"), "path").unionByName(tops)
        return scratch.keep(paths, f"{name}-paths")

    def child_paths(self, nodes: DataFrame, paths: DataFrame) -> DataFrame:
        """(g, lo, name, path) of the nodes of blocks, from the paths of the blocks."""
        levels_of, siblings = self.levels, self.siblings

        def hand_down(key, table, path):
            table, _ = expanded(table.select(["lo", "hi", "leaf", "name"]))
            levels = levels_of(table.column("leaf").to_pylist(), path.column("many")[0].as_py())
            rest = [(s["left"], s["right"]) for s in path.column("path")[0].as_py()]
            made = [[{"left": a, "right": b} for a, b in siblings(levels, i) + rest] for i in range(table.num_rows)]
            return pa.table({"g": pa.array([key[0].as_py()] * table.num_rows, pa.string()), "lo": table.column("lo"), "name": table.column("name"), "path": pa.array(made, ARROW_PATH)})

        return nodes.select("g", "block", "lo", "hi", "leaf", "name").groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(hand_down, f"g string, lo long, name string, path {PATH}")


def manifest(df: DataFrame, leaf: Column, altered: Column | None = None, key: str = "doc_id", group: str = "lang", fanout: int = 2, block: int = BLOCK, with_path: bool = False, together: int = TOGETHER) -> DataFrame:
    """A row for each row of `df`: its key and group, leaf, subroot (of its group), root (of all), proof_sha256 (hash of all siblings, level by
    level, left to right), folded_root (from the altered leaf, or the leaf itself, and the siblings) and verified (whether
    that is the root); with_path adds the siblings.

    Leaves ascend by key in their group, null keys first; rows with equal keys ascend by leaf.  Groups ascend bytewise, the null
    group first.  Equal rows are counted in each task and stay one row until their block is hashed, so any number of copies or of
    rows with one key is split among blocks.  A null text or column is part of its leaf.  No rows give no rows; other
    columns of `df` are ignored.
    """
    scratch, tree = Scratch(df.sparkSession, "merkle"), Tree(fanout, block)
    g = F.coalesce(F.concat(F.lit("."), df[group].cast("string")), F.lit(""))
    entries = df.select(g.alias("g"), df[key].alias("id"), df[group].alias("group"), leaf.alias("leaf"), (leaf if altered is None else altered).alias("altered"))
    entries = entries.groupBy("g", "id", "group", "leaf", "altered").agg(F.count("*").alias("n"))
    kind = entries.schema["id"].dataType
    entries = scratch.keep(entries.withColumn("key", F.concat(order_key(F.col("id"), kind), F.col("leaf"), F.col("altered"))), "entries")
    whole = isinstance(kind, T.IntegralType)
    rows, totals = ranked(entries, scratch, 17 - LAST if whole else STEP, "rows", together)
    rows = scratch.keep(in_blocks(rows, tree.block), "rows")
    fields = [T.StructField(key, kind), T.StructField(group, entries.schema["group"].dataType)] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [T.StructField("verified", T.BooleanType())]
    if with_path:
        fields.append(T.StructField("path", T._parse_datatype_string(PATH)))
    if totals.isEmpty():
        return df.sparkSession.createDataFrame([], T.StructType(fields))
    nodes, subroots = tree.build(rows, totals, scratch, "rows")
    # the tree of subroots, which has one group
    tops = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.concat(F.hex("g"), F.lit(" ")).alias("key"), F.col("subroot").alias("leaf"), F.lit(1).cast("long").alias("n"))
    tops, count = ranked(scratch.keep(tops, "tops"), scratch, STEP, "tops", together)
    tops = scratch.keep(in_blocks(tops, tree.block), "tops-rows")
    upper, found = tree.build(tops, count, scratch, "tops")
    root = found.first()["subroot"]
    above = found.select("g", F.array().cast(PATH).alias("path"))
    above = tree.child_paths(upper[0], tree.block_paths(upper, count, above, scratch, "tops")).select(F.col("name").alias("g"), "path")
    paths = tree.block_paths(nodes, totals, scratch.keep(above, "above"), scratch, "rows").join(subroots, "g")
    levels_of, siblings_of = tree.levels, tree.siblings

    def close(key_, table, path):
        table, of = expanded(table)
        leaves, others = table.column("leaf").to_pylist(), table.column("altered").to_pylist()
        levels = levels_of([leaves[i] for i in of], path.column("many")[0].as_py())
        rest = [(s["left"], s["right"]) for s in path.column("path")[0].as_py()]
        tail = "".join(a + b for a, b in rest)
        proofs, folded, all_paths = [], [], []
        for rank, i in enumerate(of):
            own = siblings_of(levels, rank)
            proofs.append(sha("".join(a + b for a, b in own) + tail))
            node = others[i]
            for a, b in own:
                node = sha(a + node + b)
            for a, b in rest:
                node = sha(a + node + b)
            folded.append(node)
            if with_path:
                all_paths.append([{"left": a, "right": b} for a, b in own + rest])
        out = table.select(["id", "group", "leaf"]).take(pa.array(of))
        out = out.append_column("subroot", pa.array([path.column("subroot")[0].as_py()] * len(of), pa.string())).append_column("proof_sha256", pa.array(proofs, pa.string())).append_column("folded_root", pa.array(folded, pa.string()))
        return out.append_column("path", pa.array(all_paths, ARROW_PATH)) if with_path else out

    schema = f"id {kind.simpleString()}, `group` {entries.schema['group'].dataType.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string" + (f", path {PATH}" if with_path else "")
    out = rows.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(close, schema)
    columns = [F.col("id").alias(key), F.col("group").alias(group), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")]
    return out.select(*columns, *(["path"] if with_path else []))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    leaf, altered = leaf_hash(*fields), leaf_hash(*fields[:3], more, fields[4])
    made = manifest(docs, leaf, F.when(hit, altered).otherwise(leaf))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


SQL_OP11 = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda s, c: list_reduce(list_prepend(xor(s, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('.' || lang, '') AS g, sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(head || octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1) || tail) END AS changed
  FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves),
tree AS (
  SELECT g, 0 AS level, rank AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(h || coalesce(other, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY i) AS other FROM tree WHERE n > 1) WHERE i % 2 = 0),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS rank FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, rank AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(h || coalesce(other, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY i) AS other FROM upper WHERE n > 1) WHERE i % 2 = 0),
steps AS (
  SELECT p.g, p.rank, t.level, t.n > 1 AS up, (p.rank >> t.level) % 2 = 0 AS first, coalesce(s.h, '') AS h
  FROM placed p JOIN (SELECT DISTINCT g, level, n FROM tree) t ON p.g = t.g
  LEFT JOIN tree s ON s.g = p.g AND s.level = t.level AND s.i = xor(p.rank >> t.level, 1)
  WHERE t.n > 1
  UNION ALL
  SELECT p.g, p.rank, 1000 + t.level, true, (r.rank >> t.level) % 2 = 0, coalesce(s.h, '')
  FROM placed p JOIN subroots r ON p.g = r.g JOIN (SELECT DISTINCT level, n FROM upper) t ON t.n > 1
  LEFT JOIN upper s ON s.level = t.level AND s.i = xor(r.rank >> t.level, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g, rank ORDER BY level) AS no FROM steps),
proofs AS (SELECT g, rank, sha256(string_agg(h, '' ORDER BY no)) AS proof_sha256 FROM numbered GROUP BY g, rank),
folds AS (
  SELECT g, rank, coalesce(changed, leaf) AS h, 0 AS no FROM placed
  UNION ALL
  SELECT f.g, f.rank, CASE WHEN s.first THEN sha256(f.h || s.h) ELSE sha256(s.h || f.h) END, s.no
  FROM folds f JOIN numbered s ON s.g = f.g AND s.rank = f.rank AND s.no = f.no + 1),
folded AS (SELECT g, rank, arg_max(h, no) AS folded_root FROM folds GROUP BY g, rank),
top AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (g) CROSS JOIN top LEFT JOIN proofs ON proofs.g = placed.g AND proofs.rank = placed.rank
JOIN folded ON folded.g = placed.g AND folded.rank = placed.rank
"""
