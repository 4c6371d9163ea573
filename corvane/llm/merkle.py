"""Merkle manifest of a dataset: a digest for every row, one root for each source and one for all, and proofs.

A row's leaf is the sha256 of its fields, each with its length before it. The leaves of a source in order of id are the lowest nodes of its
tree; every `fan` consecutive nodes become one. The roots of the sources in order of name are the leaves of a tree over
them. A proof of a leaf is the list of its siblings up to the root of all.

How it runs: rows are sorted by ranges of (source, id), so a row's number is its place in its range after the counts of
earlier ranges; no task numbers a whole source. Nodes are dealt into aligned blocks of `fan`**`depth` numbers, each a whole
subtree. A task hands several blocks at once, as an Arrow table, to a DuckDB of its own, bounded in memory and
without files: a level is an ordered `string_agg` of digests by run and a sha256 of it. What comes out is a root for each
block; blocks of those are reduced again until a tree has one node, so levels of blocks grow with the log of the rows.
Downwards, every block gets its own outer proof as one row among its nodes, and the same levels give the
proofs of the nodes inside. Texts are read once; only digests of 32 bytes are shuffled.

Defined cases: a null field counts as `-`, also as source or id; the null source comes first, null ids come first in a
source; rows of one source and id are in order of their leaves, and equal rows stand next to each other, each
with its own proof; a source of one row has its leaf as root; an empty table gives no rows. Other columns of the table play
no part, and columns of any names may be given as fields.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Scratch
from .textblocks import crc_mod, give_back

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*fields: Column) -> Column:
    """The 32 bytes of the sha256 of the fields: `-` if null, else byte count, `:` and value."""
    raw = [f.cast("string").cast("binary") for f in fields]
    parts = [F.when(r.isNull(), F.lit(b"-")).otherwise(F.concat(F.octet_length(r).cast("string").cast("binary"), F.lit(b":"), r)) for r in raw]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ordered(frame: DataFrame, tree: str, keys: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows numbered within trees, from 0 in order of the keys (nulls first), as `pos`, with the tree's size `n`; and (tree, n).

    Rows are sorted by ranges of tree and keys, many of one key too: a row's place in the given table is the last key.
    """
    deal = frame.withColumn("__deal", F.xxhash64(F.monotonically_increasing_id()))
    parts = max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), frame.rdd.getNumPartitions())
    by = [tree, *keys, "__deal"]
    placed = deal.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).drop("__deal")
    # the number of the range, then the place in it
    placed = scratch.put(placed.withColumn("__range", F.shiftright("__at", 33)))
    runs = placed.groupBy(F.col(tree).alias("__tree"), F.col("__range").alias("__of")).agg(F.min("__at").alias("__first"), F.count("*").alias("__m"))
    whole = Window.partitionBy("__tree")
    earlier = whole.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__m").over(earlier), F.lit(0))).withColumn("n", F.sum("__m").over(whole))
    sizes = runs.select(F.col("__tree").alias(tree), "n").distinct()
    joined = placed.join(runs, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("__range") == F.col("__of")))
    return joined.select(*frame.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"), "n"), sizes


def height(n: Column, fan: int) -> Column:
    """How many levels stand above n leaves."""
    # whole powers, since logarithms of powers of the fan are not exact
    steps = [F.when(n > F.lit(fan**k), 1).otherwise(0) for k in range(0, 62 // (fan.bit_length() - 1) + 1)]
    return sum(steps[1:], steps[0]).cast("int")


def _engine() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def _blocks(batches: Iterator[pa.RecordBatch], width: int, least: int = 8192) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole blocks, with a number `g` for each block; a block has up to `width` + 1 rows."""
    held: list[pa.Table] = []
    rows = 0

    def cut(last: bool) -> Iterator[pa.Table]:
        nonlocal held, rows
        table = pa.concat_tables(held).combine_chunks()
        tree, block = table.column("tree"), table.column("block")
        same = pc.and_(pc.equal(block[1:], block[:-1]), pc.coalesce(pc.equal(tree[1:], tree[:-1]), pc.and_(pc.is_null(tree[1:]), pc.is_null(tree[:-1]))))
        g = pc.cumulative_sum(pc.cast(pc.invert(same), pa.int64()))
        table = table.append_column("g", pa.chunked_array([pa.array([0], pa.int64()), *(g.chunks if isinstance(g, pa.ChunkedArray) else [g])]))
        end = len(table) if last else pc.index(table.column("g"), table.column("g")[-1]).as_py()
        held, rows = [table.slice(end).drop_columns(["g"])], len(table) - end
        if end:
            yield table.slice(0, end)

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= least + width:
                yield from cut(False)
    if rows:
        yield from cut(True)
    give_back()


def _levels(con: duckdb.DuckDBPyConnection, nodes: pa.Table, fan: int, depth: int) -> None:
    """level0 .. level{depth}: (g, pos, h, left_over) of the nodes, with `run`, the digests below each in order; levels above it are left over."""
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TEMP TABLE level0 AS SELECT g, pos, lower(hex(h)) AS h, levels AS left_over FROM nodes WHERE h IS NOT NULL")
    for k in range(1, depth + 1):
        con.execute(f"""
            CREATE OR REPLACE TEMP TABLE level{k} AS
            SELECT g, up AS pos, run, sha256(run) AS h, left_over FROM (
                SELECT g, pos // {fan} AS up, string_agg(h, '' ORDER BY pos) AS run, any_value(left_over) - 1 AS left_over
                FROM level{k - 1} WHERE left_over > 0 GROUP BY g, up)""")


def _top(con: duckdb.DuckDBPyConnection, fan: int, depth: int) -> str:
    """SQL for (g, h): the one node that remains of each block."""
    rows = [f"SELECT g, h FROM level{k} WHERE {'left_over <= 0' if k < depth else 'true'}" for k in range(depth + 1)]
    return " UNION ALL ".join(rows)


def _grouped(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes of a block in one partition, in order; the block's outer proof, where there is one, comes first."""
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / width).cast("long"))
    return keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("h").isNotNull(), "pos")


def _in_engine(work: Callable[[duckdb.DuckDBPyConnection, pa.Table], pa.Table], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for table in _blocks(batches, width):
            yield from work(con, table).to_batches()
        con.close()

    return run


def _climb(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """Of (tree, pos, h, levels): the nodes `depth` levels up, or fewer where a tree ends sooner."""

    def work(con: duckdb.DuckDBPyConnection, table: pa.Table) -> pa.Table:
        _levels(con, table, fan, depth)
        con.register("heads", table.select(["g", "tree", "block", "levels"]))
        return con.sql(f"""
            SELECT tree, block AS pos, unhex(h) AS h, (levels - {depth})::INT AS levels
            FROM (SELECT g, any_value(tree) AS tree, any_value(block) AS block, any_value(levels) AS levels FROM heads GROUP BY g) JOIN ({_top(con, fan, depth)}) USING (g)""").to_arrow_table()

    kind = nodes.schema["tree"].dataType.simpleString()
    return _grouped(nodes.select("tree", "pos", "h", "levels"), fan**depth).mapInArrow(_in_engine(work, fan**depth), f"tree {kind}, pos long, h binary, levels int")


def _others(run: str, at: str) -> tuple[str, str]:
    """SQL for the digests of a run before and after the place `at`."""
    return f"left({run}, 64 * {at})", f"substr({run}, 64 * {at} + 65)"


#: A step of a proof: all digests of a run, in order, and the place in it that the digest from below takes.
_STEPS = "array<struct<at:int,run:string>>"


def _with_outer(nodes: DataFrame, outer: DataFrame, width: int) -> DataFrame:
    """Nodes and, with a null digest, the outer proofs of their blocks."""
    kinds = {f.name: f.dataType for f in nodes.schema}
    more = [c for c in nodes.columns if c not in ("tree", "pos", "h", "levels")]
    own = nodes.select("tree", "pos", "h", "levels", *more, F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast(_STEPS).alias("steps"))
    head = outer.select(
        "tree", (F.col("pos") * width).alias("pos"), F.lit(None).cast("binary").alias("h"), F.lit(0).alias("levels"), *[F.lit(None).cast(kinds[c]).alias(c) for c in more], "subroot", "steps"
    )
    return _grouped(own.union(head), width)


def _descend(nodes: DataFrame, outer: DataFrame, fan: int, depth: int) -> DataFrame:
    """The outer proof of each node: its own steps within the block, then those of the block."""

    def work(con: duckdb.DuckDBPyConnection, table: pa.Table) -> pa.Table:
        _levels(con, table, fan, depth)
        steps = ", ".join(f"CASE WHEN l{k}.run IS NOT NULL THEN {{'at': (n.pos // {fan ** (k - 1)} % {fan})::INT, 'run': l{k}.run}} END" for k in range(1, depth + 1))
        joins = " ".join(f"LEFT JOIN level{k} l{k} ON l{k}.g = n.g AND l{k}.pos = n.pos // {fan**k}" for k in range(1, depth + 1))
        return con.sql(f"""
            SELECT n.tree, n.pos, o.subroot, list_concat(list_filter([{steps}], lambda s: s IS NOT NULL), coalesce(o.steps, [])) AS steps
            FROM nodes n LEFT JOIN (SELECT g, subroot, steps FROM nodes WHERE h IS NULL) o ON o.g = n.g {joins} WHERE n.h IS NOT NULL""").to_arrow_table()

    kind = nodes.schema["tree"].dataType.simpleString()
    return _with_outer(nodes.select("tree", "pos", "h", "levels"), outer, fan**depth).mapInArrow(_in_engine(work, fan**depth), f"tree {kind}, pos long, subroot binary, steps {_STEPS}")


def _prove(nodes: DataFrame, outer: DataFrame, fan: int, depth: int) -> DataFrame:
    """Of leaves with `id` and `altered`: (id, leaf, subroot, proof_sha256, folded_root).

    The fold starts from the altered leaf, or else from the leaf, and puts it among its siblings, level by level.
    """

    def work(con: duckdb.DuckDBPyConnection, table: pa.Table) -> pa.Table:
        _levels(con, table, fan, depth)
        others = _others("s.run", "s.at")
        con.execute(f"""
            CREATE OR REPLACE TEMP TABLE heads AS
            SELECT g, subroot, coalesce(steps, []) AS steps, array_to_string(list_transform(coalesce(steps, []), lambda s: {others[0]} || {others[1]}), '') AS rest
            FROM nodes WHERE h IS NULL""")
        con.execute("CREATE OR REPLACE TEMP TABLE fold AS SELECT g, pos, id, lower(hex(h)) AS leaf, lower(hex(coalesce(altered, h))) AS v, '' AS proof FROM nodes WHERE h IS NOT NULL")
        for k in range(1, depth + 1):
            before, after = _others("l.run", f"(f.pos // {fan ** (k - 1)} % {fan})")
            con.execute(f"""
                CREATE OR REPLACE TEMP TABLE fold AS
                SELECT f.* REPLACE (CASE WHEN l.run IS NULL THEN v ELSE sha256({before} || v || {after}) END AS v,
                                    CASE WHEN l.run IS NULL THEN proof ELSE proof || {before} || {after} END AS proof)
                FROM fold f LEFT JOIN level{k} l ON l.g = f.g AND l.pos = f.pos // {fan**k}""")
        longest = con.sql("SELECT coalesce(max(len(steps)), 0) FROM heads").fetchall()[0][0]
        con.execute("CREATE OR REPLACE TEMP TABLE fold AS SELECT f.* EXCLUDE (proof), subroot, steps, sha256(proof || rest) AS proof_sha256 FROM fold f JOIN heads USING (g)")
        for k in range(1, longest + 1):
            before, after = _others(f"steps[{k}].run", f"steps[{k}].at")
            con.execute(f"CREATE OR REPLACE TEMP TABLE fold AS SELECT * REPLACE (CASE WHEN steps[{k}] IS NULL THEN v ELSE sha256({before} || v || {after}) END AS v) FROM fold")
        return con.sql("SELECT id, leaf, lower(hex(subroot)) AS subroot, proof_sha256, v AS folded_root FROM fold").to_arrow_table()

    kind = nodes.schema["id"].dataType.simpleString()
    held = _with_outer(nodes.select("tree", "pos", "h", "levels", "id", "altered"), outer, fan**depth)
    return held.mapInArrow(_in_engine(work, fan**depth), f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")


class _Tree:
    """Nodes of trees at every `depth`th level, each table a whole one in the shared folder."""

    def __init__(self, leaves: DataFrame, fan: int, depth: int, scratch: Scratch):
        self.fan, self.depth, self.scratch = fan, depth, scratch
        self.tables = [leaves]
        most = leaves.agg(F.max("levels")).first()[0] or 0
        for _ in range(-(-most // depth)):
            self.tables.append(scratch.put(_climb(self.tables[-1].where("levels > 0"), fan, depth)))

    def roots(self) -> DataFrame:
        """(tree, h) of every tree."""
        found = [t.where("levels <= 0").select("tree", "h") for t in self.tables]
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out

    def outer(self, of_roots: DataFrame) -> DataFrame:
        """(tree, pos, subroot, steps) for the blocks of leaves, from (tree, subroot, steps) of the roots."""
        of_blocks = None
        for nodes in reversed(self.tables[1:]):
            ended = nodes.where("levels <= 0").select("tree", "pos")
            top = ended.join(of_roots.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree"))).select("tree", "pos", "subroot", "steps")
            if of_blocks is not None:
                top = top.union(_descend(nodes.where("levels > 0"), of_blocks, self.fan, self.depth))
            of_blocks = self.scratch.put(top)
        single = self.tables[0].where("levels <= 0").select("tree", "pos")
        single = single.join(of_roots.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree"))).select("tree", "pos", "subroot", "steps")
        return single if of_blocks is None else of_blocks.union(single)


def manifest(documents: DataFrame, *, doc_id: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, fan: int = 16, depth: int = 3) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    `altered` gives other values of fields, as a copy of the table might hold them; its rows are folded into roots with the
    proofs of the table as it is, and `verified` tells those that still come to its root.
    """
    scratch = Scratch(documents.sparkSession, "merkle")
    values = [F.col(f"`{c}`") for c in fields]
    other = [(altered or {}).get(c, v) for c, v in zip(fields, values)]
    now = leaf(*values)
    # one row whose digest differs keeps both
    rows = documents.select(F.col(f"`{source}`").alias("tree"), F.col(f"`{doc_id}`").alias("id"), now.alias("h"), (leaf(*other) if altered else now).alias("__a"))
    rows = scratch.put(rows.select("tree", "id", "h", F.when(F.col("__a") != F.col("h"), F.col("__a")).alias("altered")))
    placed, sizes = ordered(rows, "tree", ["id", "h"], scratch)
    leaves = scratch.put(placed.select("tree", "pos", "h", height(F.col("n"), fan).alias("levels"), "id", "altered"))
    by_source = _Tree(leaves, fan, depth, scratch)

    subroots = scratch.put(by_source.roots().select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "h"))
    above, _ = ordered(subroots, "tree", ["source"], scratch)
    above = scratch.put(above.select("tree", "pos", "h", height(F.col("n"), fan).alias("levels"), "source"))
    over_sources = _Tree(above.select("tree", "pos", "h", "levels"), fan, depth, scratch)
    root = over_sources.roots().first()
    start = documents.sparkSession.range(1).select(F.lit(0).alias("tree"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast(_STEPS).alias("steps"))
    proofs = _descend(above.where("levels > 0").select("tree", "pos", "h", "levels"), over_sources.outer(start), fan, depth)
    alone = above.where("levels <= 0").select("tree", "pos", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast(_STEPS).alias("steps"))
    proofs = proofs.union(alone).select(F.col("pos").alias("__pos"), "steps")
    of_sources = scratch.put(above.join(proofs, F.col("pos") == F.col("__pos")).select(F.col("source").alias("tree"), F.col("h").alias("subroot"), "steps"))

    found = _prove(leaves, by_source.outer(of_sources), fan, depth)
    known = F.lit(root["h"].hex() if root else None).cast("string")
    return found.select("id", "leaf", "subroot", known.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == known).alias("verified"))


def lowered_where(text: str, doc_id: str, every: int = 5) -> Column:
    """The text with A-Z lowered in the rows whose id's crc32 divides by `every`: a change for proofs to find."""
    low = F.translate(F.col(f"`{text}`"), _UPPER, _LOWER)
    return F.when(crc_mod(doc_id, every) == 0, low).otherwise(F.col(f"`{text}`"))


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR END"


SQL = f"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS tab),
d AS (SELECT doc_id, source, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} AS head, text,
  CASE WHEN xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS other FROM documents, c),
l AS (SELECT row_number() OVER () AS rid, doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("other")}) AS altered FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY sid) AS n FROM l),
up AS (SELECT sid, 0 AS lvl, pos, leaf AS h, n FROM p
  UNION ALL SELECT sid, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY sid, lvl, pos // 16, n),
s AS (SELECT sid, h FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, sid AS pos, h, (SELECT count(*) FROM s) AS n FROM s
  UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
r AS (SELECT sid, lvl, pos // 16 AS pos, string_agg(h, '' ORDER BY pos) AS run FROM up WHERE n > 1 GROUP BY sid, lvl, pos // 16),
t AS (SELECT lvl, pos // 16 AS pos, string_agg(h, '' ORDER BY pos) AS run FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
st AS (SELECT rid, r.lvl AS k, run, ((p.pos >> (4 * r.lvl)) % 16)::INT AS spot FROM p JOIN r ON r.sid = p.sid AND r.pos = p.pos >> (4 * r.lvl + 4)
  UNION ALL SELECT rid, 1000 + t.lvl, run, ((p.sid >> (4 * t.lvl)) % 16)::INT FROM p JOIN t ON t.pos = p.sid >> (4 * t.lvl + 4)),
g AS (SELECT rid, list({{'run': run, 'spot': spot}} ORDER BY k) AS steps, string_agg(left(run, 64 * spot) || substr(run, 64 * spot + 65), '' ORDER BY k) AS proof FROM st GROUP BY rid),
f AS (SELECT p.*, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend({{'run': altered, 'spot': 0}}, coalesce(steps, [])), lambda a, b: {{'run': sha256(left(b.run, 64 * b.spot) || a.run || substr(b.run, 64 * b.spot + 65)), 'spot': 0}}).run AS folded_root
  FROM p JOIN s USING (sid) LEFT JOIN g USING (rid))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
