"""A Merkle manifest of a dataset: a root for all of it, a subroot for each group, and a proof for every row.

A row's leaf is a hash of its values. Leaves of a group stand in the order of their keys, and each two neighbours become
the hash of both, level by level, until one is left: the subroot. Subroots likewise become the root. The rows of a group
are dealt in aligned blocks, the subtrees of ``BLOCK`` leaves, and the authentication path of each leaf comes from Merkle's
traversal: a treehash stack for each level has the next sibling ready when the leaf number reaches it, two steps a
leaf, so a path costs about two hashes a level and the state is logarithmic. The roots of blocks are the leaves of the
next layer, and what they share above is appended to the paths of all leaves below.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Table, map_arrow, numbered, parallel, runs, written

HEIGHT = 10
BLOCK = 1 << HEIGHT  # leaves of an aligned block


def joined(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class TreeHash:
    """Computes one node from the leaves below it, a step at a time, with a stack of at most one node for each level.

    Where leaves are missing on the right, a lone node becomes the hash of itself on each level.
    """

    def __init__(self, leaves: list[str], first: int, height: int):
        self.leaves, self.at, self.height = leaves, first, height
        self.stop = min(first + (1 << height), len(leaves))
        self.stack: list[tuple[int, str]] = []  # level, node

    def step(self) -> tuple[int, str] | None:
        """One hash or leaf more; what it made, or None if the node was there already or has no leaves."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (level, right), (_, left) = stack.pop(), stack.pop()
            stack.append((level + 1, joined(left, right)))
        elif self.at < self.stop:
            stack.append((0, self.leaves[self.at]))
            self.at += 1
        elif stack and stack[-1][0] < self.height:
            level, node = stack.pop()
            stack.append((level + 1, joined(node)))
        else:
            return None
        return stack[-1]

    def node(self) -> str | None:
        """The node, once done; None where there are no leaves."""
        while self.step():
            pass
        return self.stack[0][1] if self.stack else None


def tree_root(leaves: list[str], height: int) -> str:
    return TreeHash(leaves, 0, height).node()


def paths(leaves: list[str], height: int) -> Iterator[list[str]]:
    """The authentication path of every leaf in turn: ``L`` or ``R`` and the sibling on that side, empty where it has none."""
    ready: list[TreeHash] = [TreeHash(leaves, len(leaves), h) for h in range(height)]
    path: list[str | None] = [None] * height
    # The first two nodes of each level, by one treehash over all leaves.
    whole, seen = TreeHash(leaves, 0, height), [0] * (height + 1)
    while made := whole.step():
        level, node = made
        if level < height and seen[level] == 0:
            ready[level].stack = [(level, node)]
        elif level < height and seen[level] == 1:
            path[level] = node
        seen[level] += 1
    for i in range(len(leaves)):
        yield ["" if p is None else ("L" if i >> h & 1 else "R") + p for h, p in enumerate(path)]
        for h in range(height):
            if (i + 1) % (1 << h) == 0:
                path[h] = ready[h].node()
                ready[h] = TreeHash(leaves, (i + 1 + (1 << h)) ^ (1 << h), h)
        for stack in ready:
            stack.step()
            stack.step()


def height_of(size: int) -> int:
    """Levels of a block above its leaves: a group of one block ends where one node is left."""
    return min(HEIGHT, (size - 1).bit_length())


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (gid, block, idx, size, node) sorted: the root of each block."""
    for run in runs(batches, 2):
        size = run.column("size")[0].as_py()
        node = tree_root(run.column("node").to_pylist(), height_of(size))
        yield pa.RecordBatch.from_pydict({"gid": [run.column(0)[0].as_py()], "idx": [run.column(1)[0].as_py()], "size": [-(-size // BLOCK)], "node": [node]})


def _traversal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (gid, block, idx, size, node, tops, carry...) sorted, a block's shared upper path in a row before its leaves."""
    for run in runs(batches, 2):
        upper = run.column("upper")[0].as_py()
        rows = run.slice(1)
        own = list(paths(rows.column("node").to_pylist(), height_of(rows.column("size")[0].as_py())))
        proof = pa.array([p + upper for p in own], pa.list_(pa.string()))
        tops = [pa.array([run.column(c)[0].as_py()] * len(rows), pa.string()) for c in ("subroot", "root")]
        kept = rows.drop_columns(["block", "size", "upper", "subroot", "root"]).combine_chunks()
        yield from pa.table([*kept.columns, *tops, proof], names=[*kept.column_names, "subroot", "root", "proof"]).to_batches()


def climbed(nodes: DataFrame, top=None) -> DataFrame:
    """``nodes`` (``gid, idx, size, node`` and others) with ``subroot, root, proof``.

    ``size`` counts the nodes of a group and ``idx`` numbers them from 0. ``top`` gives from ``gid, subroot`` what stands
    above the subroots: ``gid, root, above``.
    """
    block = F.shiftright("idx", HEIGHT).alias("block")
    dealt = nodes.select("gid", block, "idx", "size", "node").repartition("gid", "block").sortWithinPartitions("gid", "block", "idx")
    roots = Table(map_arrow(dealt, _roots, "gid long, idx long, size long, node string")).df
    if roots.where("size > 1").isEmpty():
        upper = roots.select("gid", "idx", F.col("node").alias("subroot"), F.array().cast("array<string>").alias("upper"))
    else:
        upper = climbed(roots).select("gid", "idx", "subroot", F.col("proof").alias("upper"))
    upper = written(upper)
    if top is None:
        upper = upper.withColumn("root", F.col("subroot"))
    else:
        over = top(upper.where("idx = 0").select("gid", "subroot"))
        upper = upper.join(over, "gid").withColumn("upper", F.concat("upper", "above"))
    # One shuffle brings each block its shared upper path, as a row that sorts before its leaves.
    heads = upper.select("gid", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "upper", "subroot", "root")
    both = nodes.select("gid", block, "idx", "size", "node", *[c for c in nodes.columns if c not in ("gid", "idx", "size", "node")]).unionByName(heads, allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("block", "size", "upper", "subroot", "root")]
    schema = ", ".join([f"`{c}` {both.schema[c].dataType.simpleString()}" for c in names])
    return map_arrow(both.repartition("gid", "block").sortWithinPartitions("gid", "block", "idx"), _traversal, f"{schema}, subroot string, root string, proof array<string>")


def leaf_hash(*values: Column) -> Column:
    """The leaf of a row: the hash of its values, each with its length in bytes before it, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def merkle_manifest(rows: DataFrame, key: Column, group: Column, leaf: Column, **carry: Column) -> DataFrame:
    """``key, leaf, subroot, root, proof`` and the named ``carry`` columns, one row for each of ``rows``.

    ``proof`` has the siblings from the leaf up over the subroot to the root, ``L`` or ``R`` (the side the sibling is on)
    before each, and an empty text on levels where the node is alone. Groups are ordered by their value, null first, and
    leaves by key, null first; equal keys by their leaves. Repeated rows are leaves of their own. Texts of any length
    are hashed whole. An empty table gives an empty result. Only the given expressions are read, so other columns and
    their names don't matter.
    """
    slim = written(parallel(rows).select(group.alias("group"), key.alias("key"), leaf.alias("node"), *[c.alias(f"carry_{n}") for n, c in carry.items()]))
    placed, groups = numbered(slim, "group", ["key", "node"])
    sized = written(placed.join(groups.select("gid", "size"), "gid").drop("group"))

    def top(subroots: DataFrame) -> DataFrame:
        n = groups.count()
        nodes = subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"), F.lit(n).cast("long").alias("size"), F.col("subroot").alias("node"))
        return climbed(nodes).select(F.col("idx").alias("gid"), F.col("subroot").alias("root"), F.col("proof").alias("above"))

    if sized.isEmpty():
        none = F.lit(None).cast("string")
        return sized.select("key", F.col("node").alias("leaf"), none.alias("subroot"), none.alias("root"), F.array(none).alias("proof"), *[F.col(f"carry_{n}").alias(n) for n in carry])
    return climbed(sized, top).select("key", F.col("node").alias("leaf"), "subroot", "root", "proof", *[F.col(f"carry_{n}").alias(n) for n in carry])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    sibling = lambda s: F.substring(s, 2, 64)
    return F.aggregate(proof, leaf, lambda a, s: F.sha2(F.when(s.startswith("L"), F.concat(sibling(s), a)).when(s.startswith("R"), F.concat(a, sibling(s))).otherwise(a), 256))


def op13(spark, sf_dir: str) -> DataFrame:
    """The proof of every document, and whether it still holds after every seventh or so has been tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaf = lambda n: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(more))
    proven = merkle_manifest(docs, F.col("doc_id"), F.col("lang"), leaf(F.col("n_chars")), tampered=tampered)
    siblings = F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), "")
    found = proven.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join([_FIELD.format(c) for c in ("doc_id", "source", "lang")] + ["{n}", _FIELD.format("text")]) + ")"
#: CRC-32 by its polynomial, a bit at a time.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)), 4294967295), 4294967295)"""

ORACLE = f"""
    WITH RECURSIVE l AS (
        SELECT doc_id, lang, {_LEAF.format(n=_FIELD.format("n_chars"))} AS leaf, {_CRC} % 7 = 0 AS bad, {_LEAF.format(n=_FIELD.format("(n_chars + 1)"))} AS changed FROM documents
    ),
    placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM l),
    up AS (
        SELECT g, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM placed
        UNION ALL SELECT g, any_value(level) + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY g, i // 2
    ),
    sub AS (SELECT g, node, level FROM up WHERE n = 1),
    top AS (
        SELECT 0 AS level, g AS i, node, count(*) OVER () AS n FROM sub
        UNION ALL SELECT any_value(level) + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY i // 2
    ),
    steps AS (
        SELECT p.doc_id, x.level AS k, coalesce(CASE WHEN (p.i >> x.level) % 2 = 1 THEN 'L' ELSE 'R' END || u.node, '') AS step
        FROM placed p JOIN (SELECT DISTINCT g, level FROM up WHERE n > 1) x ON x.g = p.g LEFT JOIN up u ON u.g = p.g AND u.level = x.level AND u.i = xor(p.i >> x.level, 1)
        UNION ALL
        SELECT p.doc_id, 1000 + x.level, coalesce(CASE WHEN (p.g >> x.level) % 2 = 1 THEN 'L' ELSE 'R' END || u.node, '')
        FROM placed p CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) x LEFT JOIN top u ON u.level = x.level AND u.i = xor(p.g >> x.level, 1)
    ),
    proofs AS (SELECT doc_id, list(step ORDER BY k) AS proof FROM steps GROUP BY doc_id),
    done AS (
        SELECT p.*, sub.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root, coalesce(proof, []) AS proof
        FROM placed p JOIN sub ON sub.g = p.g LEFT JOIN proofs f USING (doc_id)
    ),
    folds AS (
        SELECT *, list_reduce(proof, lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a WHEN s[1] = 'R' THEN a || s[2:] ELSE a END), CASE WHEN bad THEN coalesce(changed, leaf) ELSE leaf END) AS folded_root FROM done
    )
    SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(proof, lambda s: s[2:]), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
