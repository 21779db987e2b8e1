"""Merkle manifest of a dataset: digests of all documents in one tree a source, and of all sources in one tree above.

The manifest is checkpointed, not whole: of each tree only every ``stride``-th level and the top are written.  A *subtree*
is the ``fanout ** stride`` written nodes below one node of the next written level, so it is aligned and of bounded size.
Building folds each subtree into its node.  Extracting proofs goes down from the root: each subtree is read again, its
missing interior nodes are computed anew, every node takes its siblings from them, appends those its parent got, and the
interior nodes are discarded.

Positions come from one range partitioning by source, doc_id and leaf; a row's place in its partition and one row for each
partition and source give its place in its source, so no source is sorted or counted in one task.

A proof is ``steps``: for each level from the leaf to the root the joined digests left and right of the node in its run.
``folded`` recomputes the root from any leaf and a proof.

Defined cases: null in any hashed column is ``-``; null is a source of its own, before all others; null doc_ids come first
in their source; rows with one doc_id stand by their leaf, and rows equal in all hashed columns are leaves of their own; a
very long text is hashed by the task that reads it; an empty table has no root and gives an empty result; columns other
than the five hashed ones are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.plans.offsets import running_start
from ledgerline.plans.scratch import materialize, release

FANOUT = 16
STRIDE = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row; ``changed`` replaces some of its columns."""
    return F.sha2(F.concat(*[framed(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def tampered_leaf() -> Column:
    """Where 5 divides the checksum of the doc_id, the leaf of the row with A-Z of its text in lower case; else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf_of(text=F.translate("text", _UPPER, _LOWER)))


@dataclass
class Manifest:
    """Written levels of the trees of documents and of the tree of sources, from the leaves up, and the root.

    Each level holds ``tree, n, pos, digest``: the tree's number and leaves, the node's place in its level.  Level 0 of the
    documents also holds ``source``, ``doc_id`` and the columns carried.
    """

    levels: list[DataFrame]
    source_levels: list[DataFrame]
    root: str | None
    carried: tuple[str, ...]
    fanout: int
    stride: int


def _depth(fanout: int) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return sum((F.when(F.col("n") > fanout**k, 1).otherwise(0) for k in range(1, 63) if fanout**k < 2**63), F.when(F.col("n") > 1, 1).otherwise(0))


def _interior(members: Column, level: int, fanout: int) -> Column:
    """The digests of the nodes ``level`` levels above the members of a subtree."""
    below = F.transform(members, lambda m: m["digest"]) if level == 1 else F.col(f"level{level - 1}")
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * fanout + 1, F.lit(fanout)), ""), 256))


def _subtrees(nodes: DataFrame, level: int, fanout: int, stride: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``tree, n, up, reach, members, level1 ..``: the subtrees above a written level with their interior nodes."""
    above = nodes.withColumn("reach", F.least(F.lit(stride), _depth(fanout) - level * stride)).where("reach > 0")
    wide = F.lit(fanout**stride)
    grouped = above.groupBy("tree", "n", "reach", F.floor(F.col("pos") / wide).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *keep))).alias("members"))
    for k in range(1, stride + 1):
        grouped = grouped.withColumn(f"level{k}", _interior(F.col("members"), k, fanout))
    return grouped


def _grow(leaves: DataFrame, depth: int, fanout: int, stride: int, name: str) -> list[DataFrame]:
    """All written levels: each holds the nodes of the trees that were not complete one written level below."""
    levels = [leaves]
    for level in range(-(-depth // stride)):
        top = F.element_at(F.expr("CASE reach " + " ".join(f"WHEN {k} THEN level{k}" for k in range(1, stride + 1)) + " END"), 1)
        folded = _subtrees(levels[-1].select("tree", "n", "pos", "digest"), level, fanout, stride)
        levels.append(materialize(folded.select("tree", "n", F.col("up").alias("pos"), top.alias("digest")), name))
    return levels


def _tops(levels: list[DataFrame], fanout: int, stride: int) -> DataFrame:
    """``tree, digest``: the top of each tree, from the first written level that completes it."""
    done = [nodes.where(_depth(fanout) <= level * stride).select("tree", "digest") for level, nodes in enumerate(levels)]
    tops = done[0]
    for more in done[1:]:
        tops = tops.unionByName(more)
    return tops


def _placed(leaves: DataFrame, carried: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The leaves with ``tree, n, pos``, and ``source, tree, n`` of each source."""
    parts = max(1, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("digest")]
    dealt = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "merkle-dealt")
    # rows of a source lie together in a partition: one row for each partition and source
    held = materialize(dealt.groupBy("part", "source").agg(F.count("*").alias("rows"), F.min("row").alias("first")), "merkle-held")
    sources = running_start(held.groupBy("source").agg(F.sum("rows").alias("n")).withColumn("one", F.lit(1)), [F.asc_nulls_first("source")], "one", "tree", "merkle-order")
    sources = materialize(sources.select("source", F.col("tree").cast("long").alias("tree"), "n"), "merkle-sources")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first"))
    bases = bases.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.part", "b.source", "s.tree", "s.n", "b.base")
    bases = materialize(bases, "merkle-bases")
    same = (F.col("d.part") == F.col("b.part")) & F.col("d.source").eqNullSafe(F.col("b.source"))
    placed = dealt.alias("d").join(bases.alias("b"), same).select("b.tree", "b.n", (F.col("b.base") + F.col("d.row")).alias("pos"), "d.digest", "d.source", "d.doc_id", *[f"d.{c}" for c in carried])
    placed = materialize(placed, "merkle-leaves")
    release(dealt, held, bases)
    return placed, sources


def build(leaves: DataFrame, carried: tuple[str, ...] = (), fanout: int = FANOUT, stride: int = STRIDE) -> Manifest:
    """The manifest over rows ``source, doc_id, digest`` and the columns ``carried``."""
    placed, sources = _placed(materialize(leaves.select("source", "doc_id", "digest", *carried), "merkle-hashed"), carried)
    deepest, trees = sources.select(F.max(_depth(fanout)), F.count("*")).first()
    levels = _grow(placed, deepest or 0, fanout, stride, "merkle-level")
    above = materialize(_tops(levels, fanout, stride).select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("pos"), "digest"), "merkle-subroots")
    depth = next(k for k in range(64) if fanout**k >= trees)
    source_levels = _grow(above, depth, fanout, stride, "merkle-level")
    top = _tops(source_levels, fanout, stride).first()
    return Manifest(levels, source_levels, top["digest"] if top else None, carried, fanout, stride)


def _own_steps(fanout: int, stride: int) -> Column:
    """The siblings of the member at place ``at`` of its subtree, level by level."""
    steps = []
    for k in range(stride):
        nodes = F.transform("members", lambda m: m["digest"]) if k == 0 else F.col(f"level{k}")
        node = F.floor(F.col("at") / fanout**k).cast("int")
        place = node % fanout
        left = F.array_join(F.slice(nodes, node - place + 1, place), "")
        right = F.array_join(F.slice(nodes, node + 2, F.lit(fanout - 1) - place), "")
        steps.append(F.when(F.col("reach") > k, F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*steps))


def _descend(levels: list[DataFrame], tops: DataFrame, keep: tuple[str, ...], fanout: int, stride: int) -> DataFrame:
    """``tree, pos, digest, subroot, steps`` of the leaves, with ``keep``; ``tops`` has ``tree, subroot, steps`` of each tree's top."""
    found = None
    for level in range(len(levels) - 1, -1, -1):
        own = keep if level == 0 else ()
        nodes = levels[level].select("tree", "n", "pos", "digest", *own)
        out = nodes.where(_depth(fanout) <= level * stride).join(tops, "tree").select("tree", "pos", "digest", *own, "subroot", "steps")
        if found is not None:
            above = found.select("tree", F.col("pos").alias("up"), "subroot", F.col("steps").alias("above"))
            near = _subtrees(nodes, level, fanout, stride, own).join(above, ["tree", "up"])
            near = near.select("tree", "reach", "members", *[f"level{k}" for k in range(1, stride)], "subroot", "above", F.posexplode("members").alias("at", "member"))
            near = near.select("tree", "member.*", "subroot", F.concat(_own_steps(fanout, stride), F.col("above")).alias("steps"))
            out = out.unionByName(near.select(*out.columns))
        found = out if level == 0 else materialize(out, "merkle-steps")
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """One row a document: ``source, doc_id``, the carried columns, ``digest`` (the leaf), ``subroot`` and ``steps``."""
    m = manifest
    session = m.levels[0].sparkSession
    start = session.createDataFrame([(0, m.root)], "tree long, subroot string").withColumn("steps", F.expr("CAST(array() AS array<struct<left:string,right:string>>)"))
    tops = _descend(m.source_levels, start, (), m.fanout, m.stride).select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "steps")
    return _descend(m.levels, materialize(tops, "merkle-tops"), ("source", "doc_id", *m.carried), m.fanout, m.stride).drop("tree", "pos")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings_digest(steps: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def audit(documents: DataFrame) -> DataFrame:
    """Proofs of all documents, each checked against its tampered leaf where it has one."""
    rows = documents.select("doc_id", "source", leaf_of().alias("digest"), tampered_leaf().alias("changed"))
    manifest = build(rows, ("changed",))
    out = proofs(manifest).withColumn("root", F.lit(manifest.root).cast("string"))
    out = out.withColumn("proof_sha256", siblings_digest(F.col("steps"))).withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("steps")))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, leaves: str, rounds: int) -> str:
    """CTEs ``{name}0 ..``: nodes ``tree, n, pos, digest`` level by level; a tree of one node stays as it is."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(rounds):
        out.append(f"""{name}{k + 1} AS (
  SELECT tree, count(*) OVER (PARTITION BY tree) AS n, pos, digest FROM (
    SELECT tree, CASE WHEN n > 1 THEN pos // {FANOUT} ELSE pos END AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
    FROM {name}{k} GROUP BY tree, CASE WHEN n > 1 THEN pos // {FANOUT} ELSE pos END))""")
    return ",\n".join(out)


def _path_sql(name: str, rounds: int) -> tuple[str, str]:
    """For a node at ``pos`` of tree ``tree`` (alias p): columns of the runs it passes, and the joins that give them."""
    columns, joins = [], []
    for k in range(rounds):
        runs = f"(SELECT tree, pos // {FANOUT} AS run, list(digest ORDER BY pos) AS nodes FROM {name}{k} WHERE n > 1 GROUP BY ALL)"
        columns.append(f"{name}r{k}.nodes AS {name}nodes{k}, (p.pos // {FANOUT**k}) % {FANOUT} AS {name}at{k}")
        joins.append(f"LEFT JOIN {runs} AS {name}r{k} ON {name}r{k}.tree = p.tree AND {name}r{k}.run = p.pos // {FANOUT ** (k + 1)}")
    return ", ".join(columns), " ".join(joins)


def audit_sql(rounds: int = 5, source_rounds: int = 3) -> str:
    """``audit`` in DuckDB SQL, for at most 16 ** rounds documents a source and 16 ** source_rounds sources."""
    frame = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    leaf = lambda text: "sha256(" + " || ".join(frame(text if c == "text" else c) for c in FIELDS) + ")"
    bits = "flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    left = lambda t, k: f"coalesce(array_to_string({t}nodes{k}[:{t}at{k}], ''), '')"
    right = lambda t, k: f"coalesce(array_to_string({t}nodes{k}[{t}at{k} + 2:], ''), '')"
    path, joins = _path_sql("t", rounds)
    top_path, top_joins = _path_sql("s", source_rounds)
    steps = [("t", k) for k in range(rounds)] + [("s", k) for k in range(source_rounds)]
    fold = ["SELECT *, coalesce(changed, digest) AS h FROM paths"]
    for t, k in steps:
        fold.append(f"SELECT * REPLACE (CASE WHEN {t}nodes{k} IS NULL THEN h ELSE sha256({left(t, k)} || h || {right(t, k)}) END AS h) FROM ({fold[-1]})")
    siblings = " || ".join(f"{left(t, k)} || {right(t, k)}" for t, k in steps)
    return f"""
WITH hashed AS (SELECT doc_id, source, {leaf("text")} AS digest, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS changed FROM documents),
dealt AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM hashed),
{_tree_sql("t", "SELECT tree, n, pos, digest FROM dealt", rounds)},
{_tree_sql("s", f"SELECT 0 AS tree, count(*) OVER () AS n, tree AS pos, digest FROM t{rounds}", source_rounds)},
tops AS (SELECT p.pos AS source_tree, p.digest AS subroot, {top_path} FROM s0 AS p {top_joins}),
low AS (SELECT p.*, {path} FROM dealt AS p {joins}),
paths AS (SELECT low.*, tops.* FROM low JOIN tops ON low.tree = tops.source_tree)
SELECT doc_id, f.digest AS leaf, subroot, s{source_rounds}.digest AS root, sha256({siblings}) AS proof_sha256, h AS folded_root, h = s{source_rounds}.digest AS verified
FROM ({fold[-1]}) AS f CROSS JOIN s{source_rounds}
"""
