"""Merkle manifest of a dataset: a tree per source, and one over the sources' roots.

A leaf is the digest of a row's fields. Rows of a source ascend by id; every ARITY consecutive
nodes (the last run may have fewer, even one) become the digest of their digests, until one
node, the subroot, remains. The subroots, ordered by source, likewise give the root.

On every level, lag and lead columns of fixed offsets, masked by a node's slot in its run and by
the run's length, hold the siblings to its left and right; the row in slot 0 hashes itself and
its leads into the parent. Windows are partitioned by run, so a source with any share of the rows
is spread like the others; positions come from a range sort (`dense_positions`), and the driver
sees the greatest group size and the root. Siblings of a run's ancestors are the same for all
its leaves: paths are built from the root down and joined once per run and level.

Defined cases: a null field is `-`; a null id comes first in its source and is not tampered
with; rows of one id are ordered by their leaf digest, so equal rows share neighbours and each
gets its own place; a null source is a source of its own, before all others; a source of one
row has its leaf as subroot and takes no level; texts of any length are one hash input; an
empty table has no rows and the root is null. Other columns of the table play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.graph import stored
from quaestor.operators.ordering import dense_positions

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_PART = 5
GROUP_BYTES = 8 << 20  # of source names that may be broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


@dataclass
class Tree:
    """`leaves`: the given rows with `subroot` and `path`, the siblings of every level from the
    leaf to the root. `nodes`: `tree` (sources or top), `grp`, `level`, `pos`, `n`, `h`."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_of(source: Column) -> Column:
    """A source as a key that is never null and sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def leaves_of(docs: DataFrame) -> DataFrame:
    """`doc_id`, `grp`, leaf digest `h`, and `tampered`, the digest after tampering, where that
    changes the text."""
    given = [field(F.col(c)) for c in FIELDS[:-1]]
    lowered = F.translate("text", UPPER, LOWER)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_PART == 0
    return docs.select(
        "doc_id",
        group_of(F.col("source")).alias("grp"),
        digest(*given, field(F.col("text"))).alias("h"),
        F.when(chosen & F.col("text").rlike("[A-Z]"), digest(*given, field(lowered))).alias("tampered"),
    )


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Add `run`, `slot`, and the run's other digests to the `left` and to the `right`."""
    dealt = nodes.withColumn("run", F.floor(F.col("pos") / ARITY)).withColumn("slot", F.col("pos") % ARITY)
    length = f"least({ARITY}, n - run * {ARITY})"
    run = "OVER (PARTITION BY grp, run ORDER BY pos)"
    before = [f"CASE WHEN slot >= {k} THEN lag(h, {k}) {run} END" for k in range(ARITY - 1, 0, -1)]
    after = [f"CASE WHEN slot + {k} < {length} THEN lead(h, {k}) {run} END" for k in range(1, ARITY)]
    # concat_ws passes over nulls, which the masks leave
    sides = (f"concat_ws('', {', '.join(side)}) AS {name}" for side, name in ((before, "left"), (after, "right")))
    return dealt.selectExpr("*", *sides)


def climb(leaves: DataFrame) -> list[DataFrame]:
    """Levels (`grp`, `pos`, `n` nodes in the group, `h`) up from `leaves`; a group's last has n = 1."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        wide = with_siblings(levels[-1].select("grp", "pos", "n", "h").where("n > 1"))
        parents = wide.where("slot = 0").select(
            "grp", F.col("run").alias("pos"), F.ceil(F.col("n") / ARITY).alias("n"), digest(F.col("h"), F.col("right")).alias("h")
        )
        levels.append(stored(parents, "level"))
        most = -(-most // ARITY)
    return levels


def descend(levels: list[DataFrame], above_top) -> DataFrame:
    """`levels[0]` with `subroot` and `path`; `above_top(nodes)` adds both to groups' last nodes."""
    known = None
    for k in range(len(levels) - 1, -1, -1):
        kept = levels[k].columns
        paths = above_top(levels[k].where("n = 1")).select(*kept, "subroot", "path")
        if known is not None:
            wide = with_siblings(levels[k].where("n > 1"))
            up = known.select(F.col("grp").alias("_g"), F.col("pos").alias("_p"), "subroot", F.col("path").alias("_up"))
            joined = wide.join(up, (F.col("grp") == F.col("_g")) & (F.col("run") == F.col("_p")))
            longer = F.concat(F.array(F.struct("left", "right")), "_up").alias("path")
            paths = paths.unionByName(joined.select(*kept, "subroot", longer))
        known = stored(paths, "paths") if k else paths
    return known


def light(df: DataFrame, *texts: str) -> DataFrame:
    """A stored table, to be broadcast if it is proven to be small in bytes."""
    size = df.agg(F.coalesce(F.sum(sum((F.octet_length(t) for t in texts), F.lit(64))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= GROUP_BYTES else df


def build(leaves: DataFrame) -> Tree:
    """The tree over `leaves` (`doc_id`, `grp`, `h`, further columns)."""
    placed = dense_positions(leaves, [F.col("grp"), F.col("doc_id").asc_nulls_first(), F.col("h")], "_at")
    groups = stored(placed.groupBy("grp").agg(F.min("_at").alias("_first"), F.count("*").alias("n")), "groups")
    rows = placed.join(light(groups, "grp"), "grp").withColumn("pos", F.col("_at") - F.col("_first")).drop("_at", "_first")
    levels = climb(rows)

    subroots = levels[0].where("n = 1").select("grp", "h")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("grp", "h"))
    subroots = stored(subroots, "subroots")
    n = subroots.count()
    top = dense_positions(subroots, ["grp"], "pos").select(
        F.lit("").alias("grp"), F.col("grp").alias("source_grp"), "pos", F.lit(n).cast("long").alias("n"), "h"
    )
    tops = climb(top)
    last = tops[-1].where("n = 1").select("h").first()
    ends = descend(tops, lambda nodes: nodes.withColumns({"path": F.array().cast(PATH), "subroot": F.lit(None).cast("string")}))
    ends = stored(ends.select(F.col("source_grp").alias("_s"), F.col("h").alias("subroot"), "path"), "ends")
    ends = light(ends, "_s", "subroot", F.concat_ws("", "path.left", "path.right"))
    done = descend(levels, lambda nodes: nodes.join(ends, F.col("grp") == F.col("_s")))

    def listed(name: str, of: list[DataFrame]) -> DataFrame:
        parts = [x.select(F.lit(name).alias("tree"), "grp", F.lit(k).alias("level"), "pos", "n", "h") for k, x in enumerate(of)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return Tree(done.drop("pos", "n"), listed("sources", levels).unionByName(listed("top", tops)), last and last["h"])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def manifest(docs: DataFrame) -> Tree:
    """The tree over a document table."""
    return build(stored(leaves_of(docs), "leaves"))


def audit(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof digest, and the root recomputed from its tampered content."""
    tree = manifest(docs)
    root = F.lit(tree.root).cast("string")
    folded = fold(F.coalesce("tampered", "h"), F.col("path"))
    rows = tree.leaves.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
