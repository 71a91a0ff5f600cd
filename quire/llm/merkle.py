"""A Merkle manifest of a dataset: leaves of rows, a tree per group, a tree over the groups, and proofs that fold back.

A level is made of window columns only. Nodes have consecutive places in their group; a run is ``fanout`` of them. Fixed-offset
``lag`` and ``lead`` columns, masked by the slot in the run and by the run's length, give every node the digests of its siblings
to the left and to the right, and the row of a run's first child hashes the parent. Runs never cross the edge of a block of
``fanout ** 3`` places, so a window holds one block and no group, however large, sits in one task. Places come from ranges
of rows that are numbered apart and stitched with their counts.

A row's path (the siblings per level) is not carried up: each level has an eighth of the rows, so paths go down from the top,
one join per level on the parent's place. Digests travel as 32 bytes and are hashed as lowercase hex text.

Defined cases: a null field is ``-``, so it differs from an empty text (``0:``); a null group is a group, before all others; null
ids come first in theirs; rows with equal ids are ordered by their leaf, and equal rows, which have equal leaves, take the places
in any order; a group of one leaf has that leaf as its subroot; a single group's subroot is the root; an empty table gives
no rows. Texts are hashed whole. Other columns are not read, and columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import broadcast_checked, materialize, placed

FANOUT = 8
#: Levels of a block: a window holds ``fanout ** BLOCK_LEVELS`` rows at most.
BLOCK_LEVELS = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Where this divides the checksum of an id, the query tampers with the row.
TAMPERED = 3
#: Siblings per level.
_PATH = "array<struct<left:binary,right:binary>>"


def digest(value: Column) -> Column:
    """32 bytes of the SHA-256 of a text."""
    return F.unhex(F.sha2(value, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row: per field its length in bytes, a colon and its text, or a dash."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def siblings(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Add ``left`` and ``right`` (the siblings' digests) and, on a run's first row, ``parent`` to ``g, at, n, node``."""
    block = Window.partitionBy("g", "_block").orderBy("at")
    slot = F.col("at") % fanout
    length = F.least(F.lit(fanout), F.col("n") - F.col("at") + slot)
    nothing = F.lit("").cast("binary")
    left = [F.when(slot >= j, F.lag("node", j).over(block)).otherwise(nothing) for j in range(fanout - 1, 0, -1)]
    right = [F.when(slot + j < length, F.lead("node", j).over(block)).otherwise(nothing) for j in range(1, fanout)]
    return (
        nodes.withColumn("_block", F.floor(F.col("at") / fanout**BLOCK_LEVELS))
        .withColumns({"left": F.concat(*left), "right": F.concat(*right)})
        .withColumn("parent", F.when(slot == 0, digest(hexed(F.concat("node", "right")))))
        .drop("_block")
    )


def tree(leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """The root ``g, root`` of every group, and the leaves with ``path``, the siblings per level from the leaf up.

    ``leaves`` has the group ``g`` (not null), the place ``at``, the group's number of leaves ``n``, ``node`` and any others.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, roots, nodes = [], [leaves.where("n = 1").select("g", F.col("node").alias("root"))], leaves
    while most > 1:
        level = materialize(siblings(nodes.where("n > 1"), fanout), "merkle-level")
        levels.append(level)
        nodes = level.where("parent IS NOT NULL").select(
            "g", F.floor(F.col("at") / fanout).alias("at"), F.ceil(F.col("n") / fanout).alias("n"), F.col("parent").alias("node")
        )
        roots.append(nodes.where("n = 1").select("g", F.col("node").alias("root")))
        most = -(-most // fanout)
    path = None
    for depth, level in reversed(list(enumerate(levels))):
        step = F.array(F.struct("left", "right"))
        if path is None:
            path = level.withColumn("path", step)
        else:
            above = path.select(F.col("g").alias("_g"), F.col("at").alias("_at"), F.col("path").alias("_path"))
            on = (F.col("g") == F.col("_g")) & (F.floor(F.col("at") / fanout) == F.col("_at"))
            whole = F.when(F.col("_path").isNull(), step).otherwise(F.concat(step, "_path"))
            path = level.join(above, on, "left").withColumn("path", whole).drop("_g", "_at", "_path")
        path = path.select(*(leaves.columns if depth == 0 else ["g", "at"]), "path")
    alone = leaves.where("n = 1").withColumn("path", F.array().cast(_PATH))
    root = roots[0]
    for r in roots[1:]:
        root = root.unionByName(r)
    return root, alone if path is None else path.unionByName(alone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(hexed(F.concat(step["left"], node, step["right"]))))


def path_digest(path: Column) -> Column:
    """Hex digest of all siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: hexed(F.concat(s["left"], s["right"]))), ""), 256)


def proofs(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The rows with ``subroot``, ``root`` and ``path`` (through the group's tree and the tree of groups) in place of ``grp``.

    ``rows`` is a written table with the group ``grp`` (may be null), the order key ``key``, ``node`` and any others.
    """
    rest = [c for c in rows.columns if c != "grp"]
    groups = materialize(rows.groupBy("grp").agg(F.lit(0).alias("all")), "merkle-groups")
    numbers = materialize(placed(groups, "all", ["grp"]).select(F.col("grp").alias("_grp"), F.col("at").alias("g"), F.col("n").alias("_groups")), "merkle-numbers")
    joined = rows.join(broadcast_checked(numbers), F.col("grp").eqNullSafe(F.col("_grp"))).select("g", *rest)
    leaves = materialize(placed(materialize(joined, "merkle-leaves"), "g", ["key", "node"]), "merkle-places")
    subroots, with_path = tree(leaves, fanout)
    tops = numbers.join(subroots, "g").select(F.lit(0).alias("g"), F.col("g").alias("at"), F.col("_groups").alias("n"), F.col("root").alias("node"))
    root, above = tree(materialize(tops, "merkle-subroots"), fanout)
    above = above.select(F.col("at").alias("g"), F.col("node").alias("subroot"), F.col("path").alias("_above"))
    top = root.select("root").first()
    out = with_path.join(broadcast_checked(materialize(above, "merkle-above")), "g")
    return out.select(
        *rest, "subroot", F.lit(bytes(top["root"]) if top else None).cast("binary").alias("root"), F.concat("path", "_above").alias("path")
    )


def leaves_of(docs: DataFrame) -> DataFrame:
    """A written narrow table of the documents' leaves; ``changed`` is the leaf after tampering, null where there is none."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    fields = [F.col(c) for c in FIELDS]
    changed = leaf_of([*fields[:-1], low])
    return materialize(docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), leaf_of(fields).alias("node"), F.when(hit, changed).alias("changed")), "merkle-rows")


def op13_merkle(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what its tampered form folds to."""
    folded = fold(F.coalesce("changed", "node"), F.col("path"))
    rows = proofs(leaves_of(docs)).select("*", folded.alias("_folded"))
    return rows.select(
        F.col("key").alias("doc_id"), hexed(F.col("node")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        path_digest(F.col("path")).alias("proof_sha256"), hexed(F.col("_folded")).alias("folded_root"), (F.col("_folded") == F.col("root")).alias("verified"),
    )


def _oracle(levels: int = 8, above: int = 3) -> str:
    """SQL for groups of up to 8 ** levels leaves and 8 ** above groups; a tree that is done passes through the other levels."""
    field = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = "sha256(" + " || ".join(field.format(c) for c in FIELDS[:-1]) + " || {0})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten([[(ascii(c) >> b) & 1 for b in range(0, 8)] for c in string_split(CAST(doc_id AS VARCHAR), '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT)"
    ctes = [
        f"d AS MATERIALIZED (SELECT doc_id, lang, {leaf.format(field.format('text'))} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf.format(field.format(low))} END AS changed FROM documents)",
        "p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "a0 AS (SELECT lang, place, n, leaf AS node FROM p)",
    ]
    up = "SELECT {k}, place // 8 AS place, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node FROM {t} GROUP BY {k}, place // 8, n"
    runs = "SELECT {k}, place // 8 AS run, list(node ORDER BY place) AS nodes FROM {t} WHERE n > 1 GROUP BY {k}, place // 8"
    for i in range(levels):
        ctes += [f"a{i + 1} AS MATERIALIZED ({up.format(k='lang', t=f'a{i}')})", f"ar{i} AS ({runs.format(k='lang', t=f'a{i}')})"]
    ctes.append(f"b0 AS MATERIALIZED (SELECT 0 AS w, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n, node FROM a{levels})")
    for i in range(above):
        ctes += [f"b{i + 1} AS MATERIALIZED ({up.format(k='w', t=f'b{i}')})", f"br{i} AS ({runs.format(k='w', t=f'b{i}')})"]
    ctes.append("f0 AS (SELECT p.*, b.place AS spot, b.node AS subroot, coalesce(changed, leaf) AS now, '' AS proof FROM p JOIN b0 b ON b.lang IS NOT DISTINCT FROM p.lang)")
    steps = [(f"ar{i}", "place", i, "r.lang IS NOT DISTINCT FROM f.lang AND ") for i in range(levels)] + [(f"br{i}", "spot", i, "") for i in range(above)]
    for i, (t, spot, k, on) in enumerate(steps):
        slot = f"f.{spot} // {8**k} % 8"
        left, right = f"array_to_string(nodes[1:{slot}], '')", f"array_to_string(nodes[{slot} + 2:], '')"
        ctes.append(
            f"f{i + 1} AS (SELECT f.* EXCLUDE (now, proof), CASE WHEN nodes IS NULL THEN now ELSE sha256({left} || now || {right}) END AS now, proof || CASE WHEN nodes IS NULL THEN '' ELSE {left} || {right} END AS proof "
            f"FROM f{i} f LEFT JOIN {t} r ON {on}r.run = f.{spot} // {8 ** (k + 1)})"
        )
    return "WITH " + ",\n ".join(ctes) + (
        f"\nSELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = root.node AS verified FROM f{len(steps)} CROSS JOIN (SELECT node FROM b{above}) root"
    )


ORACLE = _oracle()
