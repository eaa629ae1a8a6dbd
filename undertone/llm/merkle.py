"""A Merkle manifest of a dataset: every row is a leaf, every group of rows a tree, and the groups' tops make one root.

H is the SHA-256 of its inputs put together, as lower-case hex; digests go into it as hex text. A leaf is H of the row's
fields, each `-` if null, else its length in UTF-8 bytes, `:` and its value. In a group, leaves stand in the order of an
id; while a group has several nodes, every `fan` consecutive ones (the last run may be shorter, even one) become their H.
What is left is the group's top; tops, in the order of their group (null first, bytewise), give the root in the same way.

A level is one window: rows of a group and parent index, in order, over the full frame, collect the run, which is the
parent's preimage and holds each node's siblings. The first node of a run stands for it on the next level, so a level
has an eighth of the rows of the one below. Way back, each node gets its own step (siblings to the left, siblings to
the right) and then its parent's, joined by group and index. Places in a group come from ranges of the whole order that
are sorted apart and numbered from the sizes of the ranges: no group is ever in one task, however large it is.

Defined results: a null id stands before all others, and equal ids are ordered by leaf, so equal rows are interchangeable;
a null group is a group of its own; a null or empty field has a digest of its own each; a single leaf is its group's top,
a single group's top is the root; an empty table gives no rows; columns that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertone.llm.shared import discard, read_table, stored

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A node's siblings on its way up: those to the left and those to the right, put together, level by level.
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda n, s: digest(s["before"], n, s["after"]))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def placed(df: DataFrame, *by: str) -> DataFrame:
    """df as a stored table with idx, the place of a row among those of its group g, and n, their number. by: a total order within groups."""
    ranged = df.repartitionByRange("g", *by).sortWithinPartitions("g", *by).withColumn("__at", F.monotonically_increasing_id())
    rows = stored(ranged, "ranges")
    part = F.shiftright("__at", 33).alias("__part")
    sizes = rows.groupBy(part, "g").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    group = Window.partitionBy("g")
    before = F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumns({"__before": F.coalesce(before, F.lit(0)), "n": F.sum("__rows").over(group)}).drop("__rows")
    found = rows.withColumn("__part", part).join(starts, ["__part", "g"])
    out = stored(found.withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before"), "places")
    return discard(out, rows)


def _runs(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes of groups that have several, with the run of siblings that each stands in."""
    run = Window.partitionBy("g", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.where("n > 1").withColumn("up", F.floor(F.col("idx") / fan)).withColumn("run", F.collect_list("node").over(run))


def levels(nodes: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Tables of g, idx, n and node, from the leaves up; the last level has groups of one node only."""
    most, out = nodes.agg(F.max("n")).first()[0] or 0, [nodes]
    while most > 1:
        first = _runs(out[-1], fan).where(F.col("idx") % fan == 0)
        up = first.select("g", F.col("up").alias("idx"), F.ceil(F.col("n") / fan).alias("n"), digest(F.array_join("run", "")).alias("node"))
        out.append(stored(up, f"level{len(out)}"))
        most = -(-most // fan)
    return out


def tops(tables: list[DataFrame]) -> DataFrame:
    """g and the node at the top of each group."""
    out = [t.where("n = 1").select("g", "node") for t in tables]
    for t in out[1:]:
        out[0] = out[0].unionByName(t)
    return out[0]


def paths(tables: list[DataFrame], above: DataFrame, fan: int = FAN) -> DataFrame:
    """The nodes of the lowest table, with path and the columns of above, which holds g, path and others for the top of each group."""
    others = [c for c in above.columns if c not in ("g", "path")]
    down = None
    for level in reversed(tables):
        found = level.where("n = 1").join(above, "g")
        if down is not None:
            place = (F.col("idx") % fan).cast("int")
            step = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("before"), F.array_join(F.slice("run", place + 2, F.lit(fan)), "").alias("after"))
            parents = down.select("g", F.col("idx").alias("up"), F.col("path").alias("__path"), *others)
            steps = _runs(level, fan).withColumn("__step", step).drop("run").join(parents, ["g", "up"])
            found = found.unionByName(steps.withColumn("path", F.concat(F.array("__step"), "__path")).drop("up", "__step", "__path"))
        down = found
    return down


def manifest(docs: DataFrame, *, fields: Sequence[str] = FIELDS, order: str = "doc_id", group: str = "lang", fan: int = FAN, keep: dict[str, Column] | None = None) -> DataFrame:
    """The order column, leaf, subroot, root and path of each row, and further columns named by keep."""
    keep = keep or {}
    g = F.concat(F.lit("="), F.col(group).cast("string"))
    rows = docs.select(F.col(order).alias("__id"), F.coalesce(g, F.lit("")).alias("g"), leaf([F.col(f) for f in fields]).alias("node"), F.monotonically_increasing_id().alias("__row"), *(c.alias(n) for n, c in keep.items()))
    leaves = stored(rows, "leaves")
    bottom = placed(leaves, "__id", "node", "__row")
    forest = levels(bottom.select("g", "idx", "n", "node"), fan)
    groups = placed(tops(forest).select(F.lit("").alias("g"), F.col("g").alias("__group"), "node"), "__group")
    trunk = levels(groups.select("g", "idx", "n", "node"), fan)
    ground = tops(trunk).select("g", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    over = paths([groups, *trunk[1:]], ground, fan).select(F.col("__group").alias("g"), "path", "root", F.col("node").alias("subroot"))
    out = paths([bottom, *forest[1:]], stored(over, "tops"), fan)
    return discard(out, leaves).select(F.col("__id").alias(order), F.col("node").alias("leaf"), "subroot", "root", "path", *keep)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lowered = F.translate("text", _UPPER, _LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf([lowered if f == "text" else F.col(f) for f in FIELDS]))
    found = manifest(docs, keep={"changed": tampered})
    root = folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"
_LEVELS = """{t} AS (SELECT g, idx, n, node, 0 AS level FROM {leaves}
  UNION ALL SELECT g, idx // 8, (max(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)), level + 1 FROM {t} WHERE n > 1 GROUP BY g, idx // 8, level)"""
#: A node's siblings are looked up by group, level and run; crc32 is spelt out by its polynomial.
SQL = rf"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
d AS (SELECT *, coalesce('=' || lang, '') AS g, {_LEAF} AS leaf FROM documents),
c AS (SELECT d.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a // 256)), 4294967295::BIGINT) % 3 = 0 AND doc_id IS NOT NULL AS changed FROM d, tab),
e AS (SELECT doc_id, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n, CASE WHEN changed THEN {_LEAF.replace("text", f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE leaf END AS shown FROM c),
low AS (SELECT g, idx, n, leaf AS node FROM e),
{_LEVELS.format(t="l", leaves="low")},
s AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, g AS of, node FROM l WHERE n = 1),
{_LEVELS.format(t="u", leaves="s")},
runs AS (SELECT 'low' AS tree, g, level, idx // 8 AS up, list(node ORDER BY idx) AS run FROM l WHERE n > 1 GROUP BY ALL UNION ALL SELECT 'top', g, level, idx // 8, list(node ORDER BY idx) FROM u WHERE n > 1 GROUP BY ALL),
f AS (SELECT doc_id, leaf, e.g AS lang, s.node AS subroot, s.idx AS place, 'low' AS tree, e.g AS g, e.idx AS idx, 0 AS level, e.n AS n, s.n AS m, '' AS proof, shown AS node FROM e JOIN s ON s.of = e.g
  UNION ALL
  SELECT doc_id, leaf, f.lang, subroot, place, f.tree, f.g, CASE WHEN r.run IS NULL THEN place ELSE f.idx // 8 END, CASE WHEN r.run IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN r.run IS NULL THEN m ELSE (n + 7) // 8 END, m,
    proof || coalesce(array_to_string(list_concat(r.run[: f.idx % 8], r.run[f.idx % 8 + 2 :]), ''), ''),
    CASE WHEN r.run IS NULL THEN node ELSE sha256(array_to_string(list_concat(r.run[: f.idx % 8], [node], r.run[f.idx % 8 + 2 :]), '')) END
  FROM (SELECT doc_id, leaf, lang, subroot, place, CASE WHEN n = 1 THEN 'top' ELSE tree END AS tree, CASE WHEN n = 1 THEN '' ELSE g END AS g, CASE WHEN n = 1 THEN place ELSE idx END AS idx, CASE WHEN n = 1 THEN 0 ELSE level END AS level, CASE WHEN n = 1 THEN m ELSE n END AS n, m, proof, node FROM f WHERE n > 1 OR tree = 'low') f
  LEFT JOIN runs r ON r.tree = f.tree AND r.g = f.g AND r.level = f.level AND r.up = f.idx // 8 AND f.n > 1)
SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT node FROM u WHERE n = 1) AS verified FROM f WHERE tree = 'top' AND n = 1
"""
