"""Merkle manifest of a dataset: subroots per source, one root, and a proof for every document.

A leaf is the hash of a document's fields. Per source the leaves stand in order; while several
nodes remain, every ``WIDTH`` consecutive ones become their hash. The subroots of the sources, in
order, become one root in the same way.

Nodes carry nested-interval labels: the ranks ``[lo, hi)`` of the leaves below them. Ranks come from
one range-partitioned sort (position within the partition, plus what lies in the partitions before),
so a source of any size is ranked by all tasks. A node of level *k* falls into the bucket
``lo div WIDTH**(k+1)`` of the level above, and the ancestor is the one of that bucket whose interval
contains its own. Its siblings are the ancestor's children left and right of that interval. Paths go
down level by level: each join carries the path of a node to at most ``WIDTH`` children, so no group
is larger than that, whatever source it belongs to, and texts are never shuffled.

Defined results: null fields count as ``-``; a null source is a source of its own and the first one,
null ids come first within a source. Documents of equal id are ordered by their leaf; rows equal in
all fields are leaves of their own, with equal hashes. A lone leaf is its subroot and a lone subroot
is the root. An empty table gives no rows. Other columns, whatever they are called, do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import LOWER, UPPER
from folioflow.operators.shared import materialise

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<before:string,after:string>>"


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each with its length in bytes; ``-`` for null."""
    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[one(f) for f in fields]), 256)


def ranked(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, within ``key`` in ``order``) and ``n``, the rows of the key.

    The sorted rows are written with their number within the partition; a table of one row per
    partition and key then says what to add. No task sees more than a partition.
    """
    by = [key, *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "ordered").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    shifts = materialise(sizes.select(
        key, "_part", shift.alias("_shift"), F.sum("_n").over(Window.partitionBy(key)).alias("n")), "offsets")
    return placed.join(shifts, [key, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift", "_first", "_n")


def tree(leaves: DataFrame, key: str, digest: str, carry: Sequence[str]) -> list[DataFrame]:
    """Nodes of the levels 1, 2, …: ``key, n, lo, hi, digest, children``; all of a tree's leaves are below level 1.

    ``children`` are ``STRUCT<lo, hi, digest, …carry>``. Trees that are complete have no nodes in
    higher levels; a lone leaf has a node of level 1 with the leaf's own hash.
    """
    kept = [key, "n", "lo", "hi", "digest"]
    nodes = leaves.select(key, "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col(digest).alias("digest"), *carry)
    out: list[DataFrame] = []
    span = WIDTH
    while True:
        child = F.struct("lo", "hi", "digest", *([] if out else carry))
        groups = nodes.groupBy(key, "n", F.expr(f"lo div {span}").alias("bucket")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(child)).alias("children"))
        whole = F.sha2(F.array_join(F.col("children.digest"), ""), 256)
        lone = F.get("children", F.lit(0))["digest"]
        level = groups.select(key, "n", "lo", "hi", F.when(F.col("n") == 1, lone).otherwise(whole).alias("digest"), "children")
        out.append(materialise(level, f"level{len(out) + 1}"))
        nodes = out[-1].where(F.col("n") > span).select(kept)
        span *= WIDTH
        if nodes.isEmpty():
            return out


def roots(levels: Sequence[DataFrame]) -> list[DataFrame]:
    """Of each level the nodes that are roots of their trees."""
    return [level.where(F.col("n") <= WIDTH ** k) for k, level in enumerate(levels, 1)]


def _siblings(children: Column, lo: Column, hi: Column) -> Column:
    """The children's digests outside ``[lo, hi)``, before and after it."""
    beside = lambda test: F.array_join(F.transform(F.filter(children, test), lambda c: c["digest"]), "")
    return F.struct(beside(lambda c: c["hi"] <= lo).alias("before"), beside(lambda c: c["lo"] >= hi).alias("after"))


def paths(levels: Sequence[DataFrame], key: str, above: DataFrame) -> DataFrame:
    """Every leaf's carried columns with ``digest, path`` and the columns of ``above``.

    ``above(key, path, …)`` has a row per tree: the siblings from that tree's root upwards.
    """
    extra = [c for c in above.columns if c != key]
    names = [key, "n", "lo", "hi", "children", *extra]
    found: DataFrame | None = None
    for k in range(len(levels), 0, -1):
        here = roots(levels)[k - 1].join(above, key).select(names)
        if found is not None:
            bucket = F.expr(f"lo div {WIDTH ** (k + 1)}")
            up = found.select(
                F.col(key).alias("_key"), bucket.alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                F.col("children").alias("_children"), F.col("path").alias("_path"), *[F.col(c) for c in extra if c != "path"])
            inner = levels[k - 1].where(F.col("n") > WIDTH ** k).join(up, (
                (F.col(key) == F.col("_key")) & (bucket == F.col("_bucket")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))))
            own = _siblings(F.col("_children"), F.col("lo"), F.col("hi"))
            here = here.unionByName(inner.withColumn("path", F.concat(F.array(own), "_path")).select(names))
        found = here
    each = found.withColumn("leaf", F.explode("children"))
    own = _siblings(F.col("children"), F.col("leaf.lo"), F.col("leaf.hi"))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(own), "path"))
    return each.select(key, "leaf.*", path.alias("path"), *[c for c in extra if c != "path"]).drop("lo", "hi")


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def manifest(documents: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of ``documents``.

    ``folded_root`` starts from the leaf of the document as it is presented: where ``tampered``, with
    A-Z of its text in lower case. ``proof_sha256`` is the hash of all siblings on the way to the root.
    """
    fields = [F.col(f) for f in FIELDS]
    lowered = [F.translate(f, UPPER, LOWER) if n == "text" else f for n, f in zip(FIELDS, fields)]
    source = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))  # null first
    leaves = documents.select(
        "doc_id", source.alias("tree"), leaf_of(fields).alias("leaf"), F.when(tampered, leaf_of(lowered)).alias("presented"))
    # written first: a range partitioning reads its input twice, and texts are to be read and hashed once
    placed = ranked(materialise(leaves, "leaves"), "tree", ["doc_id", "leaf"])
    levels = tree(placed, "tree", "leaf", ["doc_id", "presented"])
    tops = [top.select("tree", F.col("digest").alias("subroot")) for top in roots(levels)]
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.unionByName(top)
    over = tree(ranked(subroots.withColumn("all", F.lit("")), "all", ["tree"]), "all", "subroot", ["tree"])
    start = over[-1].select("all", F.col("digest").alias("root"), F.array().cast(STEP).alias("path"))
    sources = paths(over, "all", start).select("tree", F.col("digest").alias("subroot"), "root", "path")
    found = paths(levels, "tree", materialise(sources, "sources"))
    steps = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    done = found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.array_join(steps, ""), 256).alias("proof_sha256"),
        folded(F.coalesce("presented", "digest"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(source_levels: int = 7, root_levels: int = 4) -> str:
    """SQL for up to ``16 ** source_levels`` documents of a source and ``16 ** root_levels`` sources."""
    def leaf(text: str) -> str:
        part = lambda f: f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')"
        return f"sha256({' || '.join(part(text if f == 'text' else f) for f in FIELDS)})"

    def climb(name: str, by: str, n: int) -> str:
        up = [f"""{name}{k} AS (
  SELECT {by}, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (m + 15) // 16 AS m
  FROM {name}{k - 1} WHERE m > 1 GROUP BY {by}, pos // 16, m)""" for k in range(1, n + 1)]
        side = [f"""{name}x{k} AS (
  SELECT {by}, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WHERE m > 1 WINDOW w AS (PARTITION BY {by}, pos // 16 ORDER BY pos))""" for k in range(n)]
        return ", ".join(up + side)

    def fold(name: str, before: str, on: str, n: int) -> str:
        steps = [f"""{name}f{k} AS (
  SELECT f.* REPLACE (CASE WHEN x.l IS NULL THEN f.d ELSE sha256(x.l || f.d || x.r) END AS d, f.proof || coalesce(x.l || x.r, '') AS proof)
  FROM {before if k == 0 else f'{name}f{k - 1}'} f LEFT JOIN {name}x{k} x ON x.pos = f.{on} // {16 ** k} AND x.tree IS NOT DISTINCT FROM f.{'tree' if name == 'a' else 'one'})"""
                 for k in range(n)]
        return ", ".join(steps)

    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""
    return f"""
WITH d AS (
  SELECT doc_id, source AS tree, {leaf('text')} AS leaf,
    CASE WHEN doc_id IS NULL OR {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS presented FROM documents),
p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS m FROM d),
a0 AS (SELECT tree, pos, leaf AS h, m FROM p), {climb('a', 'tree', source_levels)},
sub AS ({' UNION ALL '.join(f'SELECT tree AS s, h FROM a{k} WHERE m = 1' for k in range(source_levels + 1))}),
b0 AS (SELECT 1 AS tree, s, h, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM sub), {climb('b', 'tree', root_levels)},
top AS ({' UNION ALL '.join(f'SELECT h FROM b{k} WHERE m = 1' for k in range(root_levels + 1))}),
start AS (
  SELECT p.doc_id, p.tree, 1 AS one, p.leaf, p.pos, s.pos AS spos, s.h AS subroot, p.presented AS d, '' AS proof
  FROM p JOIN b0 s ON s.s IS NOT DISTINCT FROM p.tree),
{fold('a', 'start', 'pos', source_levels)}, {fold('b', f'af{source_levels - 1}', 'spos', root_levels)}
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = top.h AS verified FROM bf{root_levels - 1}, top
"""
