"""A Merkle manifest of documents: a tree for each source by pivoting children into slots, and one over the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import table, written
from tabframe.plans.position import POS, SortKey, number_by_key

#: Nodes of a run, which become one node of the level above.
FANOUT = 3
SLOTS = [f"s{i}" for i in range(FANOUT)]
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other; null parts count as empty."""
    return sf.sha2(sf.concat(*(sf.coalesce(p, sf.lit("")) for p in parts)), 256)


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a document: of each field its length in bytes, a colon and the value, or a dash for null."""
    texts = [values[c].cast("string") for c in FIELDS]
    return digest(*(sf.coalesce(sf.concat(sf.octet_length(t).cast("string"), sf.lit(":"), t), sf.lit("-")) for t in texts))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The runs of every level of the trees in ``nodes`` (tree, at, n, node and more), from the leaves up.

    A run has its number ``at`` in its tree, the number ``n`` of runs of its tree at its level, its children as structs
    in the columns of SLOTS, and their digest ``node``. A tree ends where it has one node. The key of a run is its tree and
    number, so a tree that holds most of the rows is spread like any other.
    """
    out, most = [], nodes.agg(sf.max("n")).first()[0] or 0
    while most > 1:
        child = sf.struct(*(c for c in nodes.columns if c not in ("tree", "at", "n")))
        slot = [sf.max(sf.when(sf.col("at") % FANOUT == i, child)).alias(c) for i, c in enumerate(SLOTS)]
        up = sf.expr(f"at div {FANOUT}").alias("at")
        runs = nodes.where("n > 1").groupBy("tree", up).agg(sf.expr(f"max(n + {FANOUT - 1}) div {FANOUT}").alias("n"), *slot)
        out.append(written(runs.withColumn("node", digest(*(sf.col(c)["node"] for c in SLOTS))), "merkle"))
        nodes, most = out[-1].select("tree", "at", "n", "node"), -(-most // FANOUT)
    return out


def tops(nodes: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """tree, node: the last node of every tree."""
    found = nodes.where("n = 1").select("tree", "node")
    for level in runs:
        found = found.union(level.where("n = 1").select("tree", "node"))
    return found


def paths(runs: list[DataFrame], above: DataFrame) -> DataFrame:
    """The children of the lowest level with what is beside them on the way up, ``path``: for each level what stands left
    and right of the node in its run. ``above`` (tree, path and more) is what follows each tree's last node."""
    rest = [c for c in above.columns if c != "tree"]
    known = None
    for i, level in reversed(list(enumerate(runs))):
        ends = level.where("n = 1").select("tree", "at").join(above, "tree")
        known = ends if known is None else known.unionByName(ends)
        both = level.select("tree", "at", *SLOTS).join(known, ["tree", "at"])
        shape = "array<struct<left:string,right:string>>"
        each = []
        for own, c in enumerate(SLOTS):
            sides = [sf.concat(sf.lit(""), *(sf.coalesce(sf.col(s)["node"], sf.lit("")) for s in part))
                     for part in (SLOTS[:own], SLOTS[own + 1 :])]
            step = sf.array(sf.struct(sides[0].alias("left"), sides[1].alias("right"))).cast(shape)
            each.append(sf.struct((sf.col("at") * FANOUT + own).alias("at"), sf.col(c).alias("child"), step.alias("step")))
        opened = both.select("tree", *rest, sf.explode(sf.array(*each)).alias("c")).where("c.child is not null")
        below = opened.select("tree", sf.col("c.at").alias("at"), sf.col("c.child").alias("child"),
                              *(sf.concat("c.step", "path").alias("path") if c == "path" else sf.col(c) for c in rest))
        known = below if i == 0 else written(below.drop("child"), "merkle")
    return known


def folded(start: Column, path: Column) -> Column:
    """The digest that a leaf and what is beside it on the way up lead to."""
    return sf.aggregate(path, start, lambda x, s: sf.sha2(sf.concat(s["left"], x, s["right"]), 256))


def manifest(docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source.

    ``docs`` needs doc_id, source, lang, n_chars and text; other columns, whatever their names, are not looked at. Nulls
    in any of the five count as such, an empty text is a text. Leaves of a source stand by doc_id, null first; rows with one
    id by the digest of their contents, and repeated rows are leaves of their own. A null source is a source, the first one. An
    empty table gives no rows. Texts are hashed whole, and only digests leave the tasks that read them.

    ``seen`` is the text that is verified, a column over ``docs`` (by default the text itself): folded_root is computed from
    the leaf with that text and the original siblings, and verified says whether it is the root.
    """
    own = {c: sf.col(c) for c in FIELDS}
    now = leaf(own) if seen is None else leaf(own | {"text": seen})
    leaves = written(docs.select("doc_id", "source", leaf(own).alias("node"), now.alias("now")), "merkle")
    placed = number_by_key(leaves, [SortKey(sf.col(c)) for c in ("source", "doc_id", "node")], unique=False).placed
    placed = written(placed, "merkle")
    sources = placed.groupBy("source").agg(sf.min(POS).alias("first"), sf.count("*").alias("n"))
    order = written(number_by_key(sources, [SortKey(sf.col("source"))], unique=True).placed.withColumnRenamed(POS, "tree"), "merkle")
    named = order.select(sf.col("source").alias("name"), "first", "n", "tree")
    nodes = placed.join(named, sf.col("source").eqNullSafe(sf.col("name"))).select(
        "tree", (sf.col(POS) - sf.col("first")).alias("at"), "n", "node", "now", "doc_id", "source")
    nodes = written(nodes, "merkle")
    runs = levels(nodes)
    # the tree over the sources
    subroots = written(tops(nodes, runs), "merkle")
    top = subroots.select(sf.lit(0).cast("long").alias("tree"), sf.col("tree").alias("at"), sf.lit(order.count()).alias("n"), "node")
    top_runs = levels(top)
    root = tops(top, top_runs).first()
    root = sf.lit(root["node"] if root else None).cast("string")
    none = sf.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path")
    if top_runs:
        found = paths(top_runs, docs.sparkSession.range(1).select(sf.col("id").alias("tree"), none))
        above = found.select(sf.col("at").alias("tree"), "path", sf.col("child.node").alias("subroot"))
    else:
        above = subroots.select("tree", none, sf.col("node").alias("subroot"))
    above = written(above, "merkle")
    fields = ["doc_id", "source", "node", "now"]
    out = nodes.where("n = 1").select("tree", *fields).join(above, "tree").select(*fields, "path", "subroot")
    if runs:
        out = out.union(paths(runs, above).select(*(sf.col("child")[c].alias(c) for c in fields), "path", "subroot"))
    beside = sf.transform("path", lambda s: sf.concat(s["left"], s["right"]))
    out = out.select("doc_id", sf.col("node").alias("leaf"), "subroot", root.alias("root"),
                     sf.sha2(sf.array_join(beside, ""), 256).alias("proof_sha256"),
                     folded(sf.col("now"), sf.col("path")).alias("folded_root"), "source")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (sf.col("folded_root") == sf.col("root")).alias("verified"), "source")


def tampered() -> Column:
    """The text without newlines where 2 divides the crc32 of the id, else the text."""
    even = sf.crc32(sf.col("doc_id").cast("string")) % 2 == 0
    return sf.when(even, sf.replace("text", sf.lit("\n"), sf.lit(""))).otherwise(sf.col("text"))


def op13_merkle(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"), tampered())


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar)) || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if c == "text" else c) for c in FIELDS) + ")"


ORACLE = f"""
with recursive
marked as (
    select *, case when list_reduce(list_transform(split(doc_id::varchar, ''), lambda d: ascii(d)::bigint), lambda crc, byte:
        list_reduce(range(8), lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295::bigint) & 1 = 1
        then replace(text, chr(10), '') else text end as seen from documents),
leaves as (select doc_id, source, {_leaf("text")} as leaf, {_leaf("seen")} as now from marked),
placed as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
           count(*) over (partition by source) as n from leaves),
up as (
    select source, 0 as level, pos, n, leaf as node from placed
    union all
    select source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' order by pos)) from up where n > 1
    group by source, level, pos // 3, n),
subroots as (
    select source, node as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n
    from up where n = 1),
over_sources as (
    select 0 as level, pos, n, subroot as node from subroots
    union all
    select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' order by pos)) from over_sources where n > 1
    group by level, pos // 3, n),
steps as (
    select p.source, p.pos, 0 as tree, u.level,
           coalesce(string_agg(node, '' order by u.pos) filter (where u.pos < p.pos // (3 ** u.level)::bigint), '') as l,
           coalesce(string_agg(node, '' order by u.pos) filter (where u.pos > p.pos // (3 ** u.level)::bigint), '') as r
    from placed p join up u on u.source is not distinct from p.source and u.n > 1 and u.pos // 3 = p.pos // (3 ** (u.level + 1))::bigint
    group by p.source, p.pos, u.level
    union all
    select p.source, p.pos, 1, u.level,
           coalesce(string_agg(node, '' order by u.pos) filter (where u.pos < s.pos // (3 ** u.level)::bigint), ''),
           coalesce(string_agg(node, '' order by u.pos) filter (where u.pos > s.pos // (3 ** u.level)::bigint), '')
    from placed p join subroots s on s.source is not distinct from p.source
    join over_sources u on u.n > 1 and u.pos // 3 = s.pos // (3 ** (u.level + 1))::bigint
    group by p.source, p.pos, u.level),
ways as (select source, pos, list({{'l': l, 'r': r}} order by tree, level) as way from steps group by source, pos),
results as (
    select p.doc_id, p.leaf, s.subroot, (select node from over_sources where n = 1) as root,
           sha256(coalesce(list_reduce(list_transform(way, lambda w: w.l || w.r), lambda a, b: a || b), '')) as proof_sha256,
           coalesce(list_reduce(way, lambda x, w: sha256(w.l || x || w.r), p.now), p.now) as folded_root, p.source
    from placed p join subroots s on s.source is not distinct from p.source
    left join ways w on w.source is not distinct from p.source and w.pos = p.pos)
select *, folded_root = root as verified from results
"""
