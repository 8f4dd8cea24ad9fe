"""Merkle dataset manifest with proofs by content-addressed DAG descent.

A leaf is H of its row's fields (H: lowercase hex SHA-256 of the concatenated inputs,
digests as hex text). The leaves of a language ascend by id; every ``FAN`` consecutive
nodes become their H until one node, the subroot, is left. The subroots, by language,
become the root the same way.

Storing: every inner node is a record digest -> children, one per distinct digest, so the
tables of a dataset and of its next version share what did not change. Levels are one
aggregation each, over FAN times fewer rows than the last.

Proofs: requests for the leaves descend from the root. Leaves with the same digits so
far travel as one request, so the root is one row and no key is hot: a step joins the
requests with the records on the digest, splits them by the next rank digit (the children's
places) and collects the children not taken as a segment (left, right). At the bottom the
segments are reversed: leaf to root. A proof is then checked by folding the leaf
with its segments.

Ranks come from range-partitioned blocks, so a language with most of the rows is spread
over all tasks. Nothing reaches the driver but the height.

Defined cases: a null field counts as ``-``; a null language is a language of its own,
first in order; null ids come first in their language; equal ids are ordered by leaf digest
and repeated rows are leaves each; a null id is never tampered with; a lone leaf is its
language's subroot and a lone subroot the root; a null text stays null when tampered with;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import UPPER, ascii_lower, crc32_sql, in_order, stored, table

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 3                  # ids whose CRC-32 it divides are tampered with in the query
HEX = 64                    # letters of a digest
SEGMENT = "struct<left:string,right:string>"


def h(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf_digest(fields: list[Column]) -> Column:
    """H over the fields: ``-`` for a null, else byte count, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")),
                        F.lit("-")) for c in fields]
    return h(F.concat(*parts))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, given): ``given`` is the leaf of the row with ``changed`` as its
    text, if given. ``tree`` names the language and orders as the languages do, null first."""
    own = [F.col(c) for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    leaf = leaf_digest(own)
    given = leaf if changed is None else leaf_digest([*own[:-1], changed])
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
                       given.alias("given"))


def build(nodes: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame | None]:
    """Trees over ``nodes(tree, pos, n, digest)``, n nodes each: their tops (tree, digest,
    height) and the records (digest, children) of all inner nodes, None without any."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops, records, height = [], [], 0
    while True:
        tops.append(nodes.filter("n = 1").select("tree", "digest", F.lit(height).alias("height")))
        if most <= 1:
            break
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))),
                                            lambda x: x["digest"]), "")
        level = (nodes.filter("n > 1").groupBy("tree", F.floor(F.col("pos") / fan).alias("pos"))
                 .agg(F.first("n").alias("n"), children.alias("children")))
        nodes = stored(level.select("tree", "pos", F.ceil(F.col("n") / fan).alias("n"),
                                    h(F.col("children")).alias("digest"), "children"), "merkle-level")
        records.append(nodes.select("digest", "children"))
        most, height = -(-most // fan), height + 1
    made = reduce(DataFrame.unionAll, records).dropDuplicates(["digest"]) if records else None
    return reduce(DataFrame.unionAll, tops), made


def descend(requests: DataFrame, records: DataFrame | None, fan: int = FAN, stop: int = 0) -> DataFrame:
    """Follow ``requests(tree, pos, height, digest, path, ...)`` down to ``stop`` levels above
    the leaves. ``pos`` is a node's place in its level; each step appends a segment. Other
    columns travel along."""
    kept = [c for c in requests.columns if c not in ("pos", "height", "digest", "path")]
    found, left = [requests.filter(F.col("height") <= stop)], requests.filter(F.col("height") > stop)
    for _ in range(requests.agg(F.max("height")).first()[0] or 0 if records is not None else 0):
        step = left.join(records, "digest")
        size = F.length("children") / HEX
        digit = F.explode(F.sequence(F.lit(0), size.cast("int") - 1)).alias("digit")
        down = step.select(*kept, "pos", "height", "path", "children", digit)
        below = segment_of(F.col("children"), F.col("digit"))
        left = stored(down.select(
            *kept, (F.col("pos") * fan + F.col("digit")).alias("pos"), (F.col("height") - 1).alias("height"),
            F.expr(f"substring(children, {HEX} * digit + 1, {HEX})").alias("digest"),
            F.concat("path", F.array(below)).alias("path")).select(*requests.columns), "merkle-requests")
        found.append(left.filter(F.col("height") <= stop))
        left = left.filter(F.col("height") > stop)
        if stop and not left.head(1):
            break
    return reduce(DataFrame.unionAll, found)


def segment_of(children: Column, digit: Column) -> Column:
    """The children not taken: those before and those after the one at ``digit``."""
    return F.struct(F.substring(children, F.lit(1), digit * HEX).alias("left"),
                    F.substring(children, (digit + 1) * HEX + 1, F.length(children)).alias("right"))


def manifest(docs: DataFrame, changed: Column | None = None, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof (segments from leaf
    to root), given (the leaf after ``changed``)."""
    placed = in_order(leaves(docs, changed), [F.col("tree"), F.asc_nulls_first("doc_id"), F.col("leaf")], ["tree"],
                      "merkle")
    sizes = stored(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle-sizes")
    sized = placed.join(sizes, "tree").select("tree", "pos", "n", F.col("leaf").alias("digest"))
    tops, records = build(sized, fan)
    tops = stored(tops, "merkle-tops")
    # the tree over the subroots is built and descended in the same way
    order = in_order(tops.withColumn("all", F.lit("")), [F.col("all"), F.col("tree")], ["all"], "merkle-order")
    upper = order.select(F.col("all").alias("tree"), "pos", F.lit(order.count()).cast("long").alias("n"), "digest")
    top, top_records = build(upper, fan)
    start = top.select("tree", F.lit(0).cast("long").alias("pos"), "height", "digest",
                       F.lit(None).cast(f"array<{SEGMENT}>").alias("path"))
    start = start.withColumn("path", F.coalesce("path", F.array().cast(f"array<{SEGMENT}>")))
    subs = descend(start, top_records, fan).select("pos", "path").join(order.drop("all"), "pos")
    requests = subs.select("tree", F.col("digest").alias("subroot"), F.lit(0).cast("long").alias("pos"), "height",
                           "digest", "path")
    low = descend(stored(requests, "merkle-subroots"), records, fan, stop=1)
    if records is None:                                 # every language is a lone leaf
        low = low.withColumn("children", F.lit(None).cast("string"))
    else:
        low = low.join(records, "digest", "left")
    bottom = low.select("tree", F.col("pos").alias("up"), "subroot", "height", "path", "children")
    root = top.first()
    own = placed.withColumn("up", F.floor(F.col("pos") / fan))
    last = segment_of(F.col("children"), (F.col("pos") % fan).cast("int"))
    rows = own.join(bottom, ["tree", "up"]).withColumn(
        "path", F.when(F.col("height") > 0, F.concat("path", F.array(last))).otherwise(F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"),
                       F.reverse("path").alias("proof"), "given")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its segments lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: h(F.concat(s["left"], acc, s["right"])))


def proof_digest(proof: Column) -> Column:
    """H over all siblings of a proof, leaf to root, left to right."""
    return h(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.col("text").cast("string")
    changed = F.when(F.coalesce(crc % TAMPER == 0, F.lit(False)), ascii_lower(text)).otherwise(text)
    return manifest(docs, changed).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.col("given"), F.col("proof")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 8) -> str:
    """The tree level by level, for up to FAN ** levels leaves a language and languages."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    changed = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    before = " || ".join(field(c) for c in FIELDS[:-1])
    crc = crc32_sql("doc_id::VARCHAR")
    ctes = [f"""leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, lang, sha256({before} || {field('text')}) AS leaf,
        sha256({before} || CASE WHEN coalesce({crc} % {TAMPER} = 0, false) THEN {field(changed)} ELSE {field('text')} END)
        AS given FROM documents))"""]

    def tree(name: str, group: str) -> None:
        for k in range(levels):
            ctes.append(f"""{name}g{k} AS (SELECT {group}, pos, d, count(*) OVER t AS n,
  coalesce(string_agg(d, '') OVER (PARTITION BY {group}, pos // {FAN} ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (PARTITION BY {group}, pos // {FAN} ORDER BY pos
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WINDOW t AS (PARTITION BY {group}))""")
            ctes.append(f"""{name}{k + 1} AS (SELECT {group}, pos // {FAN} AS pos, CASE WHEN max(n) = 1 THEN max(d)
  ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}g{k} GROUP BY {group}, pos // {FAN})""")

    def fold(name: str, group: str, source: str) -> str:
        """``source`` with ``proof`` extended and ``given`` folded through the tree."""
        for k in range(levels):
            step = f"{name}f{k}"
            ctes.append(f"""{step} AS (SELECT s.* EXCLUDE (given, proof, place), s.place // {FAN} AS place,
  s.proof || g.l || g.r AS proof, CASE WHEN g.n = 1 THEN s.given ELSE sha256(g.l || s.given || g.r) END AS given
  FROM {source} s JOIN {name}g{k} g ON s.place = g.pos AND s.{group} IS NOT DISTINCT FROM g.{group})""")
            source = step
        return source

    ctes.append("a0 AS (SELECT lang, pos, leaf AS d FROM leaves)")
    tree("a", "lang")
    ctes.append("b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, d, lang FROM "
                f"a{levels})")
    ctes.append("p0 AS (SELECT doc_id, lang, leaf, given, '' AS proof, pos AS place, 0 AS one FROM leaves)")
    low = fold("a", "lang", "p0")
    tree("b", "one")
    ctes.append(f"q0 AS (SELECT s.* EXCLUDE (place), b0.pos AS place, b0.d AS subroot FROM {low} s "
                "JOIN b0 ON s.lang IS NOT DISTINCT FROM b0.lang)")
    top = fold("b", "one", "q0")
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, (SELECT d FROM b{levels}) AS root, "
            f"sha256(proof) AS proof_sha256, given AS folded_root, given = (SELECT d FROM b{levels}) AS verified FROM {top}")


SQL = _sql()
