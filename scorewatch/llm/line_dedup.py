"""Line deduplication by a suffix array over line-ID sequences (native).

The corpus is one sequence of lines per document, documents in id order. A run
of whole lines that occurred before (earlier document, or earlier in the same
one) and holds at least ``min_words`` words is a copy; all lines of all such
copies are deleted, first occurrences stay.

* Level 0 ranks the lines that occur twice or more; every other line ends a
  run. Consecutive repeated lines form islands; islands below ``min_words``
  cannot hold a copy and drop out, which leaves a small part of the corpus.
* Prefix doubling: the level k rank of a suffix orders it by its first 2^k
  lines, from the pair of its level k-1 ranks at p and p + 2^(k-1). Ranks
  come from a range sort of the distinct pairs that occur twice or more, so a
  suffix unique at this depth is dropped at once. The successor is found by an
  equi-join on (document, line), whose keys are unique: no hot key. Doubling
  stops at the depth of the longest window below.
* LCP intervals: the suffixes whose first n lines agree form the interval of
  depth n, named by the ranks of its two overlapping power-of-two blocks. Line x
  lies in a long enough copy exactly if the shortest window of ``min_words``
  words from some line on covers x, or the shortest one ending at x does, and
  that window's interval has an earlier member. (Shrink the copy around x
  from the left, then from the right: one of the two remains.) Hence the
  deleted lines are precisely the union of all maximal repeated runs' copies,
  and adjoining windows merge into maximal runs.

Groups reduce to (count, smallest place) with a map-side combine; joins back to
a hot line's rows have one row per key on the other side, both sides read from
stored tables, so AQE splits the hot partition.

Defined cases: a null text stays null and an empty text stays empty; a null id
sorts last, equal ids in table order; words are maximal runs of non-space
characters; blank lines have none and are part of runs; a text whose lines all
go becomes empty, its row stays; an empty table gives an empty result; other
columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorewatch.llm.common import WORD, fresh_name, stored, table

MIN_WORDS = 10
PLACE = ["key", "rid", "ln"]          # document order, document row, line


def line_rows(docs: DataFrame, rid: str, id_col: str, text_col: str) -> DataFrame:
    """One row per line: place, 128-bit line id, number of words."""
    lines = docs.filter(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("key"), F.col(rid).alias("rid"),
        F.posexplode(F.split(text_col, "\n", -1)).alias("ln", "line"))
    return lines.select(*PLACE, F.unhex(F.md5("line")).alias("id"),
                        F.regexp_count("line", F.lit(WORD)).alias("words"))


def ranked(pairs: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Ranks, in key order, of the keys that occur at least twice."""
    repeated = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return stored(repeated.repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .withColumn(name, F.monotonically_increasing_id()), "line-ranks")


def islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Runs of consecutive repeated lines that hold ``min_words`` words or more."""
    by_doc = W.partitionBy("rid").orderBy("ln")
    runs = lines.withColumn("island", F.col("ln") - F.row_number().over(by_doc))
    total = F.sum("words").over(W.partitionBy("rid", "island"))
    return runs.withColumn("total", total).filter(F.col("total") >= min_words).drop("total")


def windows(suffixes: DataFrame, min_words: int) -> DataFrame:
    """Shortest windows of ``min_words`` words inside each island: from each line
    on and up to each line, as (place of the start, lines, covers). ``covers`` is
    how many of its last lines a hit deletes: all of them, or the last one."""
    isl = W.partitionBy("rid", "island")
    cum = F.sum("words").over(isl.orderBy("ln").rowsBetween(W.unboundedPreceding, 0))
    s = suffixes.select(*PLACE, "island", "words", cum.cast("long").alias("upto"))
    before = F.col("upto") - F.col("words")
    # first end whose running total reaches (total before the start) + min_words:
    # starts and ends as one sorted list of marks, read from the far end
    marks = (s.select(*PLACE, "island", (before + min_words).alias("at"), F.lit(0).alias("end"))
             .unionAll(s.select(*PLACE, "island", F.col("upto").alias("at"), F.lit(1).alias("end"))))
    down = isl.orderBy(F.desc("at"), F.desc("end"), F.desc("ln"))
    nearest = F.last(F.when(F.col("end") == 1, F.col("ln")), True).over(
        down.rowsBetween(W.unboundedPreceding, 0))
    fwd = (marks.withColumn("last", nearest).filter("end = 0 AND last IS NOT NULL")
           .withColumn("last", F.greatest("last", "ln"))
           .select(*PLACE, (F.col("last") - F.col("ln") + 1).alias("n")).withColumn("covers", F.col("n")))
    # latest start with (total before the start) <= (total up to the end) - min_words
    marks = (s.select(*PLACE, "island", before.alias("at"), F.lit(0).alias("end"))
             .unionAll(s.select(*PLACE, "island", (F.col("upto") - min_words).alias("at"),
                                F.lit(1).alias("end"))))
    up = isl.orderBy("at", "end", "ln").rowsBetween(W.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("end") == 0, F.col("ln")), True).over(up)
    bwd = (marks.withColumn("first", latest).filter("end = 1 AND first IS NOT NULL")
           .withColumn("first", F.least("first", "ln"))
           .select("key", "rid", F.col("first").alias("start"), F.col("ln")))
    bwd = bwd.select("key", "rid", F.col("start").alias("ln"),
                     (F.col("ln") - F.col("start") + 1).alias("n")).withColumn("covers", F.lit(1))
    return fwd.unionByName(bwd)


def copied_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """(rid, ln) of every line that lies in a copy of at least ``min_words`` words."""
    level = ranked(lines, ["id"])
    start = islands(lines.join(level, "id").select(*PLACE, "words", "rank"), min_words)
    suffixes = stored(start, "line-suffixes")
    wins = stored(windows(suffixes, min_words), "line-windows")
    longest = wins.agg(F.max("n")).first()[0] or 0
    hits, width = [], 1
    at = suffixes.select(*PLACE, "rank")
    while longest:
        # windows of width <= n < 2 * width lines: two overlapping blocks of `width`
        own = wins.filter((F.col("n") >= width) & (F.col("n") < 2 * width))
        tail = at.select("rid", (F.col("ln") + width).alias("stop"), F.col("rank").alias("rank2"))
        named = (own.join(at, PLACE).withColumn("stop", (F.col("ln") + F.col("n")).cast("int"))
                 .join(tail, ["rid", "stop"]))
        hits.append(stored(named.select(*PLACE, "n", "covers", "rank", "rank2"), "line-intervals"))
        if 2 * width > longest:
            break
        nxt = at.select("rid", (F.col("ln") - width).alias("ln"), F.col("rank").alias("rank2"))
        pairs = stored(at.join(nxt, ["rid", "ln"]), "line-pairs")
        names = ranked(pairs, ["rank", "rank2"], "next")
        at = stored(pairs.join(names, ["rank", "rank2"])
                    .select(*PLACE, F.col("next").alias("rank")), "line-suffixes")
        width *= 2
    if not hits:
        return lines.select("rid", "ln").limit(0)
    named = hits[0]
    for h in hits[1:]:
        named = named.unionByName(h)
    depth = ["n", "rank", "rank2"]
    firsts = stored(named.groupBy(*depth).agg(F.min(F.struct(*PLACE)).alias("first"),
                                              F.max(F.struct(*PLACE)).alias("final"))
                    .filter("first < final").drop("final"), "line-firsts")
    later = named.join(firsts, depth).filter(F.struct(*PLACE) > F.col("first"))
    end = F.col("ln") + F.col("n") - 1
    return later.select("rid", F.explode(F.sequence(end - F.col("covers") + 1, end)).alias("ln")).distinct()


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` with the copies deleted from ``text_col``, plus ``n_lines`` (before)
    and ``removed_lines`` (sorted line numbers); existing columns of these names
    are replaced."""
    rid, gone = fresh_name(docs, "rid"), fresh_name(docs, "gone")
    kept = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "line-docs")
    lines = stored(line_rows(kept, rid, id_col, text_col), "lines")
    dead = (copied_lines(lines, min_words).groupBy("rid")
            .agg(F.array_sort(F.collect_set(F.col("ln").cast("int"))).alias(gone))
            .withColumnRenamed("rid", rid))
    out = kept.join(dead, rid, "left")
    split = F.split(text_col, "\n", -1)
    # the split text is bound once as a lambda variable, lines are then fetched by number
    rest = F.transform(F.array(split), lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: ls[i]), "\n"))[0]
    return out.select(*[F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest).alias(c)
                        if c == text_col else F.col(f"`{c}`")
                        for c in docs.columns if c not in ("n_lines", "removed_lines")],
                      F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).alias("n_lines"),
                      F.coalesce(gone, F.array().cast("array<int>")).alias("removed_lines"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text without copied lines, lines before, lines removed (numbers
    joined by commas)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"),
                                   F.array_join("removed_lines", ",").alias("removed_lines"), "text")


# The same definition, by brute force over the text of every window.
SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
      SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l)),
f AS (SELECT s.doc_id, s.i AS a, min(e.i) AS b FROM c s JOIN c e
      ON s.doc_id = e.doc_id AND e.i >= s.i AND e.upto - s.upto + s.w >= {MIN_WORDS} GROUP BY ALL),
g AS (SELECT e.doc_id, max(s.i) AS a, e.i AS b FROM c s JOIN c e
      ON s.doc_id = e.doc_id AND e.i >= s.i AND e.upto - s.upto + s.w >= {MIN_WORDS} GROUP BY ALL),
v AS (SELECT doc_id, a, b, a AS x, ls[a:b] AS body FROM f JOIN d USING (doc_id)
      UNION ALL SELECT doc_id, a, b, b AS x, ls[a:b] AS body FROM g JOIN d USING (doc_id)),
o AS (SELECT body, min((doc_id, a)) AS first FROM v GROUP BY body),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(x, b)) AS i FROM v JOIN o USING (body)
      WHERE (doc_id, a) > first),
k AS (SELECT doc_id, list(i - 1 ORDER BY i)::INTEGER[] AS removed_lines FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(len(ls), 0)::INTEGER AS n_lines,
       coalesce(len(removed_lines), 0)::INTEGER AS n_removed,
       coalesce(array_to_string(removed_lines, ','), '') AS removed_lines,
       CASE WHEN k.doc_id IS NULL THEN text ELSE array_to_string(
           [ls[j + 1] FOR j IN range(len(ls)) IF NOT list_contains(removed_lines, j)], chr(10)) END AS text
FROM d LEFT JOIN k USING (doc_id)
"""
