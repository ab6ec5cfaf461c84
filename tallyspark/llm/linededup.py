"""Line dedup: repeated runs of lines by a suffix array over line ids, built by distributed prefix doubling.

A text is the sequence of its lines that aren't blank, each known by a 128-bit digest of the line without spaces, tabs
and carriage returns at its ends.  A suffix is a place in such a sequence.

*Prefix doubling.*  At depth h suffixes with equal first h lines have one name, and names are in the order of the suffix
array sorted to that depth.  The pair of the names at i and i+h orders suffix i to depth 2h: the distinct pairs, with
counts taken before they meet, are sorted by ranges over the cluster, and a pair's place is the new name.  Suffixes
whose pair occurs once have no longer repeat and leave, so each round works on fewer rows.

*Intervals.*  The suffixes of one name at depth h are an interval of the suffix array with a common prefix of h lines or
more: the repeated runs.  The first of them in the order of documents is the copy that stays.  Doubling starts at the
least length m of a run and goes on until no two suffixes tie.  A maximal run of any length l is two overlapping ones of
the greatest depth m, 2m, 4m, ... up to l, so the later suffixes of all depths cover every later copy from end to end.

All steps are DataFrame operations; joins on frequent lines are split by AQE.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import few_files, release, settle, shared_dir

MIN_LINES = 2
MIN_WORDS = 50


def _clean(line):
    return F.trim(F.translate(line, "\t\r\f\x0b", "    "))


def line_suffixes(docs: DataFrame, text: str = "text") -> DataFrame:
    """rid, key, pos (among the lines that aren't blank), line (among all), words, a and b (digest) of each line of ``docs`` (rid, key, text)."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("line"), _clean(x).alias("t")))
    rows = docs.select("rid", "key", F.posexplode(F.filter(lines, lambda s: s["t"] != "")).alias("pos", "s"))
    return rows.select("rid", "key", "pos", "s.line", F.size(F.split("s.t", " +")).alias("words"), F.xxhash64("s.t").alias("a"), F.xxhash64(F.lit(1), "s.t").alias("b"))


def _name(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Number distinct rows in their order: ranges over the cluster, then the place in the range."""
    return pairs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """What occurs more than once, with its first occurrence."""
    return rows.groupBy(*by).agg(F.count("*").alias("copies"), F.min(F.struct("key", "rid", "pos")).alias("first")).where("copies > 1")


_PLACE = ["rid", "key", "pos", "line", "words"]


def _is_later():
    return ~F.struct("key", "rid", "pos").eqNullSafe(F.col("first"))


def first_depth(lines: DataFrame, folder: str, size: int = 0) -> DataFrame:
    """Suffixes whose first line repeats: name, copies and first occurrence at depth 1."""
    named = _name(_classes(lines, ["a", "b"]), ["a", "b"])
    named = settle(named, folder, "names-1", size)
    return settle(lines.join(named, ["a", "b"]).select(*_PLACE, "name", "copies", "first"), folder, "depth-1", size)


def deepen(now: DataFrame, step: int, folder: str, depth: int, size: int = 0) -> DataFrame:
    """Suffixes that repeat to depth h + step from those at depth h (``step`` at most h); ``depth`` is the new depth."""
    other = now.select("rid", (F.col("pos") - step).alias("pos"), F.col("name").alias("name2"))
    both = now.select(*_PLACE, F.col("name").alias("one")).join(other, ["rid", "pos"])
    both = settle(both, folder, f"pairs-{depth}", size)
    named = settle(_name(_classes(both, ["one", "name2"]), ["one", "name2"]), folder, f"names-{depth}", size)
    return settle(both.join(named, ["one", "name2"]).select(*_PLACE, "name", "copies", "first"), folder, f"depth-{depth}", size)


def to_depth(now: DataFrame, depth: int, folder: str, size: int = 0) -> DataFrame:
    """Suffixes that repeat to ``depth`` lines, from those of depth 1."""
    h = 1
    while 2 * h <= depth:
        now, h = deepen(now, h, folder, 2 * h, size), 2 * h
    return deepen(now, depth - h, folder, depth, size) if h < depth else now


def doublings(now: DataFrame, depth: int, folder: str, size: int = 0) -> Iterator[tuple[int, DataFrame]]:
    """(depth, suffixes that tie at it) for ``depth`` and each doubling of it, until no two suffixes tie."""
    while not now.isEmpty():
        yield depth, now
        release(now.sparkSession)
        now, depth = deepen(now, depth, folder, 2 * depth, size), 2 * depth


def intervals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All repeated runs whose length is a power of two: depth, name (its order in the suffix array), copies, first (key and place)."""
    folder = shared_dir(docs.sparkSession)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ones = first_depth(settle(line_suffixes(settle(base, folder, "docs")), folder, "lines"), folder)
    out = ones.limit(0).select(F.lit(1).alias("depth"), "name", "copies", "first")
    for depth, tied in doublings(ones, 1, folder):
        out = out.unionByName(tied.select(F.lit(depth).alias("depth"), "name", "copies", "first").distinct())
    return out


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without later copies of repeated runs, plus n_lines, n_removed and n_runs.

    A run repeats if it has at least ``min_lines`` lines, or is one line of at least ``min_words`` words, and stands
    earlier too, in the order of the key (equal keys: of the rows as read) and the place; the earlier copy may overlap
    it.  All its lines go; blank lines stay.  n_lines and n_removed don't count blank lines, n_runs are the maximal
    removed stretches.  A null text counts as empty; a text from which nothing goes stays as it is.  Columns of the
    input called n_lines, n_removed, n_runs or rid are replaced.
    """
    folder = shared_dir(docs.sparkSession)
    own = ("rid", "key", "n_lines", "n_removed", "n_runs", "gone", "lines", "parts")
    others = [c for c in docs.columns if c not in own]
    # a number for each row that stays the same from here on
    base = docs.select(*[F.col(f"`{c}`") for c in others]).withColumn("rid", F.monotonically_increasing_id())
    base = settle(base, folder, "docs", None)
    size = int(base.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0])
    lines = settle(line_suffixes(base.select("rid", F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))), folder, "lines", size)
    ones = first_depth(lines, folder, size)
    # a later copy reaches from its place over as many lines as its depth says
    reaches = ones.where((F.col("words") >= min_words) & _is_later()).select("rid", "pos", F.lit(1).alias("reach"))
    for depth, tied in doublings(to_depth(ones, min_lines, folder, size), min_lines, folder, size):
        reaches = reaches.unionByName(tied.where(_is_later()).select("rid", "pos", F.lit(depth).alias("reach")))
    rows = lines.select("rid", "pos", "line", F.lit(0).alias("reach")).unionByName(reaches.select("rid", "pos", F.lit(None).cast("int").alias("line"), "reach"))
    before = Window.partitionBy("rid").orderBy("pos", F.col("line").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # one document's lines
    rows = rows.withColumn("gone", F.col("line").isNotNull() & (F.max(F.col("pos") + F.col("reach")).over(before) > F.col("pos")))
    per = rows.groupBy("rid").agg(F.count("line").alias("n_lines"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.struct("pos", "line")))).alias("gone"))
    per = per.withColumn("gone", F.when(F.size("gone") > 0, F.col("gone")))

    at, pos = F.col("gone.line"), F.col("gone.pos")
    parts = F.zip_with(F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size("lines"))), lambda a, b: F.struct((a + 2).alias("from"), (b - a - 1).alias("n")))
    left = F.array_join(F.flatten(F.transform(F.filter("parts", lambda p: p["n"] > 0), lambda p: F.slice("lines", p["from"], p["n"]))), "\n")
    starts = F.filter(F.zip_with(F.concat(F.array(F.lit(-2)), F.slice(pos, 1, F.size(pos) - 1)), pos, lambda before, x: x != before + 1), lambda x: x)
    joined = base.join(per, "rid", "left")
    joined = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(F.col(f"`{text}`"), "\n", -1)))
    joined = joined.withColumn("parts", F.when(F.col("gone").isNotNull(), parts))
    columns = [F.when(F.col("gone").isNull(), F.col(f"`{c}`")).otherwise(left).alias(c) if c == text else F.col(f"`{c}`") for c in others]
    none = F.col("gone").isNull()
    return few_files(joined.select(*columns, F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.when(none, 0).otherwise(F.size("gone")).alias("n_removed"), F.when(none, 0).otherwise(F.size(starts)).alias("n_runs")), size)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.col("n_runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = """
WITH all_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
  FROM documents),
clean AS (SELECT doc_id, no, line, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) AS t FROM all_lines),
solid AS (
  SELECT doc_id, no, t, row_number() OVER d AS pos, lead(t) OVER d AS t2, lead(no) OVER d AS no2,
         len(regexp_split_to_array(t, ' +')) AS words
  FROM clean WHERE t <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, no) AS one,
         row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, no) AS two
  FROM solid),
gone AS (
  SELECT doc_id, no FROM ranked WHERE one > 1 AND words >= 50
  UNION SELECT doc_id, no FROM ranked WHERE t2 IS NOT NULL AND two > 1
  UNION SELECT doc_id, no2 FROM ranked WHERE t2 IS NOT NULL AND two > 1),
placed AS (
  SELECT s.doc_id, s.pos, g.no IS NOT NULL AS out, lag(g.no IS NOT NULL, 1, false) OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS before
  FROM solid s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.no = g.no),
counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed, count(*) FILTER (WHERE out AND NOT before) AS n_runs
  FROM placed GROUP BY doc_id),
kept AS (
  SELECT c.doc_id, sha256(coalesce(string_agg(c.line, chr(10) ORDER BY c.no) FILTER (WHERE g.no IS NULL), '')) AS kept_sha256
  FROM clean c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.no = g.no GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_runs, 0) AS n_runs, k.kept_sha256
FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id JOIN kept k ON d.doc_id = k.doc_id
"""
