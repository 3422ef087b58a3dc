"""Operator 7: removal of repeated line runs, with DataFrame functions only.

The corpus is a set of sequences of line identifiers, and its suffixes are sorted by prefix doubling:
the rank of the run of 2h lines that starts at a position follows from the ranks of its two halves.
Ranks come from range sorts of the distinct pairs of ranks, which a map-side combined aggregation has
counted before, so no task holds the positions of one run together. Lines that occur once end every
run; only positions in a run of two lines that occurs again go on, and of the documents only those
with an unsettled position.

Neighbours in the suffix order have the longest common prefixes. Where a class of equal runs splits,
the prefixes of its new neighbours are measured by going back down through the halves. Equal ranks
over two lines are the longest-common-prefix intervals of at least that length: the first position of
an interval stays, the lines of all others go.

A position is one number: the order of documents, then that of lines. p + 1 is the next line if that
occurs again as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: A run is two lines, or one line of so many words (a paragraph).
MIN_LINES, MIN_WORDS = 2, 50
_LAST = (1 << 63) - 1
#: Bits of a position below the number of its partition.
_PARTITION = 40


def _document(key: str, text: str) -> list[Column]:
    """A document is known by its key and its text; rows that agree in both are one document. Null keys come last."""
    return [F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST)).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t")]


def _units(text: Column) -> Column:
    """A line that is not blank together with the blank lines after it; blank lines at the start are a unit without a line."""
    return F.split(F.coalesce(text, F.lit("")), "\n(?=[ \\t\\r]*[^ \\t\\r\\n])")


def _is_line(unit: Column) -> Column:
    return F.trim(F.translate(F.substring_index(unit, "\n", 1), "\t\r", "  ")) != ""


def _is_long(line: Column) -> Column:
    """Whether a line has MIN_WORDS words. Blanks are counted first; only lines with two blanks together are split."""
    t = F.trim(F.translate(line, "\t\r", "  "))
    blanks = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    words = F.filter(F.split(t, " "), lambda w: w != "")
    return F.when(blanks < MIN_WORDS - 1, False).when(~F.contains(t, F.lit("  ")), True).otherwise(F.size(words) >= MIN_WORDS)


def line_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, j, x, y, w): the line of the j-th unit, as 128 bits of hash, and whether it is a run by itself."""
    units = docs.select(*_document(key, text), F.posexplode(_units(F.col(text))).alias("j", "u"))
    units = units.where((F.col("j") > 0) | _is_line(F.col("u")))  # all but the first begin with a line
    line = F.substring_index("u", "\n", 1)
    return units.select("d", "t", "j", F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"), _is_long(line).alias("w"))


def _ranked(rows: DataFrame, scratch: Scratch, name: str, *by: str) -> DataFrame:
    """The rows with a number that grows in the order of `by` (written). Numbers have gaps between partitions."""
    return scratch.write(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))


def positions(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(m, p, r, w): the positions p of lines that occur again, their document m and the rank r of the line; and (m, d, t). Both are written."""
    rows = scratch.write(line_ids(docs, key, text))
    again = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = _ranked(again, scratch, "r", "x", "y")
    # a repeated row of the table gives the same positions
    level = scratch.write(rows.join(again, ["x", "y"]).groupBy("d", "t", "j").agg(F.min("r").alias("r"), F.max("w").alias("w")))
    scratch.drop(rows, again)
    names = level.groupBy("d", "t").agg((F.max("j") + 2).cast("bigint").alias("n"))
    names = _ranked(names, scratch, "k", "d", "t").withColumn("part", F.shiftright("k", 33))
    # documents of one range of the order are numbered together; the first line of each has the number of lines before it
    before = F.sum("n").over(Window.partitionBy("part").orderBy("k")) - F.col("n")
    names = scratch.write(names.select("d", "t", (F.shiftleft("part", _PARTITION) + before).alias("m")))
    out = scratch.write(level.join(names, ["d", "t"]).select("m", (F.col("m") + F.col("j")).alias("p"), "r", "w"))
    scratch.drop(level)
    return out, names


def _pairs(level: DataFrame, h: int) -> DataFrame:
    """Each position with the rank e of the position h lines further on."""
    return level.join(level.select((F.col("p") - h).alias("p"), F.col("r").alias("e")), "p")


def repeated_pairs(level: DataFrame, scratch: Scratch) -> DataFrame:
    """(m, p): positions whose run of two lines occurs again (written)."""
    pairs = scratch.write(_pairs(level, 1).select("m", "p", "r", "e"))
    again = scratch.write(pairs.groupBy("r", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    out = scratch.write(pairs.join(again, ["r", "e"]).select("m", "p"))
    scratch.drop(pairs, again)
    return out


def prefix_lengths(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """(m, p, length, first): how many lines each position shares with the suffix it is most like, and the first
    position of its interval of two lines (null outside one).

    kept: (m, p, r), positions with the rank of their line. At the step for h lines, `r` ranks runs of
    h lines, and `e` the h lines after them; where those are not all kept, a number below zero, of
    which no two are equal, stands for what ends the run. A class of one position is settled.
    """
    now, h, steps, one = kept.withColumn("one", F.lit(False)), 1, [], F.col("one")
    while True:
        ahead = now.select((F.col("p") - h).alias("p"), F.col("r").alias("e"))
        pairs = scratch.write(now.where(~one).join(ahead, "p", "left").select("m", "p", "r", F.coalesce("e", -1 - F.col("p")).alias("e")))
        classes = pairs.groupBy("r", "e").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m"), F.min("p").alias("p"))
        settled = now.where(one).select("r", F.lit(None).cast("bigint").alias("e"), F.lit(0).cast("bigint").alias("n"), "m", "p")
        ranked = _ranked(classes.unionByName(settled), scratch, "c", "r", "e")
        steps.append((h, ranked, _neighbours(ranked, h, scratch)))
        live = ranked.where("n > 1").select("r", "e", "c", F.col("p").alias("first")).join(pairs, ["r", "e"]).select("m", "p", F.col("c").alias("r"), F.lit(False).alias("one"), "first")
        if h == 1:
            live = scratch.write(live)
            intervals = scratch.write(live.select("m", "p", "first"))
            live = live.drop("first")
        else:
            live = scratch.write(live.drop("first"))
        scratch.drop(pairs, now)
        if live.isEmpty():
            break
        rest = ranked.where("n < 2").join(live.select("m").distinct(), "m", "left_semi").select("m", "p", F.col("c").alias("r"), F.lit(True).alias("one"))
        now, h = scratch.write(live.unionByName(rest)), 2 * h
        scratch.drop(live)
    todo, done = None, []
    for k in reversed(range(len(steps))):
        h, _, found = steps[k]
        todo = found if todo is None else todo.unionByName(found)
        if h == 1:
            done.append(todo)
            break
        todo = scratch.write(todo)
        done.append(todo.where("a < 0 or b < 0"))
        halves = steps[k - 1][1].select("c", "r", "e")
        side = lambda s: halves.select(F.col("c").alias(s), F.col("r").alias(f"{s}1"), F.col("e").alias(f"{s}2"))  # noqa: B023, E731
        todo = todo.where("a >= 0 and b >= 0").join(side("a"), "a").join(side("b"), "b")
        same = F.col("a1") == F.col("b1")
        half = lambda s: F.when(same, F.col(f"{s}2")).otherwise(F.col(f"{s}1")).alias(s)  # noqa: B023, E731
        todo = todo.select(half("a"), half("b"), "at", (F.col("length") + F.when(same, h // 2).otherwise(0)).alias("length"))
    every = done[0]
    for df in done[1:]:
        every = every.unionByName(df)
    every = every.select(F.explode("at").alias("at"), "length").where("at is not null").groupBy("at.m", "at.p").agg(F.max("length").alias("length"))
    return every.join(intervals, ["m", "p"], "left")


def _neighbours(ranked: DataFrame, h: int, scratch: Scratch) -> DataFrame:
    """(a, b, at, length): the later halves of neighbouring classes with one first half, the positions that settle here, and h (written)."""
    part = F.shiftright("c", 33)
    sizes = ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    # one row for each partition of the sort
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("offset"))
    k = F.col("offset") + F.col("c").bitwiseAND((1 << 33) - 1)
    rows = ranked.withColumn("part", part).join(F.broadcast(offsets), "part").where("n > 0")
    at = F.when(F.col("n") == 1, F.struct("m", "p"))
    low = rows.select(k.alias("k"), "r", F.col("e").alias("a"), at.alias("at_a"))
    high = rows.select((k - 1).alias("k"), "r", F.col("e").alias("b"), at.alias("at_b"))
    both = low.join(high, ["k", "r"]).where("at_a is not null or at_b is not null")
    return scratch.write(both.select("a", "b", F.array("at_a", "at_b").alias("at"), F.lit(h).cast("bigint").alias("length")))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row as a struct `row`, untouched, and kept, n_lines, n_removed, n_runs, longest.

    A line goes if it lies in a run that also starts at an earlier place (smaller key, then earlier
    line); a run is two or more lines, or one line of MIN_WORDS words or more. The first copy stays, save
    for lines that an overlapping later copy covers. Blank lines are no part of runs and not counted; they
    stay or go with the line before. n_runs: stretches that were cut out. longest: lines of the longest
    run of the document that occurs anywhere again.
    Null texts count as empty, and kept is null for them; documents without repeats are unchanged;
    repeated rows are one document and get the same result; empty tables give no rows. Ties cannot
    occur: positions are unique. Other columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    level, names = positions(docs, scratch, key, text)
    pairs = repeated_pairs(level, scratch)
    long_ = level.where("w")
    firsts = long_.groupBy("r").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    alone = long_.join(firsts, "r").where("p <> first").select("m", "p")
    kept = scratch.write(level.join(pairs.select(F.explode(F.array("p", F.col("p") + 1)).alias("p")).distinct(), "p", "left_semi").select("m", "p", "r"))
    runs = scratch.write(prefix_lengths(kept, scratch))
    # an interval of two lines or more: its first position stays
    later = runs.where((F.col("length") >= MIN_LINES) & (F.col("p") != F.col("first"))).select("m", F.explode(F.array("p", F.col("p") + 1)).alias("p")).unionByName(alone)
    marks = later.groupBy("m").agg(F.array_sort(F.collect_set(F.col("p") - F.col("m"))).alias("js"))
    # lines of a document that touch are one run: [first, last] unit
    js = F.col("js")
    first = F.filter(js, lambda j, k: (k == 0) | (j - F.get(js, k - 1) > 1))
    last = F.filter(js, lambda j, k: (k == F.size(js) - 1) | (F.get(js, k + 1) - j > 1))
    marks = marks.select("m", F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("runs"))
    # a line outside every repeated pair shares itself alone
    found = level.select("m", F.lit(1).cast("bigint").alias("length")).unionByName(runs.select("m", F.greatest("length", F.lit(1)).alias("length")))
    marks = marks.join(found.groupBy("m").agg(F.max("length").alias("longest")), "m", "full")
    marks = scratch.write(names.join(marks, "m").select("d", "t", "runs", "longest"))
    scratch.drop(level, pairs)
    d, t = _document(key, text)
    rows = docs.select(d, t, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # the same join at every size: texts are moved once, and not sorted
    joined = rows.join(marks.hint("shuffle_hash"), ["d", "t"], "left")
    whole = F.col("row").getField(text)
    units, some = _units(whole), F.coalesce(F.size("runs") > 0, F.lit(False))
    inside = lambda j: F.exists(F.col("runs"), lambda r: (j >= r["a"]) & (j <= r["b"]))
    left = F.array_join(F.filter(units, lambda _, j: ~inside(j)), "\n")
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["b"] - r["a"] + 1)
    return joined.select(
        "row",
        F.when(some, left).otherwise(whole).alias("kept"),
        F.size(F.filter(units, _is_line)).cast("bigint").alias("n_lines"),
        F.when(some, removed).otherwise(0).cast("bigint").alias("n_removed"),
        F.when(some, F.size("runs")).otherwise(0).cast("bigint").alias("n_runs"),
        F.coalesce("longest", F.lit(0).cast("bigint")).alias("longest"),
    )


def query(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select(
        "row.doc_id",
        "n_lines",
        "n_removed",
        "n_runs",
        F.col("longest").alias("longest_repeat"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


_FULL = "trim(translate(s, chr(9) || chr(13), '  ')) <> ''"
_WORDS = "len(list_filter(string_split(translate(s, chr(9) || chr(13), '  '), ' '), lambda w: w <> ''))"
ORACLE = f"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
units AS (SELECT doc_id, i, s, {_FULL} AS full_, sum(({_FULL})::INT) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM split),
lines AS (SELECT doc_id, s, j FROM units WHERE full_),
pairs AS (SELECT doc_id, j, s AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY j) AS b FROM lines),
ranked AS (SELECT doc_id, j, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, j) AS nth FROM pairs WHERE b IS NOT NULL),
alone AS (SELECT doc_id, j, row_number() OVER (PARTITION BY s ORDER BY doc_id, j) AS nth FROM lines WHERE {_WORDS} >= {MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, j + k AS j FROM ranked, (VALUES (0), (1)) AS v(k) WHERE nth > 1 UNION SELECT doc_id, j FROM alone WHERE nth > 1),
marked AS (SELECT l.doc_id, l.j, g.j IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.j = l.j),
runs AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed, sum((gone AND NOT coalesce(before, false))::INT) AS n_runs
         FROM (SELECT *, lag(gone) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM marked) GROUP BY doc_id),
kept AS (SELECT u.doc_id, string_agg(u.s, chr(10) ORDER BY u.i) AS text FROM units u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.j = u.j
         WHERE g.j IS NULL GROUP BY u.doc_id),
-- lines that two places share, and how many follow one another
shared AS (SELECT a.doc_id, a.j, b.doc_id AS other, b.j - a.j AS shift FROM lines a JOIN lines b ON a.s = b.s AND (a.doc_id <> b.doc_id OR a.j <> b.j)),
islands AS (SELECT doc_id, other, shift, j - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY j) AS island FROM shared),
longest AS (SELECT doc_id, max(n) AS h FROM (SELECT doc_id, count(*) AS n FROM islands GROUP BY doc_id, other, shift, island) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       coalesce(h, 0)::BIGINT AS longest_repeat, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN runs USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN longest USING (doc_id)"""
