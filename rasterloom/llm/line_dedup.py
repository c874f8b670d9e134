"""Line dedup: delete later copies of repeated line runs. DataFrame and SQL functions only.

The lines of all documents, in order of document and line, form one sequence of line ids. Lines that occur once can
be in no repeated run, so they only separate the stretches that are kept. Prefix doubling over the suffixes of those
stretches gives, level by level, the bucket of suffixes that agree on 2^k lines, which is an interval of the suffix
array; a bucket is named by its first position. A prefix of m lines, 2^k <= m < 2^(k+1), is named by the buckets of
its first and its last 2^k lines, so suffixes with the same name form the interval whose common prefix is at least m.

A repeated run counts if it has at least min_words words. Line p is deleted if it lies in such a run that also begins
at an earlier position. That is so exactly if p lies in a shortest such run from some line on, or back from some
line, that repeats: in a longer run, the shortest runs from each of its lines on and back cover it all, and repeat at
the same earlier place. A shortest run has at most min_words lines, which is how deep doubling goes. On the way it
keeps only the lines inside blocks of 2^k lines that repeat and that a shortest run can hold: all lines of a shortest
run but its last (or, looked at from its end, its first) have less than min_words words together. Chained along the
place they repeat, shortest runs make up the maximal repeated runs (maximal_runs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.session import materialize

#: Words that a repeated run must have. A run is any number of whole lines.
MIN_WORDS = 20
#: A line with the blank lines after it is one unit: cut at a line feed if the next line has a word. The lookahead reads
#: no further than that line's first word, so cutting is linear.
CUT = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"
BLANK = " \t\n\x0b\x0c\r"
KEY = ["doc_id", "th"]


def _units(text: Column) -> Column:
    return F.split(text, CUT, -1)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id and a hash of the text name a document; rows that repeat both are one document."""
    return docs.withColumn("__dedup_id", F.col(key)).withColumn("__dedup_th", F.xxhash64(F.col(text)))


def _firsts(rows: DataFrame, parts: list[str], out: str) -> DataFrame:
    """The rows whose parts occur twice or more, with the smallest pos among equal ones. Firsts are written before they
    are joined, so Spark can split a hot bucket's join."""
    names = rows.groupBy(*parts).agg(F.min("pos").alias(out), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(materialize(names, "lines-names"), parts)


def _stretches(rows: DataFrame) -> DataFrame:
    """stretch numbers the runs of neighbouring lines that are left."""
    return rows.withColumn("stretch", F.col("at") - F.row_number().over(Window.partitionBy(*KEY).orderBy("at")))


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, start, lines, first: shortest runs with min_words words, from a line on or back from a line, that begin
    at an earlier position too; first is the earliest (doc_id, th, at)."""
    rows = _keyed(docs.filter(F.col(text).isNotNull()), key, text)
    rows = rows.select(F.col("__dedup_id").alias("doc_id"), F.col("__dedup_th").alias("th"), F.posexplode(_units(F.col(text))).alias("at", "line"))
    line = F.rtrim(F.col("line"), F.lit(BLANK))
    # only whether sums of words reach min_words matters, so counting stops there
    some = F.size(F.split(F.ltrim(line, F.lit(BLANK)), r"[\x20\x09-\x0D]+", min_words + 1))
    words = F.when(line == "", 0).otherwise(F.least(some, F.lit(min_words)))
    ids = rows.select(*KEY, "at", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"), words.alias("words"))
    ids = materialize(ids.filter("words > 0"), "lines-ids")
    twice = materialize(ids.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "lines-twice")
    kept = ids.join(twice, ["h1", "h2"]).dropDuplicates([*KEY, "at"]).withColumn("pos", F.struct(*KEY, "at"))
    now = _firsts(materialize(kept, "lines-kept"), ["h1", "h2"], "rank").drop("h1", "h2")

    stretch = Window.partitionBy(*KEY, "stretch").orderBy("at")
    upto = F.sum("words").over(stretch.rowsBetween(Window.unboundedPreceding, 0))
    runs, size = None, 1
    while True:
        # here rank is the first position of the same `size` lines, or null where they do not repeat
        now = materialize(_stretches(now).withColumn("up_to", upto), "lines-level")
        before = F.col("up_to") - F.col("words")
        sizes = range(size, min(2 * size - 1, min_words) + 1)
        least = lambda total, m, less: (total >= min_words) & (less < min_words) if m > 1 else total >= min_words
        on = F.coalesce(*[F.when(least(F.lead("up_to", m - 1).over(stretch) - before, m, F.lead("up_to", max(m - 2, 0)).over(stretch) - before), F.lit(m)) for m in sizes])
        back = F.coalesce(*[F.when(least(F.col("up_to") - F.lag(before, m - 1).over(stretch), m, F.col("up_to") - F.lag(before, max(m - 2, 0)).over(stretch)), F.lit(m)) for m in sizes])
        pick = lambda column, make: F.coalesce(*[F.when(F.col(column) == m, make(m)) for m in sizes])
        found = now.withColumn("on", on).withColumn("back", back)
        ahead = found.select(
            *KEY, F.col("at").alias("start"), F.col("on").alias("lines"),
            F.col("rank").alias("a"), pick("on", lambda m: F.lead("rank", m - size).over(stretch)).alias("b"),
        )
        behind = found.select(
            *KEY, (F.col("at") - F.col("back") + 1).alias("start"), F.col("back").alias("lines"),
            pick("back", lambda m: F.lag("rank", m - 1).over(stretch)).alias("a"), F.lag("rank", size - 1).over(stretch).alias("b"),
        )
        mine = ahead.unionByName(behind) if size > 1 else ahead
        mine = mine.filter("lines is not null and a is not null and b is not null").distinct().withColumn("pos", F.struct(*KEY, F.col("start").alias("at")))
        mine = materialize(_firsts(materialize(mine, "lines-runs"), ["lines", "a", "b"], "first").filter(F.col("first") < F.col("pos")).select(*KEY, "start", "lines", "first"), "lines-repeated")
        runs = mine if runs is None else runs.unionByName(mine)
        if 2 * size > min_words:
            return runs
        # blocks of 2 * size lines that a shortest run can hold and whose halves repeat
        end = F.lead("up_to", 2 * size - 1).over(stretch)
        last = F.lead("words", 2 * size - 1).over(stretch)
        held = (end - before - last < min_words) | (end - F.col("up_to") < min_words)
        now = now.withColumn("_next", F.lead("rank", size).over(stretch)).withColumn("_held", F.coalesce(held & F.col("rank").isNotNull() & F.col("_next").isNotNull(), F.lit(False)))
        inside = F.max("_held").over(stretch.rowsBetween(1 - 2 * size, 0))
        now = materialize(now.withColumn("_inside", inside).filter("_inside").drop("_inside", "stretch", "up_to"), "lines-blocks")
        if now.isEmpty():
            return runs
        named = _firsts(now.filter("_held"), ["rank", "_next"], "_rank").select(*KEY, "at", "_rank")
        now = now.drop("rank", "_next", "_held").join(named.withColumnsRenamed({"doc_id": "_d", "th": "_t", "at": "_a"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("at") == F.col("_a")), "left")
        now = now.withColumnRenamed("_rank", "rank").drop("_d", "_t", "_a")
        size *= 2


def maximal_runs(runs: DataFrame) -> DataFrame:
    """doc_id, th, start, lines, first: repeated_runs() that overlap or touch and repeat along the same earlier place,
    joined: the lines from start on equal those from first on, and neither side can be extended by another shortest run."""
    place = [*KEY, "first_id", "first_th", "shift"]
    rows = runs.select(*KEY, "start", (F.col("start") + F.col("lines")).alias("stop"), F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"), (F.col("start") - F.col("first.at")).alias("shift"))
    order = Window.partitionBy(*place).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*place, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    first = F.struct(F.col("first_id").alias("doc_id"), F.col("first_th").alias("th"), (F.col("start") - F.col("shift")).alias("at"))
    return out.select(*KEY, "start", (F.col("stop") - F.col("start")).alias("lines"), first.alias("first"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cut and n_lines, n_deleted added: later copies of repeated runs go, first ones stay.

    Order is that of key, then of a hash of the text. A null text stays null with 0 lines; an empty one is a line
    without words; lines without words are never compared and go with the line before, as part of it in n_lines and
    n_deleted; white space at a line's end is not compared. Rows that repeat key and text are one document and get the same result; rows with a null key
    are ordinary documents and come first. Columns that clash with the added ones are replaced; an empty table
    gives an empty result.
    """
    runs = repeated_runs(docs, key, text, min_words)
    gone = runs.select("doc_id", "th", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)).alias("at"))
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set("at").alias("__dedup_gone"))
    gone = materialize(gone.withColumnsRenamed({"doc_id": "__dedup_doc", "th": "__dedup_hash"}), "lines-gone")
    rows = _keyed(docs.drop("n_lines", "n_deleted"), key, text)
    # the small side is hashed, so texts are not sorted
    rows = rows.join(gone.hint("shuffle_hash"), F.col("__dedup_id").eqNullSafe(F.col("__dedup_doc")) & (F.col("__dedup_th") == F.col("__dedup_hash")), "left")
    units, lost = _units(F.col(text)), F.col("__dedup_gone")
    left = lambda u: F.transform(F.array_except(F.sequence(F.lit(0), F.size(u) - 1), lost), lambda i: F.get(u, i))
    # the outer transform binds the units, so that a text is split once and not for every line
    joined = F.element_at(F.transform(F.array(units), lambda u: F.array_join(left(u), "\n")), 1)
    cut = F.when(lost.isNull(), F.col(text)).otherwise(joined)
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(units)).cast("long")
    out = rows.withColumn("n_lines", n_lines).withColumn("n_deleted", F.coalesce(F.size("__dedup_gone"), F.lit(0)).cast("long")).withColumn(text, cut)
    return out.drop("__dedup_id", "__dedup_th", "__dedup_doc", "__dedup_hash", "__dedup_gone")
