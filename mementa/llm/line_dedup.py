"""Line deduplication by winnowing over line hashes.

The unit that counts as a repeat is a run of consecutive lines with at least ``MIN_WORDS`` words.  At every line one
window starts and, with ``extend``, one ends, each the shortest run that is long enough; equal runs have equal windows
wherever they stand.  Of each window the line with the least hash is selected (winnowing), so any repeat shares a
selected line, and only windows whose selected line is selected elsewhere too can be repeats.  These are joined with the
first place of their window; a match grows in both directions as far as the neighbouring windows repeat as well, and
the lines of all later runs are deleted.

Of a repeat, the windows that start in it begin with its first line, and those that end in it close with its last one:
with both, a match extends as far as the lines are equal.  Without ``extend`` the lines after the last whole window
that starts in a repeat stay.

DataFrame operations only.  Order is by doc_id, then text hash, then line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mementa.llm.common import stored, text_of

MIN_WORDS = 50
_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _identity(text: Column) -> Column:
    """What tells texts apart besides their id."""
    return F.xxhash64(text, F.length(text))


def _wordless(text: Column) -> Column:
    return F.octet_length(F.ltrim(text, F.lit(_BLANKS))) == 0


def _word_count(line: Column) -> Column:
    """Words of a line without blanks at its end: single spaces are counted as bytes, the pattern is for other lines."""
    body = F.ltrim(line, F.lit(_BLANKS))
    apart = F.lit(False)
    for other in ("  ", *_BLANKS[1:]):
        apart = apart | F.contains(body, F.lit(other))
    spaces = F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit("")))
    return F.when(apart, F.size(F.split(body, _SPACE))).otherwise(spaces + 1)


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, extend: bool = False) -> DataFrame:
    """(id, print, line, last, words, window, pick, pick_line) per line from which ``min_words`` words follow in whole
    lines, with ``extend`` also per line up to which there are as many.

    ``window`` names the lines of the run, ``pick`` is the least of their hashes and ``pick_line`` its last place.
    Lines without a word are passed over.  A window that starts at its first line and ends at its last is given once.
    """
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    # the print and the lines come before the explode, which would evaluate the print once per line
    cut = F.transform(_lines(F.col("text")), lambda x: F.struct(F.rtrim(x, F.lit(_BLANKS)).alias("text")))
    split = rows.select("id", _identity(F.col("text")).alias("print"), cut.alias("lines"))
    lines = split.select("id", "print", F.posexplode("lines").alias("line", "l")).filter(F.octet_length("l.text") > 0)
    hashed = lines.select("id", "print", "line", _word_count(F.col("l.text")).alias("words"), F.xxhash64("l.text").alias("hash"))
    # rows that repeat id and text are one document
    once = hashed.repartition("id", "print").groupBy("id", "print", "line").agg(F.first("words").alias("words"), F.first("hash").alias("hash"))
    document = Window.partitionBy("id", "print")
    before = F.sum("words").over(document.orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    starting = document.orderBy("before").rangeBetween(0, min_words - 1)
    ending = document.orderBy("through").rangeBetween(1 - min_words, 0)

    def window(run):
        return F.struct(
            F.min("line").over(run).alias("line"),
            F.max("line").over(run).alias("last"),
            F.sum("words").over(run).alias("words"),
            F.xxhash64(F.collect_list("hash").over(run)).alias("window"),
            F.min(F.struct("hash", (-F.col("line")).alias("back"))).over(run).alias("least"),
        )

    placed = once.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("through", F.col("before") + F.col("words"))
    if extend:
        found = placed.select("id", "print", "words", window(starting).alias("s"), window(ending).alias("e"))
        # an ending window that is long enough without its last line is another than the one from its first line
        other = F.when(F.col("e.words") - F.col("words") >= min_words, F.col("e"))
        found = found.select("id", "print", F.explode(F.array("s", other)).alias("w"))
    else:
        found = placed.select("id", "print", window(starting).alias("w"))
    found = found.filter(F.col("w.words") >= min_words)
    return found.select(
        "id", "print", "w.line", "w.last", "w.words", "w.window", F.col("w.least.hash").alias("pick"), (-F.col("w.least.back")).alias("pick_line")
    )


def repeats(found: DataFrame) -> DataFrame:
    """(id, print, first, last) of the later runs among ``windows``'s rows."""
    # selected lines, once for each place, that occur at two places
    places = found.select("id", "print", "pick", "pick_line").distinct()
    shared = places.groupBy("pick").agg(F.count("*").alias("n")).filter("n > 1").select("pick")
    candidates = found.join(shared, "pick", "left_semi").withColumn("place", F.struct("id", "print", "line", "last"))
    named = ["window", "words"]
    first = candidates.groupBy(*named).agg(F.min("place").alias("origin"), F.count("*").alias("n")).filter("n > 1")
    later = candidates.join(first.drop("n"), named).filter(F.col("place") != F.col("origin"))
    # a run that overlaps its own first place keeps that place
    same = F.col("id").eqNullSafe(F.col("origin.id")) & (F.col("print") == F.col("origin.print"))
    begin = F.when(same, F.greatest("line", F.col("origin.last") + 1)).otherwise(F.col("line"))
    covered = later.select("id", "print", begin.alias("first"), "last").filter("first <= last")
    # grow both ways: runs that touch or overlap become one
    order = Window.partitionBy("id", "print").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("first") > F.coalesce(reached, F.lit(-2)) + 1).cast("int")
    grown = covered.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grown.groupBy("id", "print", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def deduplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, extend: bool = False) -> DataFrame:
    """``docs`` with later repeated runs of lines taken out of ``text``; all rows and columns stay.

    With ``extend`` a run goes to its first and last equal line, and a text that loses all its words becomes empty.

    Lines are equal when they are the same up to white space at their end.  Null texts stay null and empty texts
    empty; a text may become empty.  Rows that repeat id and text are one document and get the same result.  Null ids
    come first in the order.  A deleted run takes the wordless lines inside it along.
    """
    found = stored(windows(docs, key, text, min_words, extend), "line-windows")
    runs = repeats(found).groupBy("id", "print").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    row = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), _identity(text_of(text)).alias("print"))
    runs = runs.select(F.col("id").alias("run_id"), F.col("print").alias("run_print"), "runs")
    joined = row.join(runs.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("run_id")) & (F.col("print") == F.col("run_print")), "left")
    kept = F.filter(
        _lines(F.col("row")[text]),
        lambda _, i: ~F.exists("runs", lambda r: (r["first"] <= i) & (i <= r["last"])),
    )
    left = F.array_join(kept, "\n")
    if extend:
        left = F.when(_wordless(left), "").otherwise(left)
    cleaned = F.when(F.col("runs").isNull(), F.col("row")[text]).otherwise(left)
    return joined.select(*[cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
