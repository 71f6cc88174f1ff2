"""Message files: ``user;text`` records without a header, UTF-8 or else Latin-1.

A quoted field may hold line breaks, so a record may be several lines, and where it starts depends on all quotes
before it; the encoding of a file is known only after its last byte.  Both are found out by a first pass from which
nothing but a few flags a line leave the scan, so files are split among tasks however large they are:

* A line maps "inside a quoted field or not" at its start to the same at its end.  These maps compose, so they are summed up
  for each block of a file, the blocks are scanned in order, and every line gets its state from its block's.
* Only lines of records of several lines are listed, and only files that are not UTF-8.  The second pass reads the
  texts: lines that are a record by themselves are parsed where they are, the others are put together by record.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellsign.operators.clean import drop_null_tokens
from tellsign.session import written

RECORD = "user string, text string, _bad string"
OPTIONS = {"sep": ";", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_bad"}
#: Lines of records of several lines that are broadcast; more are joined by a shuffle of all texts.
MOST_BROADCAST = 1_000_000
_PLACE = ["file", "block", "line"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files as they are; ``line`` rises within a block of a file."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether a quoted field is open at the end of a line, if one is (``inside``) or is not at its start.

    Quotes open a field only at its start, doubled ones stand for one, and what follows a closing quote is
    taken as it is up to the next separator.
    """
    def step(state: Column, part: Column) -> Column:
        body = F.when(state, part).when(F.startswith(part, F.lit('"')), F.substring(part, 2, 1 << 30))
        return F.coalesce(~F.contains(F.replace(body, F.lit('""'), F.lit("")), F.lit('"')), F.lit(False))

    return F.when(F.contains(line, F.lit('"')), F.aggregate(F.split(line, ";"), F.lit(inside), step)).otherwise(F.lit(inside))


def _scan(flags: DataFrame) -> DataFrame:
    """``inside``, ``after`` (the state before and after each line) and the place of the record a line belongs to.

    ``flags``: ``out, back``, the state after a line that starts outside or inside a quoted field.  A line with both
    equal sets the state, one with both exchanged turns it round, the others leave it.
    """
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum(F.when(F.col("out") & ~F.col("back"), 1).otherwise(0))
    odd = F.col("turns") % 2 == 1
    own = flags.withColumn("turns", turns.over(upto)).withColumn(
        "set", F.when(F.col("out") == F.col("back"), F.col("out") != odd)).withColumn("set", F.last("set", True).over(upto))
    blocks = own.groupBy("file", "block").agg(
        F.max_by(F.struct("turns", "set"), "line").alias("end")).select("file", "block", "end.*")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the same over blocks: those that set the state, and the turns since
    total = F.coalesce(F.sum("turns").over(before), F.lit(0))
    fixed = blocks.withColumn("total", total).withColumn(
        "sets", F.when(F.col("set").isNotNull(), F.col("set") != (F.col("total") % 2 == 1)))
    starts = fixed.select("file", "block", (F.coalesce(F.last("sets", True).over(before), F.lit(False))
                                            != (F.col("total") % 2 == 1)).alias("start"))
    states = own.join(starts, ["file", "block"]).withColumn("after", F.coalesce("set", "start") != odd)
    in_block = Window.partitionBy("file", "block").orderBy("line")
    return states.withColumn("inside", F.coalesce(F.lag("after").over(in_block), F.col("start")))


def _records(states: DataFrame) -> DataFrame:
    """``file, block, line, record`` of the lines of records of several lines; ``record`` is the place of the first."""
    parts = states.where(F.col("inside") | F.col("after"))
    opened = F.when(~F.col("inside"), F.struct("block", "line"))
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumn("record", F.last(opened, True).over(upto))
    last = parts.groupBy("file", "block").agg(F.max_by(F.struct("block", "line"), F.when(~F.col("inside"), F.col("line"))).alias("open"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "block", F.last("open", True).over(before).alias("carried"))
    return own.join(carried, ["file", "block"]).select(*_PLACE, F.coalesce("record", "carried").alias("record"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df.hint("merge")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All records with their file; ``_bad`` holds a record without exactly two fields.

    A record whose quotes are never closed reaches to the end of its file.
    """
    lines = _lines(spark, path)
    flags = written(lines.select(
        *_PLACE, F.is_valid_utf8("value").alias("utf8"), _ends_inside(F.col("value"), False).alias("out"),
        _ends_inside(F.col("value"), True).alias("back")), "line-flags")
    latin = written(flags.groupBy("file").agg(F.bool_and("utf8").alias("utf8")).where("not utf8").select(
        "file", F.lit(True).alias("latin")), "latin-files")
    many = written(_records(_scan(flags)) if not flags.where("out").isEmpty() else flags.limit(0).select(
        *_PLACE, F.struct("block", "line").alias("record")), "long-records")
    coded = lines.join(_sized(latin, latin.count()), "file", "left")
    value = F.when(F.col("latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
    placed = coded.withColumn("value", value).join(_sized(many, many.count()), _PLACE, "left")
    single = placed.where(F.col("record").isNull()).select("file", "value")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n")
    joined = placed.where(F.col("record").isNotNull()).groupBy("file", "record").agg(whole.alias("value")).select("file", "value")
    records = single.unionByName(joined).withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.trim("value") != "")
    return records.select(F.from_csv("value", RECORD, OPTIONS).alias("r"), "file").select("r.*", "file")


def read_messages(spark: SparkSession, path: str, null_tokens: bool = True) -> DataFrame:
    """Well-formed records of a file or folder as ``user`` and ``text``."""
    rows = read_lines(spark, path).filter(F.col("_bad").isNull()).select("user", "text")
    return drop_null_tokens(rows) if null_tokens else rows


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """Records kept, those among them that lack a field, and records refused, per file."""
    rows = read_lines(spark, path)
    good = F.col("_bad").isNull()
    lacking = F.col("user").isNull() | F.col("text").isNull()
    return rows.groupBy("file").agg(
        F.count_if(good).alias("kept"), F.count_if(good & lacking).alias("incomplete"),
        F.count_if(~good).alias("rejected"))


def write_messages(messages: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Write ``user;text`` lines that ``read_messages`` reads back unchanged."""
    (
        messages.select("user", "text").write.mode("errorifexists")
        .option("sep", ";").option("quote", '"').option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("lineSep", "\n").option("encoding", encoding).csv(path)
    )
