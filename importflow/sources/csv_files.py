"""Contact CSV files: records, source row numbers and named fields.

Files are read in splits that are planned once.  A file whose lines are each a whole record (nearly
all files) is numbered with two scans of the same splits and no shuffle of its lines.  A file in which a quoted value runs over
a line end takes a second route that works out, per line, whether the line begins inside
quotes; it is split across tasks just the same.

``spark.read.csv`` is not used: it drops lines of blanks, treats short and long records
alike, accepts text after a closing quote, and needs one schema (so one plan) per header.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from importflow.operators import skew
from importflow.operators.skew import checked_broadcast, has_at_most
from importflow.schemas import CONTACT_FIELDS, RECORD_LENGTHS
from importflow.session import freeze, pin, store

PRUNE_FILES = 1_000                  # up to here a file list goes into the scan itself
BLOCK_ROWS = 2_000_000               # blocks whose places, about 100 bytes each, may be broadcast
RECORD_BYTES = 1 << 30               # a longer record does not fit in a row and fails its file
# A valid phone is far below its limit, so only the other fields can be too long.
_LONG_LINE = min(RECORD_LENGTHS[f] for f in CONTACT_FIELDS if f != "phone")

# --- fixed values -----------------------------------------------------------------
BLANK_NAME = "A header name is missing in ["
TEXT_AFTER_QUOTE = "invalid character between encapsulated token and delimiter"
OPEN_QUOTE = "EOF reached before encapsulated token finished"
# ----------------------------------------------------------------------------------
RECORD_TOO_LONG = "record too long"

# One field: quoted (blanks may follow the closing quote), or bare text up to the comma.
# All loops are possessive, so matching needs no backtracking and no stack.
_BLANK = r"\p{javaWhitespace}*+"
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_INSIDE}"{_BLANK}(?=,|\z)|(?!")[^,]*+)'
_MORE = rf"(?:,{_FIELD})*+"
_WHOLE = rf"\A{_FIELD}{_MORE}\z"                                  # begins and ends outside
_OPENS = rf'\A(?:{_FIELD},)*+"{_INSIDE}\z'                        # begins outside, ends inside
_STAYS = rf"\A{_INSIDE}\z"                                        # begins and ends inside
_CLOSES = rf'\A{_INSIDE}"{_BLANK}(?=,|\z){_MORE}\z'               # begins inside, ends outside
_REOPENS = rf'\A{_INSIDE}"{_BLANK},(?:{_FIELD},)*+"{_INSIDE}\z'   # inside, out, and inside again
_TOKEN = rf",({_FIELD})"      # for a record with a comma put before it


@dataclass
class ContactFiles:
    """``rows``: one row per data record; ``files``: one row per file that has a header.

    A file's ``data_rows`` is what it must yield unless it fails at ``failed_row``.
    ``any_suspect`` says whether some file has lines long enough for over-long values.
    ``rows_of`` gives the rows of some files (``file_path``), for which no other file is read
    where they are few.
    """

    rows: DataFrame
    files: DataFrame
    any_suspect: bool
    rows_of: Callable[[DataFrame], DataFrame]


def scan_lines(spark: SparkSession, paths, line_sep: str = "\n") -> DataFrame:
    """Lines with their file, split offset and line end.

    LF, CRLF and CR all end a line.  CR is found within LF-separated pieces, so that the
    line ends inside quoted values stay known; for files with bare CR line ends only, pass
    ``line_sep='\\r'`` so that they can be split too.
    """
    raw = (
        spark.read.option("lineSep", line_sep).text(paths)
        .select(
            F.make_valid_utf8("value").alias("raw"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )
    at = F.instr("raw", "\r")
    inside = (at > 0) & (at < F.length("raw"))
    pieces = F.when(inside, F.split("raw", r"\r(?!\z)")).otherwise(F.array("raw"))
    parts = raw.withColumn("pieces", pieces).select(
        "file_path", "block_start", F.size("pieces").alias("n"),
        F.posexplode_outer("pieces").alias("i", "piece"),   # never empty; spares an inferred filter
    )
    ends_cr = F.endswith("piece", F.lit("\r"))
    return parts.select(
        "file_path", "block_start",
        F.when(ends_cr, F.col("piece").substr(F.lit(1), F.length("piece") - 1))
        .otherwise(F.col("piece")).alias("line"),
        F.when(F.col("i") < F.col("n") - 1, "\r").when(ends_cr, "\r\n").otherwise("\n").alias("eol"),
    )


def _has_quote(c: str) -> Column:
    return F.contains(F.col(c), F.lit('"'))


def tokens(record: Column | str) -> Column:
    """Fields of one well-formed record as they stand there, quotes and all."""
    record = F.col(record) if isinstance(record, str) else record
    return F.when(
        F.contains(record, F.lit('"')),
        F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_TOKEN), F.lit(1)),
    ).otherwise(F.split(record, ",", -1))


def unquote(token: Column) -> Column:
    """The value of a field; only a quoted field begins with a quote."""
    inner = F.regexp_extract(token, rf'(?s)\A"(.*)"{_BLANK}\z', 1)
    return F.when(
        F.startswith(token, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))
    ).otherwise(token)


def _with_header(files: DataFrame) -> DataFrame:
    """Positions of the contact fields in each file's ``header`` record.

    Names match exactly; of equal names the last position counts; a blank name fails the file.
    """
    names = files.withColumn("names", F.transform(tokens("header"), unquote))
    turned = F.reverse("names")

    def position(name: str) -> Column:
        at = F.array_position(turned, name)
        return F.when(at > 0, F.size("names") - at).cast("int").alias(f"at_{name}")

    listed = F.concat(F.lit("["), F.array_join(F.array_distinct("names"), ", "), F.lit("]"))
    blank = F.exists("names", lambda n: n.rlike(rf"\A{_BLANK}\z"))
    return names.select(
        *[c for c in files.columns if c != "header"],
        *[position(f) for f in CONTACT_FIELDS],
        listed.alias("header_names"),
        F.when(blank, F.concat(F.lit(BLANK_NAME),
                               F.array_join("names", ", "), F.lit("]"))).alias("header_error"),
    )


def _starts_per_file(blocks: DataFrame, count: str) -> Column:
    """Running total of ``count`` over the earlier blocks of the file."""
    earlier = (
        Window.partitionBy("file_path").orderBy("block_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(count).over(earlier), F.lit(0))


# --- files whose lines are records -------------------------------------------------


def _stamp(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their place in the scan."""
    return lines.where(F.col("line") != "").select(
        "file_path", "block_start", "line",
        F.spark_partition_id().alias("task"),
        F.monotonically_increasing_id().alias("place"),
    )


def _profile(stamped: DataFrame) -> DataFrame:
    """One row per block: first place, record count, first line, and what to look out for.

    The set-valued flag makes Spark use the object hash aggregate, which needs no sort even
    though the buffer holds a string.
    """
    odd = _has_quote("line") & ~F.col("line").rlike(_WHOLE)
    long_line = F.octet_length("line") > _LONG_LINE      # never fewer bytes than characters
    blocks = stamped.groupBy("task", "file_path", "block_start").agg(
        F.min("place").alias("first_place"),
        F.count(F.lit(1)).alias("lines"),
        F.min_by("line", "place").alias("first_line"),
        F.collect_set(F.when(odd, "odd").when(long_line, "long")).alias("flags"),
    )
    return freeze(blocks)


def _number_plain(stamped: DataFrame, blocks: DataFrame) -> DataFrame:
    """Number the records of the given blocks, which carry their file's columns.

    The scan's splits were planned before the first use, so a block's places are the same here
    as in its profile.  With many blocks only their places go to every task, and the columns of
    the files are joined file by file.
    """
    placed = blocks.withColumn("shift", F.col("row_start") - F.col("first_place")).drop(
        "first_place", "lines", "first_line", "flags", "row_start"
    )
    block = ["task", "file_path", "block_start"]
    if has_at_most(placed, skew.BROADCAST_ROWS):
        found = stamped.join(F.broadcast(placed), block)
    else:
        places = placed.select(*block, "shift")
        found = stamped.join(checked_broadcast(places, BLOCK_ROWS), block).join(
            checked_broadcast(freeze(placed.drop("task", "block_start", "shift").distinct())), "file_path"
        )
    return found.withColumn("source_row_number", F.col("place") + F.col("shift")).withColumnRenamed(
        "line", "record"
    )


# --- files with quoted line ends ----------------------------------------------------


def _classify(lines: DataFrame) -> DataFrame:
    """What each line does to the in-quotes state.

    ``sets`` is the state after the line where it does not depend on the state before;
    ``flips`` says that it turns the state round; neither means it keeps the state.  A line
    that is an error from one state is described by what it does from the other.
    """
    line = F.col("line")
    from_out = F.when(~_has_quote("line") | line.rlike(_WHOLE), 0).when(line.rlike(_OPENS), 1)
    from_in = (
        F.when(~_has_quote("line") | line.rlike(_STAYS), 1)
        .when(line.rlike(_CLOSES), 0).when(line.rlike(_REOPENS), 1)
    )
    coded = lines.withColumns({"from_out": from_out, "from_in": from_in})
    either = F.coalesce("from_out", "from_in", F.lit(0))
    return coded.withColumns({
        "sets": F.when(
            F.col("from_out").isNull() | F.col("from_in").isNull()
            | (F.col("from_out") == F.col("from_in")), either,
        ),
        "flips": F.coalesce(
            ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("int"), F.lit(0)
        ),
    }).withColumn("flips", F.when(F.col("sets").isNotNull(), 0).otherwise(F.col("flips")))


def _state_before(keys: list[str], order: str, start: Column) -> Column:
    """State before a row, from the rows before it in the window and the ``start`` state."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    flips_before = F.coalesce(F.sum("flips").over(before), F.lit(0))
    last_set = F.last(
        F.when(F.col("sets").isNotNull(), F.struct("sets", F.col("flips_to").alias("at"))),
        ignorenulls=True,
    ).over(before)
    return F.pmod(
        F.when(last_set.isNotNull(), last_set["sets"] + flips_before - last_set["at"])
        .otherwise(start + flips_before), F.lit(2),
    ).cast("int")


def _with_flips_to(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("flips_to", F.sum("flips").over(upto))


def _multi_line(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, headers, failures and row counts) of files with quoted line ends.

    A block is one split of one file, and no window here is larger.  What depends on the
    state at the start of the block is worked out for both states in the same pass; the
    table of blocks then says which of the two is true.
    """
    block = ["file_path", "block_start"]
    outside, inside = F.lit(0), F.lit(1)
    upto = Window.partitionBy(*block).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)

    def after(state: Column) -> Column:
        return F.pmod(F.coalesce(F.col("sets"), state + F.col("flips")), F.lit(2)).cast("int")

    def starts(state: str) -> Column:
        return ((F.col(state) == 0) & (F.col("line") != "")).cast("int")

    coded = _classify(lines.withColumn("place", F.monotonically_increasing_id()))
    coded = _with_flips_to(coded, block, "place")
    coded = coded.withColumns({
        "if_out": _state_before(block, "place", outside),
        "if_in": _state_before(block, "place", inside),
    })
    coded = coded.withColumns({
        "nth_out": F.sum(starts("if_out")).over(upto), "nth_in": F.sum(starts("if_in")).over(upto),
    })
    coded = store(coded.drop("flips_to"), "lines")

    # A block as a whole acts on the state just as a line does.
    last = F.max_by(
        F.struct(after(F.col("if_out")).alias("o"), after(F.col("if_in")).alias("i"),
                 "nth_out", "nth_in"), "place",
    )
    blocks = coded.groupBy(*block).agg(last.alias("end")).select(
        *block, "end.nth_out", "end.nth_in",
        F.when(F.col("end.o") == F.col("end.i"), F.col("end.o")).alias("sets"),
        ((F.col("end.o") == 1) & (F.col("end.i") == 0)).cast("int").alias("flips"),
    )
    blocks = _with_flips_to(blocks, ["file_path"], "block_start").withColumn(
        "state_in", _state_before(["file_path"], "block_start", outside)
    )
    blocks = blocks.withColumns({
        "state_out": after(F.col("state_in")),
        "lines": F.when(F.col("state_in") == 1, F.col("nth_in")).otherwise(F.col("nth_out")),
    })
    blocks = freeze(blocks.withColumn("row_start", _starts_per_file(blocks, "lines")))

    began_in = F.col("state_in") == 1
    known = coded.join(
        checked_broadcast(blocks.select(*block, "state_in", "row_start")), block
    ).withColumns({
        "state": F.when(began_in, F.col("if_in")).otherwise(F.col("if_out")),
        "nth": F.when(began_in, F.col("nth_in")).otherwise(F.col("nth_out")),
    }).where((F.col("state") == 1) | (F.col("line") != ""))
    from_here = F.when(F.col("state") == 1, F.col("from_in")).otherwise(F.col("from_out"))
    numbered = known.select(
        *block, "place", "line", "eol", from_here.isNull().alias("bad"),
        (F.col("row_start") + F.col("nth") - 1).alias("source_row_number"),
        ((F.col("state") == 1) | (after(F.col("state")) == 1)).alias("several"),
    )

    record = ["file_path", "source_row_number"]
    broken = (
        numbered.where("bad or several").groupBy(*record)
        .agg(F.max("bad").alias("bad"), F.sum(F.octet_length("line") + F.octet_length("eol")).alias("bytes"))
        .where(F.col("bad") | (F.col("bytes") > RECORD_BYTES))
        .select(*record, F.when(F.col("bad"), TEXT_AFTER_QUOTE).otherwise(RECORD_TOO_LONG).alias("why"))
    )
    unclosed = (
        blocks.groupBy("file_path").agg(
            F.max_by("state_out", "block_start").alias("open"),
            (F.sum("lines") - 1).alias("source_row_number"),
        ).where("open = 1").select(*record, F.lit(OPEN_QUOTE).alias("why"))
    )
    failures = freeze(
        unclosed.unionByName(broken).groupBy("file_path").agg(
            F.min("source_row_number").alias("failed_row"),
            F.min_by("why", "source_row_number").alias("failed_why"),
        )
    )
    sound = (
        numbered.join(checked_broadcast(failures), "file_path", "left")
        .where(F.col("failed_row").isNull() | (F.col("source_row_number") < F.col("failed_row")))
    )
    single = sound.where(~F.col("several")).select(*record, F.col("line").alias("record"))
    joined = (
        sound.where("several").groupBy(*record)
        .agg(F.array_sort(F.collect_list(F.struct("block_start", "place", "line", "eol"))).alias("p"))
        .select(
            *record,
            F.concat(
                F.array_join(
                    F.transform(F.slice("p", F.lit(1), F.size("p") - 1),
                                lambda x: F.concat(x["line"], x["eol"])), ""),
                F.element_at("p", -1)["line"],
            ).alias("record"),
        )
    )
    records = single.unionByName(joined)
    headers = records.where(F.col("source_row_number") == 0).select(
        "file_path", F.col("record").alias("header")
    )
    counts = blocks.groupBy("file_path").agg((F.sum("lines") - 1).alias("data_rows"))
    return records, headers, counts.join(failures, "file_path", "left")


# --- public -------------------------------------------------------------------------


def read_contact_files(
    spark: SparkSession, paths, describe=None, line_sep: str = "\n"
) -> ContactFiles:
    """Read contact files into numbered, tokenised rows.

    ``describe`` may add columns (a job id, a resume cursor) to the table of files; they are
    carried on to every row through the small block table, so no join by job is needed.
    """
    describe = describe or (lambda df: df)
    lines = scan_lines(spark, paths, line_sep)
    found = _read(lines, describe)

    def rows_of(some: DataFrame) -> DataFrame:
        """Few files are profiled and read by themselves; more are picked from all rows."""
        some = some.select("file_path")
        if has_at_most(some, PRUNE_FILES):
            return _read(_lines_of(lines, some), describe).rows
        return found.rows.join(checked_broadcast(some), "file_path", "left_semi")

    found.rows_of = rows_of
    return found


def _lines_of(lines: DataFrame, some: DataFrame) -> DataFrame:
    """The lines of some files; a short list of them prunes the scan."""
    if has_at_most(some, PRUNE_FILES):
        return lines.where(F.col("file_path").isin([r["file_path"] for r in some.collect()]))
    return lines.join(checked_broadcast(some), "file_path", "left_semi")


def _read(lines: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> ContactFiles:
    stamped = _stamp(pin(lines))
    blocks = _profile(stamped)
    blocks = blocks.withColumn("row_start", _starts_per_file(blocks, "lines"))
    files = blocks.groupBy("file_path").agg(
        F.min_by("first_line", "block_start").alias("header"),
        F.max(F.array_contains("flags", "odd")).alias("odd"),
        F.max(F.size("flags") > 0).alias("suspect"),
        (F.sum("lines") - 1).alias("data_rows"),
    )
    files = freeze(describe(files))
    seen = files.agg(F.max("odd").alias("odd"), F.max("suspect").alias("suspect")).first()

    plain = _with_header(files.where(~F.col("odd")).drop("odd")).withColumns(
        {"failed_row": F.lit(None).cast("bigint"), "failed_why": F.lit(None).cast("string")}
    )
    own = [c for c in files.columns if c not in ("header", "odd", "data_rows")]
    at = [f"at_{f}" for f in CONTACT_FIELDS] + ["header_names"]
    readable = plain.where(F.col("header_error").isNull()).select(*own, *at)
    rows = _number_plain(stamped, freeze(blocks.join(readable, "file_path")))
    keep = [*own, *at, "source_row_number", "record"]
    rows = rows.select(*keep)

    if seen["odd"]:
        records, headers, counted = _multi_line(_lines_of(lines, files.where("odd").select("file_path")))
        quoted = freeze(
            _with_header(
                files.where("odd").drop("odd", "header", "data_rows")
                .join(headers, "file_path", "left")
            ).join(counted, "file_path")
        )
        sound = quoted.where(F.col("header_error").isNull() & F.col("header_names").isNotNull())
        rows = rows.unionByName(
            records.join(checked_broadcast(sound.select(*own, *at)), "file_path").select(*keep)
        )
        plain = plain.unionByName(quoted.select(*plain.columns))
    # A blank header name fails the file before its first row.
    described = plain.select(
        *own, "data_rows",
        F.when(F.col("header_error").isNotNull(), 1).otherwise(F.col("failed_row"))
        .cast("bigint").alias("failed_row"),
        F.coalesce("header_error", "failed_why").alias("failed_why"),
    )
    data = rows.where(F.col("source_row_number") >= 1).withColumn("tokens", tokens("record"))
    every = data.drop("record")
    return ContactFiles(
        every, described, bool(seen["suspect"]), lambda some: every.join(some, "file_path", "left_semi")
    )
