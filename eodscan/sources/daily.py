"""Readers for daily price/volume/delivery files.

Every reader ends in the same step: raw text columns by header name -> typed rows and rejects.
Rows are unique per (symbol, series, date1) afterwards; the windows downstream rely on that.
"""

from __future__ import annotations

import datetime as dt
import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eodscan.functions.dates import FILE_PREFIX, FILE_SUFFIX, file_date, parse_trade_date
from eodscan.functions.numbers import numbers_or_null, unit_ratio, whole_numbers_or_null
from eodscan.functions.text import strip
from eodscan.schemas import BARS, COUNT_COLUMNS, DAILY_COLUMNS, KEYS, PRICE_COLUMNS, REJECTS

REQUIRED = ["symbol", "series", "date1", "ttl_trd_qnty", "no_of_trades"]

# fixed values: texts that mean "no number here" in a numeric column
MISSING_MARKERS = ["", "-", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN"]
MISSING_MARKERS += ["<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# an archive's lines reach Spark in blocks of this many
LINES_PER_BLOCK = 20_000

_NUMBERS = [*PRICE_COLUMNS, "deliv_per"]


# --- raw text -> typed rows and rejects ---------------------------------------------------------


def split_typed(
    raw: DataFrame, bad_values: str = "reject", header_ok: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Type the text columns of `raw` (plus `source`); return (good, rejects).

    A row is refused when its date or (with bad_values="reject") a number cannot be read.
    bad_values="null" keeps such a row with null in that place, and still reports it.
    Among rows with the same key the smallest one, column by column, is kept; the others are rejects.
    """
    if bad_values not in ("reject", "null"):
        raise ValueError("bad_values must be 'reject' or 'null'")
    text = {c: F.col(c) if c in raw.columns else F.lit(None).cast("string") for c in DAILY_COLUMNS}

    def stripped(names: list[str]) -> Column:
        return F.transform(F.array(*[text[c] for c in names]), strip)

    texts = raw.select(
        "source",
        _raw_text(raw, text).alias("raw"),
        (F.lit(True) if header_ok is None else header_ok).alias("_ok"),
        text["symbol"].alias("symbol"),
        stripped(["series", "date1"]).alias("_days"),
        stripped(_NUMBERS).alias("_numbers"),
        stripped(COUNT_COLUMNS).alias("_counts"),
    )
    # inline() over one struct: the casts are evaluated once, and no filter below repeats them. Columns of one type go
    # through one expression; a cast for each column makes a method that the JVM does not compile
    read = F.struct(
        F.get("_days", F.lit(0)).alias("series"),
        parse_trade_date(F.get("_days", F.lit(1))).alias("date1"),
        numbers_or_null(F.col("_numbers")).alias("_number"),
        whole_numbers_or_null(F.col("_counts")).alias("_count"),
    )
    parsed = texts.select("*", F.inline(F.array(read)))

    def unreadable(names: list[str], given: str, values: str) -> Column:
        def problem(t: Column, i: Column) -> Column:
            bad = F.get(values, i).isNull() & t.isNotNull() & ~t.isin(MISSING_MARKERS)
            return F.when(bad, F.concat(F.lit("bad number in "), F.get(F.array(*map(F.lit, names)), i)))

        return F.transform(given, problem)

    fatal = [
        F.when(~F.col("_ok"), F.lit("no usable header")),
        F.when(F.col("date1").isNull(), F.lit("bad date in date1")),
    ]
    numbers = [unreadable(_NUMBERS, "_numbers", "_number"), unreadable(COUNT_COLUMNS, "_counts", "_count")]
    if bad_values == "reject":
        fatal, numbers = [*fatal, *numbers], []

    typed = {c: F.col(c) for c in KEYS}
    typed |= {c: F.get("_number", F.lit(i)) for i, c in enumerate(_NUMBERS)}
    typed |= {c: F.get("_count", F.lit(i)) for i, c in enumerate(COUNT_COLUMNS)}
    checked = parsed.select(
        "source",
        "raw",
        *[typed[c].alias(c) for c in DAILY_COLUMNS],
        F.concat_ws("; ", *fatal).alias("_fatal"),
        F.concat_ws("; ", F.lit(None).cast("string"), *numbers).alias("_kept"),
    )
    ratio = unit_ratio(F.col("ttl_trd_qnty"), F.col("no_of_trades"))
    good = one_row_per_key(checked.filter("_fatal = ''").select(*DAILY_COLUMNS, ratio.alias("ratio")))

    # refused lines keep their text, readable ones their values, and all are counted in one pass over the lines
    refused = F.col("_fatal") != ""
    told = {"_source": "source", "_reason": "_fatal", "_line": "raw"}
    counted = checked.select(
        *[F.when(refused, F.col(c)).alias(name) for name, c in told.items()],
        *[F.when(~refused, F.col(c)).alias(c) for c in DAILY_COLUMNS],
        F.when(~refused, ratio).alias("ratio"),
    )
    rejects = _each_refused(_beyond_first(counted, told, many_copies=False)).select(
        F.col("_source").alias("source"),
        F.coalesce("_reason", F.lit("duplicate key")).alias("reason"),
        F.when(F.col("_reason").isNull(), F.to_json(F.struct(*DAILY_COLUMNS, "ratio"))).otherwise(F.col("_line")).alias("raw"),
        "copies",
    )
    if numbers:
        reported = checked.filter("_fatal = '' and _kept <> ''").select(
            "source",
            F.concat(F.lit("kept as null: "), "_kept").alias("reason"),
            "raw",
            F.lit(1).cast("bigint").alias("copies"),
        )
        rejects = rejects.unionByName(reported)
    return good.select(*BARS.fieldNames()), rejects.select(*REJECTS.fieldNames())


_PER_ARRAY = 10_000


def _each_refused(rows: DataFrame) -> DataFrame:
    """A refused line as often as it stands in its file, in arrays of bounded size."""
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / _PER_ARRAY))
    parts = rows.withColumn("_run", F.explode(F.when(F.col("_reason").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(runs)))
    ones = F.least(F.lit(_PER_ARRAY), F.col("copies") - F.col("_run") * _PER_ARRAY).cast("int")
    each = F.when(F.col("_reason").isNull(), F.array("copies")).otherwise(F.array_repeat(F.lit(1).cast("bigint"), ones))
    return parts.withColumn("copies", F.explode(each)).drop("_run")


def _raw_text(raw: DataFrame, text: dict[str, Column]) -> Column:
    """What a reject shows: the line itself where there is one, else its columns."""
    if "line" in raw.columns:
        return F.col("line")
    return F.to_json(F.struct(*[text[c].alias(c) for c in DAILY_COLUMNS]))


def one_row_per_key(rows: DataFrame, many_copies: bool = False) -> DataFrame:
    """Smallest row of each key. min() combines on the map side, so rows of one key never pile up in one task.

    That sorts what a task holds; with many_copies equal rows are counted by hash first (one more shuffle of distinct rows).
    """
    rest = [c for c in rows.columns if c not in KEYS]
    smallest = F.min(F.struct(*rest)).alias("_row")
    if many_copies:
        # the filter keeps all; a plain distinct() below min() is dropped by the optimizer
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0").drop("_n")
    return rows.groupBy(*KEYS).agg(smallest).select(*KEYS, "_row.*")


def _beyond_first(rows: DataFrame, told: Iterable[str] = (), many_copies: bool = True) -> DataFrame:
    """Distinct rows with their `copies` beyond the first of each key; rows with values in `told` are all beyond.

    Equal rows are counted before the shuffle, and distinct ones shuffled again by key; with many_copies=False all rows
    are shuffled once, by key, and equal ones counted there, by hash.
    """
    if not many_copies:
        rows = rows.repartition(*KEYS, *told)
    rest = [c for c in rows.columns if c not in KEYS and c not in told]
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    place = F.row_number().over(Window.partitionBy(*KEYS, *told).orderBy(*rest))
    stays = F.col("_place") == 1
    for c in told:
        stays = stays & F.col(c).isNull()
    left = F.col("copies") - F.when(stays, 1).otherwise(0)
    return counted.withColumn("_place", place).withColumn("copies", left).drop("_place").filter("copies > 0")


def surplus_rows(rows: DataFrame) -> DataFrame:
    """Rows beyond the smallest of each key, each distinct row once with its number of copies."""
    return _beyond_first(rows).select(
        F.lit(None).cast("string").alias("source"),
        F.lit("duplicate key").alias("reason"),
        F.to_json(F.struct(*rows.columns)).alias("raw"),
        "copies",
    )


# --- files --------------------------------------------------------------------------------------


def read_daily(
    spark: SparkSession,
    path: str | list[str],
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    bad_values: str = "reject",
    quoted_breaks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Daily CSV files under one or several paths -> (good, rejects).

    With start and end, only files named for a day in between are read; others are never opened.
    Every file is read by its own header line; the lines of a file without one, or with several that differ,
    are rejects. quoted_breaks: quoted fields may hold line breaks (one more shuffle of the lines).
    """
    paths = [path] if isinstance(path, str) else list(path)
    if start is not None or end is not None:
        paths = [f for p in paths for f in files_between(spark, p, start, end)]
    if not paths:
        lines = spark.createDataFrame([], "source string, value string")
    else:
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source"), "value", *_place())
        lines = whole_records(lines) if quoted_breaks else lines.select("source", "value")
    good, rejects = split_lines(with_headers(lines), bad_values)
    dropped = (
        file_headers(lines)
        .select("source", F.explode(F.transform(_fields(F.col("header")), lambda c: F.lower(strip(c)))).alias("c"))
        .filter((F.col("c") != "") & ~F.col("c").isin(DAILY_COLUMNS))
        .select(
            "source",
            F.concat(F.lit("column dropped: "), "c").alias("reason"),
            F.lit(None).cast("string").alias("raw"),
            F.lit(0).cast("bigint").alias("copies"),
        )
    )
    return good, rejects.unionByName(dropped)


def is_header(line: Column) -> Column:
    """A line naming the required columns is a header, wherever they stand in it."""
    found = line.rlike(f"(?i){REQUIRED[0]}")  # spares most lines the patterns
    for c in REQUIRED:
        found = found & line.rlike(rf'(?i)(^|,)\s*"?{c}"?\s*(,|$)')
    return found


def file_headers(lines: DataFrame) -> DataFrame:
    """(source, header, one) of the files among lines (source, value) that have a header; one: all their headers name
    the same columns in the same order."""
    named = F.lower(F.regexp_replace("value", r'[\s"]', ""))
    found = lines.filter(is_header(F.col("value"))).groupBy("source")
    return found.agg(F.min("value").alias("header"), (F.min(named) == F.max(named)).alias("one"))


def _place() -> list[Column]:
    """Where a line stands: the part of the file that a task reads, and its place in there."""
    return [F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")]


def whole_records(lines: DataFrame) -> DataFrame:
    """Lines (source, value, block, nth) -> records (source, value): a line that ends inside quotes goes on in the next.

    A line begins inside quotes if an odd number of them stands before it in its file. They are counted per part of the
    file first, so a large file stays split; a record may run over several parts.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parts = lines.groupBy("source", "block").agg(F.sum(quotes).alias("inside"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "block", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("ahead"))
    in_part = Window.partitionBy("source", "block").orderBy("nth")
    own = F.coalesce(F.sum("quotes").over(in_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("quotes", quotes).join(parts, ["source", "block"])
    opened = placed.withColumn("opens", F.when((F.col("ahead") + own) % 2 == 0, 1).otherwise(0))
    numbered = opened.withColumn("record", F.sum("opens").over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
    # a part's lines before its first record belong to the last record of the parts before it
    counts = opened.groupBy("source", "block").agg(F.sum("opens").alias("records"))
    begun = F.when(F.col("records") > 0, F.struct(F.col("block").alias("in_block"), F.col("records").alias("number")))
    last = counts.select("source", "block", F.last(begun, ignorenulls=True).over(earlier).alias("open"))
    keyed = numbered.join(last, ["source", "block"]).select(
        "source",
        F.when(F.col("record") > 0, F.col("block")).otherwise(F.col("open.in_block")).alias("in_block"),
        F.when(F.col("record") > 0, F.col("record")).otherwise(F.col("open.number")).alias("number"),
        F.struct("block", "nth", "value").alias("part"),
    )
    records = keyed.groupBy("source", "in_block", "number").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return records.select("source", F.array_join(F.col("parts.value"), "\n").alias("value"))


def with_headers(lines: DataFrame) -> DataFrame:
    """Lines (source, value) -> (source, places, line), each with the places of its own file's header."""
    headers = file_headers(lines).select("source", F.when(F.col("one"), header_places(F.col("header"))).alias("places"))
    content = lines.filter(~is_header(F.col("value")) & (strip(F.col("value")) != ""))
    # a short row per file, as the list of files itself; lines must not be dealt out by file
    return content.join(F.broadcast(headers), "source", "left").select("source", "places", F.col("value").alias("line"))


def files_between(
    spark: SparkSession, folder: str, start: dt.date | str | None, end: dt.date | str | None
) -> list[str]:
    """Daily files of a folder named for a day in the range; at most one per day. Reads names only."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"{FILE_PREFIX}*{FILE_SUFFIX}")
        .load(folder)
        .select("path", file_date(F.element_at(F.split("path", "/"), -1)).alias("day"))
        .filter("day is not null")
    )
    if start is not None:
        listed = listed.filter(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        listed = listed.filter(F.col("day") <= F.lit(end).cast("date"))
    return sorted(r.path for r in listed.select("path").collect())


# --- texts --------------------------------------------------------------------------------------

# a quoted field, in which "" is a quote, or what stands before the next comma
_FIELD = r'(?:\s*"((?:[^"]|"")*+)"\s*|([^,]*))(?:,|$)'


def _fields(line: Column) -> Column:
    """Fields of one line, however many; empty ones are null. A last empty one may be added."""
    quoted = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1))
    plain = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(2))

    def field(q: Column, p: Column) -> Column:
        text = F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p)
        return F.when(text != "", text)

    return F.when(line.contains('"'), F.zip_with(quoted, plain, field)).otherwise(
        F.transform(F.split(line, ",", -1), lambda text: F.when(text != "", text))
    )


def header_places(header: Column) -> Column:
    """Field number of each daily column in a header line, 0 for an absent one; null without header."""

    def places(fields: Column) -> Column:
        names = F.transform(fields, lambda c: F.lower(strip(c)))
        return F.get(
            F.transform(
                F.array(names),
                lambda n: F.array(*[F.array_position(n, c).cast("int") for c in DAILY_COLUMNS]),
            ),
            F.lit(0),
        )

    return F.when(header.isNotNull(), places(_fields(header)))


def split_lines(
    lines: DataFrame, bad_values: str = "reject"
) -> tuple[DataFrame, DataFrame]:
    """Frame (source, places, line) -> (good, rejects); each line is read by its own header."""

    def place(c: str) -> Column:
        return F.get("places", F.lit(DAILY_COLUMNS.index(c)))

    usable = F.lit(True)
    for c in REQUIRED:
        usable = usable & (F.coalesce(place(c), F.lit(0)) > 0)
    read = lines.select("source", "places", "line", _fields(F.col("line")).alias("_f"))
    by_name = read.select(
        "source",
        usable.alias("_ok"),
        "line",
        *[F.get("_f", place(c) - 1).alias(c) for c in DAILY_COLUMNS],
    )
    return split_typed(by_name, bad_values, F.col("_ok"))


def read_daily_text(
    df: DataFrame, col: str, source: str | None = None, bad_values: str = "reject"
) -> tuple[DataFrame, DataFrame]:
    """A column of whole file texts -> (good, rejects)."""
    name = F.col(source).cast("string") if source else F.lit(None).cast("string")
    written = F.filter(F.split(col, r"\r?\n"), lambda x: strip(x) != "")
    # header and body are parted before the explode, so no line carries the whole text along
    parted = (
        df.select(name.alias("source"), written.alias("_lines"))
        .filter(F.size("_lines") > 0)
        .select(
            "source",
            header_places(F.get("_lines", F.lit(0))).alias("places"),
            F.slice("_lines", F.lit(2), F.size("_lines")).alias("_body"),
        )
    )
    lines = parted.select("source", "places", F.explode("_body").alias("line"))
    return split_lines(lines, bad_values)


# --- archives -----------------------------------------------------------------------------------


_ARCHIVE_FAULTS = (
    zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, UnicodeDecodeError
)


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First member ending in .CSV (upper case) of each archive, in blocks of lines.

    A member is read to its end, checksum included, before its first line is given out: an archive is loaded
    whole or is one reject.
    """
    for batch in batches:
        for source, content in zip(batch["path"], batch["content"]):
            problem = None
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [m for m in archive.namelist() if m.endswith(".CSV")]
                    if members:
                        for _ in _member_lines(archive, members[0]):
                            pass
            except _ARCHIVE_FAULTS as fault:
                problem = f"unreadable archive: {fault}"
            else:
                problem = None if members else "archive without a member that ends in .CSV"
            if problem:
                yield pd.DataFrame({"source": [source], "header": [None], "lines": [[problem]]})
                continue
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                yield from _blocks(source, _member_lines(archive, members[0]))


def _member_lines(archive: zipfile.ZipFile, name: str) -> Iterator[str]:
    with archive.open(name) as member:
        yield from (x for x in io.TextIOWrapper(member, encoding="utf-8") if x.strip())


def _blocks(source: str, lines: Iterable[str]) -> Iterator[pd.DataFrame]:
    header, block = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if header is None:
            header = line
            continue
        block.append(line)
        if len(block) == LINES_PER_BLOCK:
            yield pd.DataFrame({"source": [source], "header": [header], "lines": [block]})
            block = []
    if block:
        yield pd.DataFrame({"source": [source], "header": [header], "lines": [block]})


def archive_lines(archives: DataFrame) -> DataFrame:
    """Frame (path, content) of ZIP files -> (source, places, line); one archive is one unit of work."""
    blocks = archives.select("path", "content").mapInPandas(
        _unzip, "source string, header string, lines array<string>"
    )
    placed = blocks.select("source", header_places(F.col("header")).alias("places"), "lines")
    return placed.select("source", "places", F.explode("lines").alias("line"))


def read_daily_zip(
    spark: SparkSession, path: str, bad_values: str = "reject"
) -> tuple[DataFrame, DataFrame]:
    """ZIP archives, each with one daily CSV inside -> (good, rejects)."""
    archives = spark.read.format("binaryFile").load(path)
    return split_lines(archive_lines(archives), bad_values)
