"""Readers for universe files, registries, bulk dumps, filings and archives. Schemas are always explicit."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import col
from ..operators.distribution import attach
from ..session import materialize, names_below

REGISTRY_ITEM = "array<struct<ticker:string,sector:string,cap_tier:string>>"


def read_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, upper-case tickers; blank ones dropped; default sector and tier filled in."""
    raw = spark.read.csv(path, header=True, schema="ticker string, sector string, cap_tier string", mode="PERMISSIVE")
    def text(n, default):
        return F.coalesce(F.nullif(F.trim(n), F.lit("")), F.lit(default))

    return raw.select(
        F.upper(F.trim("ticker")).alias("ticker"), text("sector", "Unknown").alias("sector"), text("cap_tier", "large").alias("cap_tier")
    ).where("ticker <> ''")


def read_registry(spark: SparkSession, path: str, regions: dict[str, str]) -> DataFrame:
    """Registry documents (one JSON object each: list name -> array of structs) to flat rows."""
    schema = ", ".join(f"{name} {REGISTRY_ITEM}" for name in regions)
    doc = spark.read.json(path, schema=schema)
    tagged = F.array(*[F.struct(F.lit(m).alias("market"), F.col(n).alias("items")) for n, m in regions.items()])
    return doc.select(F.explode(tagged).alias("r")).select("r.market", F.explode("r.items").alias("i")).select("market", "i.*")


def coerce_cell(x) -> Column:
    """Typed view of a text cell: struct(as_long, as_double, as_text); blank is all missing."""
    s = F.nullif(F.trim(col(x)), F.lit(""))
    whole = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("long"))
    number = s.try_cast("double")
    return F.struct(
        whole.alias("as_long"), F.when(whole.isNull(), number).alias("as_double"),
        F.when(whole.isNull() & number.isNull(), s).alias("as_text"),
    )


def sniff_bulk(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Dumps of mixed format below one folder, each file read as what it is; adds `bad`, the text of what did not parse.

    The first line that is not blank tells the format of a file: `[` or a lone `{` is JSON over several lines, `{` one JSON object a line, anything
    else CSV with a header, whose whole line names the cells of that file, of any width. Rows without a value in any column are left out unless they are bad.

    Formats and headers are a table of one row per file that is joined back to the lines; the driver sees nothing but the widest CSV header's number of cells. A file of JSON over
    several lines is put together in one row, as its parser needs it whole; all other lines stay where they are.
    """
    fields = spark.createDataFrame([], schema).schema
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = materialize(spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place")), "lines")
    first = lines.where(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "place").alias("head"), F.min("place").alias("start"))
    head = F.trim("head")
    kind = F.when(head.startswith("[") | (head == "{"), "array").when(head.startswith("{"), "lines").otherwise("csv")
    # the first line of an array may be the whole file, with a comma per cell of every row
    width = first.where(kind == "csv").agg(F.coalesce(F.max(F.length("head") - F.length(F.replace("head", F.lit(","), F.lit(""))) + 1), F.lit(1))).first()[0]
    row = ", ".join(f"c{i} string" for i in range(width))

    def split(df: DataFrame, line: str, name: str) -> DataFrame:
        """The cells of a line as an array; a generator, so that each line is parsed once."""
        cells = df.select(*df.columns, F.inline(F.array(F.from_csv(line, row))))
        return cells.select(*df.columns, F.array(*[f"c{i}" for i in range(width)]).alias(name))

    files = split(first.select("file", "start", F.when(kind == "csv", F.col("head")).alias("head"), kind.alias("kind")), "head", "names")
    names = F.when(F.col("kind") == "csv", F.transform("names", lambda n: F.lower(F.trim(n))))
    there = attach(lines, files.select("file", "start", "kind", names.alias("names")), ["file"], "inner")

    dump = split(there.where("kind = 'csv' AND place > start AND trim(value) <> ''").select("names", "value"), "value", "cells")
    cell = {f.name: F.get("cells", (F.array_position("names", f.name.lower()) - 1).cast("int")) for f in fields}
    wrong = F.lit(False)
    for f in fields:
        wrong = wrong | (cell[f.name].isNotNull() & cell[f.name].try_cast(f.dataType).isNull())
    typed = [F.when(F.array_contains("names", f.name.lower()), cell[f.name].try_cast(f.dataType)).alias(f.name) for f in fields]
    csv = dump.select(*typed, F.when(wrong, F.col("value")).alias("bad"))

    lenient = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    objects = there.where("kind = 'lines' AND trim(value) <> ''").select(F.from_json("value", f"{schema}, bad string", lenient).alias("r")).select("r.*")
    whole = there.where("kind = 'array'").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n").alias("value"))
    read = whole.select("value", F.from_json("value", f"array<struct<{schema_of(fields)}, bad:string>>", lenient).alias("items"))
    broken = F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], F.col("value").alias("bad")))
    arrays = read.select(F.inline(F.coalesce("items", broken)))
    return csv.unionByName(objects).unionByName(arrays).dropna(how="all")


def schema_of(fields) -> str:
    """Fields as they stand in a struct type's name."""
    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing dump reads as an empty table of the right shape."""
    try:
        return spark.read.json(path, schema=schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


FORM4 = (
    "issuer string, filed string, owner struct<id string, title string>, "
    "tx array<struct<code string, shares double, price double, day string>>"
)


def read_filings_xml(spark: SparkSession, path: str) -> DataFrame:
    """Ownership filings, one row per transaction with value = shares x price."""
    raw = spark.read.format("xml").option("rowTag", "filing").schema(FORM4).load(path)
    t = raw.select("issuer", F.to_date("filed").alias("filed"), F.col("owner.id").alias("insider_id"), F.col("owner.title").alias("title"), F.explode("tx").alias("t"))
    return t.select(
        "issuer", "filed", "insider_id", "title", "t.code", "t.shares", "t.price", F.to_date("t.day").alias("d"), (F.col("t.shares") * F.col("t.price")).alias("value")
    )


# Titles that count as key roles.
KEY_ROLES = (
    "CEO", "CFO", "COO", "CTO", "DIRECTOR", "PRESIDENT", "CHIEF EXECUTIVE", "CHIEF FINANCIAL", "CHIEF OPERATING",
    "CHAIRMAN", "FOUNDER",
)


def is_key_role(title) -> Column:
    return F.upper(col(title)).rlike("|".join(KEY_ROLES))


def committed(spark: SparkSession, path: str, schema: str, day: str = "snapshot_date") -> DataFrame:
    """The rows of committed dates with their date, see `writers.write_snapshot`; what is not committed is not looked at."""
    rows = f"{schema}, run string, {day} date"
    if not (dates := [x for x in names_below(spark, f"{path}/commits") if x.startswith(f"{day}=")]):
        return spark.createDataFrame([], rows).drop("run")
    said = spark.read.text([f"{path}/commits/{x}" for x in dates], wholetext=True).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("date")).collect()
    parts = [f"{path}/parts/run={r['value']}/{unquote(r['date'])}" for r in said]
    return spark.read.schema(rows).option("basePath", f"{path}/parts").parquet(*parts).drop("run")


def read_snapshots(spark: SparkSession, path: str, schema: str, start: str, end: str, min_rows: int, min_snapshots: int | None = None) -> DataFrame:
    """Committed dates in range, thin ones left out; too few left stops the run.

    Row counts per date are a grouped aggregate joined back, so no date is gathered in one task.
    """
    raw = committed(spark, path, schema).where(F.col("snapshot_date").between(start, end))
    ok = raw.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    if min_snapshots is not None:
        found = ok.count()
        if found < min_snapshots:
            from ..operators.quality import IntegrityError

            raise IntegrityError(f"only {found} snapshots with {min_rows} rows, {min_snapshots} needed")
    return raw.join(ok.select("snapshot_date"), "snapshot_date", "left_semi")


ENTRY = "struct<ticker:string,final_score:double,badge:string,market:string,cap_tier:string>"
# Lists of an archived document, and the lowest score each badge may carry.
ARCHIVE_LISTS = ("top_buys", "top_buys_usa", "top_buys_europe", "top_buys_asia", "mid_caps", "small_caps")
BADGE_FLOOR = {"HIGH BUY": 0.80, "TACTICAL BUY": 0.60}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of every list of every archived document: generated_at, bucket, entry columns."""
    schema = "generated_at timestamp, " + ", ".join(f"{b} array<{ENTRY}>" for b in ARCHIVE_LISTS)
    docs = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    tagged = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("items")) for b in ARCHIVE_LISTS])
    return docs.select("generated_at", F.explode(tagged).alias("l")).select("generated_at", "l.bucket", F.explode("l.items").alias("e")).select("generated_at", "bucket", "e.*")


def archive_signals(entries: DataFrame) -> DataFrame:
    """Entries whose score supports their badge, once per ticker and date; late runs enter the next day."""
    from ..functions.common import lookup

    ok = entries.where(F.col("final_score") >= lookup(BADGE_FLOOR, "badge")).withColumn("ticker", F.upper(F.trim("ticker"))).where("ticker <> ''")
    first = ok.groupBy("ticker", F.to_date("generated_at").alias("signal_date")).agg(
        F.min_by(F.struct("badge", "final_score", "market", "cap_tier"), F.struct("generated_at", F.array_position(F.array(*map(F.lit, ARCHIVE_LISTS)), F.col("bucket")))).alias("e"),
        (F.hour(F.min("generated_at")) >= 21).alias("entry_next_day"),
    )
    return first.select("ticker", "signal_date", "e.*", "entry_next_day")


def read_rows_any(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows from documents that keep them under results, rankings or rows."""
    doc = spark.read.json(path, schema=", ".join(f"{n} array<{item}>" for n in ("results", "rankings", "rows")))
    return doc.select(F.inline(F.coalesce("results", "rankings", "rows")))
