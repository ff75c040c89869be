"""Readers: messy CSV files, snapshots, JSON series and feeds, HTML and text tables, spreadsheets as rows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.functions import dates, parse, text
from gaugeflow.operators.profile import with_percentiles
from gaugeflow.operators.reshape import melt, union_all


def csv_strings(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """A CSV file with a header, every column as text, the file's name and the order of rows."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=False)
    return df.withColumns({"source_file": F.col("_metadata.file_name"), "_seq": F.monotonically_increasing_id()})


def sniffed_separator(head: str) -> str:
    """Tab, semicolon or comma: the most frequent in the beginning of a file."""
    return max("\t;,", key=lambda c: (head[:4096].count(c), c == ","))


def sniffed_csv(spark: SparkSession, path: str, river: str | None = None) -> DataFrame:
    """A CSV of unknown separator with cleaned headers and without blank rows.

    With ``river`` the rows that name it are kept, or all if none does.
    """
    head = spark.read.text(path).limit(20).agg(F.array_join(F.collect_list("value"), "\n")).first()[0] or ""
    df = spark.read.csv(path, header=True, sep=sniffed_separator(head))
    df = df.toDF(*unique(re.sub(r"\W+", "_", c.strip().lower()).strip("_") or "column" for c in df.columns)).dropna(how="all")
    if river is None:
        return df
    named = df.where(F.contains(F.lower(F.concat_ws(" ", *df.columns)), F.lit(river.lower())))
    return df if named.isEmpty() else named


def unique(names: Iterable[str]) -> list[str]:
    """Names with a number after those that repeat."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


ROLES = {
    "station_name": ("station_name", "station", "locations", "location", "name"),
    "station_code": ("station_code", "station_id", "stationid", "code"),
    "state": ("state", "state_name"),
    "date": ("date", "sample_date", "timestampdate", "data_acquisition_time"),
    "year": ("year", "_year"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "long"),
    "river": ("river", "basin", "water_body"),
}


def column_roles(columns: list[str]) -> dict[str, str]:
    """Role -> column, by the first header that a role knows."""
    lower = {c.lower().strip(): c for c in columns}
    return {role: lower[k] for role, keys in ROLES.items() for k in [next((k for k in keys if k in lower), None)] if k}


def open_data(df: DataFrame, source: str, strict: bool = True) -> DataFrame:
    """Long observations of a wide table whose headers tell the roles of its columns."""
    roles = column_roles(df.columns)
    rest = [c for c in df.columns if c not in roles.values() and c not in ("source_file", "_seq")]
    measures = {h: p for h, p in text.header_roles(rest, strict).items()}
    number = lambda c: parse.number(F.trim(F.col(f"`{c}`").cast("string")))
    meta = {r: F.col(f"`{roles[r]}`").cast("string") if r in roles else F.lit(None).cast("string") for r in ROLES}
    keys = [c.alias(r) for r, c in meta.items()]
    seq = F.col("_seq") if "_seq" in df.columns else F.monotonically_increasing_id()
    wide = df.select(*keys, seq.alias("_row"), *[number(h).alias(f"m{i}") for i, h in enumerate(measures)])
    long = melt(wide, [*ROLES, "_row"], [f"m{i}" for i in range(len(measures))], "_m", "value")
    place = F.substring("_m", 2, 9).cast("int")
    names = F.array(*[F.lit(p) for p in measures.values()])
    return long.where("station_name IS NOT NULL").select(
        text.station_name(F.col("station_name")).alias("station_name"), "station_code", text.state_name(F.col("state")).alias("state"),
        parse.number(F.col("latitude")).alias("latitude"), parse.number(F.col("longitude")).alias("longitude"),
        parse.safe_date(F.col("date")).alias("date"), F.col("year").try_cast("int").alias("year"), "river",
        F.get(names, place).alias("parameter"), "value", F.lit(source).alias("source"),
        (F.col("_row") * 1000 + place).alias("_seq"),
    )


def open_data_files(spark: SparkSession, paths: list[str], source: str, strict: bool = True) -> DataFrame:
    """``open_data`` of each file, as headers differ, in the order of their names."""
    return union_all([open_data(csv_strings(spark, p), source, strict) for p in sorted(paths)])


def spread_records(df: DataFrame, parameters: list[str], source: str = "nwmp_pdf") -> DataFrame:
    """Long observations of columns p, p_min, p_max: the value, else their mean, else either end."""
    cell = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    items = [F.struct(F.lit(p).alias("parameter"), cell(p).alias("v"), cell(f"{p}_min").alias("lo"), cell(f"{p}_max").alias("hi")) for p in parameters]
    meta = [c for c in ("station_code", "station_name", "state", "source_page") if c in df.columns]
    year = F.col("year").try_cast("int")
    rows = df.select(*meta, year.alias("year"), F.make_date(year, F.lit(1), F.lit(1)).alias("date"), F.lit(source).alias("source"), F.explode(F.array(*items)).alias("e"))
    # parsed after the explode, so that the code holds three parsers and not three per parameter
    given = [c for c in rows.columns if c != "e"]
    read = rows.select(*given, "e.parameter", *[parse.table_number(F.col(f"e.{c}")).alias(f"_{c}") for c in ("v", "lo", "hi")])
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    both = v.isNull() & lo.isNotNull() & hi.isNotNull()
    value = F.coalesce(v, (lo + hi) / 2, lo, hi).alias("value")
    return read.select(*given, "parameter", value, F.when(both, lo).alias("value_min"), F.when(both, hi).alias("value_max")).where("value IS NOT NULL")


def standard_source(df: DataFrame, source: str, columns: dict[str, str], *, date: str | None = None, year: str | None = None, month: int = 7, id_col: str | None = None, name_col: str | None = None, contains: tuple[str, str] | None = None) -> DataFrame:
    """A wide source in the common columns: ids, place, date, source, year and measures.

    ``columns`` maps measures to source columns; of several for one measure the
    last wins.  Without ``date`` the date is the first of ``month`` of the year.
    ``contains`` keeps rows whose column holds a word.
    """
    if contains:
        df = df.where(F.coalesce(F.contains(F.lower(F.col(contains[0])), F.lit(contains[1].lower())), F.lit(False)))
    get = lambda c, kind="string": F.col(f"`{c}`").cast(kind) if c and c in df.columns else F.lit(None).cast(kind)
    y = get(year).try_cast("int")
    day = parse.parse_date(get(date)) if date else F.make_date(y, F.lit(month), F.lit(1))
    measures = {m: parse.to_numeric(get(c)) for c, m in columns.items()}
    return df.select(
        F.coalesce(get(id_col), get(name_col)).alias("station_id"), F.coalesce(get(name_col), get(id_col), F.lit("unknown")).alias("station_name"),
        parse.number(get("latitude")).alias("latitude"), parse.number(get("longitude")).alias("longitude"), day.alias("date"), F.lit(source).alias("source"),
        F.coalesce(y, F.year(day)).alias("year"), *[v.alias(m) for m, v in measures.items()],
    )


def series_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """Rows of nested series: a list of {ts_name, ts_unitsymbol, data: [[time, value, percent], ..]}."""
    kind = "array<struct<ts_name:string,ts_unitsymbol:string,data:array<array<string>>>>"
    keep = [c for c in df.columns if c != column]
    series = df.select(*keep, F.explode(F.from_json(column, kind)).alias("s"))
    points = series.select(*keep, F.col("s.ts_name").alias("aggregation"), F.col("s.ts_unitsymbol").alias("unit"), F.explode("s.data").alias("p"))
    stamp = parse.mixed_timestamp(F.col("p")[0], ("yyyy-MM-dd'T'HH:mm:ss[.SSS]X", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"))
    return points.where(F.size("p") >= 3).select(*keep, "aggregation", "unit", stamp.alias("timestamp"), parse.finite(F.col("p")[1]).alias("value"), parse.finite(F.col("p")[2]).alias("quality_pct"))


def feed_rows(df: DataFrame, names: dict[str, str], column: str = "json") -> DataFrame:
    """Snapshot rows of a feed of latest readings; names are mapped where known."""
    kind = "array<struct<station_id:string,timestamp:string,ts_value:string,ts_unitsymbol:string,stationparameter_no:string,stationparameter_longname:string>>"
    rows = df.select(F.explode(F.from_json(column, kind)).alias("r")).select("r.*")
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("stationparameter_longname")) if names else F.lit(None).cast("string")
    stamp = parse.mixed_timestamp(F.col("timestamp"))
    return rows.select(
        F.col("station_id").try_cast("long").alias("stationId"), stamp.alias("timestamp"), F.date_format(stamp, "yyyy-MM-dd").alias("timestampDate"), parse.finite(F.col("ts_value")).alias("value"),
        F.col("ts_unitsymbol").alias("unit"), F.col("stationparameter_no").alias("parameterNo"), F.coalesce(mapped, "stationparameter_longname").alias("parameterName"),
    )


def json_fields(df: DataFrame, column: str, kinds: str) -> DataFrame:
    """The fields of a flat JSON column in its place; what isn't of its kind is null."""
    return df.withColumn("_j", F.from_json(column, kinds)).select(*[c for c in df.columns if c != column], "_j.*")


def tag_texts(df: DataFrame, column: str, tags: list[str], counts: dict[str, str]) -> DataFrame:
    """``df`` with the text of the first of each tag, and how often pieces of HTML occur."""
    texts = {t: F.regexp_extract(column, f"<{t}>([^<]*)</{t}>", 1) for t in tags}
    return df.withColumns({**texts, **{n: F.regexp_count(column, F.lit(piece)).cast("long") for n, piece in counts.items()}})


def html_rows(df: DataFrame, column: str = "html") -> DataFrame:
    """(.., row, cells): the table rows of HTML, cells without tags."""
    keep = [c for c in df.columns if c != column]
    rows = df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"&nbsp;|\s+", " ")))
    return rows.select(*keep, "row", plain.alias("cells"))


def annual_report(df: DataFrame, parameters: list[str], skip: int = 6) -> DataFrame:
    """Long min, max, mean of report tables: rows of ``html_rows`` with a number in front and all cells."""
    need = 3 + 3 * len(parameters)
    good = df.where((F.col("row") >= skip) & (F.size("cells") >= need) & F.get("cells", F.lit(0)).rlike(r"^\d"))
    triple = lambda i, k: F.get("cells", F.lit(3 + 3 * i + k))
    items = F.array(*[F.struct(F.lit(p).alias("parameter"), *[triple(i, k).alias(n) for k, n in enumerate(("value_min", "value_max", "value"))]) for i, p in enumerate(parameters)])
    meta = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("station_code", "station_name", "state"))]
    rows = good.select(*[c for c in df.columns if c not in ("row", "cells")], *meta, F.explode(items).alias("e"))
    given = [c for c in rows.columns if c != "e"]
    return rows.select(*given, "e.parameter", *[parse.table_number(F.col(f"e.{n}")).alias(n) for n in ("value_min", "value_max", "value")])


def header_row(cells: Column, keywords: list[str], least: int = 2) -> Column:
    """Whether a row of cells names at least ``least`` keywords."""
    return text.keyword_hits(F.array_join(cells, " "), keywords) >= least


def table_records(df: DataFrame, keywords: dict[str, str], least: int = 2, first: int = 5) -> DataFrame:
    """Records of extracted tables (table, row, cells): the header is the first row, of the first
    ``first``, with ``least`` keywords; each later cell gets the name of its header's keyword."""
    hits = header_row(F.col("cells"), list(keywords), least)
    heads = df.where((F.col("row") < first) & hits).groupBy("table").agg(F.min_by("cells", "row").alias("_head"), F.min("row").alias("_at"))
    body = df.join(heads, "table").where("row > _at").select("table", "row", "cells", F.posexplode("_head").alias("_i", "_h"))
    name = F.coalesce(*[F.when(F.contains(F.lower("_h"), F.lit(k)), v) for k, v in keywords.items()])
    return body.select("table", "row", name.alias("name"), F.get("cells", F.col("_i")).alias("cell")).where("name IS NOT NULL")


def gemstat(df: DataFrame) -> DataFrame:
    """Canonical observations of the international long file; other countries go, a blank one passes."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))
    country = F.lower(F.coalesce(pick("Country", "Country Name"), F.lit("")))
    rows = df.where((country == "") | F.contains(country, F.lit("india")))
    raw = pick("Parameter", "Parameter Name", "Parameter Code")
    return rows.select(
        pick("GEMS Station Number", "Station Number").alias("source_station_id"), pick("Station Name", "Station").alias("station_name"), pick("Water Body", "River").alias("river"), pick("State").alias("state"),
        F.coalesce(parse.number(pick("Latitude")), F.lit(0.0)).alias("latitude"), F.coalesce(parse.number(pick("Longitude")), F.lit(0.0)).alias("longitude"),
        parse.parse_date(pick("Sample Date", "Date")).alias("sample_date"), text.raw_parameter(raw).alias("parameter"), raw.alias("source_parameter"),
        parse.safe_float(pick("Value", "Analysis Result")).alias("value"), pick("Unit", "Units").alias("unit"), F.lit("gemstat").alias("source"),
    ).where("sample_date IS NOT NULL AND value IS NOT NULL")


def hydrology(df: DataFrame) -> DataFrame:
    """Canonical levels and discharges of hydrology files; columns are found by words in their headers."""
    find = lambda *words: next((c for w in words for c in df.columns if w in c.lower()), None)
    name, flow, level = find("station", "site"), find("discharge", "flow"), find("level", "gauge")
    unit = "cusec" if flow and "cusec" in flow.lower() else "cumec"
    get = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    sid = F.concat(F.lit("cwc_"), F.substring(F.replace(F.lower(F.trim(get(name))), F.lit(" "), F.lit("_")), 1, 30))
    items = F.array(
        F.struct(F.lit("water_level").alias("parameter"), parse.safe_float(get(level)).alias("value"), F.lit("m").alias("unit")),
        F.struct(F.lit("discharge").alias("parameter"), parse.safe_float(get(flow)).alias("value"), F.lit(unit).alias("unit")),
    )
    return df.select(sid.alias("source_station_id"), get(name).alias("station_name"), get(find("basin", "river")).alias("river"), get(find("state")).alias("state"), parse.parse_date(get(find("date"))).alias("sample_date"), F.explode(items).alias("e")).select(
        "*", "e.*", F.lit("cwc").alias("source")
    ).drop("e").where("value IS NOT NULL AND sample_date IS NOT NULL")


def band_statistics(pixels: DataFrame, nodata: float | None = None, keys: tuple[str, ...] = ("file", "band")) -> DataFrame:
    """Count, mean, deviation, ends and percentiles of pixels (.., value) that aren't nodata."""
    v = F.col("value")
    fine = ~F.isnan(v) if nodata is None else ~F.isnan(v) & (v != nodata)
    good = pixels.where(v.isNotNull() & fine)
    one = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    one = with_percentiles(one, good, list(keys), "value", [0.05, 0.5, 0.95])
    return one.select(*keys, "count", "mean", "std", "min", "max", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


def consolidated(frames: list[DataFrame], first: list[str]) -> DataFrame:
    """All rows; the columns of ``first`` that exist, then the others by name."""
    both = union_all(frames)
    return both.select(*[c for c in first if c in both.columns], *sorted(c for c in both.columns if c not in first))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SNAPSHOT).csv(path, header=True, pathGlobFilter="water_data_*.csv")


def season_of(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn("season", dates.season(F.month(date)))


PLACE_WORDS = ["station", "location", "site", "river", "water_body", "waterbody", "name"]


def naming(df: DataFrame, words: list[str]) -> DataFrame:
    """Rows whose columns of places, or all text columns where there are none, hold any of ``words``."""
    texts = [c for c in df.columns if any(w in c.lower() for w in PLACE_WORDS)]
    texts = texts or [n for n, kind in df.dtypes if kind == "string"]
    hit = F.lit(False)
    for c in texts:
        low = F.lower(F.col(f"`{c}`").cast("string"))
        for w in words:
            hit = hit | F.coalesce(F.contains(low, F.lit(w.lower())), F.lit(False))
    return df.where(hit)


def manifest(packages: dict[str, DataFrame]) -> DataFrame:
    """A row per package: its name, rows and columns."""
    rows = [df.agg(F.lit(name).alias("package"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")) for name, df in packages.items()]
    return union_all(rows)


def staged(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Those of ``paths`` that exist."""
    def exists(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    return {name: path for name, path in paths.items() if exists(path)}


def yearly_means(df: DataFrame, source: str, year: int) -> DataFrame:
    """A yearly file whose headers of means name their measures, dated to the first of July."""
    columns = {}
    for c in df.columns:
        if "mean" in c.lower():
            measure = next((m for words, m in schema.MEAN_COLUMNS if any(w in c.lower() for w in words)), None)
            if measure:
                columns[c] = measure
    return standard_source(df.withColumn("_year", F.lit(year)), source, columns, year="_year", id_col="station_code", name_col="locations")


def yearly_medians(df: DataFrame, source: str) -> DataFrame:
    columns = {"do__mg_l_": "Dissolved_Oxygen_mg_l", "bod__mg_l_": "BOD_mg_l", "ph": "pH", "fc__mpn_100ml_": "Fecal_Coliform_MPN_100ml"}
    return standard_source(df, source, {c: m for c, m in columns.items() if c in df.columns}, year="_year", id_col="station_code", name_col="station_name")


def stationwise(df: DataFrame, source: str, year: int, holding: str = "", id_col: str = "station_name") -> DataFrame:
    """A file with oxygen and coliform columns, the first of each whose header has ``holding``."""
    columns = {}
    for word, measure in (("dissolved_oxygen", "Dissolved_Oxygen_mg_l"), ("faecal", "Fecal_Coliform_MPN_100ml")):
        found = next((c for c in df.columns if word in c.lower() and holding in c), None)
        if found:
            columns[found] = measure
    return standard_source(df.withColumn("_year", F.lit(year)), source, columns, year="_year", id_col=id_col if id_col in df.columns else "station_name", name_col="station_name")


def surface_water(df: DataFrame, source: str, river: str = "Ganga") -> DataFrame:
    """The large file of surface water, of one basin."""
    df = df.withColumnsRenamed({"Latitude": "latitude", "Longitude": "longitude"})
    columns = {c: m for c, m in schema.SURFACE_COLUMNS.items() if c in df.columns}
    basin = ("Basin", river) if "Basin" in df.columns else None
    return standard_source(df, source, columns, date="Date", year="Year", id_col="Station_Name", name_col="Station_Name", contains=basin)


def joined_fragments(df: DataFrame, least: int = 3) -> DataFrame:
    """Tables (table, row, cells) that were cut by pages: a table of as many columns as the one before it goes on with its rows.

    ``table`` counts from 0; rows of fewer than ``least`` cells are left out.
    """
    rows = df.where(F.size("cells") >= least)
    heads = rows.groupBy("table").agg(F.max(F.size("cells")).alias("_n"))
    before = Window.partitionBy().orderBy("table")  # a row per table
    groups = heads.withColumn("_new", F.coalesce((F.lag("_n").over(before) != F.col("_n")).cast("int"), F.lit(1)))
    groups = groups.select("table", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_group"))
    placed = rows.join(F.broadcast(groups), "table")
    at = F.row_number().over(Window.partitionBy("_group").orderBy("table", "row")) - 1
    return placed.select((F.col("_group") - 1).alias("table"), at.alias("row"), "cells")
