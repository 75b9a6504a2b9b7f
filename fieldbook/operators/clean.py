"""Label sheets: required columns, cells, multi-file rows, identities, duplicates. Each operator is DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import text as t

# Columns of a label sheet, as its format names them.
REQUIRED = ("CAMERA TRAP SITE", "JAGUAR ID", "CAM", "Files Name")
OPTIONAL = ("LATITUDE", "LONGITUDE", "CAMERA ID", "LOCATION", "CAMERA MODEL", "DATE", "TIME", "TEMP C", "NOTES/ ERRORS", "NOTES")


def check_columns(sheet: DataFrame, required: tuple[str, ...] = REQUIRED, optional: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """Known columns only, names and cells trimmed, rows without any required cell dropped. Raises if a required column is missing."""
    sheet = sheet.toDF(*[c.strip() for c in sheet.columns])
    if missing := [c for c in required if c not in sheet.columns]:
        raise ValueError(f"missing required columns: {missing}")
    kept = [c for c in sheet.columns if c in required or c in optional]
    sheet = sheet.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(c) for c in kept]).dropna("all", subset=list(required))
    return sheet.withColumnRenamed("NOTES/ ERRORS", "NOTES")


def split_files(sheet: DataFrame, files: str, row_id: str, sighting: str = "SIGHTING_ID", place: str | None = None) -> DataFrame:
    """A row per file of a cell that lists several (by comma or ``and``); rows of one input row share a sighting ``S<row>``.

    ``row_id`` numbers the input rows, also those that list no file. A null cell
    lists none. ``place`` names a column for the file's place in its cell.
    """
    names = F.filter(F.transform(F.split(F.regexp_replace(F.col(files), " and ", ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = sheet.withColumn(sighting, F.concat(F.lit("S"), F.col(row_id)))
    if place is None:
        return rows.withColumn(files, F.explode(names))
    kept = [F.col(f"`{c}`") for c in rows.columns if c != files]
    return rows.select(*kept, F.posexplode(names).alias(place, files))


def first_of_duplicates(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key by ``order``, and the others. Nulls are equal to each other."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").drop("__n")


def fill_unknown_identities(rows: DataFrame, identity: str, order: str) -> DataFrame:
    """Missing and ``?`` identities become ``U<k>`` in row order, k going on from the largest one there is.

    The missing rows get their numbers from counts by range of ``order``, so no task numbers them all.
    """
    known = F.regexp_extract(F.col(identity), r"(?i)^\s*U(\d+)\s*$", 1).try_cast("bigint")
    missing = F.coalesce(F.trim(identity).isin("", "?"), F.lit(True))
    top = rows.agg(F.coalesce(F.max(known), F.lit(0)).alias("__top"))
    numbered = numbered_in_order(rows.where(missing), order, "__k").crossJoin(F.broadcast(top))
    filled = numbered.withColumn(identity, F.concat(F.lit("U"), (F.col("__top") + F.col("__k")).cast("string"))).drop("__k", "__top")
    return rows.where(~missing).unionByName(filled)


def numbered_in_order(rows: DataFrame, order: str, into: str) -> DataFrame:
    """``rows`` numbered from 1 by ``order``: range partitions are counted, and each numbers its own rows from there."""
    ranged = rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    from fieldbook.session import materialize

    ranged = materialize(ranged, "numbered")
    counts = ranged.groupBy("__part").count()
    before = counts.select(F.col("__part").alias("__p"), (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.withColumn(into, own).join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(into, F.col(into) + F.col("__before")).drop("__part", "__p", "__before")


def fill_identities_by_sex(rows: DataFrame, identity: str, sex: str, order: str) -> DataFrame:
    """Missing identities become the next F, M or U number by sex (else U), in row order."""
    prefix = F.when(F.upper(F.substring(sex, 1, 1)).isin("F", "M"), F.upper(F.substring(sex, 1, 1))).otherwise("U")
    own = F.regexp_extract(F.col(identity), r"^([FMU])(\d+)$", 1)
    number = F.regexp_extract(F.col(identity), r"^([FMU])(\d+)$", 2).try_cast("bigint")
    missing = F.coalesce(F.trim(identity) == "", F.lit(True))
    top = rows.where(own != "").groupBy(own.alias("__prefix")).agg(F.max(number).alias("__top"))
    filled = rows.where(missing).withColumn("__prefix", prefix)
    parts = [numbered_in_order(filled.where(F.col("__prefix") == p), order, "__k") for p in "FMU"]
    filled = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(F.broadcast(top), "__prefix", "left")
    filled = filled.withColumn(identity, F.concat("__prefix", (F.coalesce("__top", F.lit(0)) + F.col("__k")).cast("string")))
    return rows.where(~missing).unionByName(filled.select(*rows.columns))


def add_file_metadata(rows: DataFrame, name: str = "Files Name", site: str = "CAMERA TRAP SITE", cam: str = "CAM", base: str = "") -> DataFrame:
    """Type and extension of each file, the raw path, and copies of the cells that cleaning changes."""
    return rows.withColumns(
        {"FILE TYPE": t.file_type(F.col(name)), "FILE EXTENSION": t.extension(F.col(name)), "RAW DATA PATH": F.lit(base), "FILE NAME": F.col(name), "ORIGINAL SITE": F.col(f"`{site}`"), "ORIGINAL CAM": F.col(cam)}
    )


def normalise_places(rows: DataFrame, site: str = "CAMERA TRAP SITE", cam: str = "CAM") -> DataFrame:
    return rows.withColumns({site: t.site(F.col(f"`{site}`")), cam: t.camera(F.col(cam))})


def clean_dates(rows: DataFrame, date: str = "DATE", time: str = "TIME") -> DataFrame:
    """The date as ``yyyy-MM-dd`` or empty, and DATETIME where the time reads too."""
    rows = rows.withColumn(date, t.clean_date(F.col(date)))
    return rows.withColumn("DATETIME", t.clean_datetime(F.col(date), F.col(time)))


# Words for sexes, in the order in which they are tried as prefixes.
SEXES = {
    "UNKNOWN": "U",
    "FEMALE JUVENILE": "F",
    "MALE JUVENILE": "M",
    "UNKNOWN JUVENILE": "U",
    "MALE": "M",
    "FEMALE": "F",
    "MACHO": "M",
    "FEMEA": "F",
    "M": "M",
    "F": "F",
    "U": "U",
}


def slide_rows(slides: DataFrame, order: str) -> DataFrame:
    """``slides`` (text, name, order, ...) with identity, site, sex, location, notes, date and sighting from their labelled texts.

    The date falls back to the text's only date. An identity loses question
    marks, accents and a remark in brackets.
    """
    f = t.slide_fields(F.col("text"))
    identity = F.replace(t.first_filled(f["number_id"], f["name"], f["nome"]), F.lit("?"), F.lit(""))
    plain = F.translate(F.upper(F.trim(identity)), "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "AAAAAEEEEIIIIOOOOOUUUUCN")
    plain = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    number = F.regexp_replace(t.first_filled(f["site"], f["ponto"]), "^0+", "")
    sex = F.upper(F.trim(f["sex"]))
    dates = t.dates_in(F.col("text"))
    own = t.clean_date(f["datas"])
    short = F.lit(None).cast("string")
    for word, letter in reversed(SEXES.items()):
        short = F.when(sex.startswith(word), letter).otherwise(short)
    return numbered_in_order(slides, order, "__n").withColumns(
        {
            "identity": F.trim(F.regexp_replace(plain, r"\s*\(.*\)$", "")),
            "site": F.when(F.upper(number).startswith("SITE"), number).otherwise(F.concat(F.lit("SITE "), number)),
            "sex": F.coalesce(short, f["sex"]),
            "location": f["localizacao"],
            "notes": f["obs"],
            "date": F.when((own == "") & (F.size(dates) == 1), t.clean_date(F.get(dates, F.lit(0)))).otherwise(own),
            "SIGHTING_ID": F.concat(F.lit("PP"), F.col("__n").cast("string")),
        }
    ).drop("__n")


def clean_sheet(sheet: DataFrame, row_id: str, base: str = "") -> DataFrame:
    """The whole chain: columns, files, metadata, places, dates, identities, first of duplicates. ``row_id`` numbers the rows."""
    ids = sheet.select(row_id, *[c for c in sheet.columns if c != row_id])
    rows = check_columns(ids, REQUIRED, (*OPTIONAL, row_id)).withColumn(row_id, F.col(row_id).cast("bigint"))
    rows = split_files(rows, "Files Name", row_id, place="__file").withColumn("__order", F.struct(row_id, "__file"))
    rows = add_file_metadata(rows, base=base).transform(normalise_places)
    rows = clean_dates(rows) if {"DATE", "TIME"} <= set(rows.columns) else rows
    rows = first_of_duplicates(rows, ["CAMERA TRAP SITE", "CAM", "JAGUAR ID", "Files Name"], "__order")[0]
    return fill_unknown_identities(rows, "JAGUAR ID", "__order").drop("__file", "__order")
