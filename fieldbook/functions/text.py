"""Column functions for label sheets, file names and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldbook.sources.fixed import BACKBONE_FIELDS

# Extensions by kind of file.
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")

#: Date formats in the order in which they are tried; month first where both readings are possible.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yy", "yyyy/MM/dd", "d MMM yyyy")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def file_key(c: Column) -> Column:
    """A file name for comparison: lower case, white space collapsed."""
    return F.lower(collapse(c))


def site(c: Column) -> Column:
    """``SITE n`` for site numbers however written, else the text in upper case; blank is null."""
    text = F.upper(collapse(c))
    number = F.regexp_extract(text, r"SITE\s*0*(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("SITE "), number.cast("bigint").cast("string"))).otherwise(F.nullif(text, F.lit("")))


def camera(c: Column) -> Column:
    """``CAM A`` or ``CAM B`` however written, else the text in upper case; blank is null."""
    text = F.upper(collapse(c))
    letters = F.regexp_replace(text, "[^A-Z0-9]", "")
    return F.when((letters == "A") | letters.startswith("CAMA"), "CAM A").when((letters == "B") | letters.startswith("CAMB"), "CAM B").otherwise(F.nullif(text, F.lit("")))


def site_of_path(path: Column) -> Column:
    """The site that the first directory names."""
    return site(F.get(F.split(path, "/"), F.lit(0)))


def camera_of_path(path: Column) -> Column:
    """The first part of the path that reads as camera A or B."""
    return F.get(F.filter(F.transform(F.split(path, "/"), camera), lambda x: x.isin("CAM A", "CAM B")), F.lit(0))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\s*$", 1))


def file_type(name: Column) -> Column:
    """VIDEO, IMAGE or UNKNOWN by extension."""
    return F.when(extension(name).isin(*VIDEO_EXTENSIONS), "VIDEO").when(extension(name).isin(*IMAGE_EXTENSIONS), "IMAGE").otherwise("UNKNOWN")


def stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")


def clean_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """``yyyy-MM-dd`` by the first format that reads the cell, else the empty text."""
    text = collapse(c)
    read = F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])
    return F.coalesce(F.date_format(read, "yyyy-MM-dd"), F.lit(""))


def clean_datetime(day: Column, time: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` if both a cleaned date and an HH:MM:SS time read, else null."""
    return F.date_format(F.try_to_timestamp(F.concat_ws(" ", F.nullif(day, F.lit("")), F.trim(time)), F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss")


# Forms of dates in running text, in the order in which their matches are listed.
DATE_PATTERNS = (
    r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}",
    r"\d{4}[/.-]\d{1,2}[/.-]\d{1,2}",
    r"\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}",
    r"[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}",
)


def dates_in(text: Column) -> Column:
    """All dates in a text, form by form."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in DATE_PATTERNS])


# The labels of a slide's fields.
SLIDE_FIELDS = {
    "nome": "NOME",
    "name": "NAME",
    "number_id": "NUMBER ID",
    "localizacao": "LOCALIZAÇÃO",
    "site": "SITE",
    "ponto": "PONTO",
    "sex": "SEX",
    "idade": "IDADE",
    "datas": "DATAS",
    "obs": "OBS",
}


def labelled_field(text: Column, key: str, ends: Sequence[str]) -> Column:
    """The value after the first ``key:``, up to the next of ``ends``; white space collapsed, missing is empty.

    Labels compare without regard to case and values may span lines.
    """
    return collapse(F.regexp_extract(text, rf"(?isu){key}\s*:\s*(.*?)(?={'|'.join(ends)}|$)", 1))


def slide_fields(text: Column) -> dict[str, Column]:
    """Every labelled field of a slide's text; either word for a name ends no name."""
    names = {SLIDE_FIELDS["nome"], SLIDE_FIELDS["name"]}
    return {k: labelled_field(text, label, [o for o in SLIDE_FIELDS.values() if o != label and not (label in names and o in names)]) for k, label in SLIDE_FIELDS.items()}


def normal_path(c: Column) -> Column:
    """A POSIX path with forward slashes, without ``.``, ``..`` and doubled slashes where they can be resolved."""
    text = F.replace(F.trim(c), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(text, "/"), lambda x: (x != "") & (x != "."))
    absolute = text.startswith("/")
    empty = F.array().cast("array<string>")
    push = lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.concat(acc, F.array(x)))
    joined = F.array_join(F.aggregate(parts, empty, push), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def is_absolute(c: Column) -> Column:
    return c.rlike(r"^/") | c.rlike(r"^[A-Za-z]:/")


def source_path(direct: Column, file_path: Column, raw_base: Column, dataset_base: Column) -> Column:
    """The direct path below the raw (else the dataset) base, or the file path below the dataset (else the raw) base; absolute paths win."""
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    under = lambda path, base: F.when(path.isNull() | is_absolute(path), path).when(base.isNotNull(), F.concat_ws("/", base, path)).otherwise(path)
    first, second = blank_to_null(slashed(direct)), blank_to_null(slashed(file_path))
    return normal_path(F.coalesce(under(first, F.coalesce(raw_base, dataset_base)), under(second, F.coalesce(dataset_base, raw_base))))


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def header(name: str) -> str:
    """A header for comparison: upper case, runs of other characters as one underscore."""
    import re

    return re.sub(r"[^A-Z0-9]+", "_", name.upper()).strip("_")


def slug(c: Column) -> Column:
    """Camel case and other separators as dashes, lower case."""
    dashed = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2")
    return F.regexp_replace(F.regexp_replace(F.lower(dashed), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def embedding_field(model: Column) -> Column:
    """The field that a model's embeddings are kept in."""
    return F.concat(F.lit("embeddings_"), F.regexp_replace(F.element_at(F.split(model, ":"), -1), "[/-]", "_"))


def backbone_field(model: Column) -> Column:
    """The field of a known backbone's embeddings, else :func:`embedding_field`."""
    known = F.create_map(*[F.lit(x) for pair in BACKBONE_FIELDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, model), embedding_field(model))


def timestamp_or_least(c: Column) -> Column:
    """An ISO timestamp; what can't be read sorts first."""
    return F.coalesce(F.try_to_timestamp(c), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def utc_text(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def drive_id(url: Column, explicit: Column | None = None) -> Column:
    """The folder or sheet id in a shared link; an explicit id wins."""
    found = F.nullif(F.regexp_extract(url, r"/(?:folders|spreadsheets/d)/([A-Za-z0-9_-]+)", 1), F.lit(""))
    return found if explicit is None else F.coalesce(blank_to_null(explicit), found)


def stable_id(version: Column, path: Column) -> Column:
    """24 hex digits that name a path within a version."""
    return F.substring(F.sha2(F.concat(version.cast("binary"), F.lit(b"\x00"), path.cast("binary")), 256), 1, 24)


def identities_compatible(a: Column, b: Column) -> Column:
    """Either is null, or they are equal once ``b`` is trimmed."""
    return a.isNull() | b.isNull() | (F.trim(b) == a)


def number_or_text(value: Column, kind: Column) -> tuple[Column, Column]:
    """A metric as a number, and as text where it is none; a boolean (by its ``kind``) stays text."""
    number = F.when(kind != "boolean", value.try_cast("double"))
    return number, F.when(number.isNull(), value)
