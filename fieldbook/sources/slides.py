"""Slide decks: a row per picture, with crop, slide text and bytes."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# XML names of the slide format.
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

SCHEMA = "deck string, slide int, picture int, name string, text string, crop_left double, crop_top double, crop_right double, crop_bottom double, sha1 string, content binary, error string"


def pictures_of(deck: bytes) -> Iterator[tuple]:
    """(slide, picture, name, text, crops, sha1, bytes) of all slides but the first."""
    with zipfile.ZipFile(io.BytesIO(deck)) as z:
        numbers = sorted(int(m[1]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number in numbers[1:]:
            root = ElementTree.fromstring(z.read(f"ppt/slides/slide{number}.xml"))
            links = {}
            try:
                for e in ElementTree.fromstring(z.read(f"ppt/slides/_rels/slide{number}.xml.rels")):
                    links[e.get("Id")] = e.get("Target")
            except KeyError:
                pass
            text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in root.iter(f"{_A}p"))
            for k, pic in enumerate(root.iter(f"{_P}pic"), 1):
                blip = pic.find(f".//{_A}blip")
                target = links.get(blip.get(f"{_R}embed")) if blip is not None else None
                if not target:
                    continue
                content = z.read("ppt/" + target.replace("../", ""))
                rect = pic.find(f".//{_A}srcRect")
                crop = [int((rect.get(side) if rect is not None else None) or 0) / 100_000 for side in "ltrb"]
                yield number, k, f"slide_{number:03d}_img_{k:02d}.{target.rsplit('.', 1)[-1].lower()}", text.strip(), crop, hashlib.sha1(content).hexdigest(), content


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    """A row per picture of every deck at ``path``; one deck at a time is held in memory. A broken deck ends with a row that holds its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for deck, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    for slide, k, name, text, crop, sha1, data in pictures_of(content.as_py()):
                        yield pa.RecordBatch.from_pylist([{"deck": deck, "slide": slide, "picture": k, "name": name, "text": text, "crop_left": crop[0], "crop_top": crop[1], "crop_right": crop[2], "crop_bottom": crop[3], "sha1": sha1, "content": data}], schema=_arrow())
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as error:
                    yield pa.RecordBatch.from_pylist([{"deck": deck, "error": f"{type(error).__name__}: {error}"}], schema=_arrow())

    decks = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").load(path).select("path", "content")
    return decks.mapInArrow(run, SCHEMA)


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in SCHEMA.split(", "))])
