"""imzML: an XML index beside a binary file.

Reading: the header, which is short, is parsed on the driver; the spectra's elements become an index table
by Spark's XML reader, so the driver holds none of them. Peaks come from the data source of ``spectra.py``,
whose tasks read ranges of the binary file by that table. Writing: offsets are prefix sums of the spectra's
lengths, and tasks write their own ranges of both files.

Terms are those of the public imaging and mass-spectrometry vocabularies.
"""

from __future__ import annotations

import json
import os
import warnings
import xml.etree.ElementTree as ET
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.axis import nearest
from ..model import PIXEL, DatasetIdentity, MsiDataset, hold, pixels_of
from ..session import settings
from . import files, sidecar, spectra

# Accession numbers of the vocabularies.
DTYPES = {"MS:1000519": "<i4", "MS:1000521": "<f4", "MS:1000522": "<i8", "MS:1000523": "<f8"}
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
OFFSET, LENGTH = "IMS:1000102", "IMS:1000103"
POS_X, POS_Y, MAX_X, MAX_Y = "IMS:1000050", "IMS:1000051", "IMS:1000042", "IMS:1000043"
PIXEL_SIZE, MD5, LOWEST, HIGHEST = "IMS:1000046", "IMS:1000090", "MS:1000528", "MS:1000527"
#: Terms that tell a value, as an accession number or a part of a term's name in lower case; the first that is found counts.
ION = (("maldi", ("MS:1000075", "matrix-assisted laser desorption")), ("desi", ("MS:1002011", "desorption electrospray")), ("sims", ("MS:1000402", "secondary ion")), ("esi", ("MS:1000073", "electrospray ionization")))
MODE = (("profile", ("MS:1000128", "profile spectrum")), ("centroided", ("MS:1000127", "centroid spectrum")))
POLARITY = (("negative", ("MS:1000129", "negative scan")), ("positive", ("MS:1000130", "positive scan")))
ORBITRAP, FTICR = ("MS:1000484", "orbitrap"), ("MS:1000079", "ft-icr", "ion cyclotron resonance")
TOF, REFLECTRON = ("MS:1000084", "time-of-flight"), ("MS:1000106", "reflectron")
QTOF, FLEX = ("q-tof", "quadrupole time-of-flight"), ("bruker daltonics flex series",)
ANALYZER = {"orbitrap": (ORBITRAP,), "fticr": ((FTICR[0], "fourier transform ion cyclotron resonance"),), "tof_axial": (TOF,), "tof_reflectron": (TOF, (REFLECTRON[0], "reflectron on")), "qtof": ((TOF[0], QTOF[1]),)}
NAME = "name:"
MARK = "shared axis"
AXIS_ENDING = ".axis.json"
#: Pixel numbers of one part of a prefix sum.
PART = 4096
#: Spectra that a writing task holds at once.
BATCH = 64
_TERM = "array<struct<_accession: string, _name: string, _value: string>>"
_REF = "array<struct<_ref: string>>"
#: What is read of a spectrum's element.
SPECTRUM = f"cvParam {_TERM}, scanList struct<scan: array<struct<cvParam: {_TERM}>>>, binaryDataArrayList struct<binaryDataArray: array<struct<referenceableParamGroupRef: {_REF}, cvParam: {_TERM}>>>"


def pair(path: str) -> tuple[str, str]:
    """(imzML, ibd) of either file's path, whatever the case of their endings."""
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    stem = os.path.splitext(name)[0]
    both = {os.path.splitext(f)[1].lower(): f"{folder}/{f}" for f in files.names(folder) if os.path.splitext(f)[0] == stem}
    for ending in (".imzml", ".ibd"):
        if ending not in both:
            raise FileNotFoundError(f"no {ending} file belongs to {path}")
    return both[".imzml"], both[".ibd"]


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def parse_header(path: str) -> tuple[dict[str, dict[str, str]], dict[str, list[str]], dict[str, str]]:
    """(groups of parameters, terms with their values, user parameters) of what stands before the spectra."""
    groups: dict[str, dict[str, str]] = {}
    header: dict[str, list[str]] = {}
    user: dict[str, str] = {}
    with files.open_stream(path) as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            kind = _tag(e)
            if kind == "spectrumList":
                break
            if event == "start":
                continue
            if kind == "cvParam":
                header.setdefault(e.get("accession"), []).append(e.get("value", ""))
                # Names of terms are terms too.
                if e.get("name"):
                    header.setdefault(NAME + e.get("name").lower(), [])
            elif kind == "userParam":
                user[e.get("name")] = e.get("value", "")
            elif kind == "referenceableParamGroup":
                groups[e.get("id")] = {c.get("accession"): c.get("value", "") for c in e if _tag(c) == "cvParam"}
    return groups, header, user


def index_table(spark: SparkSession, path: str, groups: dict[str, dict[str, str]]) -> DataFrame:
    """One row a spectrum in the file's order: pixel_id, x, y, offset, length and type of both arrays, and its terms.

    Spark reads the elements of a file as one stream in one task, so row numbers follow their order."""
    raw = spark.read.format("xml").options(rowTag="spectrum", ignoreNamespace="true", mode="FAILFAST").schema(SPECTRUM).load(path)
    none = F.array().cast("array<string>")
    of_group = F.create_map(*(x for k, terms in groups.items() for x in (F.lit(k), F.array(*map(F.lit, terms)) if terms else none))) if groups else F.create_map().cast("map<string,array<string>>")
    scans = F.flatten(F.transform("scanList.scan", lambda x: x["cvParam"]))

    def value(terms: Column, accession: str) -> Column:
        return F.element_at(F.filter(terms, lambda t: t["_accession"] == accession), -1)["_value"]

    def array(b: Column) -> Column:
        refs = F.coalesce(F.transform(b["referenceableParamGroupRef"], lambda r: F.coalesce(F.try_element_at(of_group, r["_ref"]), none)), F.array().cast("array<array<string>>"))
        terms = F.concat(F.flatten(refs), F.transform(b["cvParam"], lambda t: t["_accession"]))
        kind = F.lit("<f4")
        for accession, dtype in reversed(DTYPES.items()):
            kind = F.when(F.array_contains(terms, accession), dtype).otherwise(kind)
        return F.struct(F.array_contains(terms, MZ_ARRAY).alias("is_mz"), value(b["cvParam"], OFFSET).try_cast("bigint").alias("at"), value(b["cvParam"], LENGTH).try_cast("bigint").alias("n"), kind.alias("kind"))

    rows = raw.select(
        F.monotonically_increasing_id().alias("pixel_id"), value(scans, POS_X).try_cast("int").alias("x"), value(scans, POS_Y).try_cast("int").alias("y"),
        F.transform("binaryDataArrayList.binaryDataArray", array).alias("arrays"), F.coalesce("cvParam", F.array().cast(_TERM)).alias("own"),
        F.concat(F.coalesce(scans, F.array().cast(_TERM)), F.flatten(F.transform("binaryDataArrayList.binaryDataArray", lambda b: b["cvParam"]))).alias("inner"),
    )
    mz = F.element_at(F.filter("arrays", lambda a: a["is_mz"]), -1)
    inten = F.element_at(F.filter("arrays", lambda a: ~a["is_mz"]), -1)
    return rows.select("pixel_id", "x", "y", mz["at"].alias("mo"), mz["n"].alias("ml"), mz["kind"].alias("mt"), inten["at"].alias("io"), inten["n"].alias("il"), inten["kind"].alias("it"), "own", "inner")


def spectrum_terms(index: DataFrame) -> dict[str, list[str]]:
    """The terms of the spectra with the least and the largest of their values: as many as the vocabulary has."""
    t = index.select(F.explode(F.concat(F.transform("own", lambda t: F.struct(t["_accession"].alias("a"), t["_name"].alias("n"), t["_value"].alias("v"))), F.transform("inner", lambda t: F.struct(F.lit(None).cast("string").alias("a"), t["_name"].alias("n"), F.lit(None).cast("string").alias("v"))))).alias("t")).select("t.*")
    number = F.col("v").try_cast("double")
    header: dict[str, list[str]] = {}
    for r in t.groupBy("a", "n").agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.first("v", True).alias("v")).collect():
        if r.a:
            header.setdefault(r.a, []).extend([r.v or ""] if r.lo is None else [repr(r.lo), repr(r.hi)])
        if r.n:
            header.setdefault(NAME + r.n.lower(), [])
    return header


def family(has) -> str | None:
    """The instrument by its terms, the most precise first."""
    if has(ORBITRAP):
        return "orbitrap"
    if has(FTICR):
        return "fticr"
    if has(TOF) or REFLECTRON[0] in has.terms:
        if has(QTOF):
            return "qtof"
        # Instruments of the flex series are reflectrons in common use.
        return "tof_reflectron" if has(REFLECTRON) or has(FLEX) else "tof_axial"
    return None


class Terms:
    """Whether any of some terms is there, by accession number or as a part of a name."""

    def __init__(self, header: dict[str, list[str]]) -> None:
        self.terms = {k for k in header if not k.startswith(NAME)}
        self.names = [k[len(NAME) :] for k in header if k.startswith(NAME)]

    def __call__(self, some: tuple[str, ...]) -> bool:
        return any(t in self.terms or any(t in n for n in self.names) for t in some)


def metadata(header: dict[str, list[str]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    has = Terms(header)
    for name, terms in (("ionization", ION), ("profile_or_centroided", MODE), ("polarity", POLARITY)):
        out |= {name: v for v in [next((v for v, some in terms if has(some)), None)] if v}
    if kind := family(has):
        out["instrument_family"] = kind
    number = lambda k: [float(v) for v in header.get(k, []) if v]
    lo, hi = number(LOWEST), number(HIGHEST)
    if lo and hi and max(hi) > min(lo):
        out |= {"mz_min": min(lo), "mz_max": max(hi)}
    if number(PIXEL_SIZE):
        out["pixel_size_um"] = number(PIXEL_SIZE)[0]
    return out


def read_imzml(spark: SparkSession, path: str, dataset_id: str | None = None, user: dict[str, Any] | None = None, pixels: tuple[int, int] | None = None) -> MsiDataset:
    """Spectra of an imzML pair; a file of aligned channels comes back as channels if its axis file is there.

    ``pixels``: the first pixel number and the one after the last, of those that are read; else all."""
    xml, ibd = pair(path)
    stem = os.path.splitext(xml)[0]
    name = dataset_id or os.path.basename(stem)
    groups, header, marks = parse_header(xml)
    index = hold(index_table(spark, files.spark_path(xml), groups))
    for k, v in spectrum_terms(index).items():
        header.setdefault(k, []).extend(v)
    n, top, lo, wide, high, broken = index.agg(F.count("*"), F.max("pixel_id"), F.min(F.least("x", "y")), F.max("x"), F.max("y"), F.count_if(F.expr("x IS NULL OR y IS NULL OR mo IS NULL OR ml IS NULL OR io IS NULL OR il IS NULL"))).first()
    if broken or n and top != n - 1:
        raise ValueError(f"{broken} spectra of {xml} lack a position, an offset or a length" if broken else f"the spectra of {xml} were read in parts")
    declared = next((v.lower() for v in header.get(MD5, []) if v), None)
    md5, sha256 = files.digests(ibd)
    if declared and declared != md5:
        warnings.warn(f"{os.path.basename(ibd)} doesn't have the MD5 that its index declares", stacklevel=2)
    ep, where = sidecar.experiment(metadata(header), "imzml", [stem, xml], user)
    w, h = (int(header[k][0]) if header.get(k) and header[k][0] else 0 for k in (MAX_X, MAX_Y))
    shape = (max(h, high), max(w, wide)) if n and lo >= 1 else None
    table, shape = pixels_of(index.select(F.lit(name).alias("dataset_id"), "pixel_id", "x", "y"), shape)
    first, stop = (0, n) if pixels is None else (max(0, pixels[0]), min(n, pixels[1]))
    peaks = spectra.read(spark, ibd, index, first, stop, name)
    ds = MsiDataset(table if pixels is None else table.where(F.col("pixel_id").between(first, stop - 1)), peaks=peaks, grid_shape=shape, metadata=ep, sources=where, identity=DatasetIdentity(xml, sha256, declared))
    if MARK not in marks:
        return ds
    axis_file = stem + AXIS_ENDING
    if not files.exists(axis_file):
        warnings.warn(f"{os.path.basename(axis_file)} is missing; the channels are read as peaks", stacklevel=2)
        return ds
    with files.open_stream(axis_file) as f:
        axis = json.load(f)
    if axis.get("ibd_md5") and axis["ibd_md5"] != md5:
        warnings.warn("the axis file belongs to another binary file", stacklevel=2)
    return as_matrix(ds, axis["shared_mz_axis"], axis.get("consensus_prevalence"))


def as_matrix(ds: MsiDataset, mz: list[float], prevalence: list[float] | None) -> MsiDataset:
    """Peaks binned to the nearest channel of a known axis."""
    spark = ds.pixels.sparkSession
    p = prevalence or [None] * len(mz)
    one = ds.pixels.select("dataset_id").distinct()
    axis = spark.createDataFrame([(i, float(m), None if q is None else float(q)) for i, (m, q) in enumerate(zip(mz, p, strict=True))], "channel int, mz double, prevalence double")
    channels = one.join(axis).select("dataset_id", "channel", "mz", "prevalence", F.lit(None).cast("bigint").alias("n_peaks"))
    cells = nearest(ds.peaks, channels.select("dataset_id", "channel", "mz")).groupBy(*PIXEL, "channel").agg(F.max("intensity").alias("intensity")).where("intensity > 0")
    return ds.with_matrix(cells, channels)


def _cv(accession: str, name: str, value: str = "") -> str:
    return f'<cvParam cvRef="{accession.split(":")[0]}" accession="{accession}" name="{name}" value="{value}"/>'


def before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums over all rows with smaller ``pixel_id``: within parts of ``PART`` pixel
    numbers, then over the parts, of which there are few."""
    part = F.floor(F.col("pixel_id") / PART)
    by = Window.partitionBy("part").orderBy("pixel_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", part)
    totals = rows.groupBy("part").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", *(F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"{k}_0") for k in sums))
    rows = rows.withColumns({k: F.coalesce(F.sum(c).over(by), F.lit(0)) for k, c in sums.items()}).join(starts, "part")
    return rows.withColumns({k: F.col(k) + F.col(f"{k}_0") for k in sums}).drop("part", *(f"{k}_0" for k in sums))


def _spectrum_text() -> Column:
    """The element of a spectrum of columns k (its number), gx, gy, n and at (its place in the binary file)."""

    def one(ref: str, at: Column, size: int) -> list[Column]:
        n = F.col("n")
        return [F.lit(f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{ref}"/>'), *_cv_of(OFFSET, "external offset", at), *_cv_of(LENGTH, "external array length", n), *_cv_of("IMS:1000104", "external encoded length", n * size), F.lit("<binary/></binaryDataArray>")]

    k, at = F.col("k"), F.col("at")
    head = [F.lit('<spectrum id="scan='), (k + 1).cast("string"), F.lit('" index="'), k.cast("string"), F.lit('" defaultArrayLength="0"><referenceableParamGroupRef ref="spectrum"/><scanList count="1"><scan>')]
    place = [*_cv_of(POS_X, "position x", F.col("gx") + 1), *_cv_of(POS_Y, "position y", F.col("gy") + 1), F.lit('</scan></scanList><binaryDataArrayList count="2">')]
    return F.concat(*head, *place, *one("mz", at, 8), *one("intensity", at + F.col("n") * 8, 4), F.lit("</binaryDataArrayList></spectrum>\n"))


def _cv_of(accession: str, name: str, value: Column) -> list[Column]:
    left, right = _cv(accession, name, "\0").split("\0")
    return [F.lit(left), value.cast("string"), F.lit(right)]


def _head_text(ds: MsiDataset, n: int, lo: float | None, hi: float | None, md5: str) -> str:
    ep = ds.metadata
    inverse = lambda terms, v: "".join(_cv(*some[:2]) for n, some in terms if n == v)
    bounds = _cv(LOWEST, "lowest observed m/z", repr(float(lo))) + _cv(HIGHEST, "highest observed m/z", repr(float(hi))) if n and lo is not None and hi > lo else ""
    h, w = ds.grid_shape
    size = _cv(PIXEL_SIZE, "pixel size", ep.pixel_size_um) if ep.pixel_size_um else ""
    mark = f'<userParam name="{MARK}" value="1"/>' if ds.is_matrix else ""
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1">'
        f'<fileDescription><fileContent>{_cv("IMS:1000080", "universally unique identifier", "0" * 32)}{_cv(MD5, "ibd MD5", md5)}{_cv("IMS:1000031", "processed")}{mark}</fileContent></fileDescription>'
        f'<referenceableParamGroupList count="3"><referenceableParamGroup id="mz">{_cv(MZ_ARRAY, "m/z array")}{_cv("MS:1000523", "64-bit float")}</referenceableParamGroup>'
        f'<referenceableParamGroup id="intensity">{_cv(INTENSITY_ARRAY, "intensity array")}{_cv("MS:1000521", "32-bit float")}</referenceableParamGroup>'
        f'<referenceableParamGroup id="spectrum">{inverse(MODE, ep.profile_or_centroided)}{inverse(POLARITY, ep.polarity)}{bounds}</referenceableParamGroup></referenceableParamGroupList>'
        f'<scanSettingsList count="1"><scanSettings id="s">{_cv(MAX_X, "max count of pixels x", w)}{_cv(MAX_Y, "max count of pixels y", h)}{size}</scanSettings></scanSettingsList>'
        f'<instrumentConfigurationList count="1"><instrumentConfiguration id="i"><componentList count="2"><source order="1">{inverse(ION, ep.ionization)}</source><analyzer order="2">{"".join(_cv(*t) for t in ANALYZER.get(ep.instrument_family, ()))}</analyzer></componentList></instrumentConfiguration></instrumentConfigurationList>'
        f'<run id="r"><spectrumList count="{n}">\n'
    )


def write_imzml(ds: MsiDataset, path: str, *, write_zero_intensity: bool = False) -> None:
    """Write one dataset in processed mode, spectra in the order of their pixels.

    Places in both files are prefix sums of the spectra's lengths; tasks write their own ranges, so a task
    that runs again writes the same bytes at the same place. Both files have other names until all is
    there. The folder must be one that the driver and all executors mount: no other kind of store takes
    writes at offsets. The digest of the binary file, serial by its nature, is one stream over it."""
    stem = files.mounted(os.path.splitext(path)[0])
    values = ds.cells.join(ds.channels.select("dataset_id", "channel", "mz"), ["dataset_id", "channel"]) if ds.is_matrix else ds.peaks
    if not write_zero_intensity:
        values = values.where("intensity > 0") if ds.is_matrix else values
    order = ["mz"] if ds.is_matrix else ["peak_idx", "mz"]
    s = values.groupBy("pixel_id").agg(F.sort_array(F.collect_list(F.struct(*order, F.col("intensity").cast("double").alias("i")))).alias("s"))
    rows = ds.pixels.select("pixel_id", "gx", "gy").join(s, "pixel_id", "left").withColumn("s", F.coalesce("s", F.array().cast(s.schema["s"].dataType)))
    rows = hold(rows.select("pixel_id", "gx", "gy", F.transform("s", lambda x: x["mz"].cast("double")).alias("mz"), F.transform("s", lambda x: x["i"].cast("float")).alias("intensity")))
    sizes = before(rows.select("pixel_id", "gx", "gy", F.size("mz").cast("bigint").alias("n")), {"k": F.lit(1), "peaks": F.col("n")})
    texts = hold(sizes.withColumn("at", F.col("peaks") * 12 + 16).withColumn("xml", _spectrum_text()))
    placed = hold(before(texts.select("pixel_id", "at", "xml"), {"xml_at": F.octet_length("xml")}))
    n, n_bytes, xml_bytes, lo, hi = placed.join(rows, "pixel_id").agg(F.count("*"), F.coalesce(F.sum(F.size("mz") * F.lit(12).cast("bigint")), F.lit(0)), F.coalesce(F.sum(F.octet_length("xml")), F.lit(0)), F.min(F.array_min("mz")), F.max(F.array_max("mz"))).first()
    head, tail = _head_text(ds, n, lo, hi, "0" * 32).encode(), b"</spectrumList></run></mzML>"
    ibd, xml = f"{stem}.ibd.part", f"{stem}.imzML.part"
    for name, size in ((ibd, 16 + n_bytes), (xml, len(head) + xml_bytes + len(tail))):
        with open(name, "wb") as f:
            f.truncate(size)
    out = rows.join(placed, "pixel_id").repartitionByRange("pixel_id").sortWithinPartitions("pixel_id").select("at", "mz", "intensity", (F.col("xml_at") + len(head)).alias("xml_at"), "xml")
    with settings(rows.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        spectra.write(out, ibd, xml, n_bytes + xml_bytes)
    digest = files.digests(ibd)[0]
    with open(xml, "r+b") as f:
        f.write(_head_text(ds, n, lo, hi, digest).encode())
        f.seek(len(head) + xml_bytes)
        f.write(tail)
    os.replace(ibd, f"{stem}.ibd")
    os.replace(xml, f"{stem}.imzML")
    if ds.is_matrix:
        ch = ds.channels.select("mz", "prevalence").orderBy("channel").collect()
        with open(stem + AXIS_ENDING, "w", encoding="utf-8") as f:
            json.dump({"version": 1, "shared_mz_axis": [r[0] for r in ch], "n_channels": len(ch), "consensus_prevalence": [r[1] for r in ch], "ibd_md5": digest}, f)
