"""FITS light-curve files as a Spark data source, ``spark.read.format("fits")`` once ``register`` has run.

Options
    ``rows``: ``cadences`` (default), or ``files``: one row a file, from its header blocks alone.
    ``mission``: ``TESS`` (default) or ``Kepler``; ``flux``: the flux column to prefer, PDCSAP_FLUX unless said otherwise.
    ``timeAxis``: ``any`` (default), or ``days``: files without dynamical time in days and a fitting origin are malformed.
    ``mode``: ``PERMISSIVE`` (default): a malformed file is one row with its path and the reason in ``error``;
    ``DROPMALFORMED`` leaves it out, ``FAILFAST`` fails the query.
    ``pathGlobFilter`` (default ``*.fits``), ``maxPartitionBytes``: bytes of files in a task, 64 MB.

A schema names the columns that are read; without it all are but those that need the whole file (``checksum_sha256``, ``datasum``). Equality and
IN filters on columns of a header are decided before a file's table is read; those on ``product_id`` before it is opened.
Paths may be local, or URIs of a file system that pyarrow knows; ``fits.read_fits`` takes any store that Spark reads.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from starfold.sources import fits
from starfold.sources.fits import BLOCK

#: What the headers say, for each row of a file.
HEADER = (
    "path string, product_id string, n_bytes long, mission string, target_id string, sector int, quarter int, creator string, "
    "time_start double, time_stop double, time_system string, time_reference double, time_unit string, flux_kind string, flux_unit string, "
    "n_rows long, columns array<string>, metadata map<string,string>, error string"
)
CADENCE = "cadence long, time_days double, flux double, flux_error double, quality long, centroid_column double, centroid_row double"
#: Only read where the schema names them.
WHOLE_FILE = "checksum_sha256 string, datasum string"
#: Header words that are kept as they are.
KEPT_WORDS = ("TIMEDEL", "NUM_FRM", "FRAMETIM", "INT_TIME", "READTIME", "EXPOSURE", "LIVETIME", "CROWDSAP", "FLFRCSAP", "TEFF", "LOGG", "ORIGIN")

#: Rows of a table that are held at once.
CHUNK_ROWS = 65_536
#: What opening a file costs, in bytes.
OPEN_BYTES = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Product:
    """A file's headers, and its table in pieces; only the blocks asked for are read."""

    def __init__(self, file, size: int, mission: str = "TESS", flux: str = "PDCSAP_FLUX", time_axis: str = "any"):
        self.file, self.size, self.bytes_read = file, size, 0
        self.primary, at = self._header(0)
        at += fits.padded(fits.unit_size(self.primary))
        self.extension, self.begin = self._header(at)
        if str(self.extension.get("XTENSION", "")).strip() != "BINTABLE":
            raise ValueError("extension 1 isn't a binary table")
        for word in ("MISSION", "TELESCOP"):
            declared = self.word(word)
            if declared is not None and declared.casefold() != mission.casefold():
                raise ValueError(f"{word} is {declared}, not {mission}")
        self.mission, self.kind = mission, fits.row_type(self.extension)
        self.names = list(self.kind.names)
        self.target = self.word("TICID" if mission == "TESS" else "KEPLERID")
        if mission != "TESS" and self.target is None:
            raise ValueError("no target id")
        if "TIME" not in self.names:
            raise ValueError("no TIME column")
        self.flux = next((c for c in (flux, "PDCSAP_FLUX", "SAP_FLUX") if c in self.names), None)
        if self.flux is None:
            raise ValueError("no flux column")
        self.rows = int(self.extension["NAXIS2"])
        if time_axis == "days" and (fault := fits.time_axis_fault(self.primary, self.extension)):
            raise ValueError(fault)
        end = self.begin + self.rows * self.kind.itemsize
        if end > size:
            raise ValueError(f"truncated: the table ends at byte {end}, the file at {size}")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        self.bytes_read += len(data)
        return data

    def _header(self, at: int) -> tuple[dict[str, object], int]:
        data = b""
        while True:
            block = self._read(at + len(data), BLOCK)
            data += block
            if len(block) < BLOCK:
                raise ValueError("truncated: a header without its end" if data else "no header where one belongs")
            if fits.has_end(block):
                cards, end = fits.parse_header(data, 0)
                return cards, at + end

    def word(self, name: str, first: str = "primary") -> str | None:
        """A header word as text; of either header, the named one before the other."""
        both = (self.primary, self.extension) if first == "primary" else (self.extension, self.primary)
        found = next((h[name] for h in both if h.get(name) is not None), None)
        return None if found is None else str(found).strip() or None

    def unit(self, column: str) -> str | None:
        found = self.extension.get(f"TUNIT{self.names.index(column) + 1}")
        return None if found is None else str(found).strip() or None

    def about(self) -> dict[str, object]:
        whole = lambda x: None if x is None else int(float(x))
        target = self.target
        return {
            "mission": self.word("MISSION") or self.mission,
            "target_id": target[:-2] if target and target.endswith(".0") else target,
            "sector": whole(self.word("SECTOR")) if self.mission == "TESS" else None,
            "quarter": whole(self.word("QUARTER")) if self.mission != "TESS" else None,
            "creator": self.word("CREATOR"),
            "time_start": fits.finite(self.extension.get("TSTART")),
            "time_stop": fits.finite(self.extension.get("TSTOP")),
            "time_system": self.word("TIMESYS", "extension"),
            "time_reference": fits.time_reference(self.primary | {k: v for k, v in self.extension.items() if k.startswith("BJDREF")}),
            "time_unit": self.word("TIMEUNIT", "extension") or self.unit("TIME"),
            "flux_kind": self.flux,
            "flux_unit": self.unit(self.flux),
            "n_rows": self.rows,
            "columns": self.names,
            "metadata": [(w, x) for w in KEPT_WORDS if (x := self.word(w, "extension")) is not None],
        }

    def table(self, wanted: set[str]) -> Iterator[dict[str, np.ndarray | None]]:
        """The wanted columns of ``CADENCE``, some rows at a time; those that the file lacks are null."""
        error = self.flux.replace("FLUX", "FLUX_ERR") if self.mission == "TESS" else self.flux + "_ERR"
        quality = "QUALITY" if self.mission == "TESS" else "SAP_QUALITY"
        source = {"cadence": "CADENCENO", "time_days": "TIME", "flux": self.flux, "flux_error": error, "quality": quality, "centroid_column": "MOM_CENTR1", "centroid_row": "MOM_CENTR2"}
        for at in range(0, self.rows, CHUNK_ROWS):
            n = min(CHUNK_ROWS, self.rows - at)
            if wanted:
                rows = np.frombuffer(self._read(self.begin + at * self.kind.itemsize, n * self.kind.itemsize), self.kind, n)
            out: dict[str, np.ndarray | None] = {}
            for name in wanted:
                column = source[name]
                out[name] = fits.scaled(self.extension, self.names.index(column) + 1, rows[column]) if column in self.names else None
                if name == "cadence" and out[name] is None:
                    out[name] = np.arange(at, at + n)
            yield out | {"": np.empty(n)}

    def checksum(self) -> str:
        digest = hashlib.sha256()
        for at in range(0, self.size, 1 << 20):
            digest.update(self._read(at, 1 << 20))
        return digest.hexdigest()

    def datasum(self) -> str:
        """Whether the table's checksum is what its header says."""
        n = fits.padded(fits.unit_size(self.extension))
        return fits.checksum_status(self._read(self.begin, n), self.extension)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class FitsReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.names = schema, set(schema.names)
        self.options = {k.lower(): v for k, v in options.items()}
        self.by_file = self.options.get("rows", "cadences") == "files"
        self.mode = self.options.get("mode", "PERMISSIVE").upper()
        self.filters: list = []

    def pushFilters(self, filters):  # noqa: N802
        """Equality and IN on columns of the header; Spark applies all filters again."""
        plain = {f.split()[0] for f in HEADER.split(", ")} - {"path", "n_bytes", "columns", "metadata", "error"}
        self.filters = [f for f in filters if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in plain]
        return filters

    def _fits(self, known: dict[str, object]) -> bool:
        for f in self.filters:
            if (name := f.attribute[0]) in known and known[name] not in (f.value if isinstance(f, In) else (f.value,)):
                return False
        return True

    def partitions(self) -> list[Files]:
        """Files in the order of their paths, in sets of bounded size."""
        root = self.options["path"]
        system, path = opened(root)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise ValueError(f"no such path: {root}")
        pattern, most = self.options.get("pathglobfilter", "*.fits"), int(self.options.get("maxpartitionbytes", 64 << 20))
        infos = [found] if found.is_file else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and fnmatch.fnmatch(x.base_name, pattern)]
        sets, room = [], 0
        for x in sorted(infos, key=lambda x: x.path):
            if not self._fits({"product_id": x.base_name}):
                continue
            if room < x.size + OPEN_BYTES or not sets:
                sets.append(Files([]))
                room = most
            sets[-1].files.append((x.path, x.size))
            room -= x.size + OPEN_BYTES
        return sets or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.options["path"])
        arrow = to_arrow_schema(self.schema)
        cadence = {f.split()[0] for f in CADENCE.split(", ")} & self.names
        for path, size in partition.files:
            known = {"path": path, "product_id": path.rsplit("/", 1)[-1], "n_bytes": size}
            sent = 0
            try:
                with system.open_input_file(path) as file:
                    product = Product(file, size, self.options.get("mission", "TESS"), self.options.get("flux", "PDCSAP_FLUX"), self.options.get("timeaxis", "any"))
                    known |= product.about()
                    if not self._fits(known):
                        continue
                    if "checksum_sha256" in self.names:
                        known["checksum_sha256"] = product.checksum()
                    if "datasum" in self.names:
                        known["datasum"] = product.datasum()
                    if self.by_file:
                        yield self._batch(known, {}, 1, arrow)
                        continue
                    for rows in product.table(cadence):
                        yield self._batch(known, rows, len(rows[""]), arrow)
                        sent += len(rows[""])
            except (ValueError, KeyError, TypeError, OSError) as fault:
                if self.mode == "FAILFAST":
                    raise ValueError(f"{path}: {fault}") from fault
                if self.mode != "DROPMALFORMED":
                    reason = f"{fault}" if isinstance(fault, ValueError) else f"{type(fault).__name__}: {fault}"
                    only = {k: known[k] for k in ("path", "product_id", "n_bytes")}
                    yield self._batch(only | {"error": reason if not sent else f"after {sent} rows: {reason}"}, {}, 1, arrow)

    def _batch(self, known: dict[str, object], rows: dict[str, np.ndarray | None], n: int, arrow: pa.Schema) -> pa.RecordBatch:
        columns = []
        for field in arrow:
            if rows.get(field.name) is not None:
                columns.append(pa.array(rows[field.name]).cast(field.type))
            else:
                value = known.get(field.name)
                columns.append(pa.nulls(n, field.type) if value is None else pa.array([value] * n, field.type) if pa.types.is_nested(field.type) else pa.repeat(pa.scalar(value, field.type), n))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)


class FitsSource(DataSource):
    """See the module's docstring."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return HEADER if self.options.get("rows") == "files" else f"{HEADER}, {CADENCE}"

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(schema, dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make ``fits`` known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsSource)
    return spark


def product_intervals(files: DataFrame, inventory: DataFrame, reference: float = 2457000.0) -> DataFrame:
    """(product_id, target_id, sector, start, stop, verified, fault): each inventory row with what its file's headers say.

    ``files`` are rows of the source with ``rows=files``, ``inventory`` has (product_id, target_id, sector). A product is verified if its
    file is there, can be read and names the same target and sector; its interval counts only with both ends and the usual time origin.
    """
    x = inventory.select("product_id", F.col("target_id").cast("string").alias("target_id"), F.col("sector").cast("int").alias("sector"))
    f = files.select("product_id", F.col("target_id").alias("_target"), F.col("sector").alias("_sector"), "time_start", "time_stop", "time_reference", "error", F.lit(True).alias("_there"))
    x = x.join(f, "product_id", "left")
    fault = (
        F.when(F.col("_there").isNull(), "file_missing")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("_target").eqNullSafe(F.col("target_id")), "tic_mismatch")
        .when(~F.col("_sector").eqNullSafe(F.col("sector")), "sector_mismatch")
    )
    timed = F.col("time_start").isNotNull() & F.col("time_stop").isNotNull() & (F.abs(F.coalesce("time_reference", F.lit(0.0)) - reference) <= 1e-6)
    x = x.withColumn("_fault", fault).withColumn("_timed", timed & F.col("_fault").isNull())
    return x.select(
        "product_id", "target_id", "sector", F.when(F.col("_timed"), F.col("time_start")).alias("start"), F.when(F.col("_timed"), F.col("time_stop")).alias("stop"),
        F.col("_fault").isNull().alias("verified"), F.coalesce("_fault", F.when(~F.col("_timed"), F.lit("interval_unavailable"))).alias("fault"),
    )


#: What a downloaded file can lack.
VERDICTS = ("file_missing", "unreadable", "empty_light_curve_table", "tic_mismatch", "sector_mismatch", "size_mismatch", "sha256_mismatch")


def verify_products(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(product_id, verdict, reason): ``verified``, or the first of ``VERDICTS`` that holds; files that nobody expects are ``unexpected``.

    ``expected`` has (product_id, target_id, sector, n_bytes, sha256), of which null values aren't compared;
    ``files`` are rows of the source with ``rows=files``, with ``checksum_sha256`` if hashes are to be compared.
    """
    f = files.select(*[F.col(c).alias(f"_{c}") if c != "product_id" else F.col(c) for c in files.columns], F.lit(True).alias("_there"))
    x = expected.select("product_id", "target_id", "sector", "n_bytes", "sha256", F.lit(True).alias("_wanted")).join(f, "product_id", "full")
    differs = lambda a, b: a.isNotNull() & ~a.eqNullSafe(b)
    checksum = F.col("_checksum_sha256") if "checksum_sha256" in files.columns else F.col("sha256")
    faults = [F.col("_there").isNull(), F.col("_error").isNotNull(), F.col("_n_rows") <= 0, differs(F.col("target_id").cast("string"), F.col("_target_id")), differs(F.col("sector").cast("int"), F.col("_sector")), differs(F.col("n_bytes").cast("long"), F.col("_n_bytes")), differs(F.lower("sha256"), checksum)]
    verdict = F.when(F.col("_wanted").isNull(), "unexpected")
    for name, is_so in zip(VERDICTS, faults, strict=True):
        verdict = verdict.when(is_so, name)
    return x.select("product_id", verdict.otherwise("verified").alias("verdict"), F.col("_error").alias("reason"))


def write_products(curves: DataFrame, folder: str, primary: dict[str, object] | None = None) -> DataFrame:
    """One file a product of ``curves`` (target_id, product_id, sector, cadence, time_days, flux, flux_error, quality): (product_id, n_rows, sha256).

    A group is one product's cadences, written in the order of time then cadence. A file appears under its name only once it is whole,
    and writing it again gives the same bytes. Null times, fluxes and errors are NaN, a null quality is 0.
    """

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by([("time_days", "ascending"), ("cadence", "ascending")])
        number = lambda c: table[c].to_numpy().astype(float)
        first = lambda c: table[c][0].as_py()
        time = number("time_days")
        seen = time[np.isfinite(time)]
        columns = {"TIME": ("D", time), "SAP_FLUX": ("D", number("flux")), "SAP_FLUX_ERR": ("D", number("flux_error")), "QUALITY": ("J", table["quality"].fill_null(0).to_numpy()), "CADENCENO": ("K", table["cadence"].to_numpy())}
        words = {"TICID": int(first("target_id"))} | ({"SECTOR": first("sector")} if first("sector") is not None else {}) | {"MISSION": "TESS"} | (primary or {})
        span = {"TSTART": float(seen.min()), "TSTOP": float(seen.max())} if len(seen) else {}
        data = fits.write_table(columns, words, {"TIMESYS": "TDB", "BJDREFI": 2457000, "TIMEUNIT": "d"} | span)
        system, path = opened(folder)
        name = first("product_id")
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/.{name}.{hashlib.sha256(data).hexdigest()[:12]}.part") as out:
            out.write(data)
        system.move(f"{path}/.{name}.{hashlib.sha256(data).hexdigest()[:12]}.part", f"{path}/{name}")
        return pa.table({"product_id": [name], "n_rows": pa.array([table.num_rows], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()]})

    rows = curves.select("target_id", "product_id", "sector", "cadence", "time_days", "flux", "flux_error", "quality")
    return rows.groupBy("product_id").applyInArrow(write, "product_id string, n_rows long, sha256 string")
