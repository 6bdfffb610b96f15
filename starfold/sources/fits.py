"""Light curves and pixel stamps from FITS files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The format's block and card sizes, and the number type of each column letter.
BLOCK, CARD = 2880, 80
NUMBERS = {"L": ">i1", "B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


def parse_header(data: bytes, at: int) -> tuple[dict[str, object], int]:
    """Cards of the header that begins at a place, and the place behind its last block."""
    cards: dict[str, object] = {}
    while at + CARD <= len(data):
        card = data[at : at + CARD].decode("ascii", "replace")
        at += CARD
        name = card[:8].strip()
        if name == "END":
            return cards, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            cards[name] = _value(card[10:])
    raise ValueError("header without END")


def _value(text: str) -> object:
    text = text.strip()
    if text.startswith("'"):
        end, out = 1, ""
        while end < len(text):
            if text[end] == "'":
                if text[end + 1 : end + 2] != "'":
                    break
                end += 1
            out += text[end]
            end += 1
        return out.rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, lambda v: float(v.upper().replace("D", "E"))):
        try:
            return kind(text)
        except ValueError:
            pass
    return text or None


def has_end(block: bytes) -> bool:
    """Whether one of a block's cards ends the header."""
    return any(block[at : at + CARD].rstrip() == b"END" for at in range(0, len(block), CARD))


def padded(size: int) -> int:
    return -(-size // BLOCK) * BLOCK


def unit_size(header: dict[str, object]) -> int:
    """Bytes of a unit's data, without padding."""
    axes = [int(header.get(f"NAXIS{k + 1}", 0)) for k in range(int(header.get("NAXIS", 0)))]
    return (int(np.prod(axes)) if axes else 0) * abs(int(header.get("BITPIX", 8))) // 8 + int(header.get("PCOUNT", 0))


def hdus(data: bytes) -> Iterator[tuple[dict[str, object], bytes]]:
    """Header and data of each unit."""
    at = 0
    while at < len(data):
        header, start = parse_header(data, at)
        size = unit_size(header)
        yield header, data[start : start + size]
        at = start + padded(size)


#: Bytes of the column letters that aren't plain numbers: complex numbers, and descriptors of variable arrays.
OTHER_BYTES = {"C": 8, "M": 16, "P": 8, "Q": 16}


def row_type(header: dict[str, object]) -> np.dtype:
    """A binary table's row; a repeat count gives a second axis, and columns that aren't plain numbers are bytes."""
    fields = []
    for k in range(1, int(header["TFIELDS"]) + 1):
        form = re.match(r"\s*(\d*)([A-Z])", str(header[f"TFORM{k}"]))
        if form is None or form[2] not in {"A", "X", *NUMBERS, *OTHER_BYTES}:
            raise ValueError(f"unknown column type {header[f'TFORM{k}']!r}")
        n, letter = int(form[1] or 1), form[2]
        name = str(header.get(f"TTYPE{k}", f"COLUMN{k}")).strip()
        if letter in NUMBERS:
            fields.append((name, NUMBERS[letter] if n == 1 else (NUMBERS[letter], (n,))))
        else:
            fields.append((name, f"S{n}" if letter == "A" else f"V{-(-n // 8) if letter == 'X' else n * OTHER_BYTES[letter]}"))
    kind = np.dtype({"names": [f[0] for f in fields], "formats": [f[1] for f in fields]})
    if kind.itemsize != int(header["NAXIS1"]):
        raise ValueError(f"columns take {kind.itemsize} bytes a row, not {header['NAXIS1']}")
    return kind


def scaled(header: dict[str, object], k: int, values: np.ndarray) -> np.ndarray:
    """Values of column ``k`` in the machine's byte order, scaled and shifted where the header says so."""
    values = values.astype(values.dtype.newbyteorder("="))
    scale, zero = header.get(f"TSCAL{k}", 1), header.get(f"TZERO{k}", 0)
    if (scale, zero) == (1, 0):
        return values
    whole = values.dtype.kind in "iu" and scale == 1 and float(zero).is_integer()
    return values.astype(np.int64) + int(zero) if whole else values * float(scale) + float(zero)


def table_columns(header: dict[str, object], data: bytes) -> dict[str, np.ndarray]:
    """Columns of a binary table by name."""
    kind = row_type(header)
    rows = np.frombuffer(data, kind, int(header["NAXIS2"]))
    return {name: scaled(header, k, rows[name]) for k, name in enumerate(kind.names, 1)}


def finite(value: object) -> float | None:
    """A header's number as a double; null if it isn't a finite one."""
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return number if np.isfinite(number) else None


def time_reference(header: dict[str, object]) -> float | None:
    """Whole and fractional part of the time origin; null only if both are absent."""
    parts = [header.get("BJDREFI"), header.get("BJDREFF")]
    return None if parts == [None, None] else sum(float(p) for p in parts if p is not None)


def time_axis_fault(primary: dict[str, object], extension: dict[str, object]) -> str | None:
    """Why times aren't dynamical days from a stated origin; null if they are. Both units count where both are given."""
    either = lambda name: extension.get(name) if extension.get(name) is not None else primary.get(name)
    if str(either("TIMESYS") or "").strip() != "TDB":
        return "time system isn't TDB"
    origin = time_reference({k: either(k) for k in ("BJDREFI", "BJDREFF")})
    if origin is None or not 2.4e6 <= origin <= 2.6e6:
        return "time reference is missing or out of range"
    at = next((k for k in range(1, int(extension.get("TFIELDS", 0)) + 1) if str(extension.get(f"TTYPE{k}")).strip() == "TIME"), 1)
    units = [str(u).strip().lower() for u in (either("TIMEUNIT"), extension.get(f"TUNIT{at}")) if u is not None]
    if not units:
        return "no time unit"
    for unit in units:
        shifted = re.fullmatch(r"bjd\s*-\s*(\d+(?:\.\d+)?)", unit)
        if unit not in ("d", "day", "days") and not (shifted and abs(float(shifted[1]) - origin) < 1e-7):
            return f"time unit {unit!r} isn't days"
    return None


def check_time_axis(header: dict[str, object]) -> None:
    """Dynamical time, an origin within reason, and days as its unit."""
    if fault := time_axis_fault({}, header):
        raise ValueError(fault)


def checksum_status(data: bytes, header: dict[str, object]) -> str:
    """Whether a unit's 32-bit ones-complement sum is what its header says."""
    if "DATASUM" not in header:
        return "not_present"
    padded = data + b"\0" * (-len(data) % 4)
    total = int(np.frombuffer(padded, ">u4").sum(dtype=np.uint64)) if padded else 0
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return "valid" if total == int(str(header["DATASUM"])) else "invalid"


CURVE = "target_id string, product_id string, sector int, cadence long, time_days double, flux double, flux_error double, quality long, centroid_column double, centroid_row double, flux_kind string, time_reference double, checksum_sha256 string"


def read_curve(data: bytes, name: str, preference: str = "PDCSAP_FLUX", mission: str = "TESS") -> Iterator[tuple]:
    """All cadences of a light-curve file, those that aren't finite included."""
    units = list(hdus(data))
    primary, (header, body) = units[0][0], units[1]
    found = str(primary.get("MISSION") or primary.get("TELESCOP") or mission)
    if mission.lower() not in found.lower():
        raise ValueError(f"{name}: mission {found}, not {mission}")
    target = primary.get("TICID" if mission == "TESS" else "KEPLERID") or header.get("TICID" if mission == "TESS" else "KEPLERID")
    if target is None:
        raise ValueError(f"{name}: no target id")
    columns = table_columns(header, body)
    flux = next((c for c in (preference, "PDCSAP_FLUX", "SAP_FLUX") if c in columns), None)
    if "TIME" not in columns or flux is None:
        raise ValueError(f"{name}: no TIME or flux column")
    n = len(columns["TIME"])
    none = [None] * n
    take = lambda *names: next((columns[c].tolist() for c in names if c in columns), none)
    sector = primary.get("SECTOR") if mission == "TESS" else None
    digest = hashlib.sha256(data).hexdigest()
    rows = zip(take("CADENCENO"), take("TIME"), take(flux), take(flux.replace("FLUX", "FLUX_ERR")), take("QUALITY" if mission == "TESS" else "SAP_QUALITY"), take("MOM_CENTR1"), take("MOM_CENTR2"), strict=True)
    for i, (cadence, t, f, e, q, c, r) in enumerate(rows):
        yield (str(target), name, sector, i if cadence is None else cadence, t, f, e, q, c, r, flux, time_reference(header), digest)


def read_fits(spark: SparkSession, path: str, preference: str = "PDCSAP_FLUX", mission: str = "TESS") -> DataFrame:
    """Light-curve files under a path, one row a cadence. Spark lists and reads the files, so any store will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(parts):
        import pyarrow as pa

        names = [c.split()[0] for c in CURVE.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in CURVE.split(", ")]
        for batch in parts:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(read_curve(content, p.rsplit("/", 1)[-1], preference, mission))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return files.mapInArrow(run, CURVE)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixel files as (target_id, frame, time_days, row, col, flux, in_aperture); without a mask all pixels are in the aperture."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(parts):
        for batch in parts:
            for content in batch.column(1).to_pylist():
                yield from _pixel_batches(content)

    return files.mapInArrow(run, "target_id string, frame long, time_days double, row int, col int, flux double, in_aperture boolean")


def _pixel_batches(content: bytes):
    import pyarrow as pa

    units = list(hdus(content))
    header, body = units[1]
    columns = table_columns(header, body)
    k = next(i for i in range(1, int(header["TFIELDS"]) + 1) if str(header[f"TTYPE{i}"]).strip() == "FLUX")
    shape = tuple(int(x) for x in re.findall(r"\d+", str(header.get(f"TDIM{k}", ""))))[::-1]
    cube = columns["FLUX"].reshape(len(columns["TIME"]), *shape)
    n, rows, cols = cube.shape
    mask = np.ones((rows, cols), bool)
    if len(units) > 2:
        mask = (np.frombuffer(units[2][1], ">i4").reshape(rows, cols) & 2) > 0
    frame, row, col = np.indices(cube.shape)
    target = str(units[0][0].get("TICID") or units[0][0].get("KEPLERID"))
    yield pa.RecordBatch.from_pydict(
        {
            "target_id": pa.array([target] * cube.size),
            "frame": pa.array(frame.ravel()),
            "time_days": pa.array(np.repeat(columns["TIME"], rows * cols).astype(float)),
            "row": pa.array(row.ravel().astype(np.int32)),
            "col": pa.array(col.ravel().astype(np.int32)),
            "flux": pa.array(cube.ravel().astype(float)),
            "in_aperture": pa.array(np.tile(mask.ravel(), n)),
        }
    )


def write_table(columns: dict[str, tuple[str, np.ndarray]], primary: dict[str, object], header: dict[str, object]) -> bytes:
    """A file with one binary table: name -> (column letter, values). For tests and for planted products."""

    def cards(values: dict[str, object]) -> bytes:
        def text(v: object) -> str:
            return ("T" if v else "F") if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else repr(v)

        lines = b"".join(f"{k:<8}= {text(v):>20}".ljust(CARD)[:CARD].encode() for k, v in values.items()) + b"END".ljust(CARD)
        return lines.ljust(-(-len(lines) // BLOCK) * BLOCK)

    kind = np.dtype([(n, NUMBERS[letter]) if v.ndim == 1 else (n, NUMBERS[letter], v.shape[1:]) for n, (letter, v) in columns.items()])
    rows = np.zeros(len(next(iter(columns.values()))[1]), kind)
    extra: dict[str, object] = {}
    for k, (n, (letter, v)) in enumerate(columns.items(), 1):
        rows[n] = v
        extra |= {f"TTYPE{k}": n, f"TFORM{k}": f"{int(np.prod(v.shape[1:]))}{letter}"}
        if v.ndim == 3:
            extra[f"TDIM{k}"] = f"({v.shape[2]},{v.shape[1]})"
    body = rows.tobytes()
    first = cards({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0} | primary)
    second = cards({"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": kind.itemsize, "NAXIS2": len(rows), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(columns)} | extra | header)
    return first + second + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


