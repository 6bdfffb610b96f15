"""The FITS data source: what its rows say, what it reads, and what becomes of bad files."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.sources import fits, fits_source

NAN = float("nan")
COLUMNS = {
    "TIME": ("D", [1, 2, NAN]), "PDCSAP_FLUX": ("D", [100, 99, 98]), "PDCSAP_FLUX_ERR": ("D", [1, 1, 1]), "SAP_FLUX": ("D", [101, 100, 99]),
    "QUALITY": ("K", [0, 1, 0]), "CADENCENO": ("K", [10, 11, 12]), "MOM_CENTR1": ("D", [1.1, 1.2, 1.3]), "MOM_CENTR2": ("D", [2.1, 2.2, 2.3]),
}
PRIMARY = {"TICID": 123456, "SECTOR": 42, "MISSION": "TESS", "CREATOR": "fixture"}
HEADER = {"TIMESYS": "TDB", "BJDREFI": 2457000, "TIMEUNIT": "d", "TIMEDEL": 0.01, "NUM_FRM": 60, "FRAMETIM": 2.0, "INT_TIME": 1.98, "READTIME": 0.02, "TSTART": 1.0, "TSTOP": 2.5}


def file(columns=COLUMNS, primary=PRIMARY, header=HEADER):
    return fits.write_table({k: (a, np.array(v)) for k, (a, v) in columns.items()}, primary, header)


def without(*names):
    return {k: v for k, v in COLUMNS.items() if k not in names}


@pytest.fixture(scope="module")
def spark_fits(spark):
    return fits_source.register(spark)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a_lc.fits").write_bytes(file())
    (tmp_path / "deep" / "b_lc.fits").write_bytes(file(without("PDCSAP_FLUX", "PDCSAP_FLUX_ERR", "CADENCENO", "MOM_CENTR1"), PRIMARY | {"TICID": 7, "SECTOR": 1}))
    (tmp_path / "notes.txt").write_text("no file of ours")
    return tmp_path


def test_all_cadences_and_what_the_headers_say(spark_fits, folder):
    rows = {r["path"].rsplit("/", 1)[-1]: [] for r in spark_fits.read.format("fits").load(str(folder)).select("path").collect()}
    assert sorted(rows) == ["a_lc.fits", "b_lc.fits"]
    a = spark_fits.read.format("fits").load(str(folder)).filter("target_id = '123456'").orderBy("cadence").collect()
    assert [r["cadence"] for r in a] == [10, 11, 12] and [r["flux"] for r in a] == [100, 99, 98] and [r["quality"] for r in a] == [0, 1, 0]
    assert np.isnan(a[2]["time_days"]) and a[0]["flux_kind"] == "PDCSAP_FLUX" and a[0]["sector"] == 42 and a[0]["creator"] == "fixture"
    assert a[0]["time_system"] == "TDB" and a[0]["time_reference"] == 2457000.0 and a[0]["time_unit"] == "d" and a[0]["error"] is None
    assert a[0]["metadata"] == {"TIMEDEL": "0.01", "NUM_FRM": "60", "FRAMETIM": "2.0", "INT_TIME": "1.98", "READTIME": "0.02"}
    assert [r["centroid_column"] for r in a] == [1.1, 1.2, 1.3]
    b = spark_fits.read.format("fits").load(str(folder)).filter("sector = 1").orderBy("cadence").collect()
    assert [r["flux"] for r in b] == [101, 100, 99] and b[0]["flux_kind"] == "SAP_FLUX"
    assert [r["cadence"] for r in b] == [0, 1, 2] and all(r["flux_error"] is None and r["centroid_column"] is None for r in b)
    preferred = spark_fits.read.format("fits").option("flux", "SAP_FLUX").load(str(folder / "a_lc.fits"))
    assert [r["flux"] for r in preferred.orderBy("cadence").collect()] == [101, 100, 99]


def test_a_header_scan_reads_header_blocks_only():
    many = {k: (a, np.tile(np.array(v, float if a == "D" else int), 100_000)) for k, (a, v) in COLUMNS.items()}
    data = file(many)
    product = fits_source.Product(io.BytesIO(data), len(data))
    about = product.about()
    assert (about["time_start"], about["time_stop"], about["n_rows"]) == (1.0, 2.5, 300_000)
    assert product.bytes_read == product.begin and product.bytes_read % fits.BLOCK == 0 and product.bytes_read < 5 * fits.BLOCK < len(data) / 1000
    whole = sum(len(r["flux"]) for r in product.table({"flux"}))
    assert whole == 300_000 and product.bytes_read == product.begin + 300_000 * product.kind.itemsize


def test_filters_skip_tables_and_files(folder):
    from pyspark.sql.datasource import EqualTo, In
    from pyspark.sql.types import _parse_datatype_string

    reader = fits_source.FitsReader(_parse_datatype_string("path string, sector int, flux double"), {"path": str(folder)})
    kept = reader.pushFilters([EqualTo(("sector",), 42), In(("product_id",), ("a_lc.fits", "x"))])
    assert len(list(kept)) == 2  # Spark applies them again
    sets = reader.partitions()
    assert [[p.rsplit("/", 1)[-1] for p, _ in s.files] for s in sets] == [["a_lc.fits"]]
    assert [b.num_rows for s in sets for b in reader.read(s)] == [3]
    other = fits_source.FitsReader(_parse_datatype_string("path string, flux double"), {"path": str(folder)})
    list(other.pushFilters([EqualTo(("sector",), 5)]))
    assert [b for s in other.partitions() for b in other.read(s)] == []


def test_files_go_to_sets_of_bounded_size(folder):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("path string")
    for i in range(10):
        (folder / f"c{i}.fits").write_bytes(file())
    one = fits_source.FitsReader(schema, {"path": str(folder)}).partitions()
    most = 3 * (len(file()) + fits_source.OPEN_BYTES)
    several = fits_source.FitsReader(schema, {"path": str(folder), "maxPartitionBytes": str(most)}).partitions()
    assert len(one) == 1 and len(several) == 4 and sum(len(s.files) for s in several) == 12
    assert all(sum(n + fits_source.OPEN_BYTES for _, n in s.files) <= most for s in several)


BAD = {
    "truncated.fits": (file()[:-2881], "truncated"),
    "cut_header.fits": (file()[:4000], "truncated: a header"),
    "empty.fits": (b"", "no header"),
    "text.fits": (b"hello" * 1000, "header"),
    "no_time.fits": (file(without("TIME")), "no TIME"),
    "no_flux.fits": (file(without("SAP_FLUX", "PDCSAP_FLUX")), "no flux"),
    "kepler.fits": (file(primary=PRIMARY | {"MISSION": "Kepler"}), "MISSION is Kepler"),
    "telescope.fits": (file(primary=PRIMARY | {"TELESCOP": "Other"}), "TELESCOP is Other"),
    "wrong_width.fits": (file().replace(b"NAXIS1  =                   64", b"NAXIS1  =                   60"), "bytes a row"),
    "image.fits": (file().replace(b"'BINTABLE'", b"'IMAGE   '"), "binary table"),
}


def test_bad_files_are_rows_and_leave_the_others_readable(spark_fits, folder):
    for name, (data, _) in BAD.items():
        (folder / name).write_bytes(data)
    rows = spark_fits.read.format("fits").load(str(folder)).collect()
    faults = {r["product_id"]: r["error"] for r in rows if r["error"] is not None}
    assert set(faults) == set(BAD)
    for name, (_, reason) in BAD.items():
        assert reason in faults[name], (name, faults[name])
    assert len([r for r in rows if r["error"] is None]) == 6
    files = spark_fits.read.format("fits").option("rows", "files").load(str(folder)).collect()
    assert {r["product_id"]: r["error"] for r in files if r["error"]} == faults and len(files) == len(BAD) + 2
    dropped = spark_fits.read.format("fits").option("mode", "DROPMALFORMED").load(str(folder))
    assert dropped.count() == 6
    with pytest.raises(Exception, match="isn't|truncated|no |header|bytes|MISSION|TELESCOP"):
        spark_fits.read.format("fits").option("mode", "FAILFAST").load(str(folder)).count()


def test_time_axis_on_demand(spark_fits, tmp_path):
    cases = {"ok": HEADER, "utc": HEADER | {"TIMESYS": "UTC"}, "origin": HEADER | {"BJDREFI": 1}, "seconds": HEADER | {"TIMEUNIT": "s"}, "column": HEADER | {"TUNIT1": "BJD - 2454833"}, "both": HEADER | {"TUNIT1": "BJD - 2457000"}, "none": {k: v for k, v in HEADER.items() if k != "TIMEUNIT"}}
    for name, header in cases.items():
        (tmp_path / f"{name}.fits").write_bytes(file(header=header))
    read = spark_fits.read.format("fits").option("rows", "files")
    assert read.load(str(tmp_path)).filter("error IS NOT NULL").count() == 0
    strict = {r["product_id"][:-5]: r["error"] for r in read.option("timeAxis", "days").load(str(tmp_path)).collect()}
    assert strict["ok"] is None and strict["both"] is None
    assert all(strict[k] for k in ("utc", "origin", "seconds", "column", "none"))


def test_kepler_files(spark_fits, tmp_path):
    columns = {"TIME": ("D", [1.0]), "PDCSAP_FLUX": ("E", [5.0]), "PDCSAP_FLUX_ERR": ("E", [0.5]), "SAP_QUALITY": ("J", [128])}
    (tmp_path / "k.fits").write_bytes(file(columns, {"KEPLERID": 99, "QUARTER": 3, "MISSION": "Kepler", "TELESCOP": "Kepler"}, HEADER | {"BJDREFI": 2454833}))
    (tmp_path / "x.fits").write_bytes(file(columns, {"QUARTER": 3, "MISSION": "Kepler"}))
    rows = {r["product_id"]: r for r in spark_fits.read.format("fits").option("mission", "Kepler").load(str(tmp_path)).collect()}
    k = rows["k.fits"]
    assert (k["target_id"], k["quarter"], k["sector"], k["quality"], k["flux"], k["flux_error"], k["time_reference"]) == ("99", 3, None, 128, 5.0, 0.5, 2454833.0)
    assert rows["x.fits"]["error"] == "no target id"


def test_whole_file_columns_only_where_asked_for(spark_fits, folder):
    import hashlib

    schema = "product_id string, checksum_sha256 string, datasum string"
    rows = spark_fits.read.format("fits").schema(schema).option("rows", "files").load(str(folder)).collect()
    assert {r["product_id"]: r["checksum_sha256"] for r in rows} == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.rglob("*.fits")}
    assert {r["datasum"] for r in rows} == {"not_present"}
    body = file()[-fits.padded(3 * 64) :]
    total = int(np.frombuffer(body, ">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    (folder / "c.fits").write_bytes(file(header=HEADER | {"DATASUM": str(total)}))
    (folder / "d.fits").write_bytes(file(header=HEADER | {"DATASUM": str(total + 1)}))
    got = {r["product_id"]: r["datasum"] for r in spark_fits.read.format("fits").schema(schema).option("rows", "files").load(str(folder)).collect()}
    assert got["c.fits"] == "valid" and got["d.fits"] == "invalid"


def test_scaled_and_unusual_columns():
    header = {"TFIELDS": 5, "NAXIS1": 2 + 3 + 2 + 16 + 8, "NAXIS2": 1, "TFORM1": "I", "TZERO1": 32768, "TFORM2": "3A", "TFORM3": "11X", "TFORM4": "1QD(5)", "TFORM5": "D", "TSCAL5": 2.0, "TTYPE1": "u", "TTYPE2": "s", "TTYPE3": "x", "TTYPE4": "v", "TTYPE5": "y"}
    data = np.array([-32768], ">i2").tobytes() + b"abc" + b"\1\2" + b"\0" * 16 + np.array([1.5], ">f8").tobytes()
    out = fits.table_columns(header, data)
    assert out["u"].tolist() == [0] and out["s"].tolist() == [b"abc"] and out["y"].tolist() == [3.0]
    with pytest.raises(ValueError, match="unknown column type"):
        fits.row_type({"TFIELDS": 1, "NAXIS1": 1, "TFORM1": "1Z"})


def test_intervals_and_verification(spark_fits, folder):
    (folder / "bad.fits").write_bytes(b"x" * 5000)
    (folder / "nospan.fits").write_bytes(file(header={k: v for k, v in HEADER.items() if k != "TSTOP"}))
    (folder / "stray.fits").write_bytes(file())
    (folder / "none.fits").write_bytes(file({k: (a, []) for k, (a, v) in COLUMNS.items()}))
    inventory = [("a_lc.fits", "123456", 42), ("b_lc.fits", "8", 1), ("bad.fits", "1", 1), ("gone.fits", "1", 1), ("nospan.fits", "123456", 42), ("none.fits", "123456", 41)]
    products = spark_fits.createDataFrame(inventory, "product_id string, target_id string, sector int")
    files = spark_fits.read.format("fits").option("rows", "files").load(str(folder))
    got = {r["product_id"]: (r["start"], r["stop"], r["verified"], r["fault"]) for r in fits_source.product_intervals(files, products).collect()}
    assert got["a_lc.fits"] == (1.0, 2.5, True, None) and got["nospan.fits"] == (None, None, True, "interval_unavailable")
    assert got["b_lc.fits"][2:] == (False, "tic_mismatch") and got["gone.fits"][2:] == (False, "file_missing") and got["none.fits"][3] == "sector_mismatch"
    assert not got["bad.fits"][2] and "header" in got["bad.fits"][3]
    size = (folder / "a_lc.fits").stat().st_size
    expected = products.withColumns({"n_bytes": F.when(F.col("product_id") == "nospan.fits", 1).when(F.col("product_id") == "a_lc.fits", size).cast("long"), "sha256": F.when(F.col("product_id") == "a_lc.fits", "00")})
    verdicts = {r["product_id"]: r["verdict"] for r in fits_source.verify_products(files, expected).collect()}
    assert verdicts == {"a_lc.fits": "sha256_mismatch", "b_lc.fits": "tic_mismatch", "bad.fits": "unreadable", "gone.fits": "file_missing", "nospan.fits": "size_mismatch", "none.fits": "empty_light_curve_table", "stray.fits": "unexpected"} | {"a_lc.fits": "verified"}
    schema = f"{fits_source.HEADER}, {fits_source.WHOLE_FILE}"
    hashed = spark_fits.read.format("fits").schema(schema).option("rows", "files").load(str(folder))
    verdicts = {r["product_id"]: r["verdict"] for r in fits_source.verify_products(hashed, expected).collect()}
    assert verdicts["a_lc.fits"] == "sha256_mismatch"


def test_written_products_read_back(spark_fits, tmp_path):
    rows = [("5", "p1.fits", 2, i, 10.0 + i / 7 if i != 3 else None, 1.0 / (i + 3), None, i % 4 if i else None) for i in range(50)] + [("6", "p2.fits", None, 0, None, None, None, None)]
    curves = spark_fits.createDataFrame(rows, "target_id string, product_id string, sector int, cadence long, time_days double, flux double, flux_error double, quality int")
    out = str(tmp_path / "out")
    first = sorted(map(tuple, fits_source.write_products(curves, out).collect()))
    again = sorted(map(tuple, fits_source.write_products(curves.repartition(7), out).collect()))
    assert first == again and [r[1] for r in first] == [50, 1]
    back = spark_fits.read.format("fits").load(out).filter("target_id = '5'").collect()
    want = {i: (t, f, q or 0) for _, _, _, i, t, f, _, q in rows[:50]}
    got = {r["cadence"]: (None if np.isnan(r["time_days"]) else r["time_days"], r["flux"], r["quality"]) for r in back}
    assert got == want and all(np.isnan(r["flux_error"]) for r in back)
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".")] == []
