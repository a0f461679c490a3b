"""Virtual rasters against what their sources hold."""

import numpy as np
import pytest

from cubeloom import errors, services
from cubeloom.plans import requests as rq
from cubeloom.sources import catalog, collection, raster, sinks, tiff, vrt

PLACE = (30.0, 0.0, 500000.0, 0.0, -30.0, 5000000.0)


def save(spark, path, a, nodata=0.0, **header):
    b, h, w = a.shape
    rows = [(r, c, [None if a[k, r, c] == nodata else float(a[k, r, c]) for k in range(b)]) for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, "row int, col int, bands array<double>")
    return sinks.write_geotiff(df, path, tiff.Raster(width=w, height=h, count=b, dtype="uint16", nodata=nodata, **header), tiff.Layout(block=16))


def source(name, band, src, dst, nodata=None):
    rect = lambda tag, r: f'<{tag} xOff="{r[0]}" yOff="{r[1]}" xSize="{r[2]}" ySize="{r[3]}"/>'
    kind = "SimpleSource" if nodata is None else "ComplexSource"
    more = "" if nodata is None else f"<NODATA>{nodata}</NODATA>"
    return f'<{kind}><SourceFilename relativeToVRT="1">{name}</SourceFilename><SourceBand>{band}</SourceBand>{rect("SrcRect", src)}{rect("DstRect", dst)}{more}</{kind}>'


def dataset(width, height, bands, nodata=0, srs='PROJCS["x",AUTHORITY["EPSG","32633"]]'):
    body = "".join(f'<VRTRasterBand dataType="UInt16" band="{i}"><NoDataValue>{nodata}</NoDataValue><Description>b{i}</Description>{"".join(s)}</VRTRasterBand>' for i, s in enumerate(bands, 1))
    return f'<VRTDataset rasterXSize="{width}" rasterYSize="{height}"><SRS>{srs}</SRS><GeoTransform>500000, 30, 0, 5000000, 0, -30</GeoTransform>{body}</VRTDataset>'


def load(spark, path, **options):
    return {(r["row"], r["col"]): r["bands"] for r in raster.read(spark, str(path), **options).collect()}


@pytest.fixture
def parts(spark, tmp_path):
    """Four quarters of a scene of two bands, and each band as a file of its own."""
    a = np.random.default_rng(3).integers(1, 60_000, (2, 40, 36))
    a[:, 5, 5] = 0
    for name, rows, cols in (("nw", slice(0, 25), slice(0, 20)), ("ne", slice(0, 25), slice(20, 36)), ("sw", slice(25, 40), slice(0, 20)), ("se", slice(25, 40), slice(20, 36))):
        save(spark, tmp_path / f"{name}.tif", a[:, rows, cols])
    for k in range(2):
        save(spark, tmp_path / f"band{k + 1}.tif", a[k : k + 1])
    return a, tmp_path


def values(a, r, c):
    return [None if v == 0 else float(v) for v in a[:, r, c]]


def test_mosaics_and_stacks_are_their_sources(spark, parts, monkeypatch):
    monkeypatch.setattr(vrt, "BLOCK", 16)
    a, folder = parts
    quarters = {"nw": (0, 0, 20, 25), "ne": (20, 0, 16, 25), "sw": (0, 25, 20, 15), "se": (20, 25, 16, 15)}
    mosaic = [[source(f"{k}.tif", b, (0, 0, *q[2:]), q) for k, q in quarters.items()] for b in (1, 2)]
    (folder / "mosaic.vrt").write_text(dataset(36, 40, mosaic))
    (folder / "stack.vrt").write_text(dataset(36, 40, [[source(f"band{b}.tif", 1, (0, 0, 36, 40), (0, 0, 36, 40))] for b in (2, 1)]))
    want = {(r, c): values(a, r, c) for r in range(40) for c in range(36)}
    assert load(spark, folder / "mosaic.vrt") == want
    assert load(spark, folder / "stack.vrt", bands=[2, 1, 1]) == {k: [v[0], v[1], v[1]] for k, v in want.items()}
    assert load(spark, folder / "mosaic.vrt", bands=[2], window=(15, 20, 10, 12)) == {k: v[1:] for k, v in want.items() if 20 <= k[0] < 32 and 15 <= k[1] < 25}
    assert len(load(spark, folder / "mosaic.vrt", out_shape=(6, 5))) == 30
    got = {(r["raster_id"], r["row"], r["col"]): r["bands"] for r in collection.read(collection.listed(spark, str(folder)).filter("raster_id LIKE '%.vrt'"), [1], rows=(24, 27)).collect()}
    assert got == {(n, r, c): [x[i]] for (r, c), x in want.items() if 24 <= r < 27 for n, i in (("mosaic.vrt", 0), ("stack.vrt", 1))}
    row = catalog.inspect(spark, {"m": str(folder / "mosaic.vrt")})[0].first()
    assert (row["driver"], row["width"], row["height"], row["band_count"], row["epsg"], tuple(row["transform"]), row["dtype"]) == ("VRT", 36, 40, 2, 32633, PLACE, "uint16")


def test_later_sources_cover_earlier_ones_where_they_hold_data(spark, parts):
    a, folder = parts
    b = np.zeros((1, 10, 10), int)
    b[0, :5] = 7
    save(spark, folder / "over.tif", b)
    bands = [[source("band1.tif", 1, (0, 0, 36, 40), (0, 0, 36, 40)), source("over.tif", 1, (2, 1, 8, 9), (30, 35, 8, 9), nodata=0)]]
    (folder / "over.vrt").write_text(dataset(40, 42, bands))
    (folder / "nested.vrt").write_text(dataset(6, 4, [[source("over.vrt", 1, (28, 34, 6, 4), (0, 0, 6, 4))]]))
    got = load(spark, folder / "over.vrt")
    assert len(got) == 40 * 42 and got[41, 39] == [None] and got[36, 32] == [7.0] and got[39, 32] == values(a[:1], 39, 32) and got[35, 29] == values(a[:1], 35, 29)
    assert got[37, 37] == [7.0] and got[39, 37] == [None]
    assert load(spark, folder / "nested.vrt") == {(r, c): got[34 + r, 28 + c] for r in range(4) for c in range(6)}


def test_services_take_virtual_rasters(spark, parts):
    a, folder = parts
    (folder / "s.vrt").write_text(dataset(36, 40, [[source(f"band{b}.tif", 1, (0, 0, 36, 40), (0, 0, 36, 40))] for b in (1, 2)]))
    done = services.calculate_index(spark, rq.IndexRequest(str(folder / "s.vrt"), str(folder / "out"), index="ndvi", bands=(1, 2)))
    x, y = a[:, 7, 8].astype(float)
    assert load(spark, done["path"])[7, 8] == [pytest.approx((x - y) / (x + y), rel=1e-6)]


@pytest.mark.parametrize("text", [
    "<VRTDataset rasterXSize='4' rasterYSize='4' subClass='VRTWarpedDataset'><VRTRasterBand dataType='Byte'/></VRTDataset>",
    "<VRTDataset rasterXSize='4' rasterYSize='4'><VRTRasterBand dataType='CFloat32'/></VRTDataset>",
    "<VRTDataset rasterXSize='4' rasterYSize='4'><VRTRasterBand dataType='Byte' subClass='VRTDerivedRasterBand'/></VRTDataset>",
    dataset(4, 4, [[source("a.tif", 1, (0, 0, 2, 2), (0, 0, 4, 4))]]), dataset(4, 4, [[source("a.tif", 1, (0.5, 0, 4, 4), (0, 0, 4, 4))]]),
    dataset(4, 4, [[source("a.tif", "mask,1", (0, 0, 4, 4), (0, 0, 4, 4))]]), dataset(4, 4, [[source("a.tif", 1, (0, 0, 4, 4), (0, 0, 4, 4)).replace("SimpleSource", "KernelFilteredSource")]]),
    dataset(4, 4, [[source("a.tif", 1, (0, 0, 4, 4), (0, 0, 4, 4), 0).replace("<NODATA>", "<ScaleRatio>2</ScaleRatio><NODATA>")]]),
])
def test_what_is_not_supported_says_so(text):
    with pytest.raises(errors.UnsupportedError):
        vrt.parse(text, "")


def test_broken_files(spark, tmp_path):
    (tmp_path / "x.vrt").write_text("<VRTDataset")
    with pytest.raises(errors.RasterReadError):
        raster.header(str(tmp_path / "x.vrt"))
    (tmp_path / "y.vrt").write_text(dataset(4, 4, [[source("no.tif", 1, (0, 0, 4, 4), (0, 0, 4, 4))]]))
    with pytest.raises(Exception, match=r"no\.tif"):
        raster.read(spark, str(tmp_path / "y.vrt")).count()
