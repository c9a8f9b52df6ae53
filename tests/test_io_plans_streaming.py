"""Codecs, sources, rewrites and streams."""

import zlib

import numpy as np
import pytest
from rasters import array, frame

from rastrel.model import Border, FormatError, Interp, Overflow, Rotation, Unsupported
from rastrel.operators import geometry as G
from rastrel.operators import pointwise as P
from rastrel.operators import stencil as S
from rastrel.plans import rewrite
from rastrel.sources import codecs as C
from rastrel.sources import datasource
from rastrel.streaming import images as stream

Y, X = np.mgrid[0:12, 0:17]
TEXTURE = np.stack([13 * X + 7 * Y, 7 * X + 11 * Y, X + 13 * Y], axis=2).astype(np.uint8)


def test_ppm():
    for a in (TEXTURE, TEXTURE[..., :1]):
        assert (C.decode_ppm(C.encode_ppm(a)) == a).all()
    assert (C.decode_ppm(b"P5 # a\n#b\n 2\t1 #c\n255\n\x01\x02") == [[[1], [2]]]).all()
    for bad in (b"P4\n1 1\n255\n0", b"P5\n1 1\n254\n0", b"P5\n2 2\n255\n0", b"P5\n1"):
        with pytest.raises(FormatError):
            C.decode_ppm(bad)
    with pytest.raises(Overflow):
        C.encode_ppm(TEXTURE, capacity=10)
    with pytest.raises(Unsupported):
        C.encode_ppm(TEXTURE[..., :2])
    with pytest.raises(Unsupported):
        C.write_jpeg()


def filtered(a, kind):
    """A PNG whose rows all use one filter."""
    h, w, c = a.shape
    rows, above = b"", np.zeros(w * c, int)
    for y in range(h):
        now = a[y].ravel().astype(int)
        left = np.concatenate([np.zeros(c, int), now[:-c]])
        corner = np.concatenate([np.zeros(c, int), above[:-c]])
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(np.argmin(d, axis=0), [left, above, corner])
        guess = [0 * now, left, above, (left + above) // 2, paeth][kind]
        rows += bytes([kind]) + ((now - guess) % 256).astype(np.uint8).tobytes()
        above = now
    plain = C.encode_png(a)
    head = plain[: plain.index(b"IDAT") - 4]
    return head + C._chunk(b"IDAT", zlib.compress(rows)) + C._chunk(b"IEND", b"")


def test_png():
    for c in (1, 3, 4):
        a = np.concatenate([TEXTURE, 255 - TEXTURE[..., :1]], axis=2)[..., :c]
        for level in (0, 6):
            assert (C.decode_png(C.encode_png(a, level)) == a).all()
        for kind in range(5):
            assert (C.decode_png(filtered(a, kind)) == a).all()
    with pytest.raises(FormatError):
        C.decode_png(b"nothing")
    with pytest.raises(FormatError):
        C.decode_png(C.encode_png(TEXTURE)[:-90].replace(b"IEND", b"IXND"))


def test_png_palette_and_depth():
    import struct

    head = C._SIGNATURE + C._chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 3, 0, 0, 0)) + C._chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    assert C.decode_png(head + C._chunk(b"IDAT", zlib.compress(b"\0\1\0")) + C._chunk(b"IEND", b"")).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    deep = C._SIGNATURE + C._chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 16, 4, 0, 0, 0)) + C._chunk(b"IDAT", zlib.compress(b"\0" + bytes([9, 1, 255, 0, 7, 2, 255, 0])))
    assert C.decode_png(deep).tolist() == [[[9], [7]]]


def test_decode_converts():
    blob = C.encode_png(TEXTURE)
    gray = TEXTURE.astype(int) @ [77, 150, 29] >> 8
    assert (C.decode(blob, 1)[..., 0] == gray).all() and (C.decode(blob, 4)[..., 3] == 255).all()
    assert (C.decode(C.encode_ppm(TEXTURE[..., :1]), 3) == TEXTURE[..., :1]).all()


def test_files_and_source(spark, tmp_path):
    px = frame(spark, TEXTURE, 255 - TEXTURE)
    images = C.pack(px)
    assert C.write_files(C.to_ppm(images), str(tmp_path / "a"), "ppm") == 2
    assert C.write_files(C.to_png(images), str(tmp_path / "a"), "png") == 2
    got = C.read_images(spark, str(tmp_path / "a" / "*.p*"))
    assert sorted(bytes(r.data) for r in got.collect()) == sorted([TEXTURE.tobytes(), (255 - TEXTURE).tobytes()] * 2)
    datasource.register(spark)
    rows = spark.read.format("raster").option("path", str(tmp_path / "a")).option("channels", 1).load().collect()
    assert len(rows) == 4 and {r.channels for r in rows} == {1}
    assert {r.image_id for r in rows} == {r.image_id for r in got.collect()} and len({r.image_id for r in rows}) == 4
    assert (array(C.unpack(images)) == TEXTURE).all()


def test_ids_of_paths():
    assert C.path_part("file:/a/b.png") == C.path_part("file:///a/b.png") == C.path_part("/a/b.png") == C.path_part("hdfs://host:1/a/b.png") == "/a/b.png"


def test_remaps_fuse(spark):
    px = frame(spark, TEXTURE)
    steps = {"flip_h": G.flip_h, "flip_v": G.flip_v, "transpose": G.transpose, "rotate_cw": lambda p: G.rotate(p, Rotation.CW), "rotate_ccw": lambda p: G.rotate(p, Rotation.CCW), "rotate_180": lambda p: G.rotate(p, Rotation.HALF)}
    names = list(steps)
    rng = np.random.default_rng(3)
    for _ in range(4):
        chain = [names[k] for k in rng.integers(0, len(names), 4)]
        fused, plain = rewrite.Remap(), px
        for n in chain:
            fused, plain = getattr(fused, n)(), steps[n](plain)
        assert (array(fused.apply(px)) == array(plain)).all()


def test_tables_regions_and_merged_morphology(spark):
    a = np.random.default_rng(2).integers(0, 256, (20, 24))
    px = frame(spark, a)
    assert (array(rewrite.Tables().scale(1.3).threshold(99).apply(px)) == array(P.threshold(P.scale(px, 1.3), 99))).all()
    assert (array(rewrite.erode_all(px, [(3, 5), (5, 3)])) == array(S.erode(S.erode(px, 3, 5), 5, 3))).all()
    whole = array(S.blur_gaussian(px, 5, 1.0))
    part = rewrite.region(px, 0, 6, 9, 20, 2, lambda p: S.blur_gaussian(p, 5, 1.0))
    assert all(r.v == whole[r.y, r.x] for r in part.collect()) and part.count() == 9 * 14


def test_one_exchange_after_layout(spark):
    from rastrel.model import layout

    px = layout(frame(spark, TEXTURE[..., 0]))
    plan = S.morph_open(px)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_projections_have_no_exchange_or_python(spark):
    px = frame(spark, TEXTURE)
    for out in (G.flip_h(px), P.threshold(px, 9), P.scale(px, 2), G.resize(px, 5, 5, Interp.NEAREST), rewrite.Tables().invert().apply(px)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "Arrow" not in S.convolve2d(px, [[1.0] * 3] * 3, Border.WRAP)._jdf.queryExecution().executedPlan().toString()


def test_stream(spark, tmp_path):
    C.write_files(C.to_png(C.pack(frame(spark, TEXTURE, 255 - TEXTURE))), str(tmp_path / "in"), "png")
    images = stream.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = stream.each_batch(images, lambda px: S.blur_box(P.rgb_to_gray(px), 3), str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 * TEXTURE.shape[0] * TEXTURE.shape[1] and got.select("batch").distinct().count() == 2


def test_layout_deals_in_proportion_to_the_table(spark, tmp_path, monkeypatch):
    from rastrel import model

    spark.range(40_000).selectExpr("id div 100 as image_id", "10 as w", "10 as h", "cast(id div 10 % 10 as int) as y", "cast(id % 10 as int) as x", "0 as c", "cast(hash(id) % 256 as int) as v").write.parquet(f"{tmp_path}/px")
    px = spark.read.parquet(f"{tmp_path}/px")
    size = sum(f.stat().st_size for f in (tmp_path / "px").glob("*.parquet"))
    for k in (3, 30):
        monkeypatch.setattr(model, "DEALT", size // k)
        dealt = model.layout(px)
        assert k <= dealt.rdd.getNumPartitions() <= k + 1  # Spark's own would be one partition
        assert dealt.selectExpr("image_id", "spark_partition_id() as p").distinct().count() == 400
    assert model._parts(frame(spark, TEXTURE[..., 0])) is None  # of unknown size


def _python_steps(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("InArrow")


def test_steps_on_images_share_a_worker(spark, tmp_path):
    from rastrel.operators import packed

    images = C.pack(frame(spark, TEXTURE, 255 - TEXTURE))
    blurred = packed.blur_box(images, 63)
    one = C.unpack(blurred)
    assert _python_steps(one) == 1
    blurred.write.parquet(f"{tmp_path}/blurred")
    apart = C.unpack(spark.read.parquet(f"{tmp_path}/blurred"))
    assert sorted(one.collect()) == sorted(apart.collect())
    picked = blurred.where("image_id = 1")  # no step's own frame: a worker of its own, and the filter holds
    assert _python_steps(C.unpack(picked)) == 2 and C.unpack(picked).select("image_id").distinct().collect() == [(1,)]
    assert sorted(C.unpack(images).collect()) == sorted(C.unpack(C.pack(frame(spark, TEXTURE, 255 - TEXTURE))).collect())  # images are as before


@pytest.mark.parametrize("name", ["packed_thr_tozero", "packed_transpose", "pack_unpack_f32"])
def test_queries_on_packed_images_have_one_worker_a_task(spark, tmp_path, name):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from rastrel.queries import QUERIES

    n = np.arange(1500)
    pq.write_table(pa.table({"o_orderkey": n, "o_custkey": n, "o_totalprice": n * 1.5}), tmp_path / "orders.parquet")
    assert _python_steps(QUERIES[name](spark, str(tmp_path))) == 1


def test_png_roundtrip_has_one_worker_a_task(spark):
    files = C.to_png(C.pack(frame(spark, TEXTURE, 255 - TEXTURE)))
    back = C.unpack(C.decode_contents(files))
    assert _python_steps(back) == 1
    assert (array(back) == TEXTURE).all() and (array(back, 1) == 255 - TEXTURE).all()
    assert C.decode_contents(files, 1).first().channels == 1
