"""First principles, boundaries and identities on small patterns, with independent numpy versions."""

import numpy as np
import pytest
from rasters import array, frame

from rastrel.functions import kernels as K
from rastrel.model import Border, Interp, InvalidArgument, Rotation, Threshold, Unsupported, describe
from rastrel.operators import aggregate as A
from rastrel.operators import detect as D
from rastrel.operators import draw as R
from rastrel.operators import geometry as G
from rastrel.operators import lifecycle as L
from rastrel.operators import pointwise as P
from rastrel.operators import stencil as S

Y, X = np.mgrid[0:16, 0:16]
RAMP = (7 * X + 13 * Y + 42) % 256
WHITE = (1.0, 1.0, 1.0, 1.0)


def rng_image(seed, h, w, c=1):
    a = np.random.default_rng(seed).integers(0, 256, (h, w, c))
    return a[..., 0] if c == 1 else a


def padded(a, r, border="edge"):
    return np.pad(a, r, mode=border)


def windows(a, k, **kw):
    return np.lib.stride_tricks.sliding_window_view(padded(a, k // 2, **kw), (k, k))


def test_kernels_have_the_known_weights():
    assert K.gaussian(5, 1.0) == [1785, 8002, 13194, 8002, 1785]
    assert K.gaussian(5, 1.4) == [3611, 7763, 10020, 7763, 3611]
    assert K.gaussian(9, 2.0) == [905, 2172, 4058, 5904, 6690, 5904, 4058, 2172, 905]
    assert [K.box_inverse(k) for k in (3, 5, 63)] == [349525, 209715, 16644]
    assert K.gaussian_size(0, 1.0) == (7, 1.0) and K.gaussian_size(4, 1.0)[0] == 5
    with pytest.raises(InvalidArgument):
        K.gaussian_size(67, 1.0)


def test_saturating_arithmetic(spark):
    a, b = frame(spark, [[200, 10, 0, 127]]), frame(spark, [[100, 20, 0, 127]])
    assert array(P.add(a, b)).tolist() == [[255, 30, 0, 254]]
    assert array(P.sub(b, a)).tolist() == [[0, 10, 0, 0]]
    assert array(P.scale(a, -2)).tolist() == [[0, 0, 0, 0]] and array(P.scale(a, 0.5)).tolist() == [[100, 5, 0, 63]]
    assert array(P.blend(a, b, 1.0)).tolist() == [[200, 10, 0, 127]]


def test_threshold_is_strict(spark):
    px = frame(spark, [[127, 128, 129, 255]])
    assert array(P.threshold(px, 128, 255)).tolist() == [[0, 0, 255, 255]]
    assert array(P.threshold(px, 128.9, 999, Threshold.BINARY_INV)).tolist() == [[255, 255, 0, 0]]
    assert array(P.threshold(frame(spark, [np.arange(256)]), 127)).sum() == 128 * 255


def test_channels(spark):
    white = np.full((2, 2, 3), 255)
    assert (array(P.convert_channels(frame(spark, white), 3, 1)) == 255).all()
    rgba = P.convert_channels(frame(spark, white * 0), 3, 4)
    assert array(rgba)[0, 0].tolist() == [0, 0, 0, 255] and array(P.convert_channels(rgba, 4, 3)).shape == (2, 2, 3)
    with pytest.raises(Unsupported):
        P.convert_channels(rgba, 1, 4)
    assert "unsupported" in describe(Unsupported)
    back = P.convert_depth(P.convert_depth(frame(spark, RAMP), "u8", "f32"), "f32", "u8")
    assert (array(back) == RAMP).all()


def test_otsu_and_equalize(spark):
    bimodal = np.array([[50] * 50 + [200] * 50])
    px = frame(spark, bimodal, np.full((4, 4), 9))
    found = {r.image_id: r.threshold for r in A.otsu(px).collect()}
    assert 50 <= found[0] < 200 and found[1] == 0
    assert set(array(P.threshold(px, kind=Threshold.OTSU)).ravel()) == {0, 255}
    flat = A.equalize(frame(spark, [np.arange(256)], np.full((3, 3), 7)))
    assert array(flat).min() == 0 and array(flat).max() == 255 and (array(flat, 1) == 0).all()
    hist = A.histogram(frame(spark, RAMP)).collect()
    assert len(hist) == 256 and sum(r.n for r in hist) == 256


def test_integral(spark):
    px = frame(spark, RAMP)
    got = {(r.y, r.x): r.s for r in A.integral(px).collect()}
    want = RAMP.cumsum(0).cumsum(1)
    assert all(got[y, x] == want[y, x] for y in range(16) for x in range(16))
    sums = {r.rect: r.s for r in A.integral_sum(px, [(2, 3, 5, 9), (-4, -4, 40, 40), (50, 50, 60, 60)]).collect()}
    assert sums == {0: RAMP[3:10, 2:6].sum(), 1: RAMP.sum(), 2: RAMP[15, 15]}


@pytest.mark.parametrize("h,w,k", [(16, 16, 3), (9, 13, 5), (1, 9, 5), (9, 1, 5), (1, 1, 7), (4, 5, 21), (30, 33, 19)])
def test_stencils_against_numpy(spark, h, w, k):
    a = rng_image(h * w + k, h, w)
    px = frame(spark, a)
    win = windows(a, k)
    assert (array(S.erode(px, k, k)) == win.min((2, 3))).all()
    assert (array(S.dilate(px, k, k)) == win.max((2, 3))).all()
    assert (array(S.blur_median(px, k)) == np.median(win, axis=(2, 3))).all()
    inv = K.box_inverse(k)
    rows = np.lib.stride_tricks.sliding_window_view(np.pad(a, ((0, 0), (k // 2, k // 2)), mode="edge"), k, axis=1).sum(2) * inv + (1 << 19) >> 20
    want = np.lib.stride_tricks.sliding_window_view(np.pad(rows, ((k // 2, k // 2), (0, 0)), mode="edge"), k, axis=0).sum(2) * inv + (1 << 19) >> 20
    assert (array(S.blur_box(px, k)) == want).all()
    zeros = windows(a, k, border="constant").sum((2, 3)) // (k * k)
    assert (array(S.blur_box_sat(px, k)) == zeros).all()


@pytest.mark.parametrize("border,mode", [(Border.ZERO, "constant"), (Border.REPLICATE, "edge"), (Border.REFLECT, "symmetric"), (Border.WRAP, "wrap")])
def test_correlate_borders(spark, border, mode):
    a = rng_image(3, 9, 7)
    weights = np.random.default_rng(1).integers(-9, 10, (5, 3))
    p = np.pad(a, ((2, 2), (1, 1)), mode=mode)
    want = sum(weights[j, i] * p[j : j + 9, i : i + 7] for j in range(5) for i in range(3))
    assert (array(S.correlate(frame(spark, a), weights.tolist(), border)) == want).all()


def test_convolve(spark):
    px = frame(spark, (7 * X + 3 * Y) % 256)
    assert (array(S.convolve2d(px, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])) == (7 * X + 3 * Y) % 256).all()
    assert (array(S.convolve2d(frame(spark, np.full((8, 8), 100)), [[1, 1, 1]] * 3)) == 100).all()  # made to sum to one
    with pytest.raises(InvalidArgument):
        S.convolve2d(px, [[1, 1]])


def test_uniform_images_stay(spark):
    px = frame(spark, np.full((12, 12), 128))
    for out in (S.blur_gaussian(px, 9, 2.0), S.blur_box(px, 15), S.blur_median(px, 5), S.blur_bilateral(px, 3, 1.0, 20.0), S.erode(px, 15, 15)):
        assert (array(out) == 128).all()
    assert (array(S.clahe(px)) == array(S.clahe(px))[0, 0]).all()


def test_sobel_and_median(spark):
    px = frame(spark, X)
    gx, gy = array(S.sobel_x(px)), array(S.sobel_y(px))
    assert (gx[1:-1, 1:-1] == 8).all() and (gy == 0).all()
    assert array(S.blur_median(frame(spark, [np.arange(1, 10)]), 5))[0, 4] == 5


def test_morphology_identities(spark):
    a = rng_image(5, 14, 15)
    px = frame(spark, a)
    opened, closed = array(S.morph_open(px)), array(S.morph_close(px))
    assert (opened <= a).all() and (closed >= a).all()
    assert (array(S.morph_open(S.morph_open(px))) == opened).all()
    speck, hole = np.zeros((16, 16), int), np.full((16, 16), 255)
    speck[8, 8], hole[8, 8] = 255, 0
    assert array(S.morph_open(frame(spark, speck))).sum() == 0 and (array(S.morph_close(frame(spark, hole))) == 255).all()
    one = array(S.dilate(frame(spark, np.eye(5, dtype=int)[2][:, None] * np.eye(5, dtype=int)[2] * 255), 3, 3))
    assert (one[1:4, 1:4] == 255).all() and one.sum() == 9 * 255


def test_canny_step_edge(spark):
    step = np.where(np.mgrid[0:24, 0:64][1] < 32, 0, 255)
    got = array(S.canny(frame(spark, step), 10, 50))
    assert set(np.argwhere(got[5:-5] == 255)[:, 1]) <= {31, 32} and (got[8] == 255).any()
    with pytest.raises(InvalidArgument):
        S.canny(frame(spark, step), 50, 10)


def test_flips_and_turns(spark):
    a = rng_image(2, 5, 8, 3)
    px = frame(spark, a)
    assert (array(G.flip_h(px)) == a[:, ::-1]).all() and (array(G.flip_v(px)) == a[::-1]).all()
    assert (array(G.rotate(px, Rotation.CW)) == np.rot90(a, -1)).all() and (array(G.rotate(px, Rotation.CCW)) == np.rot90(a)).all()
    assert (array(G.transpose(px)) == a.transpose(1, 0, 2)).all()
    four = px
    for _ in range(4):
        four = G.rotate(four, Rotation.CW)
    assert (array(four) == a).all()


def test_resize(spark):
    px = frame(spark, [[10, 20], [30, 40]])
    assert array(G.resize(px, 4, 4, Interp.NEAREST))[0].tolist() == [10, 10, 20, 20]
    assert (array(G.resize(frame(spark, np.full((8, 8, 3), 200)), 24, 24, Interp.BICUBIC)) == 200).all()
    a = rng_image(8, 7, 9)
    for interp in Interp:
        assert (array(G.resize(frame(spark, a), 9, 7, interp)) == a).all()
        for size in ((1, 1), (3, 20), (20, 3)):
            out = array(G.resize(frame(spark, a), *size, interp))
            assert out.shape == size[::-1] and out.min() >= 0 and out.max() <= 255
    one = array(G.resize(frame(spark, [[5]]), 4, 3))
    assert (one == 5).all() and one.shape == (3, 4)
    # corners stay with aligned corners
    out = array(G.resize(frame(spark, a), 17, 13))
    assert out[0, 0] == a[0, 0]


def test_affine_and_samples(spark):
    a = rng_image(4, 6, 7)
    px = frame(spark, a)
    assert (array(G.affine(px, [1, 0, 0, 0, 1, 0])) == a).all()
    moved = array(G.affine(px, [1, 0, 2, 0, 1, 0], interp=Interp.NEAREST, border=Border.ZERO))
    assert (moved[:, :5] == a[:, 2:]).all() and (moved[:, 5:] == 0).all()
    points = spark.createDataFrame([(0, 1.5, 2.0), (0, -9.0, 0.0)], "image_id long, px double, py double")
    got = {r.px: r.v for r in G.sample_bilinear(px, points).collect()}
    assert got[1.5] == (a[2, 1] + a[2, 2]) / 2 and got[-9.0] == a[0, 0]


def test_pyramids(spark):
    px = frame(spark, rng_image(1, 16, 16))
    sizes = {r.level: r["max(x)"] + 1 for r in G.pyramid_gaussian(px, 6, 16, 16).groupBy("level").max("x").collect()}
    assert sizes == {0: 16, 1: 8, 2: 4, 3: 2, 4: 1, 5: 1}
    assert G.pyramid_laplacian(px, 2, 16, 16).groupBy("level").count().count() == 2
    with pytest.raises(InvalidArgument):
        G.pyramid_gaussian(px, 17, 16, 16)


def test_harris_on_a_square(spark):
    a = np.full((32, 32), 255)
    a[8:24, 8:24] = 0
    got = D.harris(frame(spark, a)).orderBy("rank").collect()
    assert 0 < len(got) < 50 and [r.response for r in got] == sorted((r.response for r in got), reverse=True)
    assert all(min(abs(r.x - 8), abs(r.x - 23)) <= 2 and min(abs(r.y - 8), abs(r.y - 23)) <= 2 for r in got)
    assert len(D.harris(frame(spark, a), max_keypoints=2).collect()) == 2


@pytest.mark.parametrize("neighbours", [4, 8])
def test_labels_against_flood(neighbours):
    for seed in range(8):
        on = np.random.default_rng(seed).random((13, 17)) < 0.5
        want, n = np.zeros(on.shape, int), 0
        for y, x in np.argwhere(on):
            if not want[y, x]:
                n += 1
                stack = [(y, x)]
                while stack:
                    p, q = stack.pop()
                    if 0 <= p < 13 and 0 <= q < 17 and on[p, q] and not want[p, q]:
                        want[p, q] = n
                        stack += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if neighbours == 8 or not i or not j]
        assert (D.label_plane(on, neighbours) == want).all()


def test_components_and_boxes(spark):
    a = np.zeros((6, 9), int)
    a[1:3, 1:4], a[4, 8] = 255, 1
    labels = D.connected_components(frame(spark, a))
    boxes = {r.label: (r.x, r.y, r.w, r.h, r.area) for r in D.component_boxes(labels).collect()}
    assert boxes == {1: (1, 1, 3, 2, 6), 2: (8, 4, 1, 1, 1)}


def test_drawing(spark):
    px = L.create(spark, 64, 64)
    assert array(R.draw_rect(px, (10, 10, 20, 15), WHITE, filled=True)).astype(bool).sum() == 300
    line = array(R.draw_line(px, (0, 32), (63, 32), WHITE))
    assert (line[32] == 254).all() and line.sum() == 64 * 254
    assert array(R.draw_line(px, (5, 5), (9, 5), WHITE, 2)).astype(bool).sum() == 7 * 3
    ring = array(R.draw_circle(px, (32, 32), 10, WHITE))
    assert ring[32, 42] == 254 and ring[32, 32] == 0
    assert (array(R.draw_circle(px, (32, 32), 10, WHITE, filled=True)) >= ring).all()
    assert array(R.draw_text(px, "1\n?é", 60, -3, WHITE, 2)).astype(bool).sum() > 0
    with pytest.raises(InvalidArgument):
        R.text_hits("A", 0, 0)
    assert len(R.text_hits("A", 0, 0, font={"A": (1,) * 8})) == 8
    half = array(R.draw_polyline(R.draw_line(px, (9, 9), (9, 9), (1.0, 1.0, 1.0, 0.5)), [(0, 0), (5, 0), (0, 0)], (1.0, 1.0, 1.0, 0.5)))
    once, twice = 255 * 128 >> 8, (255 * 128 + (255 * 128 >> 8) * 127) >> 8
    assert half[9, 9] == once and half[0, 3] == twice


def test_views_and_overlays(spark):
    px = frame(spark, RAMP)
    assert (array(L.view(px, 10, 10, 20, 20)) == RAMP[10:, 10:]).all()
    assert (array(L.view(px, -3, -2, 8, 7)) == RAMP[:5, :5]).all()
    assert array(L.view(px, 40, 0, 5, 5)).shape == (5, 1)
    with pytest.raises(InvalidArgument):
        L.view(px, -20, 0, 5, 5)
    assert array(L.put(px, 1, 2, 0, 9))[2, 1] == 9 and L.get(px, 1, 2).first().v == RAMP[2, 1]
    assert L.buffer_size(4, 5, 3, "f32") == 240
    with pytest.raises(InvalidArgument):
        L.create(spark, 0, 5)
    assert P.compatible(px, frame(spark, RAMP[:5])).first().compatible is False


def test_unequal_images_are_an_error(spark):
    from rastrel.operators import packed
    from rastrel.sources import codecs

    a, b = frame(spark, RAMP), frame(spark, RAMP[:9])
    for work in (lambda: P.add(a, b), lambda: P.sub(b, a), lambda: P.blend(a, b, 0.5), lambda: L.copy(a, b), lambda: packed.add(codecs.pack(a), codecs.pack(b)), lambda: packed.add(codecs.pack(a), codecs.pack(a).where("image_id < 0"))):
        with pytest.raises(Exception, match="images differ"):
            work().collect()
    sixteen = codecs.pack(a, "u16")
    for work in (lambda: packed.add(sixteen, sixteen), lambda: packed.scale(sixteen, 2.0), lambda: packed.blur_box(sixteen, 3)):
        with pytest.raises(Exception, match="8 bits"):
            work().collect()


def test_paired_images_need_no_shuffle(spark, tmp_path):
    from rastrel.operators import packed
    from rastrel.sources import codecs

    images = codecs.pack(frame(spark, RAMP, 255 - RAMP))
    packed.paired(images, packed.scale(images, 0.5)).write.parquet(str(tmp_path / "pairs"))
    out = packed.add(spark.read.parquet(str(tmp_path / "pairs")))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(bytes(r.data) for r in out.collect()) == sorted(np.minimum(255, a + (a * 128 >> 8)).astype(np.uint8).tobytes() for a in (RAMP, 255 - RAMP))
