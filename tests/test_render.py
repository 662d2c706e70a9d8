import time
import zlib

import numpy as np
import pytest

from quire.sources import raster
from quire.sources.document import Document
from quire.sources.images import decode_image
from quire.sources.reader import rows_of
from quire.sources.render import load_function, render_page
from quire.sources.syntax import Name, Stream
from quire.sources.writer import Builder, text_pdf
from test_codecs import encode_g4, encode_jpeg


def page(content, resources=None, annots=None, size=(40, 30), **more):
    b = Builder()
    held = {k: {n: b.add(v) for n, v in items.items()} for k, items in (resources or {}).items()}
    pages = b.add({})
    made = {"Type": Name("Page"), "Contents": b.add(Stream({}, content)), "MediaBox": [0, 0, *size], "Resources": held, **more}
    if annots:
        made["Annots"] = [b.add(a) for a in annots]
    b.objects[pages.num] = {"Type": Name("Pages"), "Kids": [b.add(made)], "Count": 1}
    return b.build(b.add({"Type": Name("Catalog"), "Pages": pages}))


def pixels(content, resources=None, scale=1.0, **more):
    doc = Document(page(content, resources, **more))
    return np.rint(render_page(doc, next(doc.pages()), scale).rgb * 255).astype(int)


def test_fills_and_rules():
    got = pixels(b"1 0 0 rg 10 10 20 10 re f")
    assert (got[10:20, 10:30] == [255, 0, 0]).all() and (got[:10] == 255).all() and (got[:, :10] == 255).all()
    ring = b"0 g 5 5 30 20 re 10 10 20 10 re "
    assert (pixels(ring + b"f*")[12:18, 12:28] == 255).all() and (pixels(ring + b"f")[12:18, 12:28] == 0).all()
    half = pixels(b"0 g 10 10 10.5 5.5 re f")
    assert half[17, 20].tolist() == [128] * 3 and half[14, 15].tolist() == [128] * 3 and half[18, 15].tolist() == [0] * 3


def test_coverage_of_a_disc():
    k = 0.5522847498307936
    points = [(20.0, 10.0)]
    for a, b in ((((20, 10 + 10 * k), (10 + 10 * k, 20)), (10, 20)), (((10 - 10 * k, 20), (0, 10 + 10 * k)), (0, 10)), (((0, 10 - 10 * k), (10 - 10 * k, 0)), (10, 0)), (((10 + 10 * k, 0), (20, 10 - 10 * k)), (20, 10))):
        points += raster.curve(points[-1], *a, b)
    assert raster.coverage([points], 25, 25).sum() == pytest.approx(np.pi * 100, rel=0.02)
    assert raster.coverage([], 5, 5).sum() == 0 and raster.coverage([[(0.0, 0.0), (float("nan"), 1.0)]], 5, 5).sum() == 0


def test_strokes_clips_and_states():
    got = pixels(b"q 0 0 1 RG 4 w 5 15 m 35 15 l S Q 0 1 0 rg 0 0 5 5 re f")
    assert (got[13:17, 5:35] == [0, 0, 255]).all() and (got[12, 5:35] == 255).all() and (got[25:, :5] == [0, 255, 0]).all()
    got = pixels(b"q 10 10 5 5 re W n 0 g 0 0 40 30 re f Q 1 0 0 rg 0 0 1 1 re f")
    assert (got[15:20, 10:15] == 0).all() and got[10, 10].tolist() == [255] * 3 and got[29, 0].tolist() == [255, 0, 0]


def test_transparency():
    states = {"ExtGState": {"H": {"ca": 0.5}, "M": {"BM": Name("Multiply")}}}
    assert pixels(b"/H gs 0 g 0 0 40 30 re f", states)[5, 5].tolist() == [128] * 3
    assert pixels(b"1 1 0 rg 0 0 40 30 re f /M gs 0 1 1 rg 0 0 40 30 re f", states)[5, 5].tolist() == [0, 255, 0]


def group(content, **more):
    return Stream({"Subtype": Name("Form"), "BBox": [0, 0, 40, 30], "Group": {"S": Name("Transparency"), **more}}, content)


def test_groups_knockout_and_soft_masks():
    half = {"H": {"ca": 0.5}}
    overlap = b"/H gs 1 0 0 rg 0 0 20 30 re f 0 0 1 rg 10 0 20 30 re f"

    def shown(g):
        g = Stream({**g.dict, "Resources": {"ExtGState": half}}, g.raw)
        return pixels(b"/F Do", {"XObject": {"F": g}})

    plain, knocked = shown(group(overlap)), shown(group(overlap, K=True))
    assert plain[5, 5].tolist() == knocked[5, 5].tolist() == [255, 127, 127]
    assert plain[5, 25].tolist() == knocked[5, 25].tolist() == knocked[5, 15].tolist() == [127, 127, 255]
    assert plain[5, 15].tolist() not in ([127, 127, 255], [255, 127, 127])  # both colours show

    for level in (0, 51, 200, 255):
        b = Builder()
        masked = group(b"%.6f g 10 0 10 30 re f" % (level / 255))
        mask = {"S": Name("Luminosity"), "G": masked}
        held = b.add(masked)
        pages = b.add({})
        states = {"M": {"SMask": {**mask, "G": held}}, "N": {"SMask": Name("None")}, "A": {"SMask": {"S": Name("Alpha"), "G": held}}}
        content = b.add(Stream({}, b"q /M gs 0 g 0 0 40 15 re f Q 0 g 0 15 5 15 re f"))
        made = {"Type": Name("Page"), "Contents": content, "MediaBox": [0, 0, 40, 30], "Resources": {"ExtGState": states}}
        b.objects[pages.num] = {"Type": Name("Pages"), "Kids": [b.add(made)], "Count": 1}
        doc = Document(b.build(b.add({"Type": Name("Catalog"), "Pages": pages})))
        got = np.rint(render_page(doc, next(doc.pages())).rgb * 255).astype(int)
        assert (got[15:, 10:20] == 255 - level).all() and (got[15:, :10] == 255).all() and (got[15:, 20:] == 255).all()
        assert (got[:15, :5] == 0).all()


def test_blend_by_hue_and_lightness():
    grey = np.full((1, 1, 3), 0.25)
    red, blue = np.array([[[1.0, 0.0, 0.0]]]), np.array([[[0.0, 0.0, 1.0]]])
    assert np.allclose(raster.MODES["Hue"](red, blue), blue) and np.allclose(raster.MODES["Color"](red, blue), blue)
    assert np.allclose(raster.MODES["Luminosity"](red, grey), [[[0.5, 0, 0]]]) and np.allclose(raster.MODES["Luminosity"](grey, red), 0.5)
    assert np.allclose(raster.MODES["Saturation"](red, grey), 0.3) and np.allclose(raster.MODES["Hue"](grey, red), 0.25)


def test_reduced_images_are_means_of_boxes():
    rng = np.random.RandomState(3)
    plane = rng.randint(0, 256, (20, 30)).astype(np.uint8)
    rows, cols = np.meshgrid(np.arange(20), np.arange(30), indexing="ij")
    for high, wide in ((1, 1), (3, 2), (32, 32)):
        got = raster.box_means(plane, rows, cols, high, wide)
        for y, x in ((0, 0), (7, 11), (19, 29), (19, 0)):
            part = plane[max(0, y - high // 2) : y - high // 2 + high, max(0, x - wide // 2) : x - wide // 2 + wide]
            assert got[y, x] == part.astype(int).sum() // part.size
    checks = (np.indices((40, 40)).sum(0) % 2 * 255).astype(np.uint8)
    kind = {"Subtype": Name("Image"), "Width": 40, "Height": 40}
    got = pixels(b"20 0 0 20 10 5 cm /I Do", {"XObject": {"I": Stream({**kind, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, checks.tobytes())}})
    assert (got[5:25, 10:30] == 127).all()
    odd = np.indices((40, 40)) % 2
    for ones, painted in ((odd[0] != odd[1], True), (odd[0] | odd[1], False)):  # a half and a quarter of each box are zeros, which are painted
        stencil = Stream({**kind, "ImageMask": True, "BitsPerComponent": 1}, np.packbits(ones.astype(np.uint8), axis=1).tobytes())
        got = pixels(b"1 0 0 rg 20 0 0 20 10 5 cm /I Do", {"XObject": {"I": stencil}})
        assert (got[6:24, 11:29] == ([255, 0, 0] if painted else [255] * 3)).all()


def test_forms_text_and_rotation():
    form = Stream({"Subtype": Name("Form"), "BBox": [0, 0, 5, 5], "Matrix": [1, 0, 0, 1, 10, 10]}, b"1 0 0 rg 0 0 100 100 re f")
    got = pixels(b"/F Do", {"XObject": {"F": form}})
    assert (got[15:20, 10:15] == [255, 0, 0]).all() and (got != 255).any(2).sum() == 25
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier")}
    got = pixels(b"BT /F 10 Tf 5 10 Td (A B) Tj ET", {"Font": {"F": font}})
    assert (got[14:20, 6:10] == 0).all() and (got[:, 11:17] == 255).all() and (got[14:20, 18:22] == 0).all()
    turned = pixels(b"1 0 0 rg 0 0 10 5 re f", Rotate=90)
    assert turned.shape == (40, 30, 3) and (turned[:10, :5] == [255, 0, 0]).all()


def test_shadings_and_functions():
    function = {"FunctionType": 2, "Domain": [0, 1], "C0": [1, 0, 0], "C1": [0, 0, 1], "N": 1}
    axial = {"ShadingType": 2, "ColorSpace": Name("DeviceRGB"), "Coords": [0, 0, 40, 0], "Function": function}
    got = pixels(b"/S sh", {"Shading": {"S": axial}})
    assert got[5, 0, 0] > 245 and got[5, 39, 2] > 245 and abs(got[5, 20, 0] - 125) < 6
    radial = {"ShadingType": 3, "ColorSpace": Name("DeviceRGB"), "Coords": [20, 15, 0, 20, 15, 10], "Function": function}
    got = pixels(b"/S sh", {"Shading": {"S": radial}})
    assert got[15, 20, 0] > 230 and got[0, 0].tolist() == [255] * 3
    got = pixels(b"/Pattern cs /P scn 0 0 20 30 re f", {"Pattern": {"P": {"PatternType": 2, "Shading": axial}}})
    assert got[5, 0, 0] > 245 and (got[:, 20:] == 255).all()
    doc = Document(page(b""))
    stitched = load_function(doc, {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 1, 1, 0], "Functions": [{"FunctionType": 2, "N": 1}] * 2})
    assert stitched(np.array([0.0, 0.25, 0.5, 1.0]))[:, 0].tolist() == [0.0, 0.5, 1.0, 0.0]
    sampled = load_function(doc, Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 2], "Size": [3], "BitsPerSample": 8}, bytes([0, 255, 0])))
    assert sampled(np.array([0.0, 0.25, 0.5, 2.0]))[:, 0].tolist() == [0.0, 1.0, 2.0, 0.0]
    assert load_function(doc, {"FunctionType": 4}) is None


def image(d, raw):
    return decode_image(Document(page(b"")), Stream({"Width": 4, "Height": 2, **d}, raw))


def test_images():
    w, h, rgb, alpha = image({"ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}, zlib.compress(bytes(range(24))))
    assert (w, h, alpha) == (4, 2, None) and rgb.reshape(-1).tolist() == list(range(24))
    _, _, rgb, _ = image({"ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 1, bytes([9, 8, 7, 255, 0, 1])], "BitsPerComponent": 1}, b"\x50\xa0")
    assert rgb[0].tolist() == [[9, 8, 7], [255, 0, 1]] * 2 and rgb[1].tolist() == [[255, 0, 1], [9, 8, 7]] * 2
    _, _, rgb, _ = image({"ColorSpace": Name("DeviceCMYK"), "BitsPerComponent": 8}, bytes([255, 0, 0, 0, 0, 0, 0, 255] * 4))
    assert rgb[0, :2].tolist() == [[0, 255, 255], [0, 0, 0]]
    _, _, rgb, _ = image({"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 4, "Decode": [1, 0]}, b"\x0f\x78\xff\xff")
    assert rgb[0, :, 0].tolist() == [255, 0, 136, 119]
    mask = Stream({"Width": 2, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, b"\x00\x80")
    _, _, _, alpha = image({"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "SMask": mask}, bytes(8))
    assert alpha.tolist() == [[0, 0, 128, 128]] * 2
    _, _, _, alpha = image({"ImageMask": True, "BitsPerComponent": 1}, b"\x50\xa0")
    assert alpha.tolist() == [[255, 0, 255, 0], [0, 255, 0, 255]]
    fax = np.array([[0, 1, 1, 0], [1, 0, 0, 1]])
    _, _, rgb, _ = image({"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 1, "Filter": Name("CCITTFaxDecode"), "DecodeParms": {"K": -1, "Columns": 4}}, encode_g4(fax))
    assert (rgb[..., 0] == 255 * (1 - fax)).all()
    photo = np.full((2, 4, 3), 90, np.uint8)
    _, _, rgb, _ = image({"ColorSpace": Name("DeviceRGB"), "Filter": Name("DCTDecode")}, encode_jpeg(photo, False))
    assert np.abs(rgb.astype(int) - 90).max() < 4


def test_images_are_drawn_and_listed():
    colours = {"Subtype": Name("Image"), "Width": 2, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}
    data = page(b"q 20 0 0 10 10 10 cm /I Do Q", {"XObject": {"I": Stream(colours, b"\x00\x80"), "J": Stream({**colours, "Filter": Name("JPXDecode")}, b"")}})
    doc = Document(data)
    got = np.rint(render_page(doc, next(doc.pages())).rgb * 255).astype(int)
    assert (got[10:20, 10:20] == 0).all() and (got[10:20, 20:30] == 128).all()
    assert [(r[2], r[3], r[-1]) for r in rows_of("images", "f", data)] == [(2, 1, "OK"), (2, 1, "UNSUPPORTED")]


def test_annotations_are_drawn_unless_hidden():
    look = Stream({"Subtype": Name("Form"), "BBox": [0, 0, 1, 1]}, b"1 0 0 rg 0 0 1 1 re f")
    b = [{"Subtype": Name("Square"), "Rect": [5, 5, 15, 10], "AP": {"N": look}, "F": f} for f in (0, 2)]
    b[1]["Rect"] = [20, 20, 30, 30]

    builder = Builder()
    ref = builder.add(look)
    pages = builder.add({})
    marks = [{**a, "AP": {"N": ref}} for a in b]
    made = {"Type": Name("Page"), "MediaBox": [0, 0, 40, 30], "Annots": marks}
    builder.objects[pages.num] = {"Type": Name("Pages"), "Kids": [builder.add(made)], "Count": 1}
    doc = Document(builder.build(builder.add({"Type": Name("Catalog"), "Pages": pages})))
    got = np.rint(render_page(doc, next(doc.pages())).rgb * 255).astype(int)
    assert (got[20:25, 5:15] == [255, 0, 0]).all() and (got != 255).any(2).sum() == 50


def test_pixmap_file():
    bitmap = raster.Bitmap.blank(3, 2)
    assert bitmap.ppm() == b"P6\n3 2\n255\n" + b"\xff" * 18


def test_a_page_is_painted_where_its_paths_are():
    (top, left), held = raster.covered([[(10.0, 20.0), (14.0, 20.0), (14.0, 23.5), (10.0, 23.5)]], 1000, 2000)
    assert held.size < 50 and held.sum() == 14 and held[23 - top, 12 - left] == 0.5
    doc = Document(text_pdf("form"))
    render_page(doc, next(doc.pages()))
    began = time.process_time()
    for _ in range(50):
        render_page(doc, next(doc.pages()))
    assert time.process_time() - began < 1  # 2 s and more when each path took arrays of the page's size


def test_picture_sizes_are_those_of_the_pictures():
    files = [text_pdf("form\n" * 70), page(b"1 0 0 rg 10 10 20 10 re f"), page(b"x", Filter=Name("None")), page(b"/I Do", {"XObject": {"I": Stream({"Subtype": Name("Image"), "Filter": Name("JPXDecode"), "Width": 1, "Height": 1}, b"")}}), b""]
    for data in files:
        whole, sizes = rows_of("pictures", "f", data), rows_of("picture_sizes", "f", data)
        assert sizes == [(*r[:4], r[4] and len(r[4]), r[5]) for r in whole]
    # the memory of a page is taken for the next one, cleared
    red, blank = page(b"1 0 0 rg 0 0 40 30 re f"), page(b"")
    assert [rows_of("pictures", "f", data)[0][4][-3:] for data in (red, blank, red)] == [b"\xff\0\0", b"\xff\xff\xff", b"\xff\0\0"]
