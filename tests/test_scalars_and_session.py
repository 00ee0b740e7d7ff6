import itertools
import random

import numpy as np
import pytest
from actionflow.functions import params, paths, permissions, text
from actionflow.operators import execute, images, jpeg
from actionflow.operators.export import assign_free, resolve
from actionflow.operators.session import Session
from actionflow.plans.compile import PlanError, Step
from actionflow.sources import catalog as catalogs
from actionflow.sources.definitions import write_shipped
from actionflow.sources.images import as_png, dropped_files, read_rasters, to_png
from pyspark.sql import functions as F

L = F.lit


def values(spark, columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_golden_text(spark):
    pairs = [("kitten", "sitting", 3), ("", "abc", 3), ("é", "e", 2), ("resize", "rezise", 2), ("blur", "blur", 0)]
    assert values(spark, [text.byte_distance(L(a), L(b)) for a, b, _ in pairs]) == [d for *_, d in pairs]
    ages = [(0, 0, 0), (1, 0, 650), (1, -5, 650), (1, 0.5, 640.219457), (1, 1, 380.678061), (2, 14, 400), (10, 28, 1000), (3, 0.5, 1420.65837)]
    as_of = F.timestamp_micros(L(10**15))
    got = values(spark, [text.frecency(L(n), F.timestamp_micros(L(10**15 - int(d * 86_400e6))), as_of) for n, d, _ in ages])
    assert [round(x, 6) for x in got] == [b for *_, b in ages]


def test_golden_paths(spark):
    rows = [("/a/photo.png", "photo", ".png"), ("/a/IMG.HEIC", "IMG.HEIC", ".heic"), ("/a/b.tar.gz", "b.tar", ".gz"), ("/a/.bashrc", "", ".bashrc"), ("/a/noext", "noext", ""), ("/a.b/c", "c", "")]
    for p, name, ext in rows:
        assert values(spark, [paths.stem(L(p), strict=True), paths.extension(L(p))]) == [name, ext]
    assert values(spark, [paths.stem(L("/a/IMG.HEIC"))]) == ["IMG"]
    names = [
        ("{name}_{skill}.{ext}", "photo", ".png", "blur", "photo_blur.png"), ("  ", "a", ".png", "file", "a_file.png"), ("", "photo", ".jpg", "heic-to jpeg", "photo_heic_to_jpeg.jpg"), ("{name}", "photo", ".png", "blur", "photo.png"), ("{name}", "v1.2", ".png", "blur", "v1.2"),
        ("{name}-{ext}", "a", ".png", "x", "a-png.png"), ("{name}.{ext}", "a{ext}", ".png", "x", "apng.png"), ("{name}.{ext}", "{skill}", ".png", "x-y", "x_y.png"), ("{skill}", "noext", "", "blur", "blur."),
    ]
    assert values(spark, [paths.export_name(*map(L, n[:4])) for n in names]) == [n[4] for n in names]


def test_golden_params(spark):
    v = lambda s: F.parse_json(L(s))
    q = [("null", 90), ("30", 40), ("40", 40), ("85.9", 85), ("100", 100), ("150", 100), ('"70"', 70), ('"x"', 90), ("true", 90)]
    assert values(spark, [params.jpeg_quality(params.number_or(v(s), 90)) for s, _ in q]) == [x for _, x in q]
    dims = [(100, 50, 50), (101, 50, 50), (3, 10, 1), (1, 10, 1), (7, 300, 21), (640, 75, 480), (333, 33, 109), (9, 0, None)]
    assert values(spark, [params.resized(L(float(a)), L(float(b))) for a, b, _ in dims]) == [x for *_, x in dims]
    exts = [(".jpg", "native", "", ".jpg"), ("", "native", "", ".png"), ("none", "native", "", ".png"), ("", "cli", "WAV", ".wav"), ("", "native", "WAV", ".png"), (".heic", "cli", "WAV", ".heic")]
    assert values(spark, [params.output_extension(*map(L, e[:3]), L(".png")) for e in exts]) == [e[3] for e in exts]
    colours = [("#abc", (170, 187, 204)), ("#AABBCC", (170, 187, 204)), ("rgb(1, 2, 3)", (1, 2, 3)), ("1 2 3", (1, 2, 3)), ("256,0,0", None), ("#ab", None)]
    assert values(spark, [params.colour(L(c)) for c, _ in colours]) == [x for _, x in colours]
    made = F.create_map(L("quality"), L("70"))
    assert values(spark, [params.rendered(L("{{input}} -q {{quality}} {{output}} {{missing}}"), L("/i"), L("/o"), made)]) == ["/i -q 70 /o {{missing}}"]
    held = F.array(L("tools.exec"), L(""), L("network"), L("tools.exec"))
    assert values(spark, [permissions.normalized(held), permissions.elevated(held), permissions.needs_trust(held)]) == [["network", "tools.exec"], ["network"], True]
    assert values(spark, [params.preset_value(v('{"label":"a","value":"b"}')), params.preset_label(v('{"value":"b"}')), params.preset_value(v("3"))]) == ["b", "b", "3"]


def slow_assign(names, taken):
    used, out = set(taken), []
    for n in names:
        base, dot, ext = n.rpartition(".")
        base, ext = (base, dot + ext) if dot else (n, "")
        for c in itertools.chain([n], (f"{base}-{k}{ext}" for k in range(1, 1000))):
            if c not in used:
                used.add(c)
                out.append(c)
                break
    return out


def test_collisions(spark):
    goldens = [([], ["a.png"] * 3, ["a.png", "a-1.png", "a-2.png"]), (["a.png"], ["a.png", "a-1.png"], ["a-1.png", "a-1-1.png"]), ([], ["a.png", "a-1.png", "a.png", "a-1.png"], ["a.png", "a-1.png", "a-2.png", "a-1-1.png"]), (["a-1.png"], ["a.png", "a.png"], ["a.png", "a-2.png"])]
    for taken, asked, want in goldens:
        assert assign_free(asked, set(taken)) == want
    r = random.Random(1)
    pool = [f"{b}{s}{e}" for b in "ab" for s in ("", "-1", "-2", "-1-1") for e in (".png", ".x", "")]
    for _ in range(20):
        asked, taken = [r.choice(pool) for _ in range(40)], r.sample(pool, 4)
        want = slow_assign(asked, taken)
        assert assign_free(asked, set(taken)) == want and len(set(want)) == 40
    got = resolve(spark.createDataFrame([("f", i, n) for i, n in enumerate(asked)], "folder string, position bigint, name string"), spark.createDataFrame([("f", n) for n in taken], "folder string, name string"))
    assert [x.resolved for x in got.orderBy("position").collect()] == want


def test_collisions_without_bound(spark):
    """Over 999 requests for one name, without and with a clash; random families against one pass in order."""
    assert assign_free(["a.png"] * 1500, set())[-1] == "a-1499.png"
    r = random.Random(2)
    pool = [f"{b}{s}{e}" for b in "abcd" for s in ("", "-1", "-2", "-1-1", "-01", "-40", "-99999999999999999999") for e in (".png", ".x", "")]
    asked = [("hot", n) for n in ["a.png"] * 1500 + ["b.png"] * 700 + ["b-600.png"] + ["b.png"] * 700 + ["c-5.png", "c.png"]]
    asked += [(f"f{i}", n) for i in range(12) for n in r.choices(r.sample(pool, 1 + i), k=30)] + [(None, "a.png")] * 2
    r.shuffle(asked)
    taken = [("hot", "a.png"), ("hot", "c-5.png"), ("f0", "a.png"), ("f5", "b-1.x")] + [(f"f{i}", n) for i in range(6, 12) for n in r.sample(pool, 3)] + [(None, "a.png")]
    got = resolve(spark.createDataFrame([(f, i * i, n) for i, (f, n) in enumerate(asked)], "folder string, position bigint, name string"), spark.createDataFrame(taken + taken[:2], "folder string, name string"))
    rows = [(x.position, x.folder, x.name, x.resolved) for x in got.collect()]
    want = []
    for folder in {f for f, _ in asked}:
        mine = [(i * i, n) for i, (f, n) in enumerate(asked) if f == folder]
        made = assign_free([n for _, n in mine], {n for f, n in taken if f == folder})
        want += [(p, folder, n, m) for (p, n), m in zip(mine, made, strict=True)]
    assert sorted(rows, key=lambda x: x[0]) == sorted(want, key=lambda x: x[0])


def test_png_and_kernels():
    r = np.random.RandomState(0)
    p = r.randint(0, 256, (6, 4, 4)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(p)) == p).all()
    assert (images.decode_png(images.encode_png(p[:, :, 0]))[:, :, 1] == p[:, :, 0]).all()
    flat = np.full((8, 6, 4), 77, np.uint8)
    assert (images.blur(flat, 2.0) == 77).all() and (images.resize_percent(flat, 50) == 77).all() and images.resize_percent(flat, 50).shape == (4, 3, 4)
    assert images.grayscale(np.array([[[200, 0, 10, 255]]], np.uint8))[0, 0].tolist() == [61, 61, 61, 255]
    assert images.decode_png(images.preview(np.zeros((2, 600, 4), np.uint8))).shape[:2] == (2, 520)


def test_jpeg(spark, tmp_path):
    y, x = np.mgrid[0:21, 0:37]
    smooth = np.stack([x * 6, y * 11, 255 - x * 3, np.full_like(x, 255)], 2).astype(np.uint8)
    noise = np.random.RandomState(3).randint(0, 256, (9, 17, 4)).astype(np.uint8)
    for pixels, near in ((smooth, 3), (noise, 8), (np.full((1, 1, 4), 9, np.uint8), 2)):
        data = jpeg.encode(pixels, 100)
        got = jpeg.decode(data)
        assert np.abs(got[:, :, :3].astype(int) - pixels[:, :, :3]).max() <= near
        (tmp_path / "x.jpg").write_bytes(data)
        r = read_rasters(spark, str(tmp_path / "x.jpg")).first()  # Spark's decoder agrees
        other = images.decode_png(to_png(bytes(r["data"]), r["width"], r["height"], r["channels"]))
        assert np.abs(other[:, :, :3].astype(int) - got[:, :, :3]).max() <= 2
    assert len(jpeg.encode(smooth, 40)) < len(jpeg.encode(smooth, 90))
    with pytest.raises(images.Unsupported):
        jpeg.decode(b"xx")
    png = images.encode_png(smooth)
    step = lambda a, out="": Step(a, "image", {"percent": 50}, out, "native")
    data, ext = execute.run_steps(png, ".png", [step("convert_to_jpeg", ".jpg"), step("resize"), step("convert_to_png", ".png")])
    assert ext == ".png" and images.decode_png(data).shape[:2] == (10, 18)


def java_jpeg(spark, pixels, path, progressive):
    """A JPEG by Java's encoder."""
    jvm = spark._jvm
    height, width = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    for y in range(height):
        for x in range(width):
            r, g, b = (int(v) for v in pixels[y, x, :3])
            image.setRGB(x, y, (r << 16 | g << 8 | b) - (1 << 24))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(path))
    writer.setOutput(out)
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1 if progressive else 0)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    out.close()
    writer.dispose()


@pytest.mark.parametrize("progressive", [False, True])
def test_jpegs_of_another_encoder(spark, tmp_path, progressive):
    r = np.random.RandomState(7)
    y, x = np.mgrid[0:37, 0:45]
    smooth = np.stack([x * 5, y * 6, 255 - x * 3 - y], 2).clip(0, 255).astype(np.uint8)
    for k, p in enumerate((smooth, r.randint(0, 256, (19, 33, 3)).astype(np.uint8), np.full((8, 8, 3), 200, np.uint8))):
        path = str(tmp_path / f"{k}.jpg")
        java_jpeg(spark, p, path, progressive)
        data = open(path, "rb").read()
        assert (b"\xff\xc2" in data) == progressive
        got = jpeg.decode(data)
        row = read_rasters(spark, path).first()
        other = images.decode_png(to_png(bytes(row["data"]), row["width"], row["height"], row["channels"]))
        # the other decoder draws out halved colours smoothly, this one repeats them: what they have in common is the brightness
        light = lambda a: a[:, :, :3] @ np.array([0.299, 0.587, 0.114])
        assert np.abs(light(got.astype(float)) - light(other.astype(float))).mean() < (1.5 if k != 1 else 12), k
        if k == 2:
            assert np.abs(got[:, :, :3].astype(int) - 200).max() <= 2


def test_image_source(spark, tmp_path):
    p = np.random.RandomState(0).randint(0, 256, (5, 4, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.encode_png(p))
    (tmp_path / "b.png").write_bytes(b"xx")
    got = {r.origin[-5:]: r.content for r in as_png(read_rasters(spark, str(tmp_path))).collect()}
    assert got["b.png"] is None and (images.decode_png(bytes(got["a.png"]))[:, :, :3] == p).all()
    seen = []
    stream = dropped_files(spark, str(tmp_path)).writeStream.foreachBatch(lambda d, n: seen.extend(r.length for r in d.collect())).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert 2 in seen


def test_tools():
    step = lambda command, *args, ms=5000: Step("t", "cli", {"quality": 70}, "", "cli", command, args, "", ms)
    run = lambda s: execute.run_steps(b"abc", ".txt", [s])[0]
    assert run(step("cp", "{{input}}", "{{output}}")) == b"abc"
    for bad in (step("sleep", "5", ms=100), step("false"), step("no-such-tool"), step("ls", "/no/such")):
        with pytest.raises(RuntimeError):
            run(bad)


def test_session(spark, tmp_path):
    catalog, _ = catalogs.load(spark, [("core:embedded", write_shipped(str(tmp_path / "core")))])
    s = Session(spark, catalog, f"file://{tmp_path}/tables")
    grad = np.arange(8 * 6 * 3).reshape(6, 8, 3).astype(np.uint8)
    (tmp_path / "in").mkdir()
    for name, data in (("a.png", images.encode_png(grad)), ("b.png", b"xx")):
        (tmp_path / "in" / name).write_bytes(data)
    added = s.add_files([str(tmp_path / "in" / n) for n in ("a.png", "b.png", "missing.png")]).collect()
    assert [(r.name, r.current_extension, r.preview is None) for r in added] == [("a", ".png", False), ("b", ".png", True)]
    a, b = (r.id for r in added)
    assert "content" not in s.view().columns and "snapshot" not in s.view().columns
    done = s.apply(None, "resize", {"percent": 50})
    assert "Unsupported" in done.message and s.uses.count() == 0 and "content" not in done.files.columns
    for action, given in (("grayscale", {}), ("blur", {"radius": 2.0})):
        assert s.apply([a], action, given).message == ""
    assert {r.skill_id: r["count"] for r in s.usage().collect()} == {"grayscale": 1, "blur": 1}
    with pytest.raises(PlanError):
        s.remove_step(a, 3)
    written = s.spark.read.parquet(s.contents)
    before = written.count()
    assert s.remove_step(a, 1).count() == 1
    assert s.spark.read.parquet(s.contents).count() == before + 1  # only blur ran again
    held = lambda i: bytes(s.content([i]).first().content)
    want = images.blur(images.decode_png(images.encode_png(images.resize_percent(images.decode_png(images.encode_png(grad)), 50))), 2.0)
    assert (images.decode_png(held(a)) == want).all() and want.shape[:2] == (3, 4)
    assert [(r.step_index, r.skill_id) for r in s.steps.where(F.col("file_id") == a).orderBy("step_index").collect()] == [(0, "resize"), (1, "blur")]
    assert [r.step_index for r in s.snapshots.where(F.col("file_id") == a).orderBy("step_index").collect()] == [0, 1]
    s.apply(None, "set_output_folder", {"folder": f"file://{tmp_path}/out"})
    assert s.apply(None, "export").message == "Exported 2 files"
    assert [r.output_path.rpartition("/")[2] for r in s.export().collect()] == ["a_blur-1.png", "b_file-1.png"]
    assert (tmp_path / "out" / "a_blur.png").read_bytes() == held(a)
    s.apply(None, "switch_to_per_file")
    assert s.mode == "per_file" and s.types() == [".png"]
    s.set_active(a)
    assert s.apply(None, "compress").message == "" and s.steps.where(F.col("file_id") == b).count() == 0  # the active file alone
    s.remove_step(a, 0)
    assert images.decode_png(held(a)).shape[:2] == (6, 8) and s.steps.where(F.col("file_id") == a).count() == 2
    with pytest.raises(PlanError):
        s.apply(["nobody"], "blur")
    s.remove_files([b])
    assert s.files.count() == 1
    s.apply(None, "clear_all")
    assert s.files is None and s.mode == "batch" and s.apply(None, "blur").files.count() == 0
    assert s.export().count() == 0 and s.view().count() == 0
    s.remove_files(["x"])


def test_session_keeps_settings_trust_and_uses(spark, tmp_path):
    catalog, _ = catalogs.load(spark, [("core:embedded", write_shipped(str(tmp_path / "core")))])
    kept = f"file://{tmp_path}/kept"
    s = Session(spark, catalog, f"file://{tmp_path}/one", kept)
    assert s.settings["naming_pattern"] == paths.DEFAULT_PATTERN and s.trusted == set() and s.usage().count() == 0
    s.apply(None, "set_accent_color", {"color": "1,2,3"})
    s.apply(None, "set_naming_pattern", {"pattern": "  "})  # blank: as before
    s.set_trust("x", True)
    s.set_trust("y", True)
    s.set_trust("x", False)
    (tmp_path / "a.bmp").write_bytes(execute.WRITERS[".bmp"](np.zeros((4, 4, 3), np.uint8)))
    s.add_files([f"file://{tmp_path}/a.bmp"])
    for _ in range(2):
        assert s.apply(None, "grayscale").message == ""
    again = Session(spark, catalog, f"file://{tmp_path}/two", kept)
    assert again.settings == {"output_folder": "", "naming_pattern": paths.DEFAULT_PATTERN, "accent_color": "1,2,3"}
    assert again.trusted == {"y"} and [(r.skill_id, r["count"]) for r in again.usage().collect()] == [("grayscale", 2)]


def test_values_of_parameters_are_the_same_when_run_again(spark, tmp_path):
    """A tool that writes its argument down: run at first and again it gets the same."""
    catalog, _ = catalogs.load(spark, [("core:embedded", write_shipped(str(tmp_path / "core")))])
    s = Session(spark, catalog, f"file://{tmp_path}/tables")
    for name in ("note", "first"):
        s.plans.rows[name] = {"id": name, "is_meta": False, "driver": "cli", "output_type": "", "source": "core:embedded", "permissions": ["tools.exec"], "params": [], "executor": {"type": "cli", "command": "sh", "args": ["-c", 'printf "%s|" "$1" "$2" "$3" > "$0"', "{{output}}", "{{a}}", "{{b}}", "{{c}}"]}}
    (tmp_path / "f.txt").write_bytes(b"x")
    i = s.add_files([str(tmp_path / "f.txt")]).first().id
    for name in ("first", "note"):
        assert s.apply([i], name, {"a": 2.0, "b": "007", "c": "1e3"}).message == ""
    told = bytes(s.content().first().content)
    s.remove_step(i, 0)
    assert bytes(s.content().first().content) == told == b"2|007|1e3|"


def test_other_rasters(spark, tmp_path):
    r = np.random.RandomState(5)
    few = r.choice([0, 100, 255], (9, 13, 4)).astype(np.uint8)
    few[:, :, 3] = 255
    for ext, write in execute.WRITERS.items():
        p = few if ext == ".gif" else r.randint(0, 256, (9, 13, 4)).astype(np.uint8)
        seen = p.copy()
        seen[:, :, 3] = 255
        assert (execute.READERS[ext](write(seen)) == seen).all(), ext
        (tmp_path / f"x{ext}").write_bytes(write(seen))
        row = read_rasters(spark, str(tmp_path / f"x{ext}")).first()  # Spark's decoder agrees
        other = images.decode_png(to_png(bytes(row["data"]), row["width"], row["height"], row["channels"]))
        assert (other[:, :, :3] == seen[:, :, :3]).all(), ext
        half = p.copy()
        half[:, :, 3] = r.choice([0, 255], half.shape[:2])
        got = execute.READERS[ext](write(half))
        assert (got[:, :, 3] == half[:, :, 3]).all() and (got[half[:, :, 3] > 0] == half[half[:, :, 3] > 0]).all(), ext
        for action in ("resize", "grayscale", "blur", "convert_to_png", "convert_to_jpeg"):
            out = {"convert_to_png": ".png", "convert_to_jpeg": ".jpg"}.get(action, "")
            data, now = execute.run_steps(write(seen), ext, [Step(action, "image", {"percent": 50, "radius": 1.0}, out, "native")])
            assert now == (out or ext) and execute.READERS[now](data).shape[:2] == ((4, 6) if action == "resize" else (9, 13))
        with pytest.raises(images.Unsupported):
            execute.READERS[ext](b"not one of them at all")
    many = r.randint(0, 256, (60, 70, 4)).astype(np.uint8)
    many[:, :, 3] = 255
    got = execute.READERS[".gif"](execute.WRITERS[".gif"](many))
    assert got.shape == many.shape and np.abs(got[:, :, :3].astype(int) - many[:, :, :3]).max() <= 26  # nearest of a cube
    long = np.tile(np.arange(250, dtype=np.uint8), (300, 1))
    assert (execute.READERS[".gif"](execute.WRITERS[".gif"](long))[:, :, 0] == long).all()  # more codes than the table holds


def write_png(samples, depth, kind, filters, lace=False, extra=b""):
    """A PNG from its definition. samples: (height, width, n)."""
    import struct
    import zlib

    height, width, n = samples.shape
    body = b""
    for top, left, down, across in [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if lace else [(0, 0, 1, 1)]:
        part = samples[top::down, left::across]
        if not part.size:
            continue
        each = max(1, n * depth // 8)
        above = None
        for y, row in enumerate(part):
            bits = "".join(format(int(v), f"0{depth}b") for v in row.ravel())
            line = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
            up = above or [0] * len(line)
            how = filters[y % len(filters)]
            out = []
            for x, v in enumerate(line):
                a, b, c = line[x - each] if x >= each else 0, up[x], up[x - each] if x >= each else 0
                p = a + b - c
                guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][how]
                out.append((v - guess) & 255)
            body += bytes([how, *out])
            above = line
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, int(lace))) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth, kind, n", [(8, 0, 1), (8, 2, 3), (8, 6, 4), (8, 4, 2), (16, 2, 3), (16, 0, 1), (1, 0, 1), (2, 0, 1), (4, 0, 1)])
@pytest.mark.parametrize("lace", [False, True])
def test_png_of_every_kind(depth, kind, n, lace):
    r = np.random.RandomState(depth + n)
    samples = r.randint(0, 1 << depth, (11, 13, n))
    got = images.decode_png(write_png(samples, depth, kind, [4, 3, 2, 1, 0, 4, 4], lace))
    eight = samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1))
    assert (got[:, :, :3] == eight[:, :, : (3 if n >= 3 else 1)]).all()
    assert (got[:, :, 3] == (eight[:, :, -1] if n in (2, 4) else 255)).all()
