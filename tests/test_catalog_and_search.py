import datetime as dt
import json
import time

import pytest
from actionflow.operators.search import search, usage_of
from actionflow.plans.compile import Catalog, PlanError, compile_action, extensions, merge_params
from actionflow.sources import catalog as catalogs
from actionflow.sources.definitions import SHIPPED, write_shipped
from actionflow.streaming import reload
from actionflow.streaming.reload import watch
from pyspark.sql import functions as F

AS_OF = dt.datetime(2024, 1, 31)
META = "set_accent_color clear_all export set_naming_pattern set_output_folder switch_to_batch switch_to_per_file"

# The golden rankings.
GOLDENS = [
    ("", [], {}, f"{META} convert_to_jpeg convert_to_png convert_heic_to_jpeg convert_heic_to_png convert_jpeg_to_heic convert_png_to_heic heic_resize resize compress heic_compress blur grayscale heic_blur heic_grayscale", [1150] * 7 + [800] * 6 + [700] * 2 + [650] * 2 + [600] * 4),
    ("", [".png"], {}, f"convert_to_jpeg convert_to_png convert_png_to_heic resize compress blur grayscale {META}", [1400] * 3 + [1300, 1250, 1200, 1200] + [1150] * 7),
    ("jpeg", [".png"], {}, "convert_to_jpeg", [2350]),
    ("jpeg", [], {}, "convert_jpeg_to_heic convert_to_jpeg convert_heic_to_jpeg heic_compress", [2000, 1750, 1250, 711.5385]),
    ("heic", [".heic"], {}, "convert_heic_to_jpeg convert_heic_to_png heic_resize heic_blur heic_grayscale heic_compress", [2600, 2600, 2500, 2400, 2400, 1950]),
    ("rezise", [".png"], {}, "resize", [1566.6667]),
    ("to", [".jpg"], {}, "convert_to_jpeg convert_to_png convert_jpeg_to_heic switch_to_batch switch_to_per_file grayscale export", [2350] * 3 + [1600] * 2 + [1200, 1183.3333]),
    ("com", [".PNG", ".heic"], {}, "compress heic_compress", [2450, 2200]),
    ("", [".png"], {"blur": (3, 0.5), "resize": (10, 28), "export": (1, 14)}, "blur resize convert_to_jpeg convert_to_png convert_png_to_heic export compress grayscale set_accent_color clear_all set_naming_pattern set_output_folder switch_to_batch switch_to_per_file", [2620.6584, 2300, 1400, 1400, 1400, 1350, 1250, 1200] + [1150] * 6),
    ("exprot", [], {}, "", []),
]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    found, bad = catalogs.load(spark, [("core:embedded", write_shipped(str(tmp_path_factory.mktemp("core"))))])
    assert bad.count() == 0 and found.count() == len(SHIPPED) == 21
    return found.cache()


@pytest.mark.parametrize("case", range(len(GOLDENS)))
def test_golden_rankings(spark, catalog, case):
    query, given, uses, order, scores = GOLDENS[case]
    log = [(k, AS_OF - dt.timedelta(days=age)) for k, (n, age) in uses.items() for _ in range(n)]
    usage = usage_of(spark.createDataFrame(log, "skill_id string, used_at timestamp"))
    got = search(catalog, usage, query, given, F.lit(AS_OF)).collect()
    assert [r.id for r in got] == order.split()
    assert [round(r.score, 4) for r in got] == scores
    assert [r.id for r in search(catalog, usage, query, given, F.lit(AS_OF), 6).collect()] == order.split()[:6]


def definition(id, **more):
    return {"id": id, "name": id, "version": "1"} | more


def test_layers_and_quarantine(spark, tmp_path):
    def put(folder, name, what):
        path = tmp_path / folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(what if isinstance(what, str) else json.dumps(what))

    put("core", "a.json", definition("same", description="core"))
    put("disk", "a.json", definition("same", description="disk"))
    put("own", "deep/a.json", definition("same", description="own", permissions=["tools.exec", "", "network", "tools.exec"]))
    put("own", "x1.json", definition("twice", description="first"))
    put("own", "x2.json", definition("twice", description="last"))
    for name in ("_draft.json", ".hidden.json", "manifest.json", "pack.json", "note.txt"):
        put("own", name, definition(name))
    put("own", "X.JSON", definition("upper"))
    put("own", "cut.json", '{"id": "cut", "na')
    put("own", "blank.json", definition(" "))
    put("own", "old.json", {"id": "old", "name": "old"})
    put("own", "kind.json", definition("kind", dangerLevel="high"))
    put("own", "chain.json", definition("chain", executor={"type": "pipeline", "steps": [{"skillId": "a"}]}))
    put("own", "native.json", definition("native", executor={"type": "native"}))
    roots = [("core:embedded", str(tmp_path / "core")), ("core:disk", str(tmp_path / "disk")), ("community", str(tmp_path / "own"))]
    good, bad = catalogs.load(spark, [*roots, ("community", str(tmp_path / "missing"))])
    rows = {r.id: r for r in good.collect()}
    assert sorted(rows) == ["chain", "native", "same", "twice", "upper"]
    assert (rows["same"].description, rows["twice"].description) == ("own", "last")
    assert rows["same"].permissions == ["network", "tools.exec"] and rows["chain"].aliases == []
    assert (rows["chain"].driver, rows["native"].driver, rows["upper"].driver) == ("pipeline", "image", "meta")
    assert sorted((r.definition_path.rpartition("/")[2], r.error) for r in bad.collect()) == [("blank.json", "missing id"), ("cut.json", "malformed definition"), ("kind.json", "malformed definition"), ("old.json", "missing version")]
    assert "missing version" in catalogs.errors_text(bad)

    seen = []
    watch(spark, roots, lambda c, q: seen.append(sorted(r.id for r in c.collect())), str(tmp_path / "progress"), once=True).awaitTermination()
    assert seen[-1] == sorted(rows)
    put("disk", "new.json", definition("new"))
    (tmp_path / "own" / "native.json").unlink()
    watch(spark, roots, lambda c, q: seen.append(sorted(r.id for r in c.collect())), str(tmp_path / "progress"), once=True).awaitTermination()
    assert seen[-1] == sorted({*rows, "new"} - {"native"})
    many = len(seen)
    watch(spark, roots, lambda c, q: seen.append(sorted(r.id for r in c.collect())), str(tmp_path / "progress"), once=True).awaitTermination()
    assert len(seen) == many  # nothing has changed

    stream = watch(spark, [*roots, ("community", str(tmp_path / "later"))], lambda c, q: seen.append(sorted(r.id for r in c.collect())), str(tmp_path / "stream"))
    try:
        def settles(want):
            until = time.time() + 60
            while not (len(seen) > many and seen[-1] == sorted(want)) and time.time() < until:
                time.sleep(0.1)
            return seen[-1] == sorted(want)

        assert settles({*rows, "new"} - {"native"})
        put("disk", "new.json", definition("newer"))  # an edit
        assert settles({*rows, "newer"} - {"native"})
        (tmp_path / "disk" / "new.json").unlink()  # only a deletion
        assert settles({*rows} - {"native"})
        put("later", "deep/own.json", definition("late"))  # a folder that wasn't there
        assert settles({*rows, "late"} - {"native"})
    finally:
        stream.stop()


def test_files_that_go_away_while_they_are_looked_at(spark, tmp_path, monkeypatch):
    """A listing that fails is made again; a load that fails because files changed is left to the next look; any other error counts."""
    root = tmp_path / "own"
    root.mkdir()
    (root / "a.json").write_text(json.dumps(definition("a")))
    real, calls = reload.listing, []

    def flaky(*given):
        calls.append(1)
        if len(calls) <= 2:
            spark._jvm.java.nio.file.Files.size(spark._jvm.java.io.File("/no/such/file").toPath())  # as a vanished file fails
        return real(*given)

    monkeypatch.setattr(reload, "listing", flaky)
    assert len(reload.settled(spark, [("community", str(root))])) == 1 and len(calls) == 3

    seen = []

    def moves(good, bad):
        if not seen:
            (root / "b.json").write_text(json.dumps(definition("b")))
            seen.append(None)
            raise RuntimeError("the files moved")
        seen.append(sorted(r.id for r in good.collect()))

    roots = [("community", str(root))]
    for _ in range(2):
        watch(spark, roots, moves, str(tmp_path / "moves"), once=True).awaitTermination()
    assert seen == [None, ["a", "b"]]

    def fails(good, bad):
        raise RuntimeError("no fault of the files")

    with pytest.raises(Exception, match="no fault of the files"):
        watch(spark, roots, fails, str(tmp_path / "fails"), once=True).awaitTermination()


def test_compile(catalog):
    plans = Catalog.from_rows(catalog)
    steps = compile_action(plans, "heic_compress", {"quality": 70})
    assert [(s.action, s.params.get("quality")) for s in steps] == [("convert_heic_to_jpeg", 70), ("compress", 70), ("convert_jpeg_to_heic", 70)]
    assert extensions(steps, ".heic") == [".heic", ".jpg", ".jpg", ".heic"]
    assert compile_action(plans, "compress")[0].params == {"quality": 85}
    assert merge_params(None, {}) is None and merge_params({"q": 1, "r": 2}, {"q": 5}) == {"q": 5, "r": 2}


def fake(id, kind="native", driver="image", steps=(), source="core:embedded", permissions=(), meta=False, command=""):
    return {"id": id, "is_meta": meta, "driver": driver, "output_type": "", "source": source, "permissions": list(permissions), "params": [], "executor": {"type": kind, "steps": [{"skillId": s, "params": None} for s in steps], "command": command}}


def test_compile_errors():
    rows = {"leaf": fake("leaf"), "meta": fake("meta", meta=True), "p0": fake("p0", "pipeline", steps=["leaf"])}
    for i in range(1, 9):
        rows[f"p{i}"] = fake(f"p{i}", "pipeline", steps=[f"p{i - 1}"])
    rows["with_meta"] = fake("with_meta", "pipeline", steps=["meta"])
    rows["lost"] = fake("lost", "pipeline", steps=["nowhere"])
    rows["risky"] = fake("risky", source="community", permissions=["network"])
    rows["hides"] = fake("hides", "pipeline", steps=["risky"], source="community")
    rows["tool"] = fake("tool", "cli", "cli", source="community", permissions=["tools.exec"], command="/bin/ffmpeg")
    rows["poor"] = fake("poor", "cli", "cli", command="ffmpeg")
    plans = Catalog(rows)
    assert len(compile_action(plans, "p5")) == 1  # six pipelines and the step: depth 6
    for bad in ("p6", "meta", "with_meta", "lost", "risky", "hides", "tool", "poor", "nothing"):
        with pytest.raises(PlanError):
            compile_action(plans, bad)
    assert len(compile_action(plans, "hides", trusted=frozenset(["risky"]))) == 1
