import pytest
from pyspark.sql import functions as F

from quarrygraph.engine import Engine, mermaid, text_report

FILES = {
    "app/cache.py": "import os\nfrom .store import Store\n\n\nclass Cache:\n    def get(self, key):\n        return self.load(key)\n\n    def load(self, key):\n        s = Store()\n        return s.read(key)\n\n\ndef evict_oldest_entry(cache):\n    return cache.get(1)\n",
    "app/store.py": "class Base:\n    def read(self, key):\n        return open(key)\n\n\nclass Store(Base):\n    pass\n",
    "app/tests/test_cache.py": "from app.cache import Cache\n\n\ndef test_get():\n    Cache().get(2)\n    evict_oldest_entry(None)\n",
    "web/main.ts": "import { helper } from './helper';\nexport function start() {\n  helper();\n}\n",
    "web/helper.ts": "export function helper() {\n  return 1;\n}\n",
    "web/view.vue": "<template/>\n<script>\nexport function draw() {\n  helper();\n}\n</script>\n",
    "src/lib.rs": "pub fn parse(x: u8) {\n    check(x);\n}\nfn check(x: u8) {}\n",
    "node_modules/x/skip.py": "def skipped(): pass\n",
    ".hidden/skip.py": "def skipped(): pass\n",
    "app/broken.py": "def broken(:\n  pass\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "app" / "wide.py").write_bytes(b"\xff\xfe" + "def wide():\n    pass\n".encode("utf-16-le"))
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    e.source = str(root)
    e.build(e.source)
    return e


def edge_set(engine):
    return {(r.source, r.relation, r.target) for r in engine.graph()[1].collect()}


def test_nodes_and_edges(engine):
    nodes = {r.id: r for r in engine.graph()[0].collect()}
    assert not any("skip" in i for i in nodes)
    assert nodes["app/cache.py#Cache.get"].kind == "method" and nodes["app/cache.py#Cache.get"].owner == "Cache"
    assert nodes["app/cache.py"].chars == len(FILES["app/cache.py"])
    assert nodes["web/view.vue#draw"].span_start == 3 and "app/wide.py#wide" in nodes and "src/lib.rs#check" in nodes
    edges = edge_set(engine)
    assert ("app/cache.py#Cache.get", "calls", "app/cache.py#Cache.load") in edges
    assert ("app/cache.py#Cache.load", "calls", "app/store.py#Base.read") in edges
    assert ("app/cache.py", "imports", "app/store.py") in edges and ("app/cache.py", "imports", "os") in edges
    assert ("web/main.ts", "imports", "web/helper.ts") in edges and ("web/main.ts#start", "calls", "web/helper.ts#helper") in edges
    assert ("app/store.py#Store", "extends", "app/store.py#Base") in edges
    assert ("app/tests/test_cache.py#test_get", "calls", "app/cache.py#evict_oldest_entry") in edges


def test_questions(engine):
    assert engine.ask("who calls evict_oldest_entry").first().id == "app/tests/test_cache.py#test_get"
    assert engine.ask("evict the oldest cache entry").first().id == "app/cache.py#evict_oldest_entry"
    assert {r.id for r in engine.callers("load", None).collect()} >= {"app/cache.py#Cache.get"}
    assert {r.id for r in engine.callees("Cache.load").collect()} == {"app/store.py#Base.read", "app/store.py#Store"}
    assert [r.id for r in engine.grep("self\\.load").collect()] == ["app/cache.py#Cache.get"]
    assert [r.name for r in engine.skeleton("cache.py").collect()] == ["Cache", "get", "load", "evict_oldest_entry"]
    with pytest.raises(ValueError, match="unknown"):
        engine.skeleton("nothing.py")
    assert {r.dir for r in engine.map().collect()} >= {"app", "web", "src"}
    assert "n0" in mermaid(engine.graph()[1]) and "dir" in text_report(engine.map())
    assert engine.cards().where("path = 'src/lib.rs'").first().card.count("- function") == 2
    assert engine.summarise(lambda code, path: f"{path}:{len(code)}").count() == engine.graph()[0].where("kind <> 'file'").count()


def test_blast_and_drift(engine, spark, tmp_path):
    changed = spark.createDataFrame([("app/store.py",)], "path string")
    ranges = spark.createDataFrame([("app/store.py", 2, 2)], "path string, range_start int, range_end int")
    report = engine.blast(changed, ranges)
    assert {r.id for r in report["seeds"].collect()} == {"app/store.py#Base.read"}
    assert {r.id: r.depth for r in report["impacted"].collect()} == {"app/cache.py#Cache.load": 1, "app/cache.py#Cache.get": 2}
    assert engine.check(engine.source).where("state <> 'same'").count() == 0
    import pathlib

    pathlib.Path(engine.source, "web/new.ts").write_text("export function more() {}\n")
    assert [tuple(r) for r in engine.check(engine.source).where("state <> 'same'").collect()] == [("web/new.ts", "added")]
    assert engine.graph()[0].select(F.count_distinct("id") == F.count("*")).first()[0]


def test_refresh_parses_only_what_changed(spark, tmp_path, monkeypatch):
    from quarrygraph.operators import extract

    root = tmp_path / "tree"
    root.mkdir()
    for name, text in {"a.py": "def f():\n    return g()\n", "b.py": "def g():\n    pass\n", "c.py": "def h():\n    f()\n"}.items():
        (root / name).write_text(text)
    e = Engine(spark, str(tmp_path / "engine"))
    e.build(str(root))
    assert not e.refresh(str(root)) and ("a.py#f", "calls", "b.py#g") in edge_set(e)
    (root / "b.py").write_text("def g2():\n    pass\n")
    (root / "c.py").unlink()
    (root / "d.py").write_text("def g():\n    g2()\n")
    parsed, whole = [], extract.extract_nodes
    monkeypatch.setattr(extract, "extract_nodes", lambda fs: parsed.extend(r.path for r in fs.select("path").collect()) or whole(fs))
    assert e.refresh(str(root)) and sorted(parsed) == ["b.py", "d.py"]
    got = edge_set(e)
    assert ("a.py#f", "calls", "d.py#g") in got and ("d.py#g", "calls", "b.py#g2") in got and not any("c.py" in x or "b.py#g" == x for t in got for x in t)
    f = Engine(spark, str(tmp_path / "other"))
    monkeypatch.undo()
    f.build(str(root))
    assert edge_set(f) == got and sorted(map(str, f.graph()[0].select(*sorted(f.graph()[0].columns)).collect())) == sorted(map(str, e.graph()[0].select(*sorted(e.graph()[0].columns)).collect()))
    assert not e.refresh(str(root))


@pytest.mark.parametrize("step", ["files.write_graph", "publish"])
def test_a_failed_build_leaves_the_last_version(spark, tmp_path, monkeypatch, step):
    from pyspark.sql.readwriter import DataFrameWriter

    import quarrygraph.engine as module

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    pass\n\n\ndef two():\n    one()\n")
    e = Engine(spark, str(tmp_path / "engine"))
    with pytest.raises(ValueError, match="nothing is built"):
        e.graph()
    assert e.refresh(str(root)) and e.version().version == 1
    before = edge_set(e)
    (root / "a.py").write_text("def three():\n    pass\n")

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    if step == "publish":
        whole = DataFrameWriter.parquet
        monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: fail() if path.endswith("/versions") else whole(self, path, *a, **k))
    else:
        owner, name = step.split(".")
        monkeypatch.setattr(getattr(module, owner), name, fail)
    with pytest.raises(RuntimeError, match="lost"):
        e.refresh(str(root))
    monkeypatch.undo()
    assert edge_set(e) == before and e.version().version == 1
    assert e.check(str(root)).first().state == "changed"
    assert e.refresh(str(root)) and not e.refresh(str(root)) and e.version().version == 2
    assert {r.id for r in e.graph()[0].collect()} == {"a.py", "a.py#three"}


def test_another_extractor_parses_all_files(spark, tmp_path, monkeypatch):
    import quarrygraph.engine as module
    from quarrygraph.operators import extract

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    pass\n")
    e = Engine(spark, str(tmp_path / "engine"))
    e.build(str(root))
    parsed, whole = [], extract.extract_nodes
    monkeypatch.setattr(extract, "extract_nodes", lambda fs: parsed.extend(r.path for r in fs.select("path").collect()) or whole(fs))
    monkeypatch.setattr(module, "extractor_stamp", lambda: "another")
    assert e.refresh(str(root)) and parsed == ["a.py"] and not e.refresh(str(root))
