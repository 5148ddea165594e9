from quarrygraph.operators import resolve

NODE = "id string, name string, kind string, path string, owner string, language string, arity int, variadic boolean"
RAW = "edge long, source string, relation string, file string, language string, target_id string, specifier string, name string, via_member boolean, recv_type string, arg_count int"


def node(i, name, path, owner=None, language="python", arity=None, variadic=None, kind="function"):
    return (i, name, kind, path, owner, language, arity, variadic)


def raw(edge, file="a.py", name=None, language="python", specifier=None, member=False, recv=None, argc=None, relation="calls"):
    return (edge, file, relation, file, language, None, specifier, name, member, recv, argc)


def test_bare_names(spark):
    nodes = spark.createDataFrame([node("a#f", "f", "a.py"), node("b#f", "f", "b.py"), node("b#g", "g", "b.py"), node("c#h", "h", "c.py", arity=1), node("d#h", "h", "d.py", arity=2), node("j#g2", "g2", "j.ts", language="typescript"), node("e#k", "k", "e.py"), node("f#k", "k", "f.py")], NODE)
    edges = spark.createDataFrame([raw(1, name="f"), raw(2, name="g"), raw(3, name="h", argc=2), raw(4, name="h"), raw(5, name="g2"), raw(6, name="k"), raw(7, name="none")], RAW)
    got = {r.edge: (r.target, r.confidence) for r in resolve.bare_names(edges, nodes).collect()}
    assert got == {1: ("a#f", "extracted"), 2: ("b#g", "inferred"), 3: ("d#h", "inferred")}


def test_members_over_ancestors(spark):
    nodes = spark.createDataFrame([node("m#A.run", "run", "m.py", "A"), node("m#B.go", "go", "m.py", "B"), node("m#C.two", "two", "m.py", "C"), node("n#C.two", "two", "n.py", "C")], NODE)
    parents = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", "C")], "owner string, parent string")
    edges = spark.createDataFrame([raw(1, name="run", member=True, recv="C"), raw(2, name="go", member=True, recv="B"), raw(3, name="two", member=True, recv="C"), raw(4, name="nope", member=True, recv="A")], RAW)
    got = {r.edge: (r.target, r.confidence) for r in resolve.typed_members(edges, nodes, parents).collect()}
    assert got == {1: ("m#A.run", "inferred"), 2: ("m#B.go", "inferred")}  # extracted is for the call's own file only


def test_members_of_traits_and_overloads(spark):
    nodes = spark.createDataFrame([
        node("t#T.log", "log", "t.php", "T", "php"), node("u#U.log", "log", "u.php", "U", "php"), node("t#T.put", "put", "t.php", "T", "php"), node("p#P.log", "log", "p.php", "P", "php"), node("c#C.put", "put", "c.php", "C", "php"),
        node("s#S.save", "save", "s.swift", "S", "swift", 1), node("s#S.save~2", "save", "s.swift", "S", "swift", 1), node("j#J.one", "one", "J.java", "J", "java", 1), node("j#J.one~2", "one", "J.java", "J", "java", 2), node("j#J.any", "any", "J.java", "J", "java", 1), node("k#J.any", "any", "K.java", "J", "java", 1),
    ], NODE)
    traits = spark.createDataFrame([("C", "T"), ("D", "T"), ("D", "U")], "owner string, trait string")
    parents = spark.createDataFrame([("C", "P")], "owner string, parent string")
    edges = spark.createDataFrame([
        raw(1, "c.php", "log", "php", member=True, recv="C"),  # the trait's before the parent's
        raw(2, "c.php", "put", "php", member=True, recv="C"),  # the class's own before the trait's
        raw(3, "d.php", "log", "php", member=True, recv="D"),  # two traits: none
        raw(4, "s.swift", "save", "swift", member=True, recv="S", argc=1),  # overloads by type: none
        raw(5, "J.java", "one", "java", member=True, recv="J", argc=2),
        raw(6, "K.java", "any", "java", member=True, recv="J", argc=1),  # the call's own file's
        raw(7, "x.java", "any", "java", member=True, recv="J", argc=1),
    ], RAW)
    got = {r.edge: (r.target, r.confidence) for r in resolve.typed_members(edges, nodes, parents, traits).collect()}
    assert got == {1: ("t#T.log", "inferred"), 2: ("c#C.put", "extracted"), 5: ("j#J.one~2", "extracted"), 6: ("k#J.any", "extracted")}


def test_rust_uses_and_go_modules(spark):
    files = spark.createDataFrame([(p,) for p in ("src/lib.rs", "src/net.rs", "src/net/tcp/mod.rs", "src/two.rs", "src/two/mod.rs", "tools/x/src/main.rs", "tools/x/src/net.rs", "tests/it.rs")], "path string")
    uses = {1: ("src/a.rs", "crate::net::tcp::Conn"), 2: ("src/a.rs", "crate::net::Client"), 3: ("src/a.rs", "crate::Item"), 4: ("tools/x/src/b.rs", "crate::net"), 5: ("tests/it.rs", "crate::net"), 6: ("src/a.rs", "crate::two::X"), 7: ("src/a.rs", "crate::none::X"), 8: ("src/a.rs", "std::fmt"), 9: ("src/a.rs", "crate::"), 10: ("src/a.rs", "crate::two")}
    edges = spark.createDataFrame([raw(k, f, language="rust", specifier=u, relation="imports") for k, (f, u) in uses.items()], RAW)
    got = {r.edge: r.target for r in resolve.rust_uses(edges, files).collect()}
    assert got == {1: "src/net/tcp/mod.rs", 2: "src/net.rs", 3: "src/lib.rs", 4: "tools/x/src/net.rs", 9: "src/lib.rs", 10: "src/lib.rs"}
    texts = spark.createDataFrame([("go.mod", "// x\nmodule ex.org/a\n\ngo 1.22\n"), ("srv/go.mod", "module  ex.org/srv\n"), ("bad/go.mod", "nothing"), ("x/y.go", "module no")], "path string, text string")
    assert {tuple(r) for r in resolve.go_modules(texts).collect()} == {("ex.org/a", "."), ("ex.org/srv", "srv")}


def test_paths(spark):
    files = spark.createDataFrame([(p,) for p in ("web/a/b.ts", "web/a/index.ts", "web/c.ts", "src/com/x/Main.java", "lib/com/y/T.java", "lib2/com/y/T.java", "inc/z.h", "src/z.h", "src/q/u.h", "App/Http/Kernel.php", "srv/pkg/db/conn.go", "srv/pkg/db/a.go")], "path string")
    rel = spark.createDataFrame([raw(1, "web/a/x.ts", specifier="./b"), raw(2, "web/c.ts", specifier="./a"), raw(3, "web/a/b.ts", specifier="../c"), raw(4, "web/c.ts", specifier="./none")], RAW)
    assert {r.edge: r.target for r in resolve.relative_imports(rel, files).collect()} == {1: "web/a/b.ts", 2: "web/a/index.ts", 3: "web/c.ts"}
    java = spark.createDataFrame([raw(1, "x", language="java", specifier="com.x.Main"), raw(2, "x", language="java", specifier="com.x.Main.Inner"), raw(3, "x", language="java", specifier="com.y.T")], RAW)
    assert {r.edge: r.target for r in resolve.java_imports(java, files).collect()} == {1: "src/com/x/Main.java", 2: "src/com/x/Main.java"}
    c = spark.createDataFrame([raw(1, "src/m.c", language="c", specifier="z.h"), raw(2, "src/m.c", language="c", specifier="q/u.h"), raw(3, "other/m.c", language="c", specifier="u.h"), raw(4, "other/m.c", language="c", specifier="z.h")], RAW)
    assert {r.edge: r.target for r in resolve.c_includes(c, files).collect()} == {1: "src/z.h", 2: "src/q/u.h", 3: "src/q/u.h"}
    php = spark.createDataFrame([raw(1, "x.php", language="php", specifier="My\\App\\Http\\Kernel")], RAW)
    assert {r.edge: r.target for r in resolve.namespace_imports(php, files, r"\\", ".php").collect()} == {1: "App/Http/Kernel.php"}
    go = spark.createDataFrame([raw(1, "x.go", language="go", specifier="ex.org/srv/pkg/db")], RAW)
    modules = spark.createDataFrame([("ex.org", "."), ("ex.org/srv", "srv")], "module string, dir string")
    assert {r.edge: r.target for r in resolve.go_imports(go, files, modules).collect()} == {1: "srv/pkg/db/a.go"}


def test_all_rules_together(spark):
    places = [node(p, p.rsplit("/", 1)[-1], p, language=None, kind="file") for p in ("App/Http/Kernel.php", "srv/pkg/db/a.go", "src/z.h")]
    nodes = spark.createDataFrame([*places, node("l#f", "f", "l.lua", language="lua")], NODE)
    edges = spark.createDataFrame([raw(1, "x.php", language="php", specifier="My\\App\\Http\\Kernel", relation="imports"), raw(2, "x.go", language="go", specifier="ex.org/srv/pkg/db", relation="imports"), raw(3, "src/m.c", language="c", specifier="z.h", relation="imports"), raw(4, "b.sh", language="bash", name="f"), raw(5, "k.lua", language="lua", name="f"), raw(6, "x.go", language="go", specifier="fmt", relation="imports")], RAW)
    modules = spark.createDataFrame([("ex.org/srv", "srv")], "module string, dir string")
    none = spark.createDataFrame([], "owner string, parent string")
    got = {(r.source, r.target) for r in resolve.resolve(edges, nodes, none, modules).collect()}
    assert got == {("x.php", "App/Http/Kernel.php"), ("x.go", "srv/pkg/db/a.go"), ("src/m.c", "src/z.h"), ("k.lua", "l#f"), ("x.go", "fmt")}


def test_calls_belong_to_the_innermost_definition():
    from quarrygraph.operators.extract import _python

    text = "start()\n@mark\ndef outer(x):\n    a(b())\n    def inner():\n        foo()\n    return inner\nclass K:\n    f = made()\n    def m(self):\n        self.go()\n"
    nodes, edges = _python("p.py", text)
    calls = {(e[0], e[6]) for e in edges if e[1] == "calls"}
    assert calls == {("p.py", "start"), ("p.py#outer", "a"), ("p.py#outer", "b"), ("p.py#outer.inner", "foo"), ("p.py#K", "made"), ("p.py#K.m", "go")}
    outer = next(n for n in nodes if n[0] == "p.py#outer")
    assert outer[6:9] == (2, 7, "def outer(x):")
