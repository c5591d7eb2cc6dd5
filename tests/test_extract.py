from collections import defaultdict

from pyspark.sql import functions as F

from symweave.functions import text as X
from symweave.operators import changes, context, extract, imports, search
from symweave.sources import snapshots, trees
from symweave.streaming import sync

SOURCES = {
    "src/shapes.ts": "import { Base } from './base';\n\nexport abstract class Shape extends Base {\n  area(): number {\n    return measure(this);\n  }\n}\n\nexport function measure(s: Shape) {\n  return new Ruler().read(s);\n}\n\nconst twice = (x) => x * 2;\n",
    "src/base.ts": "export class Base implements Named {\n  @log\n  hello() {\n    // not(a, call)\n    twice(1);\n  }\n}\nexport interface Named {}\n",
    "app.py": "import os\n\nclass Service(Base):\n    def run(self):\n        self.helper()\n        open_file()\n\n    def helper(self):\n        pass\n\ndef main():\n    Service().run()\n",
    "lib.rs": "use std::fmt;\npub struct Point;\npub trait Show {}\nimpl Show for Point {\n    pub fn show(&self) {\n        draw(self);\n    }\n}\nfn draw() {}\n",
    "main.go": "package main\nimport \"fmt\"\ntype Server struct {}\nfunc (s *Server) Serve() {\n\tfmt.Println(1)\n}\nfunc helper() {}\n",
    "A.java": "import java.util.List;\npublic class A extends B {\n    public int size(List x) {\n        return x.size();\n    }\n}\n",
    "x.rb": "require 'set'\nmodule M\n  class K\n    def go\n      run(1)\n    end\n  end\nend\n",
    "r.js": "app.get('/users', list);\nrouter.post(\"/login\", auth, login);\n",
    "v.py": "@app.route('/home')\ndef home():\n    pass\nurlpatterns = [path('a/<int:id>/', view)]\n",
}


def files(spark, sources=SOURCES):
    return spark.createDataFrame(list(sources.items()), "path string, text string").withColumn("language", extract.language_of(F.col("path"), F.col("text")))


def test_symbols_and_their_parents(spark):
    own = files(spark)
    found = extract.symbols(own).collect()
    by_file = defaultdict(set)
    for r in found:
        by_file[r.file_path].add((r.kind, r.qualified_name))
    assert by_file["src/shapes.ts"] == {("import", "./base"), ("class", "Shape"), ("method", "Shape::area"), ("function", "measure"), ("function", "twice")}
    assert {("class", "Service"), ("method", "Service::run"), ("method", "Service::helper"), ("function", "main")} <= by_file["app.py"]
    assert {("struct", "Point"), ("trait", "Show"), ("function", "draw")} <= by_file["lib.rs"]
    assert {("struct", "Server"), ("method", "Serve"), ("function", "helper"), ("import", "fmt")} <= by_file["main.go"]
    assert {("class", "A"), ("method", "A::size")} <= by_file["A.java"]
    assert {("module", "M"), ("class", "M::K"), ("method", "M::K::go")} <= by_file["x.rb"]
    edges = {(r.source, r.target) for r in extract.contains_edges(extract.symbols(own)).collect()}
    ids = {r.qualified_name + r.file_path: r.id for r in found}
    assert (ids["Shapesrc/shapes.ts"], ids["Shape::areasrc/shapes.ts"]) in edges and ("file:app.py", ids["Serviceapp.py"]) in edges
    assert all(r.is_exported for r in found if r.name in ("Shape", "measure", "Base")) and not any(r.is_exported for r in found if r.name == "twice")


def test_references_come_from_the_symbol_around_them(spark):
    own = files(spark)
    found = extract.symbols(own)
    name = {r.id: r.name for r in found.collect()}
    got = {(name.get(r.from_node_id, r.from_node_id), r.reference_kind, r.reference_name) for r in extract.references(own, found).collect()}
    expected = {
        ("area", "calls", "measure"), ("measure", "instantiates", "Ruler"), ("Shape", "extends", "Base"), ("Base", "implements", "Named"), ("hello", "calls", "twice"), ("file:src/shapes.ts", "imports", "./base"),
        ("run", "calls", "open_file"), ("run", "calls", "helper"), ("Service", "extends", "Base"), ("show", "calls", "draw"), ("Serve", "calls", "fmt.Println"), ("A", "extends", "B"), ("go", "calls", "run"), ("Base", "decorates", "log"),
    }
    assert expected <= got, expected - got
    assert not any(n == "not" for _, _, n in got)


TEMPLATES = {
    "ui/Card.svelte": "<script>\n  import Icon from './Icon.svelte';\n  export let title;\n  const open = $state(false);\n  function toggle() {\n    notify(title);\n  }\n</script>\n<Icon name=\"x\" />\n<p>{format(title)}</p>\n",
    "ui/Page.vue": "<template>\n  <UserCard :user=\"u\" />\n</template>\n<script>\nfunction load() {}\n</script>\n",
    "Main.dfm": "object Form1: TForm1\n  Caption = 'x'\n  object Button1: TButton\n    OnClick = Button1Click\n  end\nend\n",
    "sections/hero.liquid": "{% render 'price' %}\n{% assign total = 1 %}\n{% schema %}\n{}\n{% endschema %}\n",
    "typed.ts": "// Reads a shape,\n// whole.\n@log\nexport class Reader {\n  /** One only. */\n  one(\n    s: Shape,\n  ): Promise<Box> {\n    return s;\n  }\n\n  two() {\n    return 2;\n  }\n}\n// lone\n\nexport function after(x: string): Shape {\n  return x;\n}\n",
    "T.java": "class T {\n  public Report make(Order order, int n) {\n    return null;\n  }\n}\n",
    "tabs.py": "class Outer:\n\tclass Inner:\n\t\t# says\n\t\tdef go(self) -> Thing:\n\t\t\treturn 1\n\n\tdef last(self):\n\t\tpass\n",
}


def test_templates_forms_types_ends_and_docstrings(spark):
    own = files(spark, TEMPLATES)
    found = extract.symbols(own)
    rows = found.collect()
    got = {(r.file_path, r.kind, r.qualified_name): (r.start_line, r.end_line) for r in rows}
    assert got["ui/Card.svelte", "property", "title"] == (3, 3) and got["ui/Card.svelte", "function", "toggle"] == (5, 7) and ("ui/Page.vue", "function", "load") in got
    assert got["Main.dfm", "component", "Form1"] == (1, 6) and got["Main.dfm", "component", "Form1::Button1"] == (3, 5)
    assert {("sections/hero.liquid", "import", "price"), ("sections/hero.liquid", "variable", "total"), ("sections/hero.liquid", "constant", "schema")} <= set(got)
    assert got["typed.ts", "class", "Reader"] == (4, 15) and got["typed.ts", "method", "Reader::two"] == (12, 14) and got["typed.ts", "function", "after"] == (18, 20)
    assert got["tabs.py", "class", "Outer"] == (1, 8) and got["tabs.py", "method", "Outer::Inner::go"] == (4, 5) and got["tabs.py", "method", "Outer::last"] == (7, 8)
    docs = {r.qualified_name: r.docstring for r in rows}
    assert docs["Reader"] == "Reads a shape,\nwhole." and docs["Outer::Inner::go"] == "says" and docs["after"] is None and docs["Reader::two"] is None
    name = {r.id: r.name for r in rows}
    refs = {(name.get(r.from_node_id, r.from_node_id), r.reference_kind, r.reference_name) for r in extract.references(own, found).collect()}
    expected = {("after", "references", "Shape"), ("make", "references", "Order"), ("go", "references", "Thing"), ("Button1", "references", "Button1Click"), ("toggle", "references", "Icon"), ("file:ui/Page.vue", "references", "UserCard"), ("toggle", "calls", "format"), ("file:sections/hero.liquid", "references", "price")}
    assert expected <= refs, expected - refs
    assert not any(n in ("Promise", "$state") for _, _, n in refs)


def test_routes(spark):
    got = {(r.framework, r.method, r.url) for r in extract.routes(files(spark)).collect()}
    assert {("express", "GET", "/users"), ("express", "POST", "/login"), ("flask", "ROUTE", "/home"), ("django", "PATH", "a/<int:id>/")} <= got


def test_tree_scan(spark, tmp_path):
    for path, text in {"src/a.py": "x = 1\n", "src/b.h": "class A {};\n", "node_modules/m.js": "x", "skip/symweave.ignore": "all", "skip/c.py": "y", "big.py": "z" * 3000}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found, errors = trees.read_tree(spark, str(tmp_path), most_bytes=2000)
    assert {(r.path, r.language) for r in found.collect()} == {("src/a.py", "python"), ("src/b.h", "cpp")}
    assert [tuple(r) for r in errors.collect()] == [("big.py", "size_exceeded")]


def test_stems_and_words(spark):
    df = spark.createDataFrame([(t,) for t in ("caching", "running", "eviction", "management", "entries", "classes", "errors", "class", "handled", "carried", "builder", "getter", "agreed")], "t string")
    got = {r.t: set(r.s) for r in df.select("t", X.stems(F.col("t")).alias("s")).collect()}
    assert got["caching"] == {"cach", "cache"} and got["running"] == {"runn", "runne", "run"} and got["eviction"] == {"evict"} and got["management"] == {"manage"}
    assert got["entries"] == {"entry"} and got["classes"] == {"class"} and got["errors"] == {"error"} and got["class"] == set() and got["handled"] == {"handle", "handl"}
    assert got["carried"] == {"carrie", "carri", "carry"} and got["builder"] == {"build", "builde"} and got["getter"] == {"gett", "gette", "get"} and got["agreed"] == set()
    row = spark.createDataFrame([("how does the getUserName call parse_config.file", "a/b/c/d.ts", "a/b/x/e.ts")], "q string, p string, o string").select(X.words_of(F.col("q")), X.proximity(F.col("p"), F.col("o")), X.proximity(F.col("p"), F.col("p")), X.proximity(F.lit("z/x.ts"), F.col("p"))).first()
    assert row[0] == ["get", "user", "name", "call", "parse", "config"] and tuple(row)[1:] == (30, 45, 0)


def test_fielded_queries(spark):
    df = spark.createDataFrame([(1, 'kind:function auth path:"my dir" lang:Python name:x foo:bar')], "query_id int, query string")
    r = search.fields(df).first()
    assert (r.kinds, r.languages, r.paths, r.names, r.text) == (["function"], ["python"], ["my dir"], ["x"], "auth foo:bar")


def test_code_blocks_budget_and_rendering(spark):
    nodes = spark.createDataFrame([("n", "f", "function", "a.ts", 2, 3), ("m", "g", "function", "a.ts", 1, 1)], "id string, name string, kind string, file_path string, start_line int, end_line int")
    text = spark.createDataFrame([("a.ts", "one\ntwo\nthree\nfour")], "path string, text string")
    assert {r.id: r.code for r in context.code_blocks(nodes, text).collect()} == {"n": "two\nthree", "m": "one"}
    blocks = spark.createDataFrame([("q", "a", 3.0, 90), ("q", "b", 2.0, 20), ("q", "c", 1.0, 5), ("r", "d", 1.0, 500)], "query_id string, id string, score double, chars int")
    assert {r.id for r in context.packed(blocks, ["query_id"], 100).collect()} == {"a", "c", "d"}  # b does not fit, c still does
    assert context.markdown(nodes).first().text == "## Symbols in a.ts\n- `g` (function, line 1)\n- `f` (function, line 2)"
    hits = spark.createDataFrame([("q", "a", "src/x.ts", 1.0), ("q", "b", "tests/y.ts", 1.0)], "query_id string, id string, file_path string, score double")
    assert {r.id: r.score for r in context.damp_tests(hits).collect()} == {"a": 1.0, "b": 0.3}


def test_a_stream_in_batches_equals_one_batch(spark, tmp_path):
    history = [[("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "1", 2)], [("b", None, 3), ("c", "0", 1), ("d", "1", 3)]]
    for k, rows in enumerate(history):
        spark.createDataFrame(rows, "path string, content_hash string, modified_at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("path string, content_hash string, modified_at int").parquet(str(tmp_path / "in"))
        sync.follow(stream, sync.merge_files, ("path",), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    state = {r.path: r.content_hash for r in snapshots.read_snapshot(spark, str(tmp_path / "state"), "state").collect()}
    assert state == {"a": "2", "c": "0", "d": "1"}
    assert snapshots.current_version(spark, str(tmp_path / "state")) == 3 and snapshots.current_version(spark, str(tmp_path / "none")) == 0


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, content_hash string")
    assert {tuple(r) for r in changes.detect(old, new).collect()} == {("a", "removed"), ("b", "modified"), ("d", "added")}
    refs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "ref_id int, reference_name string")
    edges = spark.createDataFrame([(1, "t1"), (2, "t2")], "ref_id int, target string")
    got = changes.refs_to_resolve(refs, edges, spark.createDataFrame([("z",)], "name string"), spark.createDataFrame([("t1",)], "id string"))
    assert {r.ref_id for r in got.collect()} == {1, 3}


BARREL = {
    "src/app.ts": "import Main, { Shown as Local, helper } from './index';\nimport * as ns from '@lib/tools';\nexport function run() {\n  Local();\n  ns.saw();\n  helper();\n}\n",
    "src/index.ts": "export { Middle as Shown } from './mid';\nexport * from './star';\n",
    "src/mid.ts": "export { Hidden as Middle } from './deep/in';\n",
    "src/deep/in.ts": "export function Hidden() {}\n",
    "src/star.ts": "export function helper() {}\n",
    "lib/tools/index.ts": "export function saw() {}\n",
    "pkg/__init__.py": "",
    "pkg/util.py": "def clean(x):\n    pass\n",
    "main.py": "from pkg.util import clean as tidy\ndef go():\n    tidy(1)\n",
}


def test_references_are_followed_through_imports(spark):
    own = files(spark, BARREL)
    got = {(r.path, r.local, r.imported, r.specifier) for r in imports.mappings(own).collect()}
    assert got == {("src/app.ts", "Main", "default", "./index"), ("src/app.ts", "Local", "Shown", "./index"), ("src/app.ts", "helper", "helper", "./index"), ("src/app.ts", "ns", "*", "@lib/tools"), ("main.py", "tidy", "clean", "pkg.util")}
    found = extract.symbols(own)
    names = {r.id: f"{r.file_path}:{r.name}" for r in found.collect()}
    refs = extract.references(own, found).withColumn("ref_id", F.concat_ws(":", "file_path", "reference_name"))
    aliases = spark.createDataFrame([("@lib/", "lib/"), ("@", "other/")], "prefix string, target string")
    resolved = {r.ref_id: names[r.target] for r in imports.by_import(refs, own, found, aliases).collect()}
    assert resolved == {"src/app.ts:Local": "src/deep/in.ts:Hidden", "src/app.ts:ns.saw": "lib/tools/index.ts:saw", "src/app.ts:helper": "src/star.ts:helper", "main.py:tidy": "pkg/util.py:clean"}


def test_terms_inside_names_and_at_their_start_are_found(spark):
    nodes = spark.createDataFrame(
        [("1", "class", "blueRing"), ("2", "class", "Ring"), ("3", "class", "string"), ("4", "class", "HTTPRing"), ("5", "function", "redRing"), ("6", "class", "RingBlueRing")], "id string, kind string, name string"
    ).selectExpr("*", "name AS qualified_name", "'src/a.ts' AS file_path", "'typescript' AS language", "1 AS start_line", "true AS is_exported")
    terms = spark.createDataFrame([("q", "how does the ring work", "ring"), ("q", "how does the ring work", "blue")], "query_id string, query string, term string")
    assert {r.id for r in context.inside_names(nodes, terms, 10).collect()} == {"1", "4", "6"}  # 6 by blue
    assert {r.id for r in context.definitions(nodes, terms, 10).collect()} == {"2", "6", "1"}


def test_fields_of_queries_keep_unknown_kinds_as_text(spark):
    queries = spark.createDataFrame([(1, 'kind:class kind:clazz lang:TypeScript path:"a b" name:x find me'), (2, "language:klingon http://x")], "query_id int, query string")
    got = {r.query_id: r for r in search.fields(queries).collect()}
    assert (got[1].kinds, got[1].languages, got[1].paths, got[1].names, got[1].text) == (["class"], ["typescript"], ["a b"], ["x"], "kind:clazz find me")
    assert got[2].text == "language:klingon http://x" and not got[2].languages
