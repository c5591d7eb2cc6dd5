"""What frameworks say about names: marks, conventions with a project's own, and members of a workspace."""

from pyspark.sql import functions as F
from symweave.operators import conventions as C
from symweave.operators.resolve import resolve

NODES = [
    ("s1", "class", "UserService", "UserService", "src/user/user.service.ts", "typescript", 1), ("s2", "class", "UserService", "UserService", "a/copy.ts", "typescript", 1),
    ("s3", "class", "LogService", "LogService", "src/b.ts", "typescript", 1), ("s4", "function", "MailService", "MailService", "src/mail.service.ts", "typescript", 1),
    ("c1", "class", "PageController", "PageController", "app/Http/Controllers/PageController.php", "php", 1), ("c2", "method", "show", "PageController::show", "app/Http/Controllers/PageController.php", "php", 2),
    ("c3", "method", "show", "OtherController::show", "app/Http/Controllers/Admin/OtherController.php", "php", 2), ("m1", "class", "Post", "Post", "app/Models/Post.php", "php", 1), ("m2", "method", "find", "Post::find", "app/Models/Post.php", "php", 4),
    ("p1", "function", "plugin_a", "plugin_a", "plugins/a.py", "python", 1), ("k1", "file", "lib.rs", "crates/tool-core/src/lib.rs", "crates/tool-core/src/lib.rs", "rust", 1), ("k2", "module", "inner", "inner", "crates/tool-core/src/lib.rs", "rust", 3),
    ("k3", "file", "util.rs", "src/util.rs", "src/util.rs", "rust", 1), ("k4", "import", "tool_core", "tool_core", "src/main.rs", "rust", 1),
]
REFS = [
    ("r1", "UserService", "typescript"), ("r2", "LogService", "typescript"), ("r3", "MailService", "typescript"), ("r4", "PageController@show", "php"), ("r5", "Post::find", "php"), ("r6", "Post::all", "php"),
    ("r7", "plugin_a", "python"), ("r8", "tool_core", "rust"), ("r9", "util", "rust"), ("r10", "UserService", "ruby"), ("r11", None, "php"), ("r12", "gone_crate", "rust"),
]
FILES = [
    ("package.json", '{"dependencies": {"@nestjs/core": "1"}}'), ("artisan", None), ("Cargo.toml", "[workspace] # root\nresolver = '2'\n# members = ['none']\nmembers = [\n  'crates/*', # all\n  \"tools/x/\",\n]\n[package]\nname = 'root'\n"),
    ("crates/tool-core/Cargo.toml", "[package]\nname = \"tool-core\"\n"), ("tools/x/Cargo.toml", "[package]\nversion = '1'\nname='xx'\n"), ("crates/deep/er/Cargo.toml", "[package]\nname = 'deeper'\n"),
    ("crates/.hid/Cargo.toml", "[package]\nname = 'hid'\n"), ("crates/nameless/Cargo.toml", "[dependencies]\nname = 'no'\n"), ("src/a.ts", ""), ("src/n.ts", None),
]
NODE, REF = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int", "ref_id string, reference_name string, language string"


def test_marks_and_members_of_a_workspace(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    assert {r.framework for r in C.detected(files, [C.Mark("own", r"^src/", "")]).collect()} == {"nest", "laravel", "rust", "own"}
    assert {(r.crate, r.folder) for r in C.crates(files).collect()} == {("tool-core", "crates/tool-core"), ("tool_core", "crates/tool-core"), ("xx", "tools/x")}
    assert C.detected(files.limit(0)).count() == 0 and C.crates(files.limit(0)).count() == 0


def test_names_by_the_habits_of_frameworks(spark):
    files, nodes, refs = spark.createDataFrame(FILES, "path string, text string"), spark.createDataFrame(NODES, NODE), spark.createDataFrame(REFS, REF)
    own = [C.Convention("own", ("python",), r"^plugin_", ("function",), r"^plugins/", 0.95)]
    got = {r.ref_id: (r.target, r.confidence) for r in C.by_framework(refs, nodes, files, [C.Mark("own", r"^artisan$")], own).collect()}
    assert got == {"r1": ("s1", 0.85), "r2": ("s3", 0.7), "r4": ("c2", 0.9), "r5": ("m2", 0.85), "r6": ("m1", 0.85), "r7": ("p1", 0.95), "r8": ("k2", 0.95), "r9": ("k3", 0.6)}
    without = C.by_framework(refs, nodes, files.filter("path NOT IN ('Cargo.toml', 'artisan')"), (), own)
    assert {r.ref_id for r in without.collect()} == {"r1", "r2"}
    assert C.by_framework(refs, nodes, files, (), [C.Convention("nest", ("ruby",), r"Service$", ("class",), r"copy", 0.9)]).filter("ref_id IN ('r1', 'r10')").collect()[0].target == "s2"  # in the place of all of that framework's


def test_sure_answers_end_the_cascade_others_compete(spark):
    files, nodes = spark.createDataFrame(FILES, "path string, text string"), spark.createDataFrame(NODES, NODE).withColumn("is_exported", F.lit(True))
    refs = spark.createDataFrame([(*r, "calls", "src/main.rs", 1) for r in REFS], REF + ", reference_kind string, file_path string, line int")
    got = {r.ref_id: (r.target, r.resolved_by, r.confidence) for r in resolve(refs, nodes, framework=lambda r: C.by_framework(r, nodes, files)).collect()}
    plain = {r.ref_id: (r.target, r.resolved_by, r.confidence) for r in resolve(refs, nodes).collect()}
    assert got["r8"] == ("k2", "framework", 0.95) and plain["r8"][0] == "k4" and got["r4"] == ("c2", "framework", 0.9)
    weak = {"r1": ("s1", 0.85), "r2": ("s3", 0.7), "r5": ("m2", 0.85), "r6": ("m1", 0.85), "r9": ("k3", 0.6)}
    for ref, (target, sure) in weak.items():
        other = plain.get(ref)
        assert got[ref] == (other if other and other[2] > sure else (target, "framework", sure))
    assert got["r7"] == plain["r7"] and "r11" not in got
