"""The scanner against a lexer that looks at one character after the other."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.operators import extract, imports, lexing

from .test_extract import files

PIECES = ["//", "/*", "*/", "/", '"', "'", '"""', "'''", "`", "\\", "\n", "#", "--", "--[[", "]]", "[[", "{", "}", "(*", "*)", "a", " ", "x1", "(", ")", ";", "${", "=begin", "=end", 'r#"', '"#', '@"']
PLAIN = {  # line comments, blocks, nesting, quotes, long strings (raw or not), escapes, doubled quotes
    "java": (["//"], [("/*", "*/")], False, "\"'", [('"""', '"""', False)], True, False), "go": (["//"], [("/*", "*/")], False, "\"'", [("`", "`", True)], True, False),
    "kotlin": (["//"], [("/*", "*/")], True, "\"'", [('"""', '"""', False)], True, False), "python": (["#"], [], False, "\"'", [('"""', '"""', False), ("'''", "'''", False)], True, False),
    "lua": (["--"], [("--[[", "]]")], False, "\"'", [("[[", "]]", True)], True, False), "pascal": (["//"], [("{", "}"), ("(*", "*)")], False, "'", [], False, True),
    "c": (["//"], [("/*", "*/")], False, "\"'", [], True, False), "csharp": (["//"], [("/*", "*/")], False, "\"'", [('"""', '"""', False), ('@"', '"', True)], True, False),
    "dart": (["//"], [("/*", "*/")], True, "\"'", [('"""', '"""', False), ("'''", "'''", False)], True, False),
}


def char_by_char(text, language):
    """A letter for each character: c comment, s string, space code."""
    line, block, nested, quotes, long, escapes, doubled = PLAIN[language]
    kinds, i, state, level = [], 0, None, 0
    opening = sorted([(m, "line", None) for m in line] + [(b, "block", e) for b, e in block] + [(b, "raw" if raw else "long", e) for b, e, raw in long] + [(q, "quote", q) for q in quotes], key=lambda o: -len(o[0]))
    while i < len(text):
        if state is None:
            o = next((o for o in opening if text.startswith(o[0], i)), None)
            if o is None:
                kinds.append(" ")
                i += 1
                continue
            state, level = o, 1
            kinds += ["c" if o[1] in ("line", "block") else "s"] * len(o[0])
            i += len(o[0])
            continue
        begin, kind, end = state
        letter = "c" if kind in ("line", "block") else "s"
        if kind == "line":
            if text[i] == "\n":
                state = None
                continue
        elif kind == "quote" and text[i] == "\n":
            state = None
            continue
        elif kind == "quote" and doubled and text.startswith(end * 2, i):
            kinds += letter * 2
            i += 2
            continue
        elif kind in ("quote", "long") and escapes and text[i] == "\\":
            kinds += letter * len(text[i : i + 2])
            i += 2
            continue
        elif kind == "block" and nested and text.startswith(begin, i):
            level += 1
            kinds += letter * len(begin)
            i += len(begin)
            continue
        elif text.startswith(end, i):
            level -= 1
            kinds += letter * len(end)
            i += len(end)
            if not level:
                state = None
            continue
        kinds.append(letter)
        i += 1
    return "".join(kinds)


@pytest.mark.parametrize("language", sorted(PLAIN))
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_positions_equal_a_plain_lexer(language, pieces):
    text = "".join(pieces)
    kinds = [" "] * len(text)
    for start, end, kind in lexing.spans(text, lexing.SPECS[language]):
        kinds[start:end] = kind[0] * (end - start)
    assert "".join(kinds) == char_by_char(text, language), text
    code, bare = lexing.masked(text, language)
    assert len(code) == len(bare) == len(text) and [k for k, c in enumerate(code) if c == "\n"] == [k for k, c in enumerate(text) if c == "\n"]


def test_scripts_rust_and_ruby():
    def comments(text, language):
        return [text[a:b] for a, b, kind in lexing.spans(text, lexing.SPECS[language]) if kind == "comment"]

    assert comments("a = `x ${f({b: '// no'})} // no` // yes", "typescript") == ["// yes"]
    assert comments("a = b / c; // yes\nd = /[/*]'/g.test(e) // too\nreturn /\\/\\//", "javascript") == ["// yes", "// too"]
    assert comments("fn f<'a>(x: &'a str) { '\"' } /* a /* b */ c */ // 'd", "rust") == ["/* a /* b */ c */", "// 'd"]
    assert comments("=begin\nclass Ghost\n=end\nx = '#' # yes\n=begin\n=end of it\ny", "ruby") == ["=begin\nclass Ghost\n=end", "# yes", "=begin\n=end of it"]
    assert comments("#[Attr]\nclass A {} # yes", "php") == ["# yes"]
    assert comments("<p>don't</p> <!-- class Ghost -->\n// yes", "vue") == ["<!-- class Ghost -->", "// yes"]


GHOSTS = {
    "g.ts": 'import {\n  alpha,\n  beta as b, // the second\n} from "./x";\n/*\nclass Ghost {\n*/\nexport function wide(\n  first: Alpha,\n  second: number,\n): Beta {\n  return alpha(first);\n}\nexport class Long\n  extends Base\n  implements Named {\n  text = `\nclass Spook {\n`;\n}\nexport {\n  wide as broad,\n} from "./y";\nlet s = "lost(1)"; found(s);\n',
    "g.py": 'from pkg.mod import (\n    one,\n    two as deux,\n)\n"""\ndef ghost():\n    pass\n"""\ndef spread(\n    a,\n    b,\n):\n    return one(a)\n\nfrom .near import three\nimport os.path as p, sys\n',
    "G.java": "import java.util.List;\nimport static a.b.Tool.cut;\n/* class Ghost {} */\npublic class G\n    extends Base {\n  public int run(\n      int a,\n      int b) {\n    return cut(a);\n  }\n}\n",
    "g.go": "package g\nimport (\n\t\"fmt\"\n\tio \"example.org/io\"\n)\n// func Ghost() {}\nfunc Wide(\n\ta int,\n) int {\n\treturn fmt.Print(a)\n}\n",
    "g.rs": "use std::{\n    fmt,\n    io::Read as R,\n};\nuse crate::shape::Point;\npub fn wide(\n    p: Point,\n) -> i32 {\n    draw(p)\n}\n",
}


def test_comments_give_no_symbols_and_declarations_may_span_lines(spark):
    rows = extract.symbols(files(spark, GHOSTS)).collect()
    got = {(r.file_path, r.kind, r.name): (r.start_line, r.end_line) for r in rows}
    assert not any(n in ("Ghost", "Spook", "ghost") for _, _, n in got)
    assert got["g.ts", "function", "wide"] == (8, 13) and got["g.ts", "class", "Long"] == (14, 20) and got["g.ts", "import", "./x"] == (1, 4) and ("g.ts", "import", "./y") in got
    assert got["g.py", "function", "spread"] == (9, 13) and got["G.java", "class", "G"] == (4, 11) and got["G.java", "method", "run"] == (6, 10)
    assert got["g.go", "function", "Wide"] == (7, 11) and ("g.go", "import", "fmt") in got and got["g.rs", "function", "wide"] == (6, 10)
    found = extract.symbols(files(spark, GHOSTS))
    refs = {(r.file_path, r.reference_kind, r.reference_name) for r in extract.references(files(spark, GHOSTS), found).collect()}
    assert {("g.ts", "extends", "Base"), ("g.ts", "implements", "Named"), ("g.ts", "calls", "found"), ("G.java", "extends", "Base"), ("g.rs", "calls", "draw")} <= refs
    assert not any(n == "lost" for _, _, n in refs)


def test_imports_over_several_lines(spark):
    own = files(spark, GHOSTS)
    got = {(r.path, r.local, r.imported, r.specifier) for r in imports.mappings(own).collect()}
    expected = {
        ("g.ts", "alpha", "alpha", "./x"), ("g.ts", "b", "beta", "./x"), ("g.py", "one", "one", "pkg.mod"), ("g.py", "deux", "two", "pkg.mod"), ("g.py", "three", "three", ".near"), ("g.py", "p", "*", "os.path"), ("g.py", "sys", "*", "sys"),
        ("G.java", "List", "List", "java.util.List"), ("G.java", "cut", "cut", "a.b.Tool.cut"), ("g.go", "fmt", "*", "fmt"), ("g.go", "io", "*", "example.org/io"),
        ("g.rs", "fmt", "fmt", "std::fmt"), ("g.rs", "R", "Read", "std::io::Read"), ("g.rs", "Point", "Point", "crate::shape::Point"),
    }
    assert got == expected, (expected - got, got - expected)
    passed = {(r.path, r.name, r.specifier, r.original) for r in imports.reexports(own).collect()}
    assert passed == {("g.ts", "broad", "./y", "wide")}


ALIASED = {
    "app/tsconfig.json": '{\n  // where things are\n  "compilerOptions": {\n    "baseUrl": "./src", /* "paths": {} */\n    "paths": {\n      "@/*": ["gen/*", "*"],\n      "@/deep/*": ["./deep/in/*"],\n      "main": ["../entry"],\n      "~*.tpl": ["views/*"],\n    },\n  },\n}\n',
    "app/lib/jsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["own/*"]}}}',
    "app/src/a.ts": 'import { one } from "@/shape";\nimport {\n  two,\n} from "@/deep/two";\nimport main from "main";\nimport three from "~three.tpl";\nimport { four } from "plain/four";\nexport function go() {\n  one(); two(); four();\n}\n',
    "app/lib/b.ts": 'import { five } from "@/five";\nimport { one } from "plain/four";\n',
    "app/src/shape.ts": "export function one() {}\n", "app/src/deep/in/two.ts": "export function two() {}\n", "app/entry.ts": "export default 1;\n", "app/src/views/three.ts": "export const three = 3;\n",
    "app/src/plain/four/index.ts": "export function four() {}\n", "app/lib/own/five.ts": "export function five() {}\n", "x/c.ts": 'import { one } from "@/shape";\n',
}


def test_aliases_of_configurations(spark):
    own = files(spark, ALIASED)
    known = imports.aliases(own)
    asked = imports.mappings(own).select("path", "language", "specifier")
    got = {(r.path, r.specifier): r.target for r in imports.targets(asked, own, known).collect()}
    assert got == {
        ("app/src/a.ts", "@/shape"): "app/src/shape.ts", ("app/src/a.ts", "@/deep/two"): "app/src/deep/in/two.ts", ("app/src/a.ts", "main"): "app/entry.ts",
        ("app/src/a.ts", "~three.tpl"): "app/src/views/three.ts", ("app/src/a.ts", "plain/four"): "app/src/plain/four/index.ts", ("app/lib/b.ts", "@/five"): "app/lib/own/five.ts",
    }
    plan = imports.with_aliases(asked.select("path", "specifier").distinct(), known)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = extract.symbols(own)
    names = {r.id: r.qualified_name for r in found.collect()}
    refs = extract.references(own, found).filter("reference_kind = 'calls'").selectExpr("concat_ws(':', file_path, reference_name) AS ref_id", "*")
    assert {names[r.target] for r in imports.by_import(refs, own, found, known).collect()} == {"one", "two", "four"}
