"""Ignore rules against a walk from folder to folder."""

import re

from pyspark.sql import functions as F

from symweave.sources import trees

RULES = {
    "": "# all\n*.log\n!keep.log\n/out\nbuild/\ndocs/**/*.tmp\n**/deep/x.*\n[ab]?.txt\n\\!odd\n",
    "pkg": "*.py\n!main.py\n/local/\n!*.log\n",
    "pkg/sub": "main.py\n",
    "repo": "*.md\n",
}
PATHS = (
    "a.log keep.log out/x.py src/out/y.py build/z.js src/build/z.js build.js docs/a.tmp docs/u/v/b.tmp src/docs/c.tmp m/n/deep/x.c deep/x.h deep/y.h a1.txt b22.txt c1.txt !odd "
    "pkg/one.py pkg/main.py pkg/local/q.c pkg/in/local/q.c pkg/b.log pkg/sub/main.py pkg/sub/keep.py repo/a.log repo/r.md repo/in/r.txt build/keep.log out/keep.log plain"
).split()


def plain_regex(pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.*", i + 3
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]", "[": "[", "]": "]"}.get(c, re.escape(c)), i + 1
    return out


def ignored(path, repositories):
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        entry, verdict = "/".join(parts[:k]), False
        around = ["/".join(parts[:d]) for d in range(k)]
        inside = [d for d, f in enumerate(around) if f in repositories]
        for folder in around[inside[-1] if inside else 0 :]:
            for line in RULES.get(folder, "").split("\n"):
                if not line or line.startswith("#"):
                    continue
                negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
                if line.endswith("/") and k == len(parts):
                    continue
                line = line.rstrip("/")
                regex = plain_regex(line.lstrip("/"))
                if re.fullmatch(regex if "/" in line else f"(?:.*/)?{regex}", entry[len(folder) + bool(folder) :]):
                    verdict = not negated
        if verdict:
            return True
    return False


def test_rules_equal_a_walk(spark):
    rules = spark.createDataFrame(list(RULES.items()), "folder string, text string")
    paths = spark.createDataFrame([(p, 1) for p in PATHS], "path string, size int")
    for repositories in ([], ["repo"]):
        given = spark.createDataFrame([(r,) for r in repositories], "folder string")
        got = trees.not_ignored(paths, rules, given)
        assert {r.path for r in got.collect()} == {p for p in PATHS if not ignored(p, repositories)}
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_rules_are_read_with_the_tree(spark, tmp_path):
    for path, text in {"symweave.rules": "*.log\n/gen/\n", "a.log": "x", "gen/a.py": "x", "src/b.py": "y = 1\n", "src/skip/symweave.ignore": "all", "src/skip/c.py": "z", "own/symweave.repository": "yes", "own/kept.log": "k"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found, errors = trees.read_tree(spark, str(tmp_path))
    assert {r.path for r in found.select(F.col("path")).collect()} == {"src/b.py", "own/kept.log"} and errors.isEmpty()
