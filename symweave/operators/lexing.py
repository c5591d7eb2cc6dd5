"""Source text as statements: a state machine over a whole file tells comments, strings and code apart.

Spec says how a language writes comments and strings. `spans` walks over a text from one mark to the next; `masked` blanks comments, and strings that go over
several lines, without moving anything, so that every position stays. `statements` joins what stands between round brackets, lists of imported names, heads of
declarations that go on in the next line, and lines that end in a backslash, and keeps the first and the last line.

Files are independent rows: each is scanned where it stands, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

STATEMENTS = "path string, language string, line int, end_line int, indent int, text string, bare string, is_comment boolean"


class Spec(NamedTuple):
    line: tuple[str, ...] = ()  # what begins a comment up to the line's end
    block: tuple[tuple[str, str], ...] = ()  # what begins and ends a comment
    nested: bool = False  # comments hold comments
    quotes: str = "\"'"  # strings on one line, with escapes
    long: tuple[tuple[str, str], ...] = ()  # strings over several lines
    escapes: bool = True  # a backslash takes the next character, in strings on one line and in long ones that are not raw
    template: bool = False  # `...${code}...`
    regexes: bool = False  # /.../ where a value may stand
    doubled: bool = False  # a quote within a string is written twice
    braces: bool = True  # blocks stand in braces
    prose: bool = False  # an apostrophe within a word is none of a string


C_LIKE = Spec(("//",), (("/*", "*/"),))
SCRIPT = C_LIKE._replace(template=True, regexes=True)
MARKUP = SCRIPT._replace(block=(("/*", "*/"), ("<!--", "-->")), regexes=False, prose=True)
SPECS = {
    **dict.fromkeys(("typescript", "javascript", "tsx", "jsx"), SCRIPT), **dict.fromkeys(("svelte", "vue"), MARKUP), **dict.fromkeys(("c", "cpp"), C_LIKE),
    "java": C_LIKE._replace(long=(('"""', '"""'),)), "csharp": C_LIKE._replace(long=(('"""', '"""'), ('@"', '"'))), "go": C_LIKE._replace(long=(("`", "`"),)),
    **dict.fromkeys(("kotlin", "scala", "swift"), C_LIKE._replace(nested=True, long=(('"""', '"""'),))), "rust": C_LIKE._replace(nested=True, quotes='"', long=(('r#"', '"#'),)),
    "dart": C_LIKE._replace(nested=True, long=(('"""', '"""'), ("'''", "'''"))), "php": C_LIKE._replace(line=("//", "#")),
    "python": Spec(("#",), long=(('"""', '"""'), ("'''", "'''")), braces=False), "ruby": Spec(("#",), (("\n=begin", "\n=end"),), braces=False),
    **dict.fromkeys(("lua", "luau"), Spec(("--",), (("--[[", "]]"),), long=(("[[", "]]"),), braces=False)),
    "pascal": Spec(("//",), (("{", "}"), ("(*", "*)")), quotes="'", escapes=False, doubled=True, braces=False),
    "liquid": Spec((), (("{% comment %}", "{% endcomment %}"), ("{%- comment -%}", "{%- endcomment -%}"), ("<!--", "-->")), quotes="", braces=False),
    "json": SCRIPT._replace(template=False, regexes=False, quotes='"'),
}
#: A slash behind one of these begins a regular expression.
VALUE_NEXT = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete))\s*\Z")
REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
CHARACTER = re.compile(r"'(?:\\(?:u\{[0-9a-fA-F]+\}|x..|.)|[^'\\\n])'")


@cache
def _marks(spec: Spec) -> re.Pattern:
    """What a scanner stops at in code, longest first."""
    marks = {*spec.line, *(b for b, _ in spec.block), *(b for b, _ in spec.long), *spec.quotes}
    if spec.template:
        marks |= {"`", "{", "}"}
    if spec.regexes:
        marks.add("/")
    if "'" not in spec.quotes and spec.nested:
        marks.add("'")
    return re.compile("|".join(re.escape(m) for m in sorted(marks, key=lambda m: (-len(m), m))))


def _line_string(text: str, at: int, spec: Spec) -> int:
    """The end of a string on one line that begins at at; it ends with its line if nothing else ends it."""
    quote, k = text[at], at + 1
    stops = re.compile(rf"\\|\n|{re.escape(quote)}" if spec.escapes else rf"\n|{re.escape(quote)}")
    while found := stops.search(text, k):
        if found[0] == "\\":
            k = found.end() + 1
        elif found[0] == "\n":
            return found.start()
        elif spec.doubled and text.startswith(quote, found.end()):
            k = found.end() + 1
        else:
            return found.end()
    return len(text)


def spans(text: str, spec: Spec) -> Iterator[tuple[int, int, str]]:
    """(start, end, `comment` or `string`) of what is not code, in order."""
    at, templates, depth = 0, [], 0  # templates: depths of braces at which the code in a template ends
    marks = _marks(spec)
    begins, longs = dict(spec.block), dict(spec.long)
    if text.startswith("=begin") and "\n=begin" in begins:
        at = text.find("\n=end")
        at = len(text) if at < 0 else min([n for n in [text.find("\n", at + 1)] if n >= 0], default=len(text))
        yield 0, at, "comment"

    def template(k: int) -> int:
        nonlocal at, depth
        found = re.compile(r"\\.|`|\$\{", re.S).search(text, k)
        while found and found[0][0] == "\\":
            found = re.compile(r"\\.|`|\$\{", re.S).search(text, found.end())
        if found and found[0] == "${":
            templates.append(depth)
            depth += 1
        return found.end() if found else len(text)

    while found := marks.search(text, at):
        mark, start = found[0], found.start()
        at = found.end()
        if mark == "{" and mark not in begins:
            depth += 1
        elif mark == "}":
            depth -= 1
            if templates and templates[-1] == depth:
                templates.pop()
                at = template(at)
                yield start, at, "string"
        elif mark in begins:
            level, ends = 1, re.compile("|".join(re.escape(m) for m in ((mark, begins[mark]) if spec.nested else (begins[mark],))))
            while level:
                end = ends.search(text, at)
                at = end.end() if end else len(text)
                level += 0 if not end else 1 if end[0] == mark and spec.nested else -1
                level = level if end else 0
            if mark == "\n=begin":
                line_end = text.find("\n", at)
                start, at = start + 1, len(text) if line_end < 0 else line_end
            yield start, at, "comment"
        elif mark in spec.line:
            if mark == "#" and spec.braces and text.startswith("[", at):
                continue
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
            yield start, at, "comment"
        elif mark in longs:
            raw = mark in ("`", "[[", '@"', 'r#"') or not spec.escapes
            end = re.compile(re.escape(longs[mark]) if raw else rf"(?:\\.|(?!{re.escape(longs[mark])})[^\\])*?{re.escape(longs[mark])}", re.S)
            end = end.search(text, at) if raw else end.match(text, at)
            at = end.end() if end else len(text)
            yield start, at, "string"
        elif mark == "`":
            at = template(at)
            yield start, at, "string"
        elif mark == "/":
            regex = VALUE_NEXT.search(text, max(0, start - 12), start) and REGEX.match(text, start)
            if regex:
                at = regex.end()
                yield start, at, "string"
        elif mark == "'" and "'" not in spec.quotes:  # a character, or a lifetime
            character = CHARACTER.match(text, start)
            if character:
                at = character.end()
                yield start, at, "string"
        elif mark in spec.quotes:
            if spec.prose and start and text[start - 1].isalnum():
                continue
            at = _line_string(text, start, spec)
            yield start, at, "string"


def blanked(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def masked(text: str, language: str) -> tuple[str, str]:
    """The text with comments and strings over several lines blanked, and with all strings' content blanked, too; nothing moves."""
    spec = SPECS.get(language)
    if spec is None:
        return text, text
    code, bare, at = [], [], 0
    for start, end, kind in spans(text, spec):
        own = text[start:end]
        blank = blanked(own)
        code += [text[at:start], own if kind == "string" and "\n" not in own else blank]
        bare += [text[at:start], blank if kind == "comment" or len(own) < 2 else own[0] + blank[1:-1] + own[-1] if own[-1] != "\n" else blank]
        at = end
    return "".join([*code, text[at:]]), "".join([*bare, text[at:]])


OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Braces of such statements hold names, not statements.
LISTS = re.compile(r"^\s*(?:(?:pub(?:\([^)]*\))?\s+)?use\b|import\b|export\s*(?:type\s*)?\{)")
#: A script's import or export that has not said from where yet.
UNTOLD = re.compile(r"^\s*(?:import\b(?!\s*[(.])|export\s*(?:type\s*)?\*)[^'\"`;=]*$")
#: Round brackets of such statements hold statements, one a line.
GROUPS = re.compile(r"^\s*(?:import|var|const|type)\s*\(\s*$")
HEAD = re.compile(r"^\s*(?:(?:export|default|declare|public|private|protected|internal|abstract|final|static|sealed|open|data|case|partial|pub(?:\([^)]*\))?|async|unsafe|template\s*<[^{;]*>)\s+)*(?:class|interface|trait|struct|enum|record|object|protocol|fn|func|fun|function|extension|impl|mixin)\b[^{;]*$")
GOES_ON = re.compile(r"^\s*(?:(?:extends|implements|permits|throws|where|with)\b|->|=>|:(?!:)|,)")
#: A statement that begins like this at the left margin ends whatever brackets an unbalanced text left open.
FRESH = re.compile(r"^(?:export|public|class|def|func|fn|function|import|package|struct|interface|impl|module|namespace)\b")


def statements(text: str, language: str) -> list[tuple[int, int, int, str, str, bool]]:
    """(line, last line, indent, text, bare, is_comment) of each statement and of each line that holds comments alone; lines count from 1."""
    text = text.replace("\r\n", "\n")
    code, bare = masked(text, language)
    spec = SPECS.get(language, C_LIKE)
    found: list[tuple[int, int, int, str, str, bool]] = []
    stack: list[str] = []
    held: list | None = None  # first line, indent, parts, bare parts
    own, own_bare = code.split("\n"), bare.split("\n")
    for n, (whole, line, shown) in enumerate(zip(text.split("\n"), own, own_bare, strict=True), 1):
        if not line.strip():
            comment = whole.strip()
            if comment and not shown.strip() and held is None and language in SPECS:
                found.append((n, n, len(whole) - len(whole.lstrip()), comment, "", True))
            continue
        if held and FRESH.match(line):
            found.append((held[0], held[4], held[1], " ".join(held[2]), " ".join(held[3]), False))
            held, stack = None, []
        if held is None:
            held = [n, len(line) - len(line.lstrip()), [line.rstrip()], [shown.rstrip()], n]
        else:
            held[2].append(line.strip())
            held[3].append(shown.strip())
            held[4] = n
        lists = LISTS.match(held[3][0])
        grouped = language == "go" and GROUPS.match(shown)
        for mark in re.findall(r"[()\[\]{}]", shown):
            if mark in OPENS:
                stack.append("(" if mark == "{" and lists else "{" if mark == "(" and grouped else mark)
            elif mark in CLOSES and stack:
                want = {"(": "([", "[": "([", "{": "{"}[CLOSES[mark]]
                if stack[-1] in want or (mark == "}" and lists) or (mark == ")" and stack[-1] == "{" and language == "go"):
                    stack.pop()
                elif CLOSES[mark] in stack:
                    while stack.pop() != CLOSES[mark]:
                        pass
        if stack and stack[-1] == "(":
            continue
        if shown.rstrip().endswith("\\") and language in ("python", "ruby", "c", "cpp"):
            held[2][-1], held[3][-1] = held[2][-1].rstrip("\\ "), held[3][-1].rstrip("\\ ")
            continue
        if (spec is SCRIPT or spec is MARKUP) and UNTOLD.match(" ".join(held[3])):
            continue
        if spec.braces:
            after = next((x for x in own_bare[n : n + 8] if x.strip()), "")
            if HEAD.match(" ".join(held[3])) and GOES_ON.match(after):
                continue
        found.append((held[0], held[4], held[1], " ".join(held[2]), " ".join(held[3]), False))
        held = None
    if held:
        found.append((held[0], held[4], held[1], " ".join(held[2]), " ".join(held[3]), False))
    return found


def scanned(files: DataFrame) -> DataFrame:
    """STATEMENTS of files (path, language, text). Null texts have none; languages without a Spec have no comments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "language", "line", "end_line", "indent", "text", "bare", "is_comment"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(path, language, *r) for r in statements(text or "", language)]
                for k in range(0, len(rows), 10000):
                    part = zip(*rows[k : k + 10000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(part, kinds, strict=True)], names)

    return files.select("path", "language", "text").mapInArrow(run, STATEMENTS)


def uncommented(files: DataFrame) -> DataFrame:
    """files (path, language, text) with comments, and strings over several lines, blanked; no character moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, language, text = batch.columns
            yield pa.RecordBatch.from_arrays([path, language, pa.array([t and masked(t, la)[0] for la, t in zip(language.to_pylist(), text.to_pylist(), strict=True)], pa.string())], ["path", "language", "text"])

    return files.select("path", "language", "text").mapInArrow(run, "path string, language string, text string")
