"""Scalar expressions over names, paths and queries, all built from Spark's own functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about code.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could "
    "should may might can shall not no all each every how what where when who which why i me my we our you your he she they "
    "show give tell been done made used using work works found also into then than just more some such over only out its so up as if "
    "look need needs want happen happens affect affected break breaks failing implemented implement "
    "code file files function method class type fix bug called"
).split()
# What a node's kind adds to its rank.
KIND_BONUS = {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6, "trait": 9, "enum": 5, "component": 8, "route": 9, "module": 4,
    "property": 3, "field": 3, "variable": 2, "constant": 3, "import": 1, "export": 1, "parameter": 0, "namespace": 4, "file": 0, "protocol": 9, "enum_member": 3,
}
# Folders whose files are not production code, those of them that count as a path's first folder too, words that
# mark a test in a file's name, and how names in mixed case end.
TEST_DIRS = "tests test __tests__ spec specs testlib testing".split()
FIRST_TEST_DIRS = "test tests spec specs".split()
OTHER_DIRS = "integration sample samples example examples fixture fixtures benchmark benchmarks demo demos".split()
TEST_WORDS = "test tests spec specs".split()
TEST_ENDS = "Test Tests TestCase Tester Spec Specs".split()
TEST_DIR_ENDS = "Test Tests Spec".split()
# Endings of words, the least length of a word that has them, what may stand in their place, endings that rule them
# out, and whether a doubled letter before them is also halved.
ENDINGS = (
    ("ing", 6, ("", "e"), (), True), ("tion", 6, ("t",), (), False), ("sion", 6, ("s",), (), False), ("ment", 7, ("",), (), False), ("ies", 5, ("y",), (), False),
    ("es", 5, ("",), ("ies",), False), ("s", 5, ("",), ("ss", "es"), False), ("ed", 5, ("", "e"), ("eed",), False), ("ied", 6, ("y",), (), False), ("er", 5, ("", "e"), (), True),
)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """The folder of a path; `.` for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, F.lit("/[^/]*$"), F.lit(""))).otherwise(F.lit("."))


def last_segment(name: Column) -> Column:
    """What follows the last `::`, `.` or `/`."""
    return F.element_at(F.split(name, r"::|\.|/"), -1)


def split_camel(name: Column) -> Column:
    """fooBarHTTPServer -> foo Bar HTTP Server."""
    return F.regexp_replace(F.regexp_replace(name, F.lit("([a-z])([A-Z])"), F.lit("$1 $2")), F.lit("([A-Z]+)([A-Z][a-z])"), F.lit("$1 $2"))


def words_of(name: Column) -> Column:
    """The lower-cased parts of an identifier, of three letters at least and no stop words, each once."""
    parts = F.split(F.lower(F.regexp_replace(split_camel(name), F.lit("[_.]+"), F.lit(" "))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def stems(term: Column) -> Column:
    """Shorter forms of a lower-cased word by its ending; each of three letters at least and none the word itself."""

    def forms(ending: str, least: int, instead: tuple[str, ...], never: tuple[str, ...], halve: bool) -> Column:
        stem = F.substr(term, F.lit(1), F.length(term) - len(ending))
        own = [F.concat(stem, F.lit(x)) for x in instead]
        if halve:
            own.append(F.regexp_replace(stem, F.lit(r"(.)\1$"), F.lit("$1")))
        fits = reduce(lambda so_far, x: so_far & ~term.endswith(x), never, term.endswith(ending) & (F.length(term) >= least))
        return F.when(fits, F.array(*own)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.filter(F.concat(*(forms(*row) for row in ENDINGS)), lambda s: (F.length(s) >= 3) & (s != term)))


def is_test_file(path: Column) -> Column:
    """Whether a path looks like a test, sample or benchmark: by a word or ending of the file's name, or by one of its folders."""
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    low = F.transform(folders, F.lower)
    stem = F.regexp_replace(name, F.lit(r"\.[A-Za-z0-9]+$"), F.lit(""))
    leading, words = F.split(F.lower(name), "[_.]"), F.split(F.lower(stem), "[._-]")
    ends = lambda x, some: reduce(Column.__or__, (x.endswith(e) for e in some))
    among = lambda xs, some: F.arrays_overlap(xs, F.array(*map(F.lit, some)))
    by_name = [
        (F.size(leading) > 1) & (leading[0] == "test"), (stem != name) & (F.size(words) > 1) & F.element_at(words, -1).isin(*TEST_WORDS), (stem != name) & ends(stem, TEST_ENDS),
    ]
    by_folder = [
        among(F.slice(low, 2, F.greatest(F.size(low), F.lit(1))), TEST_DIRS), F.coalesce(F.get(low, F.lit(0)).isin(*FIRST_TEST_DIRS), F.lit(False)), among(low, OTHER_DIRS),
        F.exists(folders, lambda f: f.rlike("^[A-Za-z0-9]+$") & ends(f, TEST_DIR_ENDS)),
    ]
    return reduce(Column.__or__, by_name + by_folder)


def kind_bonus(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KIND_BONUS.items() for x in kv)), kind), F.lit(0))


def path_relevance(path: Column, terms: Column, query: Column) -> Column:
    """For each term 10 if the file name has it, and 5 if the folder or else 3 if the path has it; test files lose 15 unless asked for."""
    low, name, folder = F.lower(path), F.lower(base_name(path)), F.lower(dir_name(path))
    each = F.transform(terms, lambda t: F.when(F.contains(name, t), 10).otherwise(0) + F.when(F.contains(folder, t), 5).when(F.contains(low, t), 3).otherwise(0))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    asked = F.lower(query).rlike("test|spec")
    return F.when(F.size(terms) == 0, 0).otherwise(total - F.when(~asked & is_test_file(path), 15).otherwise(0))


def name_match_bonus(name: Column, query: Column) -> Column:
    """The points of the first test that a name passes: it is the query, one of its words, begins with it, has all its parts, or holds it."""
    low, whole = F.lower(name), F.lower(F.regexp_replace(query, F.lit(r"\s+"), F.lit("")))
    two_letters = lambda words: F.filter(words, lambda w: F.length(w) >= 2)
    words = two_letters(F.split(F.lower(query), r"\s+"))
    parts = two_letters(F.split(F.lower(F.regexp_replace(query, F.lit("([a-z])([A-Z])"), F.lit("$1 $2"))), r"[\s_.\-]+"))
    share = F.length(whole) / F.length(low)
    tests = {
        "the query": (low == whole, F.lit(80)),
        "a word of it": (F.array_contains(words, low) & (F.size(words) > 1), F.lit(60)),
        "begins with it": (F.startswith(low, whole), F.floor(10.5 + 30 * share).cast("int")),
        "has all parts": (F.forall(parts, lambda p: F.contains(low, p)) & (F.size(parts) > 1), F.lit(15)),
        "holds it": (F.contains(low, whole), F.lit(10)),
    }
    return F.coalesce(*(F.when(test, points) for test, points in tests.values()), F.lit(0))


def title_case(word: Column) -> Column:
    return F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def contained_share(terms: Column, text: Column) -> Column:
    """The share of the terms that a text holds, whatever the case; 0 without terms."""
    held = F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t)))
    return F.when(F.size(terms) > 0, F.size(held) / F.size(terms)).otherwise(0.0)


def cut_at_line(text: Column, most: int = 15000) -> Column:
    """The text's first most characters, up to the last line end if that keeps more than four fifths of them."""
    head = F.substr(text, F.lit(1), F.lit(most))
    upto = F.length(head) - F.length(F.element_at(F.split(head, "\n"), -1)) - 1
    return F.when(F.length(text) <= most, text).when(upto > most * 0.8, F.substr(head, F.lit(1), upto)).otherwise(head)


def shared_folders(a: Column, b: Column) -> Column:
    """How many leading folders two paths have in common."""
    one, two = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(one), F.size(two)) - 1
    same = F.transform(F.slice(one, 1, F.greatest(n, F.lit(0))), lambda x, i: x == F.get(two, i))
    return F.coalesce(F.array_position(same, False).cast("int") - F.when(F.array_contains(same, False), 1).otherwise(F.lit(None)), F.size(same))


def proximity(a: Column, b: Column) -> Column:
    return F.least(15 * shared_folders(a, b), F.lit(80))


def glob_regex(pattern: str) -> str:
    """A whole-string regular expression for `*` (any run) and `?` (one character)."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def path_glob_regex(pattern: str) -> str:
    """As glob_regex, but `*` and `?` stay within a folder, and `**` does not."""
    parts = re.split(r"(\*\*/?|\*|\?)", pattern)
    return "^" + "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


# Words of questions that are no names of symbols.
QUESTION_WORDS = (
    "the and for with from this that have been will would could should does done make made use used using work works find found show "
    "call called calling get set add all any how what when where which who why not but are was were has had its can did may also into than then them "
    "each other some such only same about after before between through during without again further once here there both just more most very being having doing "
    "system need needs want wants like look change changes changed changing layer handle handles handling incoming outgoing data flow flows level levels "
    "request requests response responses implement implements implementation interface interfaces class classes method methods "
    "trigger triggers affected affect affects else code failing failed silently decide decides return returns returned take takes taken "
    "check checks checked create creates created read reads write writes written start starts stop stops run runs running"
).split()
#: Whole words that are written as names are: camel case, with underscores, capitals alone, and plain words of three letters or more.
NAME_FORMS = "[A-Z][a-z]+([A-Z][a-z]*)*|[a-z]+([A-Z][a-z]*)+|[A-Za-z][A-Za-z0-9]*(_[A-Za-z0-9]+)+|[A-Z]{2,}|[a-z][a-z0-9]{2,}"
DOTTED = "[a-zA-Z][a-zA-Z0-9]*(?:[.][a-zA-Z][a-zA-Z0-9]*)+"
# What marks a task as a wish for something new, and what marks it as a fault or a question.
WISHES = ("add", "create", "implement", "build", "enable", "allow", "new feature", "support for", "ability to", "want to", "should be able", "need to add", "swap", "edit", "modify")
NO_WISHES = (
    "fix", "bug", "error", "broken", "crash", "issue", "problem", "not working", "fails", "undefined", "null",
    "how does", "where is", "what is", "find", "show me", "explain", "understand", "explore",
)


def question_symbols(question: Column) -> Column:
    """The names that a question may speak of: words in the form of names, dotted names whole and in parts of two letters or more, without common words."""
    words = F.filter(F.regexp_extract_all(question, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: w.rlike(f"^(?:{NAME_FORMS})$"))
    dotted = F.regexp_extract_all(question, F.lit(f"(?<![A-Za-z0-9_]){DOTTED}(?![A-Za-z0-9_])"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(dotted, lambda d: F.split(d, "[.]"))), lambda p: F.length(p) >= 2)
    return F.array_distinct(F.filter(F.concat(words, dotted, parts), lambda w: ~F.lower(w).isin(*QUESTION_WORDS)))


def is_feature_request(task: Column) -> Column:
    low = F.lower(task)
    return low.rlike("|".join(WISHES)) & ~low.rlike("|".join(NO_WISHES))
