"""Line-first quality rules: clean line by line, then reject documents that lose too much.

A line fails on punctuation (no sentence end and few words, or doubled marks behind every other word), navigation (a separator for every third word or
more; slashes and angle brackets count where they stand alone) or boilerplate (a licence, cookie, script or log-in notice, in four languages, for every BOILERPLATE_WORDS words or more: a long line that
mentions one is prose). Failing lines are taken out, and a document whose remaining lines hold less than
LEAST_KEPT of its word characters is rejected. Before that, base counts of the whole text reject short and repetitive ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import SPACES, documents, small_batches

LEAST_KEPT = 0.5
SYMBOLS = "#*$%&|<>"
SENTENCE_END = re.compile(r"[.!?…。！？؟][\"'”’»)\]]*$")
SHOUTS = re.compile(r"[!?#*$%&|<>]{2,}")
SEPARATORS = re.compile(r"[|»›•·]|(?<!\S)[>/](?!\S)")
# Phrases of notices, in English, French, German and Spanish.
NOTICES = (
    "licensed under", "released under", "this work is licensed", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "lorem ipsum", "click here",
    "sign in", "sign up", "log in", "login", "subscribe", "newsletter", "©",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "cliquez ici", "se connecter", "s'inscrire", "abonnez-vous", "sous licence",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "hier klicken", "anmelden", "registrieren", "abonnieren", "lizenziert unter",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "aviso legal", "haga clic aquí", "iniciar sesión", "regístrate", "suscríbete", "bajo licencia",
)
BOILERPLATE = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, NOTICES)) + ")")
BOILERPLATE_WORDS = 25
_notices = ahocorasick.Automaton()
for _phrase in NOTICES:
    _notices.add_word(_phrase, _phrase)
_notices.make_automaton()


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    most_repeat_percent: int = 50
    few_words: int = 8
    boilerplate_words: int = BOILERPLATE_WORDS
    least_kept: float = LEAST_KEPT


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in some 3-word window whose words occur in another window too."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    pair = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1].astype(np.int64) * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def line_verdict(line: str, rules: Rules = Rules(), notices: bool = True) -> str:
    """keep, or the rule that a line with words fails. notices: whether it may hold one."""
    bare = line.strip(SPACES)
    words = bare.split()
    if notices and len(BOILERPLATE.findall(bare.lower())) * rules.boilerplate_words >= len(words):
        return "boilerplate"
    if len(SEPARATORS.findall(bare)) * 3 >= len(words) > 0:
        return "navigation"
    if len(SHOUTS.findall(bare)) * 2 >= len(words) or not SENTENCE_END.search(bare) and len(words) < rules.few_words:
        return "punctuation"
    return "keep"


def clean(text: str | None, rules: Rules = Rules()) -> dict:
    """All columns of clean_lines for one text."""
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    filled = [x for x in lines if x.strip(SPACES)]
    chars = lambda s: len(s) - sum(map(s.count, SPACES))
    notices = next(_notices.iter(text.lower()), None) is not None
    verdicts = [line_verdict(x, rules, notices) if x.strip(SPACES) else "blank" for x in lines]
    cleaned = "\n".join(x for x, v in zip(lines, verdicts, strict=True) if v in ("keep", "blank"))
    found = {
        "n_words": len(words), "word_chars": chars(text), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(filled) - len(set(filled)), "n_repeat_words": repeat_words(words),
        "n_bad_punctuation": verdicts.count("punctuation"), "n_bad_navigation": verdicts.count("navigation"), "n_bad_boilerplate": verdicts.count("boilerplate"), "kept_chars": chars(cleaned), "cleaned": cleaned,
    }
    found["base_failed"] = found["n_words"] < rules.least_words or 100 * found["n_repeat_words"] > rules.most_repeat_percent * found["n_words"]
    found["kept"] = not found["base_failed"] and found["kept_chars"] >= rules.least_kept * found["word_chars"]
    return found


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_punctuation", "n_bad_navigation", "n_bad_boilerplate", "kept_chars")


def clean_lines(docs: DataFrame, rules: Rules = Rules(), texts: bool = True) -> DataFrame:
    """doc_id, the counts above, base_failed, kept and (if texts) cleaned for each row of docs (doc_id, text).

    Null and empty texts have no words and fail the base rules. A text without line ends is one line. Repeated rows
    get equal results. A null doc_id stays null. Other columns are ignored; an empty table gives an empty result. Each row
    is judged by itself, in a single pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [clean(t, rules) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([f[c] for f in found], pa.int64()) for c in COUNTS), *(pa.array([f[c] for f in found], pa.bool_()) for c in ("base_failed", "kept"))]
            if texts:
                columns.append(pa.array([f["cleaned"] for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", *["cleaned"] * texts])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean" + ", cleaned string" * texts
    return small_batches(docs).selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, schema)


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir), texts=False)
