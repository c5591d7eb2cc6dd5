"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

The protected entities are the personal data that patterns find (e-mail addresses, IP addresses, payment cards, phone
numbers). Masking these is not enough if other words of the text give them away: a user name, a customer code. Corpus counts tell how
much a term t discloses of an entity e: PMI(t, e) = log2(N c(t,e) / (c(t) c(e))) against the entity's own information
IC(e) = log2(N / c(e)), where c counts documents and c(t,e) those that hold both, wherever they stand. A term with
PMI >= GENERALISE * IC is replaced by its kind of word, with PMI >= REMOVE * IC it is taken out. Only pairs seen in SUPPORT different
texts count: once is chance, and copies of one text are one observation.

Every occurrence of a disclosing term is treated in every document that holds the entity. Elsewhere it stays: the entity is masked
throughout, so there is nothing left that the term alone could be matched with. A document without personal data never changes.

Entities that stand in the same texts have the same counts and are counted as one class, so a list of thousands of addresses costs as much as one.
Candidates are found among the texts that hold an entity seen SUPPORT times; words are counted over all documents, in
each task first. Texts without personal data are never shuffled. Positions are found in blocks, so that a text full of personal data takes time in
proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, scratch, stored, text_key

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive, and anchored to where a run of characters starts, so that no text takes quadratic time; the matches are those
#: of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on, leftmost and non-overlapping.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
TERM = r"[\p{L}\p{N}_]{3,}"
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Steps of a running total, and characters of a text, that are gone through one by one.
BLOCK, CHUNK_BITS = 256, 10
SPAN = "struct<start:int,kind:int,end:int,value:string,share:double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers what combine makes of those before it, from 0: block by block, then over the blocks."""

    def before(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("so_far"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, v: F.struct(combine(acc["so_far"], v).alias("so_far"), F.array_append(acc["out"], acc["so_far"]).alias("out")))

    def joined(blocks: Column) -> Column:
        offsets = before(F.transform(blocks, lambda b: b["so_far"]))["out"]
        return let(offsets, lambda o: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda v: combine(F.get(o, i), v)))))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
    return let(F.transform(starts, lambda at: before(F.slice(values, at, BLOCK))), joined)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points: what lies between matches gives their places."""

    def placed(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda s: s["skip"] + s["size"]), lambda a, b: a + b)
        start = lambda o, s, i: F.get(o, i) + s["skip"]
        return let(ends, lambda o: F.transform(steps, lambda s, i: F.struct(start(o, s, i).alias("start"), (start(o, s, i) + s["size"]).alias("end"), s["value"].alias("value"))))

    def spans(x: Column) -> Column:
        step = lambda v, i: F.struct(F.length(F.get(x["between"], i)).alias("skip"), F.length(v).alias("size"), v.alias("value"))
        return let(F.transform(x["found"], step), placed)

    return let(F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), spans)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    reversed_ = F.reverse(number)
    doubled = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substr(reversed_, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: int, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == 1:
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == 2:
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    if kind == 3:
        return n.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value, share: null), by start, then kind."""
    numbers = text.rlike("[0-9]")
    #: what a text must hold for a match of each kind
    needs = (text.contains("@"), numbers & text.rlike(r"[0-9]\.[0-9]"), numbers & text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), text.contains("+") & numbers)

    def of_kind(k: int) -> Column:
        matches = F.filter(located(text, PATTERNS[k]), lambda s: valid(k, s["value"]))
        own = F.transform(matches, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.lit(None).cast("double").alias("share")))
        return F.when(needs[k], own).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.array_sort(F.concat(*map(of_kind, range(len(PATTERNS)))))


def entity(span: Column) -> Column:
    """The same for all spellings of an entity."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1)
    return F.concat(kind, F.lit(":"), F.when(span["kind"].isin(2, 3), digits(span["value"])).otherwise(F.lower(span["value"])))


def pieces(text: Column, spans: Column) -> Column:
    """Array of (start, text) of what lies before each span, and behind the last; empty where a span begins inside an earlier one.

    The text is cut into chunks first, so that no piece has to be counted out from its beginning.
    """
    size = 1 << CHUNK_BITS
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        first, last = F.shiftright(start, CHUNK_BITS), F.shiftright(end - 1, CHUNK_BITS)
        whole = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return F.when(end > start, F.substr(whole, start - first * size + 1, end - start)).otherwise("")

    def between(x: Column) -> Column:
        piece = lambda start, end: F.struct(start.alias("start"), cut(x["chunks"], start, end).alias("text"))
        last = F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)))
        return F.concat(F.transform(spans, lambda s, i: piece(F.get(x["ends"], i), s["start"])), F.array(piece(last, F.length(text))))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return let(F.struct(chunks.alias("chunks"), ends.alias("ends")), between)


def found(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, text_key, spans and text for each row; null texts as empty. text is null where there is nothing to find, unless whole_rows: then the row is in _row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key().alias("text_key"), *[F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] * whole_rows)
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    return rows if whole_rows else rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))


def disclosing(docs: DataFrame, held: DataFrame, terms: DataFrame, n: int, support: int, generalise: float) -> DataFrame:
    """entities (a class of them), term, share: terms whose PMI with the class is at least generalise times its information."""
    pairs = held.join(terms, "text_key").groupBy("entities", "c_e", "term").agg(F.sum("rows").alias("c_te"), F.count(F.lit(1)).alias("texts"))
    pairs = stored(pairs.filter(F.col("texts") >= support), "pairs")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))
    share = F.log2(F.col("c_te") * n / (F.col("c_t") * F.col("c_e"))) / F.log2(F.lit(float(max(n, 1))) / F.col("c_e"))
    return pairs.join(counts, "term").select("entities", "term", share.alias("share")).filter(F.col("share") >= generalise)


def disclosed_terms(docs: DataFrame, base: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """text_key, shares (term to the largest share it discloses of an entity of that text) for the texts that have any."""
    private = base.filter(F.size("spans") > 0)
    n = base.count()
    entities = private.select("text_key", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity")).groupBy("text_key", "entity").agg(F.count(F.lit(1)).alias("rows"))
    entities = stored(entities, "entities")
    same = [F.bit_xor(F.xxhash64("text_key", F.lit(k))) for k in range(2)]
    classes = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("c_e"), F.struct(*same).alias("same")).filter((F.col("texts") >= support) & (F.col("c_e") < n))
    of_class = classes.select("entity", "c_e", F.xxhash64("texts", "c_e", "same").alias("entities"))
    held = stored(entities.join(of_class, "entity").select("text_key", "entities", "c_e", "rows").distinct(), "held")
    apart = F.array_join(F.transform(pieces(F.col("text"), F.col("spans")), lambda p: p["text"]), "\n")
    texts = private.join(held.select("text_key").distinct(), "text_key", "left_semi")
    terms = stored(texts.select("text_key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(apart), F.lit(TERM), F.lit(0)))).alias("term")).distinct(), "terms")
    shares = stored(disclosing(docs, held, terms, n, support, generalise), "shares")
    hits = held.join(shares, "entities").join(terms, ["text_key", "term"]).groupBy("text_key", "term").agg(F.max("share").alias("share"))
    return hits.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))


def with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows (text, text_key, spans) with all_spans: spans and those of disclosed terms, by start, then kind."""

    def of_piece(p: Column) -> Column:
        known = F.filter(located(p["text"], TERM), lambda t: F.map_contains_key("shares", F.lower(t["value"])))
        span = lambda t: F.struct((p["start"] + t["start"]).alias("start"), F.lit(KINDS.index("term")).alias("kind"), (p["start"] + t["end"]).alias("end"), t["value"].alias("value"), F.element_at("shares", F.lower(t["value"])).alias("share"))
        return F.transform(known, span)

    own = F.flatten(F.transform(pieces(F.col("text"), F.col("spans")), of_piece))
    joined = rows.join(terms, "text_key", "left")
    return joined.withColumn("all_spans", F.when(F.col("shares").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", own)))).drop("shares")


def listing(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for each row of docs (doc_id, text).

    Null and empty texts have no spans. Spans of several kinds may overlap; ties of start go by kind. Terms never overlap other spans.
    Repeated rows get equal results, and count as documents but not as different texts. A null doc_id stays null. Other columns are
    ignored; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        base = stored(found(docs), "personal", keep=True)
        rows = with_terms(base, stored(disclosed_terms(docs, base, support, generalise), "disclosed", keep=True))
    count = lambda k: F.size(F.filter("all_spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])), F.sha2(listing(F.col("spans")), 256).alias("base_sha256"), listing(F.col("all_spans")).alias("spans"), count(4).alias("n_term"))


def replacement(span: Column) -> Column:
    """Base spans: a mark of their kind. Terms: their kind of word, or nothing."""
    mark = F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), span["kind"] + 1)
    general = F.when(span["value"].rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).when(span["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
    return F.when(span["kind"] < 4, mark).when(span["share"] >= REMOVE, F.lit("")).otherwise(general)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced; of overlapping spans the first names the mark and all are covered."""
    mark = lambda p, s: F.when(s["start"] >= p["start"], replacement(s)).otherwise("")
    marked = lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(x["text"], F.coalesce(mark(x, F.get(spans, i)), F.lit("")))), "")
    return let(pieces(text, spans), marked)


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """docs with personal data and the terms that disclose it masked in text; where that changes a text, n_chars (if there is one) is brought up to date.

    Every row stays, repeated ones and those without doc_id too. Null and empty texts stay as they are, like all columns but text and
    n_chars; an empty table gives an empty one. Patterns are searched once, and rows without a match aren't joined with anything.
    """
    with scratch(docs.sparkSession):
        base = stored(found(docs, whole_rows=True).withColumn("private", F.size("spans") > 0), "personal", keep=True)
        terms = stored(disclosed_terms(docs, base, support, generalise), "disclosed", keep=True)
    clean = base.filter("NOT private").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
    rows = with_terms(base.filter("private"), terms).withColumn("text", masked(F.col("text"), F.col("all_spans")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.union(rows.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns)))


def op4_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
