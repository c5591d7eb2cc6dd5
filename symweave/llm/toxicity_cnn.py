"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of two rows of two tables, chosen by independent hashes, so a rare word is confused with another only
if both agree. Filters of several widths slide over the words of the whole text; each filter's maximum over the text, cut
at zero, goes into a logistic output. Embeddings start from the log-odds of their words in the training documents and
small noise; then everything is trained together by Adagrad.

A score of THRESHOLD means the same in every language: on training rows kept aside, the best output is found for each language
and moved to THRESHOLD. The language used for that is guessed from the text (naive Bayes over hashed words), never read.

Training begins on the driver with SAMPLE labelled documents at most, those of least hashed id, and of them one after the other that fits into what is left of SAMPLE_WORDS words;
those that take more than one in LONG of all words come last. If that leaves any out, the model goes on with all of them: ROUNDS times each task trains
its rows from the model so far, and what parameters moved is averaged over the tasks that moved them; word counts of languages and cuts are then those of all rows.
Tasks are as the rows are stored, so figures may differ a little between clusters. Scoring covers whole texts, by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, held_out, small_batches, stored

SAMPLE, SAMPLE_WORDS, BUCKET_BITS, SIZE, WIDTHS, FILTERS, EPOCHS, RATE, THRESHOLD = 8000, 8_000_000, 17, 8, (1, 2, 3), 12, 4, 0.05, 0.7
PAD = max(WIDTHS) - 1
#: Passes over all labelled documents, words that a step or a stretch of a long text holds at most, and cells of the outputs, by which cuts are found, in 1.
ROUNDS, STRETCH, CELLS = 2, 1 << 16, 256
LONG = 64
#: What a model that was trained on nothing puts between its outputs and THRESHOLD.
UNSURE = 2.0
WORD = re.compile(r"\w+")


def hashed(text: str | None) -> np.ndarray:
    """The 64-bit hash of each word."""
    words = WORD.findall((text or "").lower())
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass
class Cnn:
    tables: tuple[np.ndarray, np.ndarray]  # (bucket, SIZE)
    filters: list[np.ndarray]  # for each width (width, SIZE, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    offset: float
    language: np.ndarray  # (bucket, language) log probabilities
    cuts: np.ndarray  # each language's output at THRESHOLD

    def buckets(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << BUCKET_BITS) - 1)
        return (words & mask).astype(np.int64), (words >> np.uint64(32) & mask).astype(np.int64)

    def layout(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of all documents with PAD places behind each: starts, whether a place holds a word, and both buckets."""
        sizes = np.array([len(d) + PAD for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        real = np.ones(sizes.sum() + PAD, bool)
        for k in range(PAD):
            real[starts + sizes - 1 - k] = False
        real[sizes.sum() :] = False
        one, two = np.zeros(len(real), np.int64), np.zeros(len(real), np.int64)
        one[real], two[real] = self.buckets(np.concatenate(docs) if docs else np.empty(0, np.uint64))
        return starts, real, one, two

    def maps(self, real: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embeddings and, for each width, the filters' outputs at each place (less than any where no word starts)."""
        e = (self.tables[0][one] + self.tables[1][two]) * real[:, None]
        n, found = len(real) - PAD, []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            y = sum(e[k : n + k] @ f[k] for k in range(w)) + b
            y[~real[:n]] = -1e9
            found.append(y)
        return e, found

    def outputs(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The logistic output before calibration, and the guessed language."""
        starts, real, one, two = self.layout(docs)
        pooled = np.concatenate([np.maximum.reduceat(y, starts, axis=0) for y in self.maps(real, one, two)[1]], axis=1)
        z = np.maximum(pooled, 0) @ self.out + self.offset
        spoken = np.add.reduceat(self.language[one] * real[:, None], starts, axis=0)
        return z, spoken.argmax(axis=1)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        z, language = self.outputs(docs)
        return 1 / (1 + np.exp(-np.clip(z - self.cuts[language] + logit(THRESHOLD), -40, 40)))


def fit(docs: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], seed: int = 7) -> Cnn:
    """Trains on three quarters of the documents and calibrates on the rest."""
    rng = np.random.default_rng(seed)
    names = sorted({x for x in langs if x is not None}) or ["und"]
    order = rng.permutation(len(docs))
    held, used = order[: len(docs) // 4], order[len(docs) // 4 :]
    n = 1 << BUCKET_BITS
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    model = Cnn((small(n, SIZE) * 0.1, small(n, SIZE) * 0.1), [small(w, SIZE, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], small(len(WIDTHS) * FILTERS), 0.0, np.zeros((n, len(names)), np.float32), np.zeros(len(names)))
    if not len(docs):
        model.cuts[:] = UNSURE
        return model
    _start_from_log_odds(model, [docs[i] for i in used], toxic[used])
    for f in model.filters:
        f[0, 0, : FILTERS // 2] = 0.5
    model.out[np.arange(len(model.out)) % FILTERS < FILTERS // 2] = 0.1
    spoken = np.ones((n, len(names)))
    for i in used:
        if langs[i] is not None:
            np.add.at(spoken[:, names.index(langs[i])], model.buckets(np.unique(docs[i]))[0], 1)
    model.language[:] = np.log(spoken / spoken.sum(axis=0))
    _descend(model, docs, toxic, used, rng)
    z, language = model.outputs([docs[i] for i in held]) if len(held) else (np.zeros(0), np.zeros(0, int))
    truth = toxic[held].astype(bool)
    overall = best_cut(z, truth, 0.0)
    for k in range(len(names)):
        own = language == k
        model.cuts[k] = best_cut(z[own], truth[own], overall) if truth[own].sum() >= 20 else overall
    return model


def best_cut(z: np.ndarray, truth: np.ndarray, otherwise: float) -> float:
    """The output with the best F1, in the middle between the two neighbours."""
    if not truth.any() or truth.all():
        return otherwise
    order = np.argsort(-z)
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + truth.sum())
    k = int(f1.argmax())
    return float((z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2)


def _start_from_log_odds(model: Cnn, docs: list[np.ndarray], toxic: np.ndarray) -> None:
    words, doc = np.concatenate([np.unique(d) for d in docs]), np.repeat(np.arange(len(docs)), [len(np.unique(d)) for d in docs])
    kinds, which = np.unique(words, return_inverse=True)
    with_, total = np.bincount(which, toxic[doc]), np.bincount(which)
    often = total >= 3
    odds = np.log((with_ + 0.5) / (toxic.sum() + 1)) - np.log((total - with_ + 0.5) / (len(docs) - toxic.sum() + 1))
    for table, bucket in zip(model.tables, model.buckets(kinds[often]), strict=True):
        table[bucket, 0] += odds[often].astype(np.float32) / 2


def loss_and_gradients(model: Cnn, docs: list[np.ndarray], toxic: np.ndarray) -> tuple[float, list[np.ndarray], float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The mean logistic loss; its gradients by filters, biases and output weights, and by the offset; and by embeddings: the
    buckets in both tables and a gradient for each pair of them."""
    starts, real, one, two = model.layout(docs)
    ends = np.append(starts[1:], len(real) - PAD)
    e, maps = model.maps(real, one, two)
    place = [np.stack([s + y[s:t].argmax(axis=0) for s, t in zip(starts, ends, strict=True)]) for y in maps]  # (doc, filter)
    pooled = np.concatenate([np.take_along_axis(y, p, axis=0) for y, p in zip(maps, place, strict=True)], axis=1)
    active = np.maximum(pooled, 0)
    z = np.clip(active @ model.out + model.offset, -40, 40)
    loss = float(np.mean(np.logaddexp(0, z) - toxic * z))
    error = ((1 / (1 + np.exp(-z)) - toxic) / len(docs)).astype(active.dtype)
    back = error[:, None] * model.out[None, :] * (pooled > 0)
    by_filter, by_bias, rows, row_gradients = [], [], [], []
    for k, (w, p) in enumerate(zip(WIDTHS, place, strict=True)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        by_bias.append(g.sum(axis=0))
        by_filter.append(np.stack([np.einsum("df,dfs->sf", g, e[p + j]) for j in range(w)]))
        rows += [(p + j).ravel() for j in range(w)]
        row_gradients += [(g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, SIZE) for j in range(w)]
    where = np.concatenate(rows)
    return loss, [*by_filter, *by_bias, error @ active], float(error.sum()), (one[where], two[where], np.concatenate(row_gradients) * real[where, None])


def _descend(model: Cnn, docs: list[np.ndarray], toxic: np.ndarray, used: np.ndarray, rng: np.random.Generator, batch: int = 32) -> None:
    """EPOCHS rounds of Adagrad over all used documents, in a new order each time."""
    step = _steps(model)
    for _ in range(EPOCHS):
        used = rng.permutation(used)
        for at in range(0, len(used), batch):
            some = used[at : at + batch]
            step([docs[i] for i in some], toxic[some])


def _steps(model: Cnn) -> Callable[[list[np.ndarray], np.ndarray], None]:
    """A step of Adagrad for some documents, with what it remembers between steps."""
    parameters = [*model.filters, *model.biases, model.out]
    squares = [np.full_like(p, 1e-3) for p in parameters]
    row_squares = [np.full(len(t), 1e-3, np.float32) for t in model.tables]

    def step(docs: list[np.ndarray], toxic: np.ndarray) -> None:
        _, gradients, by_offset, (*buckets, by_row) = loss_and_gradients(model, docs, toxic)
        model.offset -= RATE * by_offset
        for p, g, s in zip(parameters, gradients, squares, strict=True):
            s += g * g
            p -= (RATE * g / np.sqrt(s)).astype(np.float32)
        for table, bucket, s in zip(model.tables, buckets, row_squares, strict=True):
            kinds, which = np.unique(bucket, return_inverse=True)
            g = np.zeros((len(kinds), SIZE), np.float32)
            np.add.at(g, which, by_row)
            s[kinds] += (g * g).mean(axis=1)
            table[kinds] -= RATE * g / np.sqrt(s[kinds])[:, None]

    return step


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Cnn:
    """A model from all labelled rows that are not held out; of several labels of a document the largest counts.

    Rows that repeat a doc_id count as documents of their own; in the sample that training begins with, equal rows are taken or left together, in the order of hashed ids and texts, long ones
    last, and one that does not fit is left to the passes over all rows, so the driver holds 8 bytes for each of at most sample_words words.
    """
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(t) for t in batch.column(3).to_pylist()]
            keys = pa.array([xxhash.xxh64_intdigest(w.tobytes(), 1) >> 1 for w in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], keys, pa.array(map(len, found), pa.int64()), pa.array([w.tobytes() for w in found], pa.binary())], ["doc_id", "toxic", "lang", "key", "n", "words"])

    rows = small_batches(docs).filter(~held_out()).select("doc_id", "lang", "text").join(known.hint("merge"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    held = stored(rows.mapInArrow(words, "doc_id long, toxic int, lang string, key long, n long, words binary"), "words")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("key")]
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"))
    sizes = held.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("n") > sample_words // LONG, *order).limit(sample).collect()
    taken, words_left, rows_left = [], sample_words, sample
    for r in sizes:
        if r.n <= words_left and r.rows <= rows_left:
            taken.append((r.doc_id, r.key))
            words_left, rows_left = words_left - r.n, rows_left - r.rows
    few = held.sparkSession.createDataFrame(taken, "doc_id long, key long")  # sample rows at most
    found = held.join(F.broadcast(few), ["doc_id", "key"]).orderBy(*order, "toxic", "lang").select("words", "toxic", "lang").toLocalIterator() if taken else []
    found = [(np.frombuffer(bytes(r.words), np.uint64), r.toxic, r.lang) for r in found]
    start = fit([w for w, *_ in found], np.array([t for _, t, _ in found], np.float32), [lang for *_, lang in found])
    n = len(found)
    del found, sizes
    return start if held.count() == n else trained_on_all(start, held, few)


def trained_on_all(model: Cnn, held: DataFrame, begun: DataFrame) -> Cnn:
    """The model after ROUNDS passes over all rows (doc_id, toxic, lang, key, words) but a quarter, none of which is in begun (doc_id, key); that quarter gives the cuts."""
    aside = (F.pmod(F.xxhash64("key", "doc_id"), F.lit(4)) == 0) & F.col("begun").isNull()
    marked = held.join(F.broadcast(begun.withColumn("begun", F.lit(True))), ["doc_id", "key"], "left").withColumn("aside", aside)
    used = marked.filter(~F.col("aside")).select("words", F.col("toxic").cast("float").alias("toxic"))
    for _ in range(ROUNDS):
        model = _moved(model, used)
    names = [r.lang for r in held.filter("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect()] or ["und"]
    model = replace(model, language=_spoken(model, marked.filter("NOT aside AND lang IS NOT NULL"), names), cuts=np.zeros(len(names)))
    cells = _cells_of_outputs(model, marked.filter("aside")).collect()
    language, cell, n, toxic = (np.array([r[k] for r in cells], np.int64) for k in range(4))
    overall = best_cut_of_cells(cell, n, toxic, 0.0)
    for k in range(len(names)):
        own = language == k
        model.cuts[k] = best_cut_of_cells(cell[own], n[own], toxic[own], overall) if toxic[own].sum() >= 20 else overall
    return model


def _flat(model: Cnn) -> np.ndarray:
    """All parameters but the embeddings, filled up to rows of SIZE."""
    values = np.concatenate([*(p.ravel() for p in (*model.filters, *model.biases, model.out)), [model.offset]])
    return np.pad(values, (0, -len(values) % SIZE)).reshape(-1, SIZE)


def _moved(model: Cnn, rows: DataFrame) -> Cnn:
    """The model after one pass over rows (words, toxic): each task trains its own, and each embedding and other parameter moves by the mean over the tasks that moved it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = [f"d{k}" for k in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = shared.value
        own = replace(before, tables=tuple(t.copy() for t in before.tables), filters=[f.copy() for f in before.filters], biases=[b.copy() for b in before.biases], out=before.out.copy())
        step, docs, toxic = _steps(own), [], []
        for batch in batches:
            for words, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(words.as_buffer(), np.uint64)
                for part in np.array_split(words, range(STRETCH, len(words), STRETCH)):
                    if docs and (len(docs) == 32 or sum(map(len, docs)) + len(part) > STRETCH):
                        step(docs, np.array(toxic, np.float32))
                        docs, toxic = [], []
                    docs.append(part.copy())
                    toxic.append(label)
        if docs:
            step(docs, np.array(toxic, np.float32))
        for kind, (old, new) in enumerate(zip((*before.tables, _flat(before)), (*own.tables, _flat(own)), strict=True)):
            moved = np.flatnonzero((old != new).any(axis=1))
            change = (new[moved] - old[moved]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(moved), kind, np.int32)), pa.array(moved.astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in change.T)], ["kind", "bucket", *at])

    changes = rows.mapInArrow(run, f"kind int, bucket int, {', '.join(f'{c} float' for c in at)}")
    mean = changes.groupBy("kind", "bucket").agg(*(F.avg(c).cast("float").alias(c) for c in at)).toArrow()  # a row for each bucket of the tables at most
    shared.destroy()
    kinds, buckets, changed = mean["kind"].to_numpy(), mean["bucket"].to_numpy(), np.stack([mean[c].to_numpy() for c in at], axis=1)
    tables, others = [t.copy() for t in model.tables], _flat(model)
    for kind, values in enumerate((*tables, others)):
        values[buckets[kinds == kind]] += changed[kinds == kind]
    shapes, values = [p.shape for p in (*model.filters, *model.biases, model.out)], others.ravel()
    ends = np.cumsum([int(np.prod(x)) for x in shapes])
    parts = [v.reshape(x).astype(np.float32) for v, x in zip(np.split(values, ends)[:-1], shapes, strict=True)]
    n = len(WIDTHS)
    return replace(model, tables=tuple(tables), filters=parts[:n], biases=parts[n : 2 * n], out=parts[-1], offset=float(values[ends[-1]]))


def _spoken(model: Cnn, rows: DataFrame, names: list[str]) -> np.ndarray:
    """(bucket, language) log probabilities by the number of rows (words, lang) of each language that hold a word of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for words, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                own[np.unique(model.buckets(np.frombuffer(words.as_buffer(), np.uint64))[0])] += 1
        for lang, own in counts.items():
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(own[held])], ["lang", "bucket", "n"])

    model = replace(model, tables=(), filters=[], biases=[])
    counted = rows.select("words", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    spoken = np.ones((1 << BUCKET_BITS, len(names)))
    for k, name in enumerate(names):
        own = counted.filter(pc.equal(counted["lang"], name))
        spoken[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return np.log(spoken / spoken.sum(axis=0)).astype(np.float32)


def _cells_of_outputs(model: Cnn, rows: DataFrame) -> DataFrame:
    """language (guessed), cell, n, toxic: how many rows (words, toxic) have an output in a cell of 1 / CELLS, and how many of them are toxic."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found = [np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column(0)], []
            ends = np.append(np.flatnonzero(np.diff(np.cumsum([len(d) for d in docs]) // STRETCH)) + 1, len(docs)) if docs else []
            for a, b in zip([0, *ends], ends, strict=False):
                found.append(shared.value.outputs(docs[a:b]))
            z, language = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(np.floor(np.clip(z, -40, 40) * CELLS).astype(np.int32)), batch.column(1)], ["language", "cell", "toxic"])

    return rows.select("words", "toxic").mapInArrow(run, "language int, cell int, toxic int").groupBy("language", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") > 0).alias("toxic"))


def best_cut_of_cells(cell: np.ndarray, n: np.ndarray, toxic: np.ndarray, otherwise: float) -> float:
    """The lower end of the cell from which on upwards F1 is best."""
    if not toxic.sum() or toxic.sum() == n.sum():
        return otherwise
    order = np.argsort(-cell, kind="stable")
    kinds, first = np.unique(-cell[order], return_index=True)  # cells of several languages
    hits, all_ = (np.add.reduceat(x[order], first).cumsum() for x in (toxic, n))
    return float(-kinds[int((2 * hits / (all_ + toxic.sum())).argmax())] / CELLS)


def score(docs: DataFrame, model: Cnn) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Null and empty texts have no words and get what the output's offset alone gives. A text of any length is scored
    whole. Repeated rows get equal scores; a null doc_id is not held out. Other columns are ignored; an empty table gives an
    empty result, and a model trained on nothing scores everything alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, waiting, size = [], [], 0
            for text in batch.column(2).to_pylist():
                waiting.append(hashed(text))
                size += len(waiting[-1])
                if size > 100_000:
                    found.append(shared.value.scores(waiting))
                    waiting, size = [], 0
            if waiting:
                found.append(shared.value.scores(waiting))
            values = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, documents(spark, sf_dir, "labels")))
