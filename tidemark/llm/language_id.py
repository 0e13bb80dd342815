"""Language identification by interpolated Kneser-Ney character models.

One model a language, of characters inside words: sorted n-gram hashes with log probabilities and
back-off weights.  A text gets the language with the lowest cross-entropy a character; the margin to
the next gives a calibrated score, and a text whose cross-entropy lies far above what its language
shows on held-back sample texts is rejected.

Every language that a row is labelled with is learnt.  Training reads whole texts of a bounded sample
of labelled rows: SAMPLE_DOCS rows a language, and SAMPLE_ROWS rows in all where there are many
languages (one row of each at least).  Prediction reads every text whole, each distinct word being
scored once for a cache life.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise
from .words import Words, distinct, mix64, slices, tidy, worker_cache

SAMPLE_DOCS, SAMPLE_ROWS = 400, 20_000
#: Of a language's sample every FOLDth text is held back to calibrate on.
FOLD = 5
ORDER, UNKNOWN, UNDECIDED = 5, -14.0, "und"
GAP = "[\\x20\\x09-\\x0D]+"
SLICE_BYTES, CACHE_NUMBERS = 1 << 20, 1_600_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def letter_codes(chunks: list[str]) -> np.ndarray:
    """Lower-case letters of the chunks, each chunk between zeros."""
    raw = ("\n" + "\n".join(chunks) + "\n").lower().encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, dtype=np.uint32)
    codes = codes[_letters()[codes] | (codes == 10)].astype(np.uint64)
    codes[codes == 10] = 0
    return codes


class Grams:
    """Hashes of the n-grams that end at each place, none across a word's bounds."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        bound = np.flatnonzero(codes == 0)
        place = np.arange(len(codes))
        since = np.searchsorted(bound, place, side="left") - 1
        self.depth = np.where(since >= 0, place - bound[np.maximum(since, 0)], 0)
        self.word = since
        self.keys, rolling = [], np.zeros(len(codes), dtype=np.uint64)
        for n in range(ORDER):
            back = np.zeros(len(codes), dtype=np.uint64)
            back[n:] = codes[: len(codes) - n] + np.uint64(1)
            rolling = rolling * _BASE + back
            self.keys.append(mix64(rolling ^ np.uint64((n + 1) << 56)))

    def at(self, n: int) -> np.ndarray:
        """Places at which an n-gram ends; the opening bound itself is never predicted."""
        return np.flatnonzero((self.depth >= n - 1) & (self.depth > 0))


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key in the sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, i, -1)


@dataclass
class Part:
    """One language: sorted n-gram hashes of all orders, log p of each, log weight of what follows it; log p of a
    letter that only other languages have shown; and the cross-entropy above which a text is rejected."""

    keys: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    floor: float
    limit: float = np.inf


@dataclass
class Model:
    languages: list[str]
    parts: list[Part]
    letters: np.ndarray
    slope: float = 1.0

    def words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of every chunk in every language, its predicted characters)."""
        g = Grams(letter_codes(chunks))
        left = g.at(1)
        left = left[(g.depth[left] > 1) | (g.codes[left] > 0)]  # a chunk without letters predicts nothing
        used = np.bincount(g.word[left], minlength=len(chunks))[: len(chunks)]
        strange = _lookup(self.letters, g.codes) < 0
        # Each distinct n-gram is looked up once a language; what isn't found backs off to the order below.
        kinds = [np.unique(k, return_inverse=True) for k in g.keys]
        before = np.maximum(np.arange(len(g.codes)) - 1, 0)
        sums = np.zeros((len(chunks), len(self.parts)), dtype=np.float32)
        for l, part in enumerate(self.parts):
            p, weight = np.where(strange, UNKNOWN, part.floor), np.zeros(len(g.codes))
            for n, (keys, back) in enumerate(kinds):
                row = _lookup(part.keys, keys)
                there = row >= 0
                lower = p + weight[before] if n else p
                p = np.where(g.depth >= n, np.where(there[back], np.where(there, part.logp[row], 0.0)[back], lower), p)
                weight = np.where(there, part.backoff[row], 0.0)[back]
            sums[:, l] = np.bincount(g.word[left], p[left], minlength=len(chunks))[: len(chunks)]
        return sums, used


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-7))


def fit(kinds: list[str], times: np.ndarray, letters: int) -> Part:
    """The model of one language from its distinct words and their counts; `letters` are known over all languages."""
    own = _counts(kinds, times)
    keys, logp, weights, lower = [], [], {}, None
    for n in range(1, ORDER + 1):
        o = own[n]
        low = 1.0 / (letters + 1) if n == 1 else lower[_lookup(own[n - 1]["keys"], o["suffix"])]
        of = _lookup(o["contexts"], o["context"])
        weight = o["discount"] * o["types"] / o["total"]
        lower = np.maximum(o["count"] - o["discount"], 0) / o["total"][of] + weight[of] * low
        keys.append(o["keys"])
        logp.append(_log(lower))
        weights[n] = o["contexts"], _log(weight)
    backoff = []
    for n in range(1, ORDER + 1):
        row = _lookup(weights[n + 1][0], keys[n - 1]) if n < ORDER else np.full(len(keys[-1]), -1)
        backoff.append(np.where(row >= 0, weights[n + 1][1][row], 0.0) if n < ORDER and len(weights[n + 1][0]) else np.zeros(len(row)))
    floor = float(weights[1][1][0] - np.log(letters + 1)) if len(weights[1][1]) else UNKNOWN
    every = np.concatenate(keys)
    order = np.argsort(every)
    return Part(every[order], *(np.concatenate(x)[order].astype(np.float32) for x in (logp, backoff)), floor)


def _counts(kinds: list[str], times: np.ndarray) -> dict[int, dict]:
    """Of each order: n-grams with their Kneser-Ney counts, and their contexts' totals and types."""
    g = Grams(letter_codes(kinds))
    weight = np.append(times, 0)[np.clip(g.word, -1, len(times))]
    out: dict[int, dict] = {}
    for n in range(ORDER, 0, -1):
        at = g.at(n)
        at = at[(g.depth[at] > 1) | (g.codes[at] > 0)]
        keys, first, back = np.unique(g.keys[n - 1][at], return_index=True, return_inverse=True)
        count = np.bincount(back, weight[at], minlength=len(keys)).astype(float)
        place = at[first]
        if n < ORDER:  # distinct left neighbours, but for n-grams that open a word
            opens = g.depth[place] == n - 1
            more = np.bincount(np.maximum(_lookup(keys, out[n + 1]["suffix"]), 0), minlength=len(keys)) if len(keys) else count
            count = np.where(opens & (n > 1), count, np.maximum(more, 1))
        context = g.keys[n - 2][place - 1] if n > 1 else np.zeros(len(keys), dtype=np.uint64)
        suffix = g.keys[n - 2][place] if n > 1 else np.zeros(len(keys), dtype=np.uint64)
        contexts, into = np.unique(context, return_inverse=True)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        out[n] = {"keys": keys, "count": count, "suffix": suffix, "context": context, "contexts": contexts, "total": np.bincount(into, count, minlength=len(contexts)), "types": np.bincount(into, minlength=len(contexts)).astype(float), "discount": min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))}
    return out


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS, most: int = SAMPLE_ROWS) -> DataFrame:
    """lang, held, text: the rows to learn from, of those whose crc32 of the id leaves 1 to 4 when divided by 5.

    The choice is by a hash of the id, so it doesn't depend on order: the first `per_language` of each
    language, or fewer of each if that made more than `most` rows in all.  `held` rows are calibrated on.
    """
    known = docs.select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null and pmod(crc32(i), 5) != 0").withColumn("h", F.xxhash64("i", F.lit(5)))
    sizes = materialise(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    languages = sizes.count()
    each = max(1, min(per_language, most // max(1, languages)))
    # A share of each language that holds half as many again as are wanted; few rows then meet in the ranking.
    share = (1.5 * each + 50) / F.col("n") * (1 << 30)
    near = known.select("lang", "h", "i").join(F.broadcast(sizes) if languages <= most else sizes, "lang").filter(F.pmod("h", F.lit(1 << 30)) < share)
    keys = near.select("lang", "h", "i").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "i")) - 1).filter(F.col("r") < each).dropDuplicates(["lang", "h", "i"])
    keys = F.broadcast(keys) if languages <= most else keys  # at most `most` rows then
    drawn = known.join(keys, ["lang", "h", "i"]).dropDuplicates(["lang", "h", "i"])
    return materialise(drawn.select("lang", (F.col("r") % FOLD == FOLD - 1).alias("held"), "text"))


def train(samples: DataFrame) -> Model:
    """Model of the sampled texts (lang, held, text).  Words are counted by Spark; one task fits one language."""
    spark = samples.sparkSession
    words = samples.filter("not held").select("lang", F.explode(F.split("text", GAP)).alias("word")).filter("word <> ''")
    words = materialise(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(distinct(letter_codes(b.column(0).to_pylist())).view(np.int64))], ["code"])

    # Letters are code points, so there are at most 1,114,112 of them.
    letters = np.sort(np.array([r["code"] for r in words.select("word").mapInArrow(codes, "code long").distinct().collect()], dtype=np.uint64))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        p = fit(table.column("word").to_pylist(), table.column("n").to_numpy(), len(letters))
        return pa.table({"lang": table.column("lang").slice(0, 1), **{c: pa.array([getattr(p, c).tobytes()], pa.binary()) for c in ("keys", "logp", "backoff")}, "floor": pa.array([p.floor])})

    got = words.groupBy("lang").applyInArrow(learn, "lang string, keys binary, logp binary, backoff binary, floor double").orderBy("lang").collect()
    parts = [Part(np.frombuffer(r["keys"], dtype=np.uint64), np.frombuffer(r["logp"], dtype=np.float32), np.frombuffer(r["backoff"], dtype=np.float32), r["floor"]) for r in got]
    model = Model([r["lang"] for r in got], parts, letters)
    return _calibrate(model, samples.filter("held")) if parts else model


def _calibrate(model: Model, held: DataFrame) -> Model:
    """Slope of the score by least log loss, and each language's limit on the cross-entropy.

    The limit stands well above the middle of what texts of that label show; those that the model gives
    to another language, as it does wrong labels, are left out, and single outliers don't move it.
    """
    shared = held.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(("scorer", name), lambda: _Scorer(shared.value))
        for b in batches:
            for a, w in slices(b.column(1), SLICE_BYTES):
                sums, used = scorer.texts(w)
                on = np.flatnonzero(used)
                h = -sums[on] / used[on, None]
                gap = np.partition(h, 1, axis=1)[:, 1] - h.min(1) if h.shape[1] > 1 else np.full(len(on), 9.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, w.rows).take(pa.array(on)), pa.array(h.argmin(1).astype(np.int32)), pa.array(h.min(1).astype(float)), pa.array(gap * np.sqrt(used[on]))], ["lang", "best", "h", "margin"])

    rows = held.select("lang", "text").mapInArrow(tidy(measure), "lang string, best int, h double, margin double").collect()
    shared.unpersist()
    right = np.array([model.languages[r["best"]] == r["lang"] for r in rows])
    if rows:
        m = np.array([r["margin"] for r in rows])
        loss = lambda k: -np.log(np.clip(np.where(right, 1 / (1 + np.exp(-k * m)), 1 / (1 + np.exp(np.minimum(k * m, 50)))), 1e-9, 1)).mean()
        model.slope = float(min(np.geomspace(0.2, 5, 15), key=loss))
    for l, part in enumerate(model.parts):
        h = np.array([r["h"] for r, x in zip(rows, right, strict=True) if x and r["best"] == l])
        if len(h):
            middle = np.median(h)
            part.limit = float(middle + max(1.5, 8 * 1.4826 * np.median(np.abs(h - middle)), 1.5 * (np.quantile(h, 0.9) - middle)))
    return model


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.scores, self.used = np.zeros((0, len(model.languages)), dtype=np.float32), np.zeros(0, dtype=np.int64)

    def texts(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(summed log probabilities, predicted characters) of each row."""
        m = self.model
        if len(self.index) > CACHE_NUMBERS // len(m.languages):
            self.__init__(m)
        keys, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        listed = keys.tolist()
        at = np.fromiter(map(self.index.get, listed, [-1] * len(listed)), dtype=np.int64, count=len(listed))
        new = np.flatnonzero(at < 0)
        if len(new):
            raw, n = w.data.tobytes(), len(self.index)
            chunks = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)]
            sums, used = m.words(chunks)
            self.index.update(zip([listed[i] for i in new], range(n, n + len(new)), strict=True))
            self.scores, self.used = np.vstack([self.scores, sums]), np.append(self.used, used)
            at[new] = np.arange(n, n + len(new))
        at = at[back]
        sums = np.stack([np.bincount(w.row, self.scores[at, i], minlength=w.rows) for i in range(len(m.languages))], axis=1)
        return sums, np.bincount(w.row, self.used[at], minlength=w.rows)


def _predictions(scorer: _Scorer, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, cross-entropy, rejected) of each row."""
    m = scorer.model
    best, mark, h0, bad = np.full(w.rows, len(m.languages)), np.zeros(w.rows), np.full(w.rows, np.nan), np.ones(w.rows, dtype=bool)
    if m.languages:
        sums, used = scorer.texts(w)
        on = np.flatnonzero(used)
        h = -sums[on] / used[on, None]
        best[on], h0[on] = h.argmin(1), h.min(1)
        gap = np.sort(h, axis=1)[:, 1] - h.min(1) if h.shape[1] > 1 else np.full(len(on), 9.0)
        mark[on] = 1 / (1 + np.exp(-np.minimum(m.slope * gap * np.sqrt(used[on]), 50)))
        bad[on] = h0[on] > np.array([p.limit for p in m.parts])[best[on]] * (1 + 3 / np.sqrt(used[on]))
    return np.array([*m.languages, UNDECIDED], dtype=object)[best], mark, h0, bad


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for every row.

    Null texts and texts without a letter get `und`, score 0 and are rejected; a model without
    languages gives `und` throughout.  Repeated rows and null ids are scored as they are, other
    columns are not read, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(("scorer", name), lambda: _Scorer(shared.value))
        for b in batches:
            for a, w in slices(b.column(1), SLICE_BYTES):
                names, mark, h0, bad = _predictions(scorer, w)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, w.rows), pa.array(names, pa.string()), pa.array(mark), pa.array(h0, from_pandas=True), pa.array(bad)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(score), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model doesn't reject; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(("scorer", name), lambda: _Scorer(shared.value))
        for b in batches:
            for a, w in slices(b.column(place), SLICE_BYTES):
                yield b.slice(a, w.rows).filter(pa.array(~_predictions(scorer, w)[3]))

    return docs.mapInArrow(tidy(keep), docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from four fifths of the rows with a language, predict all; adds held_out to `identify`'s columns.

    held_out: crc32 of the id's text is divisible by 5; rows without an id are held out too.
    """
    model = train(sample(docs, id_col, text_col, lang_col))
    return identify(docs, model, id_col, text_col).withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True)))
