"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

Elements are word shingles.  Hashed darts land on (weight, rank) regions of each element by a Poisson
process that depends on the element alone; a dart counts for a text if it falls under the element's
weight there, and every coordinate keeps its dart of the earliest rank.  Two texts then agree in a
coordinate with the probability of their weighted Jaccard similarity.

Copies are first folded into one representative.  Representatives that share a band are compared with
the band's pivot, the one with most companions; those of one bucket that end up in different classes
are then compared if they share one of their rarest shingles, which no two similar ones fail to do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import keep_rows, materialise, row_mark, salted_join
from .words import FAMILIES, Words, mix64, slices, tidy, worker_cache

SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 25, 5
#: Rank cells are [0, FIRST), [FIRST, 2 FIRST), [2 FIRST, 4 FIRST), ...
FIRST = 2.0**-7
HISTOGRAM = 1 << 16


@cache
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    n = np.arange(1, int(mean + 12 * np.sqrt(mean) + 20))
    return np.cumsum(np.exp(np.append(-mean, -mean + n * np.log(mean) - np.cumsum(np.log(n)))))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(row: np.ndarray, key: np.ndarray, rows: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """k coordinates (dart identities, uint64) for each of `rows` weighted sets of element keys.

    row: the set of each element, ascending.  weight: each element's, 1 if not given; elements then
    may repeat in a set without effect.  Rows without elements have zeros throughout.  Cells of rank
    are thrown in ascending order until a set has all coordinates.
    """
    if weight is not None:  # one unit cell of weight after the other, the last one in part
        cells = np.ceil(weight).astype(np.int64)
        part = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        row, room = np.repeat(row, cells), np.minimum(1.0, np.repeat(weight, cells) - part)
        key = mix64(np.repeat(key, cells) + part.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    out = np.zeros(rows * k, dtype=np.uint64)
    filled = np.zeros(rows * k, dtype=bool)
    low, high, cell = 0.0, FIRST, 0
    while len(key):
        h = mix64(key ^ np.uint64((cell + 1) << 48))
        n = np.searchsorted(_poisson(high - low), _uniform(h), side="right")
        hit = np.flatnonzero(n)
        n, start = n[hit], h[hit]
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        dart = mix64(np.repeat(start, n) + which.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        of = np.repeat(row[hit], n)
        rank, place = _uniform(mix64(dart)), of * k + (dart % np.uint64(k)).astype(np.int64)
        on = ~filled[place]
        if weight is not None:
            on &= _uniform(mix64(dart ^ np.uint64(0x5851F42D4C957F2D))) < np.repeat(room[hit], n)
        place, rank, dart = place[on], rank[on], dart[on]
        order = np.lexsort((rank, place))
        place, dart = place[order], dart[order]
        first = np.append(True, place[1:] != place[:-1])[: len(place)]
        out[place[first]], filled[place[first]] = dart[first], True
        left = ~filled.reshape(rows, k).all(1)
        stay = left[row]
        row, key = row[stay], key[stay]
        if weight is not None:
            room = room[stay]
        low, high, cell = high, high * 2, cell + 1
    return out.reshape(rows, k)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle; a text of fewer words is one shingle, one without words has none."""
    h = w.hashes()
    at, keys = w.windows(h, size)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    whole = whole_texts(w, h, 0)[short]
    row, keys = np.concatenate([w.row[at], short]), np.concatenate([keys, whole])
    order = np.argsort(row, kind="stable")
    return row[order], keys[order]


def whole_texts(w: Words, hashes: np.ndarray, family: int) -> np.ndarray:
    """Hash of each row's whole word sequence."""
    return FAMILIES[family].long_spans(hashes, w.first[:-1], w.first[1:])


def text_keys(w: Words) -> pa.Array:
    """128 bits of each text's word sequence; null for a text without words."""
    keys = np.stack([whole_texts(w, w.hashes(f), f) for f in (0, 1)], axis=1)
    return pa.array([None if z else x.tobytes() for x, z in zip(keys, w.counts == 0, strict=True)], pa.binary())


def signatures(docs: DataFrame, bands: int, band_rows: int, size: int, weighted: bool) -> DataFrame:
    """doc_id, mark, text_key, head (its first 64 bits), bands of rows (doc_id, mark, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none", bool)
        for b in batches:
            for a, w in slices(b.column(2)):
                row, key = shingles(w, size)
                weight = None
                if weighted:
                    order = np.lexsort((key, row))
                    row, key = row[order], key[order]
                    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)])
                    weight = np.diff(np.append(new, len(row))).astype(float)
                    row, key = row[new], key[new]
                sig = dart_signatures(row, key, w.rows, bands * band_rows, weight).reshape(w.rows, bands, band_rows)
                band = np.zeros((w.rows, bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                for i in range(band_rows):
                    band = mix64(band * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, :, i])
                flat = pa.array(band.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(w.rows + 1, dtype=np.int32) * bands), flat)
                head = pa.array(whole_texts(w, w.hashes(), 0).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, w.rows) for i in (0, 1)), text_keys(w), head, lists], ["doc_id", "mark", "text_key", "head", "bands"])

    return docs.select("doc_id", "mark", "text").mapInArrow(tidy(sign), "doc_id long, mark long, text_key binary, head long, bands array<long>")


def shingle_sets(texts: DataFrame, size: int, weighted: bool) -> DataFrame:
    """node, items: the sorted distinct shingles (with their occurrence numbers mixed in if weighted) of rows
    (node, head, text) whose text has a key that begins so."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none", bool)
        for b in batches:
            for a, w in slices(b.column(2)):
                row, key = shingles(w, size)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                same = np.append(False, (row[1:] == row[:-1]) & (key[1:] == key[:-1]))[: len(row)]
                if weighted:
                    run = np.flatnonzero(~same)
                    number = np.arange(len(row)) - np.repeat(run, np.diff(np.append(run, len(row))))
                    key = mix64(key + number.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                else:
                    row, key = row[~same], key[~same]
                at = np.searchsorted(row, np.arange(w.rows + 1)).astype(np.int32)
                out = pa.RecordBatch.from_arrays([b.column(0).slice(a, w.rows), pa.ListArray.from_arrays(pa.array(at), pa.array(key.view(np.int64)))], ["node", "items"])
                yield out.filter(pa.array(b.column(1).slice(a, w.rows).to_numpy() == whole_texts(w, w.hashes(), 0).view(np.int64)))

    return texts.select("node", "head", "text").mapInArrow(tidy(sets), "node long, items array<long>")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, sim, n (pairs of that a): exact similarity of the pairs (a, b).  The pairs of one a are spread over salts."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    met = salted_join(pairs.join(right, "b"), left.join(many, "a"), "a", "n", pairs.count())
    return met.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("sim"), "n")


def rare_heads(sets: DataFrame, similarity: float) -> DataFrame:
    """node, label, hub, d, n, place, item: of every set the items that come first when rare ones do, as many as it
    takes that two sets of the wanted similarity can't do without a common one.

    Rarity is read off a histogram of HISTOGRAM cells, whatever the number of sets; any order would
    give the same links, a rough one only more candidates.
    """
    cell = F.pmod(F.col("item"), F.lit(HISTOGRAM)).cast("int").alias("cell")
    counts = np.zeros(HISTOGRAM, dtype=np.int64)
    for r in sets.select(F.explode("items").alias("item")).groupBy(cell).count().collect():
        counts[r["cell"]] = r["count"]

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            items, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((items, counts[items % HISTOGRAM], row))
            place = np.arange(len(items)) - np.repeat(np.cumsum(n) - n, n)
            chosen = place < np.repeat(n - np.ceil((similarity - 1e-9) * n).astype(np.int64) + 1, n)
            row, items, place = row[chosen], items[order][chosen], place[chosen]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in (0, 2, 3, 4)), pa.array(n[row].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(items)], ["node", "label", "hub", "d", "n", "place", "item"])

    return sets.select("node", "items", "label", "hub", "d").mapInArrow(tidy(head), "node long, label long, hub long, d double, n int, place int, item long")


def _classes(docs: DataFrame, similarity: float, size: int, bands: int, band_rows: int, weighted: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, class_id, best (mark of the class's row with the least id; null for texts without words) of every row.

    All steps work on distinct texts, whatever ids their rows bear: a text is a node, and one row that
    holds it stands for it wherever the text itself is wanted.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_mark(docs).alias("mark"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(signatures(narrow, bands, band_rows, size, weighted))
    known = signed.filter("text_key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    folded = known.groupBy("text_key").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("head").alias("head"))
    folded = materialise(folded.withColumn("node", F.monotonically_increasing_id()))
    bucket = folded.select(F.explode("bands").alias("band"), "node")
    shared = bucket.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(bucket.join(shared, "band"))
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "node")
    pivots = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("i"))).alias("p")).select("band", (-F.col("p.i")).alias("pivot"))
    placed = materialise(members.join(pivots, "band").select("band", "node", "pivot"))
    pairs = materialise(placed.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    # The sets of all that share a bucket are made once; later rounds need no texts.
    wanted = placed.select("node").distinct().join(folded, "node").select("node", "head", F.col("first.mark").alias("mark"))
    texts = narrow.join(wanted.hint("merge"), "mark").dropDuplicates(["mark", "node"])
    sets = materialise(shingle_sets(texts, size, weighted))
    scored = materialise(_verify(pairs, sets))
    links = scored.filter(F.col("sim") >= similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components(links).withColumnRenamed("node", "of")
    # Members of one bucket in different classes may yet be linked: they meet by their rarest shingles.
    apart = placed.join(labels, F.col("node") == F.col("of"), "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    mixed = apart.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
    apart = apart.join(mixed, "band").select("node", "label").distinct()
    # Jaccard distance is a metric: two at distances more than 1 - similarity apart from one hub aren't linked.
    seen = scored.groupBy(F.col("b").alias("node")).agg(F.max(F.struct("n", "a", (1 - F.col("sim")).alias("d"))).alias("h"))
    apart = apart.join(seen, "node", "left").select("node", "label", F.coalesce("h.a", "node").alias("hub"), F.coalesce("h.d", F.lit(0.0)).alias("d"))
    heads = materialise(rare_heads(materialise(sets.join(apart, "node")), similarity))
    x, y = heads.alias("x"), heads.alias("y")
    sizes = F.least("x.n", "y.n") >= F.lit(similarity - 1e-9) * F.greatest("x.n", "y.n")
    # If this is the first common item, at most what follows it in the shorter rest is common too.
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= F.lit((similarity - 1e-9) / (1 + similarity)) * (F.col("x.n") + F.col("y.n"))
    near = (F.col("x.hub") != F.col("y.hub")) | (F.abs(F.col("x.d") - F.col("y.d")) <= 1 - similarity + 1e-9)
    more = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.label") < F.col("y.label")) & sizes & rest & near)
    more = more.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    tried = scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialise(more.join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        found = _verify(more, sets).filter(F.col("sim") >= similarity)
        labels = components(links.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v")))).withColumnRenamed("node", "of")
    named = folded.select("text_key", "node", "first", "copies").join(labels, F.col("node") == F.col("of"), "left").select("text_key", "first", "copies", F.coalesce("label", "node").alias("label"))
    named = materialise(named)
    best = named.groupBy("label").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("n"))
    classes = materialise(salted_join(named.drop("first"), best, "label", "n", named.count()).select("text_key", "copies", "best"))
    told = salted_join(signed.drop("bands", "head"), classes, "text_key", "copies", signed.count())
    alone = F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return told.select("doc_id", "mark", alone.alias("class_id"), F.col("best.mark").alias("best"), F.col("best.doc_id").alias("best_id"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) for every row.

    Texts are linked when the Jaccard similarity of their shingle sets (of the multisets, if weighted)
    is at least `similarity`; classes are the connected components.  Texts with the same words are one
    class whatever their white space.  Rows are told apart by their texts: rows that repeat an id with
    another text are in that text's class, and rows without an id take part (class null only if no row
    of the class has an id).  A null or empty text is a class of its own.  An empty table gives no rows.
    """
    return _classes(docs.select(id_col, text_col), similarity, size, bands, band_rows, weighted, id_col, text_col).select("doc_id", "class_id")


def unlike_documents(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each class of near_classes: the one with the least id, and one without only
    where none has an id.  Texts without words stay.  Rows alike in every column count as one."""
    told = _classes(docs, similarity, size, bands, band_rows, weighted, id_col, text_col)
    kept = F.col("best").isNull() | ((F.col("best") == F.col("mark")) & F.col("best_id").eqNullSafe(F.col("doc_id")))
    return keep_rows(docs, told.select("doc_id", "mark", kept.alias("kept")), id_col)
