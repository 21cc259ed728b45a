"""Subjects of documents: each is assigned the subjects that a share of its sentences are about.

Documents of a language are embedded by term weighting (log frequency, inverse document frequency) and a truncated
singular value decomposition, found by subspace iteration whose products are summed over partitions. Sentences lie in
the same space. Each subject has a seed centroid there, from the labelled documents and the description of the subject;
so has ``none``, what is about no subject. Centroids are refined by assigning every sentence to the nearest by cosine
and averaging, a labelled document's sentences being held to its labels. A word in passing doesn't make a subject: a
document is about a subject if a fifth of its sentences are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.session import cut, rows_of

#: Words of two letters or more, and what ends a sentence, in lower-case text.
_PIECES = re.compile(r"[^\W\d_]{2,}|(?<=[.!?])\s|\n")
NONE = "none"
OTHER = ""  # name of the model that the languages without one of their own share
BLOCK = 128  # terms whose partial sums are one row
SLICE = 1000  # documents worked on at once
SALTS = 64  # sums of one block are added up in so many tasks first


@dataclass(frozen=True)
class Options:
    rank: int = 16  # of the embedding of a language
    passes: int = 4  # of the subspace iteration
    refinements: int = 3
    least_cosine: float = 0.35
    keep: float = 0.3  # weight of the seed in a refined centroid
    share: float = 0.2
    own_terms: int = 8192  # of a language, the most frequent: each has a vector of its own
    shared_terms: int = 2048  # vectors that all its other terms share by hash
    language_documents: int = 50  # least of a language with a model of its own
    languages: int = 200  # with a model of their own, at most; the others share one


def pieces(text: str) -> list[str]:
    """The words of a text in lower case, and a blank or line feed where a sentence ends."""
    return _PIECES.findall(text.lower())


@dataclass
class Terms:
    """Of one model: its own terms with the documents they are in, all its terms and the sum of their documents, and
    its documents."""

    own: dict[str, int]
    terms: int
    held: int
    size: int


def term_table(docs: DataFrame, text: str, lang: str, o: Options) -> dict[str, Terms]:
    """Model -> its terms, over all documents that name their language; one pass over the texts. Languages that are
    rarer than the options ask are the model OTHER together."""
    named = docs.where(F.col(lang).isNotNull() & (F.trim(lang) != ""))
    sizes = named.groupBy(F.col(lang).alias("l")).count()
    large = {r[0]: r[1] for r in sizes.where(F.col("count") >= o.language_documents).orderBy(F.desc("count"), "l").limit(o.languages).collect()}
    rest = sizes.where(~F.col("l").isin(list(large))).agg(F.sum("count")).first()[0]
    model = F.when(F.col(lang).isin(list(large)), F.col(lang)).otherwise(OTHER)
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]{2,})"), 1))
    counts = named.select(model.alias("l"), F.explode(words).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    counts = cut(counts)
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))).where(F.col("r") <= o.own_terms)
    out = {k: Terms({}, 0, 0, n) for k, n in [*large.items(), *([(OTHER, rest)] if rest else [])]}
    for r in ranked.select("l", "w", "n").toLocalIterator():  # at most own_terms a model
        out[r["l"]].own[r["w"]] = r["n"]
    for r in counts.groupBy("l").agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect():
        out[r["l"]].terms, out[r["l"]].held = r["c"], r["s"]
    return out


class Coder:
    """Words to term numbers: a model's own terms have one each, its others share shared_terms by hash, so every word
    counts. A document that names no language gets the model its words are likeliest in."""

    def __init__(self, tables: dict[str, Terms], o: Options):
        self.models = sorted(tables)
        self.index, self.first, self.idf, self.share, self.rare = {}, {}, {}, {}, {}
        for k, t in tables.items():
            self.index[k] = {w: i for i, w in enumerate(sorted(t.own))}
            self.first[k] = len(t.own)
            others = t.terms - len(t.own)
            mean = (t.held - sum(t.own.values())) / others if others else 1.0
            own = [max(np.log(t.size / t.own[w]), 1e-3) for w in self.index[k]]
            self.idf[k] = np.array(own + [max(np.log(t.size / max(mean, 1.0)), 1e-3)] * (o.shared_terms if others else 0), np.float64)
            self.share[k] = {w: np.log((n + 0.5) / (t.size + 1)) for w, n in t.own.items()}
            self.rare[k] = np.log(0.5 / (t.size + 1))
        self.shared = o.shared_terms

    def model(self, named: str | None, words: list[str]) -> str | None:
        if named and named.strip():
            return named if named in self.index else OTHER if OTHER in self.index else None
        distinct = {w for w in words if len(w) > 1}
        best = None
        for k in self.models:
            s, rare = self.share[k], self.rare[k]
            v = sum(s.get(w, rare) for w in distinct)
            if best is None or v > best[0]:
                best = (v, k)
        return best[1] if best and distinct else None

    def numbers(self, model: str, found: list[str]) -> tuple[list[int], list[int]]:
        """(terms of the words of pieces, number of terms at the end of each sentence that has words)."""
        index, first = self.index[model], self.first[model]
        every = len(self.idf[model]) > first
        ids: list[int] = []
        ends: list[int] = []
        words = False
        for w in found:
            i = index.get(w)
            if i is not None:
                ids.append(i)
                words = True
            elif len(w) > 1:
                if every:
                    ids.append(first + zlib.crc32(w.encode()) % self.shared)
                words = True
            elif words:
                ends.append(len(ids))
                words = False
        if words:
            ends.append(len(ids))
        return ids, ends


def encode(docs: DataFrame, row_id: str, text: str, lang: str, coder: Coder) -> DataFrame:
    """(row_id, labels, model, terms, ends, own, counts): the terms of a document's sentences, run together, where each
    sentence ends, and the document's distinct terms with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                models, terms, ends, own, counts = [], [], [], [], []
                for t, named in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()):
                    found = pieces(t) if t else []
                    # What ends a sentence is one character, a word is two at least.
                    k = c.model(named, found)
                    ids, stops = c.numbers(k, found) if k is not None else ([], [])
                    flat = np.array(ids, np.int32)
                    distinct, n = np.unique(flat, return_counts=True)
                    models.append(k)
                    terms.append(flat)
                    ends.append(np.array(stops, np.int32))
                    own.append(distinct)
                    counts.append(n.astype(np.int32))
                lists = [_lists(x) for x in (terms, ends, own, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_labels"), pa.array(models, pa.string()), *lists], names=[row_id, "labels", "lang", "terms", "ends", "own", "counts"])

    return docs.select(F.col(row_id).alias("_id"), F.col("_labels"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).mapInArrow(run, f"`{row_id}` {dict(docs.dtypes)[row_id]}, labels array<string>, lang string, terms array<int>, ends array<int>, own array<int>, counts array<int>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)))


_SUMS = "lang string, block int, y array<double>"


def added_up(parts: DataFrame) -> list:
    """The sums of y (arrays of one length) of each (lang, block), as rows. parts: (lang, block, salt, y). They are
    added in two steps by tasks that hold one sum at a time of each block, so the number of parts does not matter."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for f in frames:
            for k, b, y in zip(f["lang"], f["block"], f["y"]):
                got = sums.get((k, b))
                sums[k, b] = np.array(y, float) if got is None else got + y
        yield pd.DataFrame([(k, b, y) for (k, b), y in sums.items()], columns=["lang", "block", "y"])

    first = parts.repartition("lang", "block", "salt").select("lang", "block", "y").mapInPandas(add, _SUMS)
    return first.repartition("lang", "block").mapInPandas(add, _SUMS).collect()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(model, its rows) of slices of the batches, so that what is worked on at once stays small."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            for k in sorted(x for x in pc.unique(batch.column("lang")).to_pylist() if x is not None):
                yield k, batch.filter(pc.equal(batch.column("lang"), k))


def _flat(arrays: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all arrays, length of each)."""
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(arrays).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(rows: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
    y = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32)), pa.array(np.concatenate([r[3] for r in rows]) if rows else np.zeros(0)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), y], names=["lang", "block", "salt", "y"])


def _segment_sums(x: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, lens of them for each output row (also none)."""
    out = np.zeros((len(lens), x.shape[1]), x.dtype)
    some = lens > 0
    if some.any():
        out[some] = np.add.reduceat(x, (np.cumsum(lens) - lens)[some], axis=0)
    return out


def _products(coded: DataFrame, coder: Coder, basis: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """X'X q for each language's basis q, X being its weighted and normalised documents."""
    shared = coded.sparkSession.sparkContext.broadcast((coder.idf, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = shared.value
        sums: dict[str, np.ndarray] = {}
        for k, g in _groups(batches):
            term, per_doc = _flat(g.column("own"))
            if not len(term):
                continue
            count, _ = _flat(g.column("counts"))
            doc = np.repeat(np.arange(g.num_rows), per_doc)
            w = np.log1p(count) * idf[k][term]
            w /= np.maximum(np.sqrt(np.bincount(doc, weights=w * w, minlength=g.num_rows))[doc], 1e-12)
            part = w[:, None] * _segment_sums(w[:, None] * q[k][term], per_doc)[doc]
            order = np.argsort(term, kind="stable")
            here, first = np.unique(term[order], return_index=True)
            sums.setdefault(k, np.zeros_like(q[k]))[here] += np.add.reduceat(part[order], first, axis=0)
        salt = TaskContext.get().partitionId() % SALTS
        for k, y in sums.items():
            yield _parts([(k, b, salt, y[b * BLOCK : (b + 1) * BLOCK].ravel()) for b in range(-(-len(y) // BLOCK))])

    parts = added_up(coded.where("lang IS NOT NULL").select("lang", "own", "counts").mapInArrow(run, _SUMS.replace("y ", "salt int, y ")))
    out = {k: np.zeros_like(q) for k, q in basis.items()}
    for r in parts:  # (own_terms + shared_terms) / BLOCK rows a model at most
        y = np.array(r["y"]).reshape(-1, basis[r["lang"]].shape[1])
        out[r["lang"]][r["block"] * BLOCK : r["block"] * BLOCK + len(y)] = y
    return out


def embed_terms(coded: DataFrame, coder: Coder, o: Options) -> dict[str, np.ndarray]:
    """Term vectors of each language: weight times right singular vectors."""
    rng = np.random.default_rng(0)
    basis = {k: np.linalg.qr(rng.standard_normal((len(v), min(len(v), o.rank + 8))))[0] for k, v in coder.idf.items() if len(v)}
    vectors: dict[str, np.ndarray] = {}
    for step in range(o.passes):
        z = _products(coded, coder, basis)
        for k, q in basis.items():
            if step + 1 < o.passes:
                basis[k] = np.linalg.qr(z[k])[0]
            else:
                small = q.T @ z[k]
                w, u = np.linalg.eigh((small + small.T) / 2)
                vectors[k] = q @ u[:, np.argsort(-w)[: o.rank]]
    return {k: (coder.idf[k][:, None] * v).astype(np.float32) for k, v in vectors.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _embedded(g: pa.RecordBatch, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the sentences of some documents of a language, row of g of each)."""
    terms, _ = _flat(g.column("terms"))
    ends, n = _flat(g.column("ends"))
    doc = np.repeat(np.arange(g.num_rows), n)
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    lens = ends - np.where(first, 0, np.concatenate([[0], ends[:-1]])) if len(ends) else ends
    return _unit(_segment_sums(vectors[terms], lens)) if len(ends) else np.zeros((0, vectors.shape[1])), doc


def _centroid_sums(coded: DataFrame, vectors: dict[str, np.ndarray], names: list[str], centroids: dict[str, np.ndarray] | None, o: Options) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """language -> (sum of sentence vectors of each class, their number). Without centroids, of the sentences of the
    documents labelled with that class and no other; with them, of the sentences nearest to it."""
    shared = coded.sparkSession.sparkContext.broadcast((vectors, names, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, cls, cen = shared.value
        number = {c: i for i, c in enumerate(cls)}
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, np.ndarray] = {}
        for k, g in _groups(batches):
            if k not in vec:
                continue
            e, doc = _embedded(g, vec[k])
            labels = [set() if x is None else {y for y in x if y in number} for x in g.column("labels").to_pylist()]
            if cen is None:
                alone = np.array([number[next(iter(x))] if len(x) == 1 else -1 for x in labels], int)
                of = alone[doc] if len(doc) else np.zeros(0, int)
                ok = of >= 0
            else:
                sim = e @ cen[k].T
                allowed = np.array([[not x or c in x or c == NONE for c in cls] for x in labels]).reshape(len(labels), len(cls))
                sim = np.where(allowed[doc], sim, -9.0) if len(doc) else sim
                of = sim.argmax(1) if len(doc) else np.zeros(0, int)
                ok = sim.max(1) >= o.least_cosine if len(doc) else np.zeros(0, bool)
            s = sums.setdefault(k, np.zeros((len(cls), vec[k].shape[1])))
            n = counts.setdefault(k, np.zeros(len(cls)))
            np.add.at(s, of[ok], e[ok])
            n += np.bincount(of[ok], minlength=len(cls))
        salt = TaskContext.get().partitionId() % SALTS
        yield _parts([(k, i, salt, np.append(s[i], counts[k][i])) for k, s in sums.items() for i in range(len(cls)) if counts[k][i]])

    usable = "lang IS NOT NULL" if centroids is not None else "lang IS NOT NULL AND labels IS NOT NULL"
    rows = added_up(coded.select("lang", "labels", "terms", "ends").where(usable).mapInArrow(run, _SUMS.replace("y ", "salt int, y ")))
    out = {k: (np.zeros((len(names), v.shape[1])), np.zeros(len(names))) for k, v in vectors.items()}
    for r in rows:  # one row for each language and class
        out[r["lang"]][0][r["block"]] = r["y"][:-1]
        out[r["lang"]][1][r["block"]] = r["y"][-1]
    return out


def assign_subjects(docs: DataFrame, row_id: str, text: str, lang: str, subjects: DataFrame, labels: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """(row_id, subject, sentences, share, model): the subjects of each document, perhaps none; model is the language
    whose terms it was read with, or empty for the model that rare languages share.

    subjects: (subject, description), a few rows. labels: (doc_id, subject) of some documents, any number, a subject
    'none' for those without one; without labels the descriptions are the seeds alone. Terms, weights and centroids are
    summed over all documents. Documents without a language get the one their words are likeliest in; documents
    without text have no subjects; repeated rows are assigned each. An empty table gives an empty result. More than
    BROADCAST_ROWS subjects raise ValueError.
    """
    o = options or Options()
    described = {r["subject"]: r["description"] or "" for r in rows_of(subjects.where("subject IS NOT NULL").select("subject", "description").orderBy("subject"))}
    names = [*sorted(described), NONE]
    rows = docs.select(row_id, text, lang)
    if labels is not None:
        told = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy(F.col("doc_id").alias(row_id)).agg(F.array_sort(F.collect_set("subject")).alias("_labels"))
        rows = rows.join(told, row_id, "left")
    else:
        rows = rows.withColumn("_labels", F.lit(None).cast("array<string>"))
    coder = Coder(term_table(rows, text, lang, o), o)
    coded = cut(encode(rows, row_id, text, lang, coder))
    vectors = embed_terms(coded, coder, o)
    seeds = {}
    for k, (s, n) in _centroid_sums(coded, vectors, names, None, o).items():
        c = _unit(s)
        for i, name in enumerate(names):
            if not n[i] and name in described:
                known = [coder.index[k][w] for w in pieces(described[name]) if w in coder.index[k]]
                c[i] = _unit(vectors[k][known].sum(axis=0)) if known else 0.0
        seeds[k] = c
    centroids = seeds
    for _ in range(o.refinements):
        moved = _centroid_sums(coded, vectors, names, centroids, o)
        centroids = {k: np.where(moved[k][1][:, None] > 0, _unit(o.keep * seeds[k] + (1 - o.keep) * _unit(moved[k][0])), seeds[k]) for k in seeds}
    shared = docs.sparkSession.sparkContext.broadcast((vectors, names, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, cls, cen = shared.value
        for k, g in _groups(batches):
            if k not in vec:
                continue
            e, doc = _embedded(g, vec[k])
            if not len(doc):
                continue
            sim = e @ cen[k].T
            of = np.where(sim.max(1) >= o.least_cosine, sim.argmax(1), len(cls) - 1)
            count = np.bincount(doc * len(cls) + of, minlength=g.num_rows * len(cls)).reshape(g.num_rows, len(cls))
            total = count.sum(axis=1)
            d, c = np.nonzero((count[:, :-1] > 0) & (count[:, :-1] >= o.share * total[:, None] - 1e-9))
            names_of = pa.array([cls[i] for i in c], pa.string())
            yield pa.RecordBatch.from_arrays([g.column(row_id).take(pa.array(d)), names_of, pa.array(count[d, c].astype(np.int64)), pa.array(count[d, c] / total[d]), pa.array([k] * len(d), pa.string())], names=[row_id, "subject", "sentences", "share", "model"])

    return coded.where("lang IS NOT NULL").select(row_id, "lang", "terms", "ends").mapInArrow(run, f"`{row_id}` {dict(docs.dtypes)[row_id]}, subject string, sentences bigint, share double, model string")
