"""Freely typed values mapped to the closest entry of a reference list.

The distinct values are normalised, their character n-grams look up candidates in an inverted index of the list's
labels, candidates are scored by weighted cosine, and the best entry is accepted above a threshold and with a margin
over the next entry; other values are reported as unmatched. Swapped letters destroy most grams of a short name, so a
label within a few edits of the value is scored by its edits; every acceptance passes the threshold and the margin.
A list of any length is cut into shards, whose candidates are put together.
"""

from __future__ import annotations

import math
import re
import zlib
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.session import BROADCAST_ROWS, cut, small

#: Words around a name that say nothing about it, and marks of branches and deliveries.
QUALIFIERS = frozenset("lab test level result results serum plasma venous fasting auto via the performed at by main gmbh inc ltd llc send out branch".split())
_MARK = re.compile(r"#\s*\d+|\bbranch\s*\d+|\(\s*ref\.?\s*lab\s*\)")
_SAMPLE = re.compile(r"\s-\s*(blood|serum|plasma|urine)\s*$|^\s*s-(?=\w)|[,(]\s*(blood|urine|serum|plasma|venous|fasting)\s*\)?\s*$")
# Characters that recognition software and hasty fingers confuse; one of each group stands for all.
CONFUSED = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "$": "s"})


SAID_NOTHING = frozenset(w.translate(CONFUSED) for w in QUALIFIERS)


def normalise(text: str, whole: bool = False) -> list[str]:
    """The words of a value in one form: compatibility characters, case, accents, punctuation and confusable
    characters folded, qualifiers left out unless nothing else is there (or whole)."""
    s = unicodedata.normalize("NFKC", text).casefold().strip()
    s = _SAMPLE.sub(" ", _MARK.sub(" ", s))
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    words = re.findall(r"[^\W_]+", s.replace("|", "l").replace("!", "l"))
    kept = words if whole else [w for w in words if w not in QUALIFIERS]
    return [w.translate(CONFUSED) for w in (kept or words)]


def grams(words: list[str]) -> dict[str, float]:
    """Counts of the 2- and 3-grams of the words run together, so that a space lost or moved changes nothing, plus the
    first letter of each word."""
    s = "^" + "".join(words) + "$"
    out: dict[str, float] = defaultdict(float)
    for n in (2, 3):
        for i in range(len(s) - n + 1):
            out[s[i : i + n]] += 1.0
    return dict(out)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours from a to b; most + 1 if there are more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        older, last = last, row
    return min(last[-1], most + 1)


SLOTS = 1 << 20  # grams are counted by hash in so many slots, which bounds the table of their weights
CLOSE = (1.0, 0.9, 0.8, 0.7)  # score of a label by its edits
SHORT = 0.85  # score of a label of which the value is a shortened form
BEHIND = 0.6  # part of its cosine that a label out of reach counts while another is in reach
Candidate = tuple[str, float, int, bool]  # entry, cosine, edits if in reach, else -1, the value is a shortened form of it


@lru_cache(maxsize=500_000)
def slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) & (SLOTS - 1)


def forms(label: str) -> list[tuple[str, ...]]:
    """The word forms of a label that have words."""
    return [w for w in dict.fromkeys((tuple(normalise(label)), tuple(normalise(label, True)))) if w]


def reach(length: int) -> int:
    """Edits within which a value counts as a misspelling of a label of so many letters."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 11 else 3


@dataclass
class GramIndex:
    """Inverted index of the labels of a list (or of a shard of it): gram -> postings (label number, count).

    seen: slot -> entries with a gram of it, and entries of the whole list; counted from the labels if not given."""

    labels: list[tuple[str, str]]
    seen: dict[int, int] | None = None
    entries: int | None = None
    keys: list[str] = field(default_factory=list)
    strings: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    exact: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    postings: dict[str, list[tuple[int, float]]] = field(default_factory=lambda: defaultdict(list))
    norms: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        rows = []
        for key, words in dict.fromkeys((key, w) for key, label in self.labels for w in forms(label)):
            self.keys.append(key)
            self.strings.append("".join(words))
            self.words.append(words)
            rows.append(grams(list(words)))
            self.exact["".join(words)].add(key)
            self.exact["".join(sorted(words))].add(key)
        if self.seen is None:
            held: dict[int, set[str]] = defaultdict(set)
            for key, g in zip(self.keys, rows):
                for x in g:
                    held[slot(x)].add(key)
            self.seen, self.entries = {s: len(k) for s, k in held.items()}, len(set(self.keys))
        for i, g in enumerate(rows):
            self.norms.append(math.sqrt(sum((c * self.weight(x)) ** 2 for x, c in g.items())))
            for x, c in g.items():
                self.postings[x].append((i, c))

    def weight(self, gram: str) -> float:
        n = max(self.entries or 0, 1)
        return math.log((1 + n) / (1 + self.seen.get(slot(gram), 0))) + 1

    def candidates(self, text: str) -> list[Candidate]:
        """The entries in reach of the text or shortened by it, and the two nearest others by the weighted cosine of
        their grams. A label in reach shares all 2-grams but three for each edit, which leaves few to compare letter by
        letter and none out."""
        both = [normalise(text), normalise(text, True)]
        if set(both[1]) <= SAID_NOTHING:
            return []
        cosine: dict[str, float] = {}
        edited: dict[str, int] = {}
        short: set[str] = set()
        for words in both:
            s = "".join(words)
            for key in self.exact.get(s, set()) | self.exact.get("".join(sorted(words)), set()):
                cosine[key], edited[key] = 1.0, 0
        if not edited:
            for words in dict.fromkeys(tuple(w) for w in both):
                s = "".join(words)
                dots: dict[int, float] = defaultdict(float)
                common: dict[int, float] = defaultdict(float)
                norm = 0.0
                for x, c in grams(list(words)).items():
                    w = self.weight(x)
                    norm += (c * w) ** 2
                    for i, n in self.postings.get(x, ()):
                        dots[i] += c * n * w * w
                        if len(x) == 2:
                            common[i] += min(c, n)
                norm = math.sqrt(norm)
                begins = max(map(len, words)) > 3
                for i, d in dots.items():
                    key, label = self.keys[i], self.strings[i]
                    near = d / (norm * self.norms[i])
                    if near > cosine.get(key, 0.0):
                        cosine[key] = near
                    most = reach(len(label))
                    if abs(len(label) - len(s)) <= most and common[i] >= max(len(label), len(s)) + 1 - 3 * most and (e := edits(s, label, most)) <= most:
                        edited[key] = min(edited.get(key, 99), e)
                    # A value all of whose words begin the words of a label is a shortened form of it.
                    if begins and near >= 0.5 and len(words) == len(self.words[i]) and all(x.startswith(y) and len(y) > 2 for x, y in zip(self.words[i], words)):
                        short.add(key)
        named = set(edited) | short
        others = sorted((k for k in cosine if k not in named), key=lambda k: (-cosine[k], k))[:2]
        return [(k, cosine[k], edited.get(k, -1), k in short) for k in [*sorted(named), *others]]

    def best(self, text: str) -> tuple[str | None, float, float]:
        return decide(self.candidates(text))


def decide(candidates: list[Candidate]) -> tuple[str | None, float, float]:
    """(entry, its score, the score of the next entry). Labels equal to the value leave out all others; while labels are
    in reach, they are scored by their edits, and the others count less; else while entries are shortened, they are;
    else the cosine is the score."""
    candidates = [c for c in candidates if c[1] == 1.0 and c[2] == 0] or candidates
    reached = any(e >= 0 for _, _, e, _ in candidates)
    shortened = not reached and any(s for *_, s in candidates)

    def score(c: Candidate) -> float:
        if reached:
            return CLOSE[c[2]] if c[2] >= 0 else BEHIND * c[1]
        if shortened:
            return SHORT if c[3] else BEHIND * c[1]
        return c[1]

    best: dict[str, float] = {}
    for c in candidates:
        best[c[0]] = max(best.get(c[0], 0.0), score(c))
    ranked = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))
    if not ranked:
        return None, 0.0, 0.0
    return ranked[0][0], ranked[0][1], ranked[1][1] if len(ranked) > 1 else 0.0


_CANDIDATES = "array<struct<key: string, cosine: double, edits: int, short: boolean>>"


def _sharded(asked: DataFrame, labels: DataFrame, shard: int) -> DataFrame:
    """(list_name, value, found: _CANDIDATES) for lists of any length: labels are cut by hash into shards of about
    ``shard``, values into parts of about as many; a task holds one shard's index and one part. What is sent to all is
    the table of gram weights, which has at most SLOTS rows a list."""

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = {(n, slot(g), k) for n, k, x in zip(f["list_name"], f["key"], f["label"]) for w in forms(x) for g in grams(list(w))}
            yield pd.DataFrame(sorted(rows), columns=["list_name", "slot", "key"])

    per_slot = labels.mapInPandas(slots, "list_name string, slot int, key string").distinct().groupBy("list_name", "slot").count().toPandas()
    usable = F.udf(lambda x: bool(forms(x)), "boolean")
    entries = {r[0]: r[1] for r in labels.where(usable("label")).groupBy("list_name").agg(F.countDistinct("key")).collect()}
    tables = {n: dict(zip(g["slot"].to_numpy().tolist(), g["count"].to_numpy().tolist())) for n, g in per_slot.groupby("list_name")}
    shared = asked.sparkSession.sparkContext.broadcast((tables, entries))
    shards, parts = max(1, -(-labels.count() // shard)), max(1, -(-asked.count() // shard))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("list_name", "value", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int").alias("part"), every(shards).alias("shard"))
    right = labels.select("list_name", "key", "label", F.pmod(F.xxhash64("key", "label"), F.lit(shards)).cast("int").alias("shard"), every(parts).alias("part"))

    def compare(key: tuple, values: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        seen, n = shared.value
        index = GramIndex(sorted(zip(some["key"], some["label"])), seen.get(key[0], {}), n.get(key[0], 0))
        found = [[dict(zip(("key", "cosine", "edits", "short"), c)) for c in index.candidates(v)] for v in values["value"]]
        return pd.DataFrame({"list_name": values["list_name"], "value": values["value"], "found": pd.Series(found, index=values.index, dtype=object)})

    by = ["list_name", "shard", "part"]
    got = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, f"list_name string, value string, found {_CANDIDATES}")
    return got.groupBy("list_name", "value").agg(F.flatten(F.collect_list("found")).alias("found"))


def match(values: DataFrame, reference: DataFrame, threshold: float = 0.62, margin: float = 0.06, shard: int = BROADCAST_ROWS) -> DataFrame:
    """(list_name, value, entry_key, candidate, score, margin): one row for each distinct (list_name, value) of values
    that is neither null nor blank; entry_key is null where no entry is accepted.

    reference: (list_name, key, label). Up to ``shard`` labels are one index that every task is given; a longer list is
    compared shard by shard, with the same result. Values are deduplicated with a partial step before the shuffle, so
    a value that fills a third of all rows costs one comparison. Values of lists that have no labels, and of the null list, match nothing.
    Empty tables give empty results.
    """
    listed = reference.where("list_name IS NOT NULL AND key IS NOT NULL AND label IS NOT NULL").select("list_name", "key", "label").distinct()
    asked = filled(values).select("list_name", "value").distinct()
    spark = values.sparkSession
    labels = [tuple(r) for r in listed.limit(shard + 1).collect()]
    if len(labels) <= shard:
        by_list: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for name, key, label in sorted(labels, key=lambda r: tuple(x or "" for x in r)):
            by_list[name].append((key, label))
        shared = spark.sparkContext.broadcast({n: GramIndex(x) for n, x in by_list.items()})

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            none = GramIndex([])
            for f in frames:
                got = [shared.value.get(n, none).best(v) for n, v in zip(f["list_name"], f["value"])]
                yield pd.DataFrame({"list_name": f["list_name"], "value": f["value"], "candidate": [k for k, *_ in got], "score": [g[1] for g in got], "margin": [g[1] - g[2] for g in got]})

        rows = asked
    else:

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = [decide([(c["key"], c["cosine"], c["edits"], c["short"]) for c in x]) for x in f["found"]]
                yield pd.DataFrame({"list_name": f["list_name"], "value": f["value"], "candidate": [k for k, *_ in got], "score": [g[1] for g in got], "margin": [g[1] - g[2] for g in got]})

        rows = _sharded(asked, listed, shard)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: small bytes, much to compute
    scored = rows.repartition(tasks).mapInPandas(score, "list_name string, value string, candidate string, score double, margin double")
    taken = (F.col("score") >= threshold) & (F.round("margin", 9) >= margin)
    return scored.select("list_name", "value", F.when(taken, F.col("candidate")).alias("entry_key"), "candidate", "score", "margin")


def filled(values: DataFrame) -> DataFrame:
    return values.where(F.col("value").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}]"))


def map_fields(rows: DataFrame, row_id: str, fields: dict[str, str], reference: DataFrame, literal: DataFrame, **options: float) -> DataFrame:
    """(row_id, field_name, entry_key or 'none'): one row for each row and field whose value is neither null nor blank
    nor literally one of the field's labels.

    fields: field_name -> list_name. reference: as in match. literal: (field_name, label). The mapping is written to a
    checkpoint and joined back by broadcast where it is small; else by shuffle, where AQE splits a hot value's rows, as
    the mapping has each value once. Repeated rows are kept; null ids are kept as null; whole values are compared.
    """
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(n).alias("list_name"), F.col(f).alias("value")) for f, n in fields.items()]))
    long = filled(rows.select(F.col(row_id).alias("_id"), one.alias("_x")).select("_id", "_x.*"))
    asked = long.join(small(literal.select("field_name", F.col("label").alias("value")).distinct()), ["field_name", "value"], "left_anti")
    mapping = cut(match(asked, reference, **options).select("list_name", "value", "entry_key"))
    return asked.join(small(mapping), ["list_name", "value"], "left").select(F.col("_id").alias(row_id), "field_name", F.coalesce("entry_key", F.lit("none")).alias("entry_key"))
