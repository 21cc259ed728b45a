"""Scanned pages repaired into continuous paragraphs.

Running heads are lines at the page's edges that come again, perhaps damaged, at the same edge of the document's other
pages; page numbers are edge lines that count the pages; words broken at line ends are joined when the corpus
vocabulary knows the whole; misread words are those that a known confusion of characters turns into a word many times
as frequent. Words count by how often the whole corpus has them: the most frequent are sent to all tasks, the counts of
rarer ones that a block of pages asks for are joined to it. Documents are cut into blocks of pages that also get the
pages beside them, so that a document of any length is spread over tasks; paragraphs that run on are put together.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.flow import over_keys
from vitalframe.session import cut, small

# What recognition software writes for what stands there.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("+", "t"), ("1", "i"), ("1", "l"), ("l", "i"), ("i", "l"), ("|", "l"), ("|", "i"), ("!", "l"), ("@", "a"), ("5", "s"), ("$", "s"), ("0", "o"), ("9", "g"), ("8", "b"), ("6", "b"), ("3", "e"), ("7", "t"), ("4", "a"), ("2", "z"),
    ("ri", "n"), ("rn", "m"), ("m", "rn"), ("nn", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("li", "h"), ("b", "h"), ("h", "b"), ("vv", "w"), ("fi", "h"), ("in", "m"), ("tl", "d"), ("ll", "u"), ("ü", "ii"), ("f", "t"), ("t", "f"), ("o", "a"), ("n", "u"), ("u", "n"), ("o", "0"), ("ı", "i"), ("ſ", "f"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("€", "e"), ("¢", "c"), ("£", "e"), ("(", "c"), ("{", "c"),
)
#: Confusions that also turn words into other words; they need more evidence.
WEAK = frozenset([("e", "c"), ("h", "b"), ("f", "t"), ("t", "f"), ("o", "a"), ("n", "u"), ("u", "n"), ("in", "m"), ("d", "cl"), ("nn", "m"), ("i", "l"), ("l", "i"), ("ll", "u"), ("fi", "h"), ("tl", "d"), ("li", "h")])
DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "Q": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "G": "6", "b": "6"})
_NUMERIC = re.compile(r"^[\dlI|OoSsBZ]+(?:[-/.,:][\dlI|OoSsBZ]+)*%?$")
_ALONE = re.compile(r"^(?:[lSO|]|[lSO|]{2})$")
_ENDS = "\u2010\u2011\u00ac\u00ad-"  # the hyphen last, so that a character class may hold them as they are
_BROKEN = re.compile(rf"[^\s{_ENDS}][{_ENDS}]\s*$")
_EDGE = "\"'“”‘’„«»()[]{}<>.,;:!?*_–—"
_JOINERS = frozenset("and or to und oder bis y o e u et".split())
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_PAGE = re.compile(r"^[\W_]*(?:(?:pages?|pg|p|seite|s|página|pág|blatt|sheet)[\s.:]*)?(?P<n>[\dlI|OoSsB]{1,5}|[ivxlcIVXLC]{1,7})(?:\s*(?:of|/|von|de|aus|out of)\s*[\dlI|OoSsB]{1,5})?[\W_]*$", re.I)
HALO = 3  # pages beside a block
LEAST = 3  # times the corpus must have a word for it to count; rarer ones count as seen once
SENT = 500_000  # words, the most frequent, that are sent to all tasks
LAST = 1_000_000_000  # number of pages that have none
AHEAD = 5  # lines behind a broken word that are looked at in any case, besides those of its page and the next
CROWD = 4  # times as many pages as a block has numbers make a crowd


def variants(word: str) -> tuple[list[tuple[str, bool]], list[str]]:
    """(what one confusion makes of a word, with whether it is a weak one; what two make of it, the second not weak and
    the word long enough)."""
    one: list[tuple[str, bool]] = []
    two: list[str] = []
    for wrong, right in CONFUSIONS:
        at = word.find(wrong)
        while at >= 0:
            one.append((word[:at] + right + word[at + len(wrong) :], (wrong, right) in WEAK))
            at = word.find(wrong, at + 1)
    if len(word) >= 5:
        for v in {v for v, _ in one}:
            for wrong, right in CONFUSIONS:
                if (wrong, right) not in WEAK:
                    at = v.find(wrong)
                    while at >= 0:
                        two.append(v[:at] + right + v[at + len(wrong) :])
                        at = v.find(wrong, at + 1)
    return one, two


@dataclass
class Vocabulary:
    """Words with their counts in the corpus, of those that it has LEAST times or more."""

    counts: Mapping[str, int]
    ratio: float = 8.0
    weak_ratio: float = 40.0
    known: dict[str, str | None] = field(default_factory=dict)
    seen: dict[str, str | None] = field(default_factory=dict)

    def fix(self, word: str) -> str | None:
        """The word of the vocabulary that a lower-case word was misread from, or None if it is none's misreading."""
        n = max(self.counts.get(word, 0), 1)
        get = self.counts.get
        best: tuple[int, str] | None = None
        first: set[str] = set()
        for wrong, right in CONFUSIONS:
            at = word.find(wrong)
            if at < 0:
                continue
            need = max(n * (self.weak_ratio if (wrong, right) in WEAK else self.ratio), LEAST)
            while at >= 0:
                v = word[:at] + right + word[at + len(wrong) :]
                first.add(v)
                c = get(v, 0)
                if c >= need and (best is None or (c, v) > best):
                    best = (c, v)
                at = word.find(wrong, at + 1)
        if best or len(word) < 5:
            return best and best[1]
        need = max(n * self.weak_ratio, LEAST)
        for v in first:
            for wrong, right in CONFUSIONS:
                if (wrong, right) in WEAK:
                    continue
                at = v.find(wrong)
                while at >= 0:
                    u = v[:at] + right + v[at + len(wrong) :]
                    c = get(u, 0)
                    if c >= need and u != word and (best is None or (c, u) > best):
                        best = (c, u)
                    at = v.find(wrong, at + 1)
        return best and best[1]

    def of_word(self, word: str) -> str | None:
        """What a word with its punctuation should be, if it is misread; words as they stand are judged once."""
        if word not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
            token = core(word)
            self.seen[word] = self.correction(token) if token else None
        return self.seen[word]

    def correction(self, token: str) -> str | None:
        """What a token without its punctuation should be, if it is misread."""
        low = token.lower()
        got = self.cache(low if not _NUMERIC.match(token) and not _ALONE.match(token) else token)
        return got

    def cache(self, token: str) -> str | None:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = self.judge(token)
        return self.known[token]

    def judge(self, token: str) -> str | None:
        low = token.lower()
        if token.isdigit():
            return None
        if _NUMERIC.match(token) and any(c.isdigit() for c in token):
            as_word = self.fix(low) if sum(c.isalpha() for c in token) > 1 else None
            if as_word and as_word.isalpha():
                return as_word
            if any(c.isalpha() or c == "|" for c in token):
                number = token.translate(DIGITS)
                n = self.counts.get(low, 0)
                return number if n < 3 or self.counts.get(number, 0) >= 5 * n else None
            return None
        if _ALONE.match(token):
            number = token.translate(DIGITS)
            n = self.counts.get(low, 0)
            return number if number.isdigit() and (n < 3 or self.counts.get(number, 0) >= 3 * n) else None
        if len(low) < 2 or not any(c.isalpha() for c in low):
            return None
        parts = [p for p in re.split(r"[-/–]", low) if p]
        if low not in self.counts and len(parts) > 1 and all(p.isalpha() and self.counts.get(p, 0) >= 3 and not self.fix(p) for p in parts):
            return None
        return self.fix(low)


def core(word: str) -> str:
    return word.strip(_EDGE)


def vocabulary(pages: DataFrame, text: str, sent: int = SENT) -> tuple[dict[str, int], DataFrame | None]:
    """(the most frequent words with their counts, at most ``sent``; the other words with theirs (w, n), None if there
    are none) of the corpus's words. Words broken at line ends are left out with both their parts. Words are counted
    over all pages, before the shuffle; what comes to the driver is a histogram of counts and the words sent."""
    # A broken word is marked and its token left out; words are cleaned after they are counted as they stand.
    marked = F.regexp_replace(F.lower(text), rf"[{_ENDS}][ \t]*\n\s*", "\u0001")
    raw = pages.select(F.explode(F.split(marked, r"\s+")).alias("w")).where("w != ''").groupBy("w").agg(F.count("*").alias("n")).where(~F.col("w").contains("\u0001"))
    clean = F.regexp_replace("w", rf"^[{re.escape(_EDGE)}]+|[{re.escape(_EDGE)}]+$", "")
    counts = cut(raw.select(clean.alias("w"), "n").where("w != ''").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))
    level = F.when(F.col("n") < 100_000, F.col("n")).otherwise(100_000 + F.floor(F.log2("n") * 1000)).alias("level")
    least, total = None, 0
    for r in sorted(counts.groupBy(level).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect(), key=lambda r: -r["level"]):
        total += r["c"]
        if total > sent:
            break
        least = r["least"]
    else:
        least = LEAST
    kept = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    rest = counts.where(F.col("n") < least) if least is not None else counts
    return {r["w"]: r["n"] for r in kept.toLocalIterator()}, None if least == LEAST else rest


def questions(pages: list[list[str]], counts: Mapping[str, int]) -> set[str]:
    """Every word whose count examine may ask for on these pages and counts does not have: the words, their parts and
    numbers, what breaks at line ends may join to, and what misreadings may stand for. A word that counts has can only
    be the misreading of a more frequent one, which counts has too."""
    asked: set[str] = set()
    seen: set[str] = set()

    def ask(word: str) -> None:
        if not word or word in counts or word in seen:
            return
        seen.add(word)
        one, two = variants(word)
        asked.update((word, word.translate(DIGITS), *(v for v, _ in one), *two))

    lines = [x for p in pages for x in p if x.strip()]
    firsts = [core(x.split()[0]).rstrip(_ENDS).lower() for x in lines]
    where = [k for k, p in enumerate(pages) for x in p if x.strip()]
    for i, line in enumerate(lines):
        words = line.split()
        for w in words:
            token = core(w)
            ask(token.lower())
            asked.add(token.translate(DIGITS))
            for part in re.split(r"[-/–]", token.lower()):
                ask(part)
        if _BROKEN.search(line):
            left = words[-1].rstrip(_ENDS).lstrip(_EDGE).lower()
            ask(left)
            for j in range(i + 1, len(lines)):
                if where[j] > where[i] + 1 + HALO:
                    break
                ask(firsts[j])
                ask(left + firsts[j])
                ask(left + "-" + firsts[j])
    return {w for w in asked if w not in counts}


def _page_value(line: str) -> set[int]:
    """Numbers that an edge line may tell as its page."""
    if len(line) > 80:
        return set()
    m = _PAGE.match(line.strip())
    if not m:
        return set()
    n, out = m.group("n"), set()
    folded = n.translate(DIGITS)
    if folded.isdigit():
        out.add(int(folded))
    low = n.lower()
    if low and all(c in _ROMAN for c in low):
        values = [_ROMAN[c] for c in low]
        out.add(sum(-v if i + 1 < len(values) and v < values[i + 1] else v for i, v in enumerate(values)))
    return out


@lru_cache(maxsize=50_000)
def _head_key(line: str) -> str:
    s = re.sub(r"\s+", " ", line.strip().lower())
    s = re.sub(r"[\dlio|]*\d[\dlio|]*", "#", s)
    for wrong, right in (("0", "o"), ("1", "l"), ("i", "l"), ("|", "l"), ("rn", "m"), ("cl", "d"), ("@", "a"), ("5", "s"), ("+", "t"), ("c", "e"), ("b", "h"), ("vv", "w")):
        s = s.replace(wrong, right)
    return s


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 0.3 * max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and m.ratio() >= 0.8


def _bodylike(line: str) -> bool:
    """It reads as part of a running text: it ends a sentence, or begins in lower case."""
    s = line.strip()
    return not s or (s[0].islower() and not s[0] == "p") or (s[-1] in ".;,?!" and len(s.split()) > 2) or len(s) > 100


def furniture(pages: list[list[str]], numbers: list[int]) -> list[dict[int, str]]:
    """For each page of a document (or of a block of it), line -> 'running_head' or 'page_number'."""
    out: list[dict[int, str]] = [{} for _ in pages]
    filled = [[i for i, x in enumerate(p) if x.strip()] for p in pages]
    # Page numbers: the two outer lines of each edge that tell the page, in step with the other pages.
    told: list[tuple[int, int, set[int]]] = []
    for k, at in enumerate(filled):
        for i in dict.fromkeys([*at[:2], *at[-2:]]):
            offsets = {v - numbers[k] for v in _page_value(pages[k][i])}
            if offsets:
                told.append((k, i, offsets))
    common = Counter(o for _, _, offsets in told for o in offsets)
    for k, i, offsets in told:
        outer = filled[k][0] == i or filled[k][-1] == i
        second = len(filled[k]) > 1 and i in (filled[k][1], filled[k][-2])
        if (0 in offsets or any(common[o] > 1 for o in offsets)) and (outer or second):
            out[k][i] = "page_number"
    # Only the outermost run of furniture counts: a number below a table is none.
    for k, at in enumerate(filled):
        for edge in (at, at[::-1]):
            if len(edge) > 1 and out[k].get(edge[1]) == "page_number" and edge[0] not in out[k] and _bodylike(pages[k][edge[0]]):
                del out[k][edge[1]]
    for top in (True, False):
        edge: list[list[tuple[int, str]]] = []
        for k, at in enumerate(filled):
            lines = [i for i in (at[:2] if top else at[::-1][:2]) if i not in out[k]]
            edge.append([(i, _head_key(pages[k][i])) for i in lines if not _bodylike(pages[k][i])][:1] if lines and not _bodylike(pages[k][lines[0]]) else [])
        count: Counter[str] = Counter(key for e in edge for _, key in e)
        heads = [key for key, n in count.items() if n > 1]
        for k, e in enumerate(edge):
            for i, key in e:
                if len(key) < 4:
                    continue
                if count[key] > 1 or any(_alike(key, h) for h in heads) or any(_alike(key, o) for j, other in enumerate(edge) if j != k for _, o in other):
                    out[k][i] = "running_head"
    return out


@dataclass
class Line:
    page: int
    no: int
    text: str
    noise: set[str] = field(default_factory=set)
    glue: str | None = None  # how the last word goes on in the line it goes on in: "" or "-"
    onto: "Line | None" = None
    words: dict[int, str] = field(default_factory=dict)  # word position -> correction


def examine(pages: list[list[str]], numbers: list[int], vocabulary: Vocabulary) -> tuple[list[dict[int, str]], list[Line]]:
    """(furniture of each page, body lines in reading order with their noise)."""
    heads = furniture(pages, numbers)
    body = [Line(k, i, x) for k, p in enumerate(pages) for i, x in enumerate(p) if i not in heads[k]]
    text = [x for x in body if x.text.strip()]
    first_done: dict[int, str] = {}
    for at, line in enumerate(text):
        words = line.text.split()
        last = len(words)
        if _BROKEN.search(line.text) and any(c.isalpha() for c in words[-1]) and len(words[-1].strip(_ENDS)) > 0:
            left = words[-1].rstrip(_ENDS).lstrip(_EDGE).lower()
            chosen = None
            for step in range(len(text) - at - 1):
                nxt = text[at + 1 + step]
                if step >= AHEAD and nxt.page > line.page + 1:
                    break
                right = core(nxt.text.split()[0]).rstrip(_ENDS)
                low = right.lower()
                if not low or (step and not right[:1].islower() and right[:1].isalpha()):
                    continue
                for glue in ("", "-"):
                    if (left + glue + low) in vocabulary.counts and vocabulary.counts[left + glue + low] >= 3:
                        chosen = (nxt, glue, left + glue + low, None)
                        break
                # Far lines begin with words; a misread half is none.
                if chosen is None and (step < AHEAD or low not in vocabulary.counts):
                    for glue in ("", "-"):
                        if fixed := vocabulary.cache(left + glue + low):
                            chosen = (nxt, glue, left + glue + low, fixed)
                            break
                if chosen is None and step == 0 and low[:1].isalpha() and right[:1].islower() and low not in _JOINERS:
                    known = vocabulary.counts.get(left, 0) > 50 and vocabulary.counts.get(low, 0) > 50
                    chosen = (nxt, "-" if known and words[-1].rstrip()[-1] in "-‐‑" else "", left + low, None)
                    continue  # a later line may join to a known word
                if chosen is not None and chosen[0] is nxt:
                    break
            if chosen:
                nxt, glue, whole, fixed = chosen
                line.noise.add("hyphen_break")
                line.glue, line.onto = glue, nxt
                first_done[id(nxt)] = "joined"
                last -= 1
                if fixed:
                    cut = len(left)
                    if fixed[:cut] == left:
                        nxt.noise.add("misread")
                        nxt.words[0] = fixed[cut + (fixed[cut : cut + 1] == "-") :]
                    else:
                        line.noise.add("misread")
                        if fixed.endswith(core(nxt.text.split()[0]).lower()):
                            line.words[len(words) - 1] = fixed[: len(fixed) - len(core(nxt.text.split()[0]))]
        for j in range(1 if id(line) in first_done else 0, last):
            if fixed := vocabulary.of_word(words[j]):
                line.noise.add("misread")
                line.words[j] = fixed
    return heads, body


def _respell(word: str, fixed: str) -> str:
    """fixed in the case and with the punctuation of word."""
    inner = core(word)
    a = word.find(inner) if inner else 0
    if inner.isupper() and any(c.isalpha() for c in fixed):
        fixed = fixed.upper()
    elif inner[:1].isupper():
        fixed = fixed[:1].upper() + fixed[1:]
    return word[:a] + fixed + word[a + len(inner) :]


def paragraphs(body: list[Line]) -> list[tuple[int, list[Line]]]:
    """(page of its first line, lines) of each paragraph: blank lines end one, the end of a page does not unless the
    text's last line ends a sentence and a blank line follows."""
    out: list[tuple[int, list[Line]]] = []
    current: list[Line] = []
    last_page = -1
    for line in body:
        if line.text.strip():
            if not current:
                out.append((line.page, current))
            current.append(line)
        elif current and (line.page == last_page or line.page == current[-1].page) and (current[-1].text.rstrip()[-1:] in ".:!?)\"”" or line.page == current[-1].page and line.no > 0):
            current = []
        last_page = line.page
    return out


def repaired(lines: list[Line], skip: int = 0, runs_on: bool = False) -> str:
    """The text of a paragraph from its line number ``skip`` on: broken words joined, misread words replaced, lines run
    on. runs_on: lines follow elsewhere; a word broken at the last line's end is left to them, and they, skipping
    that line, begin with it."""
    out: list[list[str]] = []
    carry: dict[int, str] = {}
    inside = {id(x) for x in lines}
    for line in lines:
        words = line.text.split()
        for j, w in line.words.items():
            words[j] = _respell(words[j], w)
        if id(line) in carry and words:
            words[0] = carry.pop(id(line)) + words[0]
        if line.onto is not None and words:
            left = words[-1].rstrip(_ENDS) + (line.glue or "")
            if id(line.onto) in inside:
                words.pop()
                carry[id(line.onto)] = left
            else:
                words[-1] = left
        out.append(words)
    if runs_on and out and out[-1] and lines[-1].onto is None and _BROKEN.search(lines[-1].text):
        out[-1].pop()
    if 0 < skip < len(lines) and lines[skip - 1].onto is None and out[skip - 1] and _BROKEN.search(lines[skip - 1].text):
        out[skip].insert(0, out[skip - 1][-1])
    return " ".join(w for words in out[skip:] for w in words)


_KEYS = ["_doc", "_block", "_part"]


def _blocks(pages: DataFrame, doc: str, page_id: str, number: str, text: str, block: int) -> DataFrame:
    """The pages of each block and those beside it. A crowd, which repeated deliveries or pages without number make, is
    cut by hash into parts that stand alone, so that no task holds all of it."""
    n = F.coalesce(F.col(number).cast("int"), F.lit(LAST))
    b = F.floor(n / block).cast("int")
    rows = pages.where(F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), b.alias("_own"), n.alias("_n"), F.col(page_id).alias("_page"), F.col(text).alias("_text"))
    # Pages without text count too, so that texts need not be read for it.
    crowds = pages.select(F.col(doc).alias("_doc"), b.alias("_own")).groupBy("_doc", "_own").agg(F.count("*").alias("_c")).where(F.col("_c") > CROWD * block)
    if crowds.limit(1).count():
        crowds = small(crowds.select(F.col("_doc").alias("_cdoc"), F.col("_own").alias("_cown"), F.ceil(F.col("_c") / (CROWD * block)).cast("int").alias("_parts")))
        rows = rows.join(crowds, F.col("_doc").eqNullSafe(F.col("_cdoc")) & (F.col("_own") == F.col("_cown")), "left").drop("_cdoc", "_cown")
        alone = F.col("_parts").isNotNull()
        part = F.when(alone, 1 + F.pmod(F.xxhash64("_page", "_text"), F.col("_parts"))).otherwise(0).cast("int")
    else:
        alone, part = F.lit(False), F.lit(0)
    own, n = F.col("_own"), F.col("_n")
    first = F.when(n >= 0, F.greatest(n - HALO, F.lit(0))).otherwise(n - HALO)  # nothing comes before the first pages
    beside = F.sequence(F.floor(first / block).cast("int"), F.floor((n + HALO) / block).cast("int"))
    return rows.select("_doc", F.explode(F.when(alone | (n == LAST), F.array(own)).otherwise(beside)).alias("_block"), part.alias("_part"), "_own", "_n", "_page", "_text")


def _over_blocks(pages: DataFrame, names: tuple[str, str, str, str], block: int, emit, schema: str, sent: int) -> DataFrame:  # noqa: ANN001
    doc, page_id, number, text = names
    spark = pages.sparkSession
    most, rest = vocabulary(pages, text, sent)
    shared = spark.sparkContext.broadcast(most)
    rows = _blocks(pages, doc, page_id, number, text, block)
    rows = rows.withColumns({"_word": F.lit(None).cast("string"), "_count": F.lit(None).cast("bigint")})
    if rest is not None:
        keys = {k: t for k, t in rows.dtypes if k in _KEYS}

        def ask(groups: list[pd.DataFrame]) -> pd.DataFrame:
            out = []
            for g in groups:
                words = sorted(questions([t.split("\n") for t in g["_text"]], shared.value))
                out.append(pd.DataFrame({k: [g[k].iloc[0]] * len(words) for k in _KEYS} | {"_word": words}))
            return pd.concat(out, ignore_index=True)

        asked = over_keys(rows, _KEYS, ["_n", "_page"], ask, ", ".join([*[f"{k} {t}" for k, t in keys.items()], "_word string"]))
        told = asked.join(rest.select(F.col("w").alias("_word"), F.col("n").alias("_count")), "_word").withColumn("_n", F.lit(-1))
        rows = rows.unionByName(told, allowMissingColumns=True)

    def step(groups: list[pd.DataFrame]) -> pd.DataFrame:
        everywhere = _shared_vocabulary(shared)
        out: list[tuple] = []
        for g in groups:
            told = g["_word"].notna()
            v = everywhere
            if told.any():  # counts for this block alone
                v = Vocabulary(ChainMap(dict(zip(g["_word"][told], g["_count"][told].astype(int))), everywhere.counts))
                g = g[~told].reset_index(drop=True)
            texts = [t.split("\n") for t in g["_text"]]
            out += emit(g, texts, *examine(texts, g["_n"].astype(int).tolist(), v))
        columns = [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]
        return pd.DataFrame(out, columns=columns)

    return over_keys(rows, _KEYS, ["_n", "_page"], step, schema)


_VOCABULARIES: dict[int, Vocabulary] = {}


def _shared_vocabulary(shared) -> Vocabulary:  # noqa: ANN001
    key = id(shared.value)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(shared.value)
    return _VOCABULARIES[key]


def page_noise(pages: DataFrame, doc: str, page_id: str, number: str, text: str, block: int = 64, sent: int = SENT) -> DataFrame:
    """(page_id, line_no, noise) for each noisy line: running_head, page_number, hyphen_break, misread.

    Pages without text (null) have no lines; pages without a number come last in their document; a null document is a
    document of its own; an empty table gives an empty result. Pages of the same document and number are read in the
    order of page_id. Where more than CROWD times ``block`` pages of a document have numbers of one block, or none, they
    are read in groups by hash. ``sent`` bounds what is sent to all tasks and does not change the result. Names of other
    columns do not matter.
    """

    def emit(g: pd.DataFrame, texts: list[list[str]], heads: list[dict[int, str]], body: list[Line]) -> list[tuple]:
        own = (g["_own"] == g["_block"]).tolist()
        ids = g["_page"].tolist()
        rows = [(ids[k], i, noise) for k, h in enumerate(heads) if own[k] for i, noise in h.items()]
        rows += [(ids[x.page], x.no, noise) for x in body if own[x.page] for noise in sorted(x.noise)]
        return rows

    kind = dict(pages.dtypes)[page_id]
    return _over_blocks(pages, (doc, page_id, number, text), block, emit, f"`{page_id}` {kind}, line_no bigint, noise string", sent)


def page_paragraphs(pages: DataFrame, doc: str, page_id: str, number: str, text: str, block: int = 64, sent: int = SENT) -> DataFrame:
    """(doc, page_number, paragraph_no, text): the repaired paragraphs in reading order (page_number, paragraph_no); a
    paragraph belongs to the page it begins on and runs on over the pages after it, however many. Otherwise as
    page_noise; a crowd's groups are read each for itself."""

    def emit(g: pd.DataFrame, texts: list[list[str]], heads: list[dict[int, str]], body: list[Line]) -> list[tuple]:
        own = (g["_own"] == g["_block"]).tolist()
        numbers, d, b, part = g["_n"].tolist(), g["_doc"].iloc[0], int(g["_block"].iloc[0]), int(g["_part"].iloc[0])
        # The block before also saw the pages below ``taken``, and this one all pages below ``end``.
        taken, end = b * block + HALO, (b + 1) * block + HALO
        final = next((x for x in reversed(body) if x.text.strip()), None)
        rows, seen = [], Counter()
        for page, lines in paragraphs(body):
            # It reaches the last line seen, behind which more pages may follow.
            open_ = not part and lines[-1] is final and numbers[final.page] >= end - HALO and numbers[page] < LAST
            if own[page]:
                rows.append((d, None if numbers[page] == LAST else int(numbers[page]), seen[page], repaired(lines, 0, open_), b, False, open_))
                seen[page] += 1
            elif numbers[page] < b * block:  # begun in a block before
                skip = next((i for i, x in enumerate(lines) if numbers[x.page] >= taken), None)
                if skip is not None:
                    rows.append((d, None, 0, repaired(lines, skip, open_), b, True, open_))
        return rows

    kind = dict(pages.dtypes)[doc]
    names = [doc, "page_number", "paragraph_no", "text"]
    schema = f"_d {kind}, _page int, _no int, _text string, _b int, _goes_on boolean, _open boolean"
    found = cut(_over_blocks(pages, (doc, page_id, number, text), block, emit, schema, sent))
    named = [F.col(c).alias(n) for c, n in zip(("_d", "_page", "_no", "_text"), names)]
    tails = found.where("_goes_on").select(F.col("_d").alias("_td"), F.col("_b").alias("_tb"), F.col("_text").alias("_tail"), F.col("_open").alias("_more"))
    whole = found.where("NOT _goes_on")
    if not tails.limit(1).count():
        return whole.select(*named)
    # The open paragraph of a block, at most one, takes the tail of the next block, and so on while that is open.
    done, growing = whole.where("NOT _open").select(*named), whole.where("_open")
    while True:
        grown = growing.join(tails, F.col("_d").eqNullSafe(F.col("_td")) & (F.col("_tb") == F.col("_b") + 1), "left")
        grown = grown.select("_d", "_page", "_no", F.concat_ws(" ", "_text", F.when(F.col("_tail") != "", F.col("_tail"))).alias("_text"), (F.col("_b") + 1).alias("_b"), F.coalesce("_more", F.lit(False)).alias("_open"))
        grown = cut(grown)
        done = done.unionByName(grown.where("NOT _open").select(*named))
        growing = grown.where("_open")
        if not growing.limit(1).count():
            return done
