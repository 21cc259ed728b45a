"""Personal information in free text, found by anchors and replaced by typed placeholders.

One Aho-Corasick pass finds anchors: at-signs and their paraphrases, identifier cues, telephone cues, digits that begin
a number, street words, titles, roles, and what people do. From each anchor a deterministic parser of that kind expands
to the item's boundaries, however far they are, and checks it: forms of numbers, parts of addresses, capitals of names.
Overlapping finds are settled by kind and length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cues of each kind, lower case. They are matched at word boundaries.
ID_CUES = (
    "ssn", "social", "social security", "social security number", "mrn", "mr#", "mr #", "medical record", "medical record number", "medical record no.", "chart no.", "chart no", "chart number", "chart #", "patient id", "patient no.", "patient number",
    "member id", "member no.", "member number", "member #", "insurance id", "insurance no.", "insurance number", "subscriber #", "subscriber id", "subscriber no.", "policy", "policy no.", "policy number", "policy #", "policy id", "passport", "passport no.", "passport number",
    "driver licence", "driver license", "driver's licence", "driver's license", "drivers license", "driving licence", "licence no.", "license no.", "dl", "id card", "identity card", "id number", "id no.", "national id", "my number", "my id", "health card", "group no.", "account no.", "reisepass", "ausweis", "versichertennummer",
)
TITLES = ("dr", "dr.", "doctor", "prof", "prof.", "professor", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "nurse", "herr", "frau", "sr.", "sra.", "señor", "señora", "sister", "rev.")
#: Behind these a name may be written in any case, and one word is enough.
NAME_CUES = (
    "my name is", "i am called", "i'm called", "name:", "patient:", "pt:", "patient name:", "signed by", "seen by", "carer", "emergency contact", "emergency contact:", "contact person", "next of kin", "next of kin:", "guardian", "this is", "referred by", "attended by", "reported by", "prescribed by",
    "my sister", "my brother", "my husband", "my wife", "my mother", "my father", "my son", "my daughter", "my partner", "my friend", "my neighbour", "my neighbor", "my aunt", "my uncle", "my cousin", "my carer", "my doctor", "my nurse",
)
#: Behind these only two or more capitalised words are a name.
LOOSE_CUES = ("with", "call", "by", "from", "ask", "asked", "met", "saw", "told", "for", "and", "to", "contact", "about", "tell", "remind", "thank", "visit", "visited", "inform", "phoned", "texted", "emailed", "signed")
#: What people do; a capitalised name stands before it.
NAME_AFTER = ("'s notes", "’s notes", " asked for", " picked up", " signed the", " signed for", " will drive", " will call", " will pick", " will bring", " drove me", " called me", " came with", " brought me", " is my", " will be there", " has the keys", " looks after")
#: Roles behind which two capitalised words are a name.
ROLES = (
    "therapist", "physiotherapist", "psychologist", "psychiatrist", "dentist", "pharmacist", "specialist", "cardiologist", "neurologist", "dermatologist", "surgeon", "physician", "midwife", "paramedic", "trainer", "coach", "teacher", "instructor", "counsellor", "counselor",
    "colleague", "coworker", "boss", "manager", "landlord", "landlady", "roommate", "flatmate", "classmate", "girlfriend", "boyfriend", "fiancé", "fiancée", "spouse", "grandmother", "grandfather", "grandma", "grandpa", "niece", "nephew", "daughter-in-law", "son-in-law", "mother-in-law", "father-in-law", "stepmother", "stepfather",
    "sister", "brother", "husband", "wife", "mother", "father", "son", "daughter", "partner", "friend", "neighbour", "neighbor", "aunt", "uncle", "cousin", "caregiver", "patient", "client", "lawyer", "secretary", "receptionist", "assistant", "driver", "courier",
)
#: What people do or are, in the third person; two capitalised words before it are a name unless they name a thing.
VERBS = tuple(
    """went goes took takes said says told tells came comes gave gives got gets had has is was will would can could did does felt feels found finds thinks thought wants wanted knows knew left leaves made makes saw sees met meets brought brings bought drove drives ate eats drank
    slept sleeps woke wakes stood sat fell falls lost keeps kept sent sends wrote writes read spoke speaks heard ran runs walked walks called calls phoned rang texted emailed asked asks answered replied reported reports complained complains mentioned mentions noticed notices visited visits
    helped helps checked checks measured measures showed shows suggested suggests recommended recommends prescribed prescribes advised advises examined treated treats fainted vomited coughed coughs forgot forgets remembered needed needs tried tries started stopped stayed stays lives lived moved worked works
    agreed cancelled confirmed signed dropped collected delivered picked waited waits returned arrived hat ist war sagt sagte kam ging nahm""".split()
)
#: Words that make capitalised words the name of a thing, as the last of them or behind them.
THINGS = frozenset(
    """disease syndrome disorder lymphoma palsy fever virus infection manoeuvre maneuver method technique procedure protocol test sign score scale index criteria classification reflex triad solution lactate acetate saline dextrose diet plan program programme study trial
    watch band ring phone app tablet pump meter monitor clinic hospital centre center wing ward unit building tower hall house school college university church museum library station airport park garden gardens lake river mountain valley ridge mill trail path bridge bay beach island forest
    town city county village district street road marathon race cup league club team company pharmacy laboratory laboratories lab labs insurance bank market store shop hotel restaurant cafe day week month year season holiday eve festival
    one two three four five six seven eight nine ten acid oil tea juice water milk bread forte plus max retard screening surgery therapy treatment rule law act code guideline guidelines report form list""".split()
)
AT_SIGNS = ("@", "(at)", "[at]", "{at}", " at ", "<at>")
# Words that end a street's name, and endings of German street names.
STREETS = (
    "street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "boulevard", "blvd", "court", "ct", "way", "terrace", "ter", "drive", "dr", "place", "pl", "square", "sq", "close", "crescent", "cres", "circle", "cir", "parkway", "pkwy", "highway", "hwy", "row", "walk", "mews", "grove", "gardens", "hill", "trail", "loop", "alley",
)
STREET_ENDINGS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "ring", "damm", "steig", "stieg", "pfad", "chaussee", "zeile", "markt", "hof", "wall", "graben")
PHONE_CUES = ("tel", "tel.", "tel:", "phone", "phone:", "telephone", "call me at", "call", "cell", "my cell is", "mobile", "text", "fax", "ring", "reach me at", "whatsapp", "sms", "number is", "handy", "telefon", "contact")
#: Capitalised words that are no names of persons.
NO_NAMES = frozenset(
    """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    breakfast lunch dinner supper brunch vitamin room ward wing west east north south street road lane avenue house hospital clinic centre center
    the a an and or if it in on at to for of with was is are be no not this that these those my your his her our their we you they i he she thanks please patient
    doctor nurse team family friends insurance insurer office lab laboratory results note notes summary page see spring summer autumn winter
    english german spanish monday's covid flu type stage grade score level test scan report form letter reading range order app version
    good great fine better worse again now today tomorrow yesterday late early then later meanwhile after before when while since until because although though so but also still yet once soon often sometimes usually finally suddenly maybe perhaps however instead
    morning evening night afternoon last next every each some any all both another other here there what who how why where which just only even as by from into during between about over under down out up off new old first second third one two three four five six seven eight nine ten""".split()
)

_WORD = r"[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[\w'’]+)*"
_ANY = r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*"
_PARTICLE = r"(?:(?:van|von|de|der|den|del|della|da|dos|di|du|la|le|ter|ten|bin|al|el|y|zu) )*"
_NAME = re.compile(rf"(?:{_WORD})(?:(?:,? )(?:[A-Z]\.|{_PARTICLE}{_WORD})){{0,3}}")
_NAME_ANY = re.compile(rf"{_ANY}(?:,? (?:[^\W\d_]\.|{_ANY})){{0,2}}")
_BEFORE = re.compile(rf"(?:{_WORD} )?(?:[A-Z]\. )?{_PARTICLE}{_WORD}$")
_SHORT = re.compile(r"(?:(?:me|us|her|him|them|it|is|at|on|number|no\.?) )*:? ?(\d{3}[ .-]\d{4})(?![\w-]|[.,]\d)", re.I)
_LOCAL = frozenset(".!#$%&'*+/=?^`{|}~-_")
_HOST = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:(?:\.|\s?[\[({]dot[\])}]\s?| dot )[^\W_](?:[\w-]*[^\W_])?)+", re.I)
_TOKEN = re.compile(r"[A-Z]{0,4}[ -]?\d[A-Z\d]*(?:[- ]?[A-Z\d]*\d[A-Z\d]*)*", re.I)
_AFTER_CUE = re.compile(r"(?:\s*(?:is|was|number|no\.?|nr\.?|id|#))*\s*[:#=]?\s*", re.I)
_SSN = re.compile(r"(?<![\w.-])\d{3}([- ])\d{2}\1\d{4}(?![\w-]|\.\d)")
_PHONE = re.compile(
    r"""(?<![\w.+@-])(?:
      \+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}
    | (?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}
    | (?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}
    | \(0\d{2,4}\)[ ./-]?\d{3,6}(?:[ -]\d{2,5})?
    | 0\d{2,4}[ ./-]\d{3,6}(?:[ -]\d{2,5})?
    | \d{10}
    )(?:\s?(?:ext\.?|x|extension)\s?\d{1,5})?(?![\w@-]|[.,]\d)""",
    re.X | re.I,
)
_STREET_NO = re.compile(r"(?<![\w.,/-])\d{1,5}[A-Za-z]?(?:-\d{1,4})? (?:(?:[NSEW]|NE|NW|SE|SW)\.? )?(?:[^\W\d_][\w'’-]* ){1,3}$")
_CITY = r"(?:[A-ZÄÖÜ][\w'’-]*(?: [A-ZÄÖÜ][\w'’-]*)?|[a-zäöü][\w'’-]*)"
_REST = re.compile(rf"\.?(?:,? (?:(?:[Aa]pt|[Uu]nit|[Ss]uite|[Ss]te|[Ff]lat|[Nn]o|APT|UNIT)\b\.?|#) ?#?[\w-]+)?(?:, (?!(?:my|and|or|but|phone|tel|call|text|cell|mail|e-mail|email|write|reach|send|the|then|see|seen|signed|with|carer|contact|please|emergency|passport|driver|member|ssn|social|chart|patient|insurance|subscriber|medical|spo2|range|reading|order|walked|took|slept|moved|glucose|app|this|is|name)\b){_CITY})?(?:,? [A-Z]{{2}}\b)?(?:,? \d{{5}}(?:-\d{{4}})?\b)?")
_NUMBER_BEHIND = re.compile(rf" \d{{1,4}}(?: ?[a-zA-Z]\b)?(?:, \d{{4,5}} {_CITY})?(?![\w-])")
_PLACEHOLDER = re.compile(r"\[[A-Z][A-Z_-]*(?:[-_:][A-Za-z_ ]+)?\]")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x2011: 0x2D, 0x2010: 0x2D}
_RANK = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}


_TITLE_WORDS = frozenset(t.rstrip(".") for t in TITLES)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for kind, words in (("at", AT_SIGNS), ("id", ID_CUES), ("title", TITLES), ("cue", NAME_CUES), ("loose", LOOSE_CUES), ("after", NAME_AFTER), ("street", STREETS), ("ending", STREET_ENDINGS), ("phone", PHONE_CUES), ("digit", "0123456789"), ("role", ROLES), ("does", [f" {v}" for v in VERBS])):
        for w in words:
            kinds.setdefault(w, set()).add(kind)
    for w, k in kinds.items():
        a.add_word(w, (w, tuple(sorted(k))))
    a.make_automaton()
    return a


def _back(s: str, at: int, words: int) -> int:
    """Where the last ``words`` words before at begin, however long they are."""
    while at > 0 and words:
        at = s.rfind(" ", 0, at)
        at, words = max(at, 0), words - 1
        while at > 0 and s[at - 1] == " ":
            at -= 1
    return at


def _word_ends(s: str, a: int, b: int) -> bool:
    return (a == 0 or not (s[a - 1].isalnum() and s[a].isalnum())) and (b >= len(s) or not (s[b].isalnum() and s[b - 1].isalnum()))


def _names(text: str, low: str, at: int, any_case: bool, least: int) -> tuple[int, int] | None:
    """The name that begins at ``at`` (blanks, a colon and titles are passed over)."""
    while at < len(text) and text[at] in " :,\t":
        at += 1
    while True:
        for t in sorted(TITLES, key=len, reverse=True):
            if low.startswith(t, at) and at + len(t) < len(text) and text[at + len(t)] == " ":
                at += len(t) + 1
                break
        else:
            break
    m = (_NAME_ANY if any_case else _NAME).match(text, at)
    if not m:
        return None
    parts = [p for p in re.finditer(r"[^\s,]+", m.group())]
    kept = []
    for p in parts:
        w = p.group().rstrip(".").lower()
        w = w[:-2] if w.endswith(("'s", "’s")) else w
        if len(w) == 1 and p.group().endswith("."):
            kept.append(p)
            continue
        if w in NO_NAMES or (any_case and kept and p.group()[:1].islower() and not (len(kept) == 1 and kept[0].group().islower() and text[at - 2 : at] == ": ")):
            break
        kept.append(p)
        comma = m.group()[p.end() : p.end() + 1] == ","
        if comma and not (p.group().isupper() and len(p.group()) > 1):  # "LAST, FIRST" goes on; other commas end a name
            break
    full = [p for p in kept if len(p.group().rstrip(".")) > 1]
    if len(full) < least or not full:
        return None
    if least > 1 and _thing(kept[-1].group(), low, m.start() + kept[-1].end()):
        return None
    end = kept[-1].end()
    if m.group()[:end].endswith(("'s", "’s")):
        end -= 2
    return m.start(), m.start() + end


def _thing(last: str, low: str, end: int) -> bool:
    """Capitalised words ending in ``last`` at end name a thing."""
    if last.lower().rstrip(".") in THINGS:
        return True
    behind = re.match(r" ?([^\W\d_]+)", low[end : end + 24])
    return bool(behind) and behind.group(1) in THINGS


def _doer(text: str, low: str, end: int, names_only: bool) -> int | None:
    """Where the name of two words or more that ends at end begins; None if there is none."""
    m = _BEFORE.search(text, _back(text, end, 7), end)
    if not m:
        return None
    words, start = m.group().split(), m.start()
    while words and words[0].rstrip(".").lower() in NO_NAMES | _TITLE_WORDS:
        start += len(words.pop(0)) + 1
    if len(words) < 2 or any(w.lower() in NO_NAMES for w in words) or (names_only and (_thing(words[-1], low, end) or any(w.lower() in THINGS for w in words) or not all(len(w) > 1 and w[1:2] != w[1:2].upper() or len(w) == 2 and w[1] == "." for w in words))):
        return None
    return start


def _is_phone(low: str, m: re.Match) -> bool:
    """A match of _PHONE has the digits of a telephone number; ten bare digits need a cue before them, or the form of a
    national number."""
    digits = sum(c.isdigit() for c in re.split(r"(?i)e?xt?", m.group())[0])
    if not 9 <= digits <= 15:
        return False
    if not m.group().isdigit():
        return True
    before = low[max(0, m.start() - 24) : m.start()]
    return any(before.rstrip(" :").endswith(c.rstrip(".:")) for c in PHONE_CUES) or re.search(r"\btel\.?:? ?$", before) is not None or re.match(r"[2-9]\d\d[2-9]\d{6}", m.group()) is not None


def find_items(raw: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items of a text, in order and without overlaps."""
    text = raw.translate(_WIDE)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: list[tuple[int, int, str]] = []
    blocked = [m.span() for m in _PLACEHOLDER.finditer(text)]
    after_ssn = after_phone = 0
    for end, (word, kinds) in _automaton().iter(low):
        a, b = end - len(word) + 1, end + 1
        if "at" in kinds:
            to = a
            while word != "@" and to > 0 and text[to - 1] == " ":
                to -= 1
            start = to
            while start > 0 and (text[start - 1].isalnum() or text[start - 1] in _LOCAL):
                start -= 1
            after = b
            while word != "@" and after < min(b + 2, len(text)) and text[after] == " ":
                after += 1
            h = _HOST.match(text, after)
            while start < to and text[start] in ".'{/!#$%&*+=?^`|~-":
                start += 1
            if start < to and h and (word.strip() != "at" or " dot " in h.group().lower() or re.search(r"\.(example|test|com|org|net|edu|de|uk|info|invalid|io)$", h.group(), re.I)):
                spans.append((start, h.end(), "email"))
        if "digit" in kinds:
            if a == 0 or not text[a - 1].isdigit():  # a number begins
                s = a - 1 if a and text[a - 1] in "(+" else a
                if s >= after_ssn and (m := _SSN.match(text, s)):
                    spans.append((m.start(), m.end(), "id_number"))
                    after_ssn = m.end()
                for s in (s - 1, s) if s and text[s - 1] == "(" else (s,):
                    if s >= after_phone and (m := _PHONE.match(text, s)):
                        after_phone = m.end()
                        if _is_phone(low, m):
                            spans.append((m.start(), m.end(), "phone"))
                        break
            continue
        if not _word_ends(low, a, b):
            if "ending" in kinds and (b >= len(low) or not low[b].isalpha()):
                pass
            else:
                continue
        if "id" in kinds:
            c = _AFTER_CUE.match(text, b)
            m = _TOKEN.match(text, c.end())
            if m and sum(x.isdigit() for x in m.group()) >= 5:
                spans.append((m.start(), m.end(), "id_number"))
        if "title" in kinds and (got := _names(text, low, b, False, 1)) and text[b : b + 1] == " ":
            spans.append((*got, "name"))
        if "cue" in kinds:
            got = _names(text, low, b, True, 1)
            if got and (text[got[0]].isupper() or word not in ("this is", "carer", "guardian", "emergency contact", "contact person", "signed by", "seen by") and not word.startswith("my ") or (word in ("my name is", "signed by", "seen by") and low[got[0] : got[1]].split()[0] not in NO_NAMES)):
                spans.append((*got, "name"))
        if "loose" in kinds and (got := _names(text, low, b, False, 2)):
            spans.append((*got, "name"))
        if "role" in kinds and (got := _names(text, low, b, False, 2)) and text[b : b + 1] == " " and got[0] == b + 1:
            spans.append((*got, "name"))
        if "after" in kinds and (start := _doer(text, low, a, False)) is not None:
            spans.append((start, a, "name"))
        if "does" in kinds and (start := _doer(text, low, a, True)) is not None:
            spans.append((start, a, "name"))
        if "phone" in kinds and (m := _SHORT.match(text, b + (text[b : b + 1] == " "))):
            spans.append((m.start(1), m.end(1), "phone"))
        if "street" in kinds:
            m = _STREET_NO.search(text, _back(text, a, 7), a)
            if m:
                r = _REST.match(text, b)
                spans.append((m.start(), r.end(), "address"))
        if "ending" in kinds and (m := _NUMBER_BEHIND.match(text, b)):
            start = a
            while start > 0 and (text[start - 1].isalpha() or text[start - 1] == "-"):
                start -= 1
            if start < a and not low[start:b].startswith(tuple(STREET_ENDINGS)):
                while (p := re.search(r"(?:^|\s)((?:Am|An|Auf|Alte|Alter|Große|Kleine|Obere|Untere|Neue|Unter|Im) )$", text[max(0, start - 10) : start])) is not None:
                    start -= len(p.group(1))
                spans.append((start, m.end(), "address"))
    spans = [s for s in spans if s[0] < s[1] and not any(a < s[1] and s[0] < b for a, b in blocked)]
    spans.sort(key=lambda s: (_RANK[s[2]], s[0] - s[1], s[0]))
    taken: list[tuple[int, int, str]] = []
    for s in spans:
        if not any(a < s[1] and s[0] < b for a, b, _ in taken):
            taken.append(s)
    return sorted(taken)


def redact(raw: str, items: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in items:
        out += [raw[at:a], f"[REDACTED-{kind}]"]
        at = b
    return "".join([*out, raw[at:]])


def redact_texts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, items, redacted): items is an array of (kind, start_pos, end_pos), start_pos counted in characters from
    0; redacted is the text with every item replaced by ``[REDACTED-kind]`` and the rest unchanged.

    A null text gives null redacted and no items; an empty one stays empty. Texts are read whole, whatever their
    length, each in its own right, so there is no shuffle and repeated rows give repeated results. Placeholders that
    are already there are left alone. Other columns are not read, whatever their names.
    """
    kind = dict(df.dtypes)[row_id]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            items = [[] if t is None else find_items(t) for t in f["t"]]
            yield pd.DataFrame({row_id: f["i"], "items": [[{"kind": k, "start_pos": a, "end_pos": b} for a, b, k in x] for x in items], "redacted": [None if t is None else redact(t, x) for t, x in zip(f["t"], items)]})

    schema = f"`{row_id}` {kind}, items array<struct<kind: string, start_pos: bigint, end_pos: bigint>>, redacted string"
    return df.select(F.col(row_id).alias("i"), F.col(text).alias("t")).mapInPandas(run, schema)
