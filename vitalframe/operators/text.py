"""Reading of short texts by expressions: lab lines, dates said in words, doses, sizes, subjects of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A result line: name, comparison and value, perhaps a flag, a unit, perhaps a range or one bound, perhaps a number of
# the sample. Alternatives are told apart by what is there, not by four patterns in turn.
NAME = r"([A-Za-z][A-Za-z0-9 ,()/-]{1,44}?)"
LINE = r"^\s*" + NAME + r"\s*:?\s+([<>]=?\s*\d[\d.,]*|\d[\d.,]*)\s+(?:(H|L|HH|LL|h|l|\*|High|Low|high|low)\s+)?([A-Za-z%µ·][\w/%·µ*^.-]*|10[*^]\d+/\w+|x10E\d/\w+)(?:\s+\(?([<>≤≥]?\s*\d[\d.]*)(?:\s*[-–]\s*(\d[\d.]*))?\)?)?(?:\s+\d{1,2})?\s*$"
# Names that lines of forms have and that are no tests.
NO_TESTS = r"^(unlabeled.*|results?|reference|range|specimen|see note|comment|note|continued|page.*|collected|reported|ordered|received|date.*|units?|flag|status|previous result.*|current result.*|standard range|final report|performing lab|patient|fasting|non-?fasting|abnormal|normal|in range|out of range|panel|report status|client|physician|doctor|provider|npi|account)$"
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# Subjects of messages in order, the first that matches counts.
MESSAGES = [
    ("symptom_report", r"\b(symptom|pain|ache|nausea|dizzy|fatigue|headache|feeling|hurts|cramp|swelling|rash|numbness|tingling|shortness of breath|palpitation)\b"),
    ("medication_change", r"\b(started|starting|stopped|stopping|switched|switching|changed|changing|prescrib|increas|decreas|dose|dosage|medication|drug|supplement|mg|mcg)\b"),
    ("doctor_visit", r"\b(doctor|physician|specialist|appointment|visit|told me|diagnosed|referr)\b"),
    ("lab_discussion", r"\b(lab|test|result|blood|panel|came back|levels?|range|normal|abnormal|high|low|flagged)\b"),
    ("wearable_query", r"\b(hrv|heart rate variability|rhr|resting heart rate|sleep|recovery|strain|wearable|steps|workout|readiness|deep sleep|rem|spo2|skin temp|respiratory rate)\b"),
]
SMALL_TALK = r"^(hi|hello|hey|thanks|thank you|ok|okay|bye|later|good morning|good night|sure|yep|nope|got it|cool|what can you do|how do you work|help)\s*[!.?]*$"
DOSE = r"(\d+(?:\.\d+)?)\s*(mcg|ug|µg|mg|g|iu|ml)\b"
HALF, QUARTER, DOUBLE = r"\b(half|halved|halves|1/2)\b", r"\b(quarter|1/4)\b", r"\b(double|doubled|twice the)\b"
MEDICINE = r"\b(pill|tablet|capsule|dose|medication|medicine|drug|supplement)s?\b"


def lab_lines(pages: DataFrame, page_id: str, text: str) -> DataFrame:
    """(page_id, line_no, name, sign, value, flag, unit, low, high) of the lines of whole texts that state a result; a
    value with a comparison keeps its sign. Null texts have no lines."""
    lines = pages.where(F.col(text).isNotNull()).select(F.col(page_id), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    part = lambda i: F.regexp_extract("line", LINE, i)
    rows = lines.where(F.col("line").rlike(LINE)).select(page_id, F.col("line_no").cast("bigint").alias("line_no"), F.trim(part(1)).alias("name"), *[F.trim(part(i)).alias(f"_{i}") for i in range(2, 7)])
    number = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[<>≤≥]=?\s*", ""), ",", "").try_cast("double")
    sign = lambda c: F.regexp_extract(c, r"^([<>≤≥])", 1)
    first, second = number(F.col("_5")), F.col("_6").try_cast("double")
    low = F.when(F.col("_6") != "", first).when(sign(F.col("_5")).isin(">", "≥"), first)
    high = F.when(F.col("_6") != "", second).when(sign(F.col("_5")).isin("<", "≤"), first)
    flag = F.upper(F.substring("_3", 1, 1))
    return rows.where(~F.lower("name").rlike(NO_TESTS)).select(page_id, "line_no", "name", sign(F.col("_2")).alias("sign"), number(F.col("_2")).alias("value"), F.when(flag.isin("H", "L"), flag).alias("flag"), F.col("_4").alias("unit"), low.alias("low"), high.alias("high"))


def said_day(text: Column, today: Column) -> Column:
    """The day that a text tells in words relative to today: 'yesterday', '3 weeks ago', 'last Tuesday', 'last month';
    null if none. Of several the more exact wording counts."""
    t = F.lower(text)
    ago = r"\b(\d{1,4})\s+(day|week|month)s?\s+ago\b"
    n, unit = F.regexp_extract(t, ago, 1).try_cast("int"), F.regexp_extract(t, ago, 2)
    last = F.regexp_extract(t, r"\blast\s+(" + "|".join(WEEKDAYS) + r")\b", 1)
    number = F.lit(0)
    for i, name in enumerate(WEEKDAYS):
        number = F.when(last == name, i).otherwise(number)
    back = F.pmod(F.weekday(today) - number - 1, F.lit(7)) + 1
    return (
        F.when(t.rlike(r"\bday before yesterday\b"), F.date_sub(today, 2)).when(t.rlike(r"\byesterday\b|\blast night\b"), F.date_sub(today, 1))
        .when(unit == "day", F.date_sub(today, n)).when(unit == "week", F.date_sub(today, n * 7)).when(unit == "month", F.add_months(today, -n))
        .when(last != "", F.date_sub(today, back)).when(t.rlike(r"\blast week\b"), F.date_sub(today, 7)).when(t.rlike(r"\blast month\b"), F.add_months(today, -1))
        .when(t.rlike(r"\b(today|now|this morning|tonight)\b"), today)
    )


def said_range(text: Column, today: Column) -> Column:
    """struct(start, end) of a question's period: 'last 3 months', 'past week', '2 weeks ago' (three days either way),
    'since March [2024]', 'recently' (14 days); null if none."""
    t = F.lower(text)
    spans = r"\b(?:last|past)\s+(\d{1,4})\s+(day|week|month|year)s?\b"
    n, unit = F.regexp_extract(t, spans, 1).try_cast("int"), F.regexp_extract(t, spans, 2)
    back = lambda k, u: F.when(u == "day", F.date_sub(today, k)).when(u == "week", F.date_sub(today, k * 7)).when(u == "month", F.add_months(today, -k)).when(u == "year", F.add_months(today, -12 * k))
    one = F.regexp_extract(t, r"\b(?:last|past)\s+(week|month|year)\b", 1)
    ago = r"\b(\d{1,4})\s+(day|week|month|year)s?\s+ago\b"
    point = back(F.regexp_extract(t, ago, 1).try_cast("int"), F.regexp_extract(t, ago, 2))
    months = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    since = r"\bsince\s+(" + "|".join(months) + r")(?:\s+(\d{4}))?\b"
    name, year = F.regexp_extract(t, since, 1), F.regexp_extract(t, since, 2).try_cast("int")
    month = F.lit(0)
    for i, m in enumerate(months):
        month = F.when(name == m, i + 1).otherwise(month)
    year = F.coalesce(year, F.year(today) - (month > F.month(today)).cast("int"))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return (
        F.when(unit != "", pair(back(n, unit), today)).when(one != "", pair(back(F.lit(1), one), today))
        .when(point.isNotNull(), pair(F.date_sub(point, 3), F.least(F.date_add(point, 3), today)))
        .when(name != "", pair(F.make_date(year, F.greatest(month, F.lit(1)), F.lit(1)), today)).when(t.rlike(r"\b(recent|recently|lately)\b"), pair(F.date_sub(today, 14), today))
    )


def dose_of(text: Column) -> Column:
    """struct(dose, unit, modifier, taken, taken_mg) of the first dose a text tells; modifiers count only beside a dose or
    a word for medicine. Null without dose."""
    t = F.lower(text)
    dose, unit = F.regexp_extract(t, DOSE, 1).try_cast("double"), F.regexp_extract(t, DOSE, 2)
    near = dose.isNotNull() | t.rlike(MEDICINE)
    modifier = F.when(near & t.rlike(HALF), "half").when(near & t.rlike(QUARTER), "quarter").when(near & t.rlike(DOUBLE), "double").otherwise("")
    by = F.when(modifier == "half", 0.5).when(modifier == "quarter", 0.25).when(modifier == "double", 2.0).otherwise(1.0)
    mg = F.when(unit.isin("mcg", "ug", "µg"), dose * by / 1000).when(unit == "mg", dose * by).when(unit == "g", dose * by * 1000)
    return F.when(dose.isNotNull(), F.struct(dose.alias("dose"), unit.alias("unit"), modifier.alias("modifier"), (dose * by).alias("taken"), mg.alias("taken_mg")))


def metres(text: Column) -> Column:
    """A height: feet and inches, centimetres, inches or metres, within what is likely; else null."""
    t = F.lower(F.trim(text))
    get = lambda p, i=1: F.regexp_extract(t, p, i).try_cast("double")
    feet = r"^(\d)\s*(?:'|’|ft\b|feet\b)\s*(\d{1,2})?"
    f, i = get(feet), F.coalesce(get(feet, 2), F.lit(0.0))
    cm, inch, m = get(r"(\d+(?:\.\d+)?)\s*cm\b"), get(r"(\d+(?:\.\d+)?)\s*(?:in|inches)\b"), get(r"(\d+\.\d+)\s*m\b")
    return F.when(f.between(3, 8), (f * 12 + i) * 0.0254).when((cm > 50) & (cm < 300), cm / 100).when((inch > 30) & (inch < 100), inch * 0.0254).when((m > 0.5) & (m < 3), m)


def kilograms(text: Column) -> Column:
    """A weight: pounds or kilograms within what is likely; a bare number above 100 is in pounds; else null."""
    t = F.lower(F.trim(text))
    get = lambda p: F.regexp_extract(t, p, 1).try_cast("double")
    lb, kg, bare = get(r"(\d+(?:\.\d+)?)\s*(?:lbs?|pounds?)\b"), get(r"(\d+(?:\.\d+)?)\s*(?:kgs?|kilograms?)\b"), get(r"^(\d+(?:\.\d+)?)$")
    return F.when((lb > 30) & (lb < 1000), lb * 0.453592).when((kg > 15) & (kg < 500), kg).when(bare > 100, bare * 0.453592).when(bare > 15, bare)


def days_of(text: Column) -> Column:
    """A duration in words as days: '2 weeks', '10 days', '3 months' (of 30 days)."""
    p = r"(\d+)\s*(day|week|month|year)s?"
    n, u = F.regexp_extract(F.lower(text), p, 1).try_cast("int"), F.regexp_extract(F.lower(text), p, 2)
    return F.when(u == "day", n).when(u == "week", n * 7).when(u == "month", n * 30).when(u == "year", n * 365)


def age_at(born: Column, day: Column) -> Column:
    """Whole years, the birthday counting."""
    return F.floor(F.months_between(day, born) / 12).cast("int")


def merge_extractions(sources: list[tuple[DataFrame, float]], key: list[str], value: str) -> DataFrame:
    """Rows of the first source that has the key (sources in order of trust, each with its confidence): 0.05 more (0.99 at
    most) where another source agrees with its value, 0.15 less (0.5 at least) where one differs and none agrees.
    Values agree within 5 % and 0.5."""
    parts = [df.select(*key, F.col(value).cast("double").alias(value), F.lit(i).alias("_p"), F.lit(c).alias("confidence")) for i, (df, c) in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    g = rows.groupBy(*key).agg(F.min_by(F.struct(value, "confidence", "_p"), F.struct("_p", value)).alias("_b"), F.collect_set(F.struct("_p", value)).alias("_all"))
    same = lambda x: (F.abs(x[value] - F.col(f"_b.{value}")) <= 0.5) & (F.abs(x[value] - F.col(f"_b.{value}")) <= 0.05 * F.greatest(F.abs(x[value]), F.abs(F.col(f"_b.{value}"))))
    others = F.filter("_all", lambda x: x["_p"] != F.col("_b._p"))
    agrees, differs = F.exists(others, same), F.exists(others, lambda x: ~same(x))
    c = F.col("_b.confidence")
    confidence = F.when(agrees, F.least(c + 0.05, F.lit(0.99))).when(differs, F.greatest(c - 0.15, F.lit(0.5))).otherwise(c)
    return g.select(*key, F.col(f"_b.{value}").alias(value), F.round(confidence, 6).alias("confidence"), F.coalesce(differs & ~agrees, F.lit(False)).alias("conflict"))


def condition_mentions(docs: DataFrame, row_id: str, text: str, words: list[tuple[str, str]], relatives: str) -> DataFrame:
    """(row_id, condition, sentences, of_family) of whole texts: the sentences that name a condition, and those of them
    that also name a relative. Sentences end at full stops, question and exclamation marks and line ends; a text names a
    condition once a sentence, whatever words it has for it. Null texts name none."""
    s = F.explode(F.split(F.lower(text), r"[.!?\n]+")).alias("s")
    sentences = docs.where(F.col(text).isNotNull()).select(row_id, s)
    named = F.array_distinct(F.filter(F.array(*[F.when(F.col("s").contains(w), c) for w, c in words]), lambda x: x.isNotNull()))
    rows = sentences.select(row_id, F.explode(named).alias("condition"), F.col("s").rlike(relatives).alias("_f"))
    return rows.groupBy(row_id, "condition").agg(F.count("*").alias("sentences"), F.count_if("_f").alias("of_family"))
