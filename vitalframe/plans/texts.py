"""Queries over short texts, search and changes of tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe import dims, knowledge
from vitalframe.operators import maintenance, records, search, text
from vitalframe.plans import sql
from vitalframe.plans.records import _RES, _TERMS, _dated, query
from vitalframe.session import cut
from vitalframe.tables import Tables


def _sq(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _part(i: int) -> str:
    return f"regexp_extract(line, {_sq(text.LINE)}, {i})"


def _num(x: str) -> str:
    return rf"TRY_CAST(replace(regexp_replace({x}, '^[<>≤≥]=?\s*', ''), ',', '') AS DOUBLE)"


def _sign(x: str) -> str:
    return f"regexp_extract({x}, '^([<>≤≥])', 1)"


@query(f"""WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM parsed_pages WHERE text IS NOT NULL),
m AS (SELECT page_id, line_no, trim({_part(1)}) AS name, {', '.join(f"trim({_part(i)}) AS p{i}" for i in range(2, 7))} FROM l WHERE regexp_matches(line, {_sq(text.LINE)}))
SELECT page_id, line_no, name, {_sign('p2')} AS sign, {_num('p2')} AS value, CASE WHEN upper(p3[1]) IN ('H', 'L') THEN upper(p3[1]) END AS flag, p4 AS unit, CASE WHEN p6 <> '' OR {_sign('p5')} IN ('>', '≥') THEN {_num('p5')} END AS low, CASE WHEN p6 <> '' THEN TRY_CAST(p6 AS DOUBLE) WHEN {_sign('p5')} IN ('<', '≤') THEN {_num('p5')} END AS high
FROM m WHERE NOT regexp_matches(lower(name), {_sq(text.NO_TESTS)})""")
def lab_lines(t: Tables) -> DataFrame:
    """Lines of whole pages that state a result."""
    return text.lab_lines(t.parsed_pages, "page_id", "text")


_AGO = r"\b(\d{1,4})\s+(day|week|month)s?\s+ago\b"
_LAST = r"\blast\s+(" + "|".join(text.WEEKDAYS) + r")\b"
_DAY = "CASE w " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(text.WEEKDAYS)) + " ELSE 0 END"


@query(rf"""WITH e AS (SELECT event_id, lower(raw_text) AS s, date_effective AS d FROM parsed_events), a AS (SELECT *, TRY_CAST(regexp_extract(s, '{_AGO}', 1) AS INT) AS n, regexp_extract(s, '{_AGO}', 2) AS u, regexp_extract(s, '{_LAST}', 1) AS w FROM e),
b AS (SELECT event_id, (CASE WHEN regexp_matches(s, '\bday before yesterday\b') THEN d - 2 WHEN regexp_matches(s, '\byesterday\b|\blast night\b') THEN d - 1 WHEN u = 'day' THEN d - n WHEN u = 'week' THEN d - n * 7 WHEN u = 'month' THEN (d - to_months(n))::DATE
  WHEN w <> '' THEN d - ((isodow(d) - 1 - {_DAY} - 1 + 7) % 7 + 1)::INT WHEN regexp_matches(s, '\blast week\b') THEN d - 7 WHEN regexp_matches(s, '\blast month\b') THEN (d - to_months(1))::DATE WHEN regexp_matches(s, '\b(today|now|this morning|tonight)\b') THEN d END)::DATE AS said FROM a)
SELECT event_id, said FROM b WHERE said IS NOT NULL""")
def said_days(t: Tables) -> DataFrame:
    """Days that messages tell in words, counted from the day of the message."""
    got = t.parsed_events.select("event_id", text.said_day(F.col("raw_text"), F.col("date_effective")).alias("said"))
    return got.where("said IS NOT NULL")


@query(f"""WITH e AS (SELECT med_id, lower(concat_ws(' ', name, dose, unit, frequency)) AS s FROM clean_medications), a AS (SELECT *, TRY_CAST(regexp_extract(s, {_sq(text.DOSE)}, 1) AS DOUBLE) AS dose, regexp_extract(s, {_sq(text.DOSE)}, 2) AS unit FROM e),
b AS (SELECT *, CASE WHEN regexp_matches(s, {_sq(text.HALF)}) THEN 'half' WHEN regexp_matches(s, {_sq(text.QUARTER)}) THEN 'quarter' WHEN regexp_matches(s, {_sq(text.DOUBLE)}) THEN 'double' ELSE '' END AS modifier FROM a WHERE dose IS NOT NULL),
c AS (SELECT *, CASE modifier WHEN 'half' THEN 0.5 WHEN 'quarter' THEN 0.25 WHEN 'double' THEN 2.0 ELSE 1.0 END::DOUBLE AS k FROM b)
SELECT med_id, dose, unit, modifier, dose * k AS taken, CASE WHEN unit IN ('mcg', 'ug', 'µg') THEN dose * k / 1000 WHEN unit = 'mg' THEN dose * k WHEN unit = 'g' THEN dose * k * 1000 END AS taken_mg FROM c""")
def dose_mentions(t: Tables) -> DataFrame:
    """Doses that the words of a prescription tell, with what is taken of them."""
    words = F.concat_ws(" ", "name", "dose", "unit", "frequency")
    return t.clean_medications.select("med_id", text.dose_of(words).alias("d")).where("d IS NOT NULL").select("med_id", "d.*")


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(s, {_sq('(?i)' + p)}) THEN '{n}'" for n, p in text.MESSAGES) + " ELSE 'general' END"


@query(f"WITH e AS (SELECT trim(coalesce(raw_text, '')) AS s FROM parsed_events), k AS (SELECT {_KIND} AS kind, regexp_matches(s, {_sq('(?i)' + text.SMALL_TALK)}) OR s = '' AS idle FROM e) SELECT CASE WHEN idle THEN 'small_talk' ELSE kind END AS kind, count(*) AS messages FROM k GROUP BY ALL")
def message_kinds(t: Tables) -> DataFrame:
    """How many messages are about what; small talk is about nothing."""
    s = F.trim(F.coalesce("raw_text", F.lit("")))
    kind = F.when((s == "") | s.rlike("(?i)" + text.SMALL_TALK), "small_talk").otherwise(records.classify(s, text.MESSAGES, "general"))
    return t.parsed_events.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("messages"))


# Self-authored: words that stand for others in a search.
SYNONYMS = {"sugar": ("glucose",), "glucose": ("sugar", "hba1c"), "thyroid": ("tsh",), "fat": ("cholesterol", "ldl"), "kidney": ("creatinine",)}
_ALL_TERMS = search.expanded(_TERMS, SYNONYMS)
_LIST = ", ".join(f"'{x}'" for x in _ALL_TERMS)
_SCORED = f"""w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM w WHERE length(term) > 1 GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term), size AS (SELECT count(*) AS docs FROM documents),
wt AS (SELECT doc_id, term, n * (ln((1 + docs) / (1 + d)) + 1) AS x FROM tf JOIN df USING (term), size), nm AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM wt GROUP BY doc_id), by_terms AS (SELECT doc_id, sum(x) / any_value(norm) AS score FROM wt JOIN nm USING (doc_id) WHERE term IN ({_LIST}) GROUP BY doc_id)"""


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 4) AS score FROM by_terms WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def search_top(t: Tables) -> DataFrame:
    """The ten best documents for the terms and their synonyms: a top-k report."""
    scores = search.tfidf_scores(t.documents, "doc_id", "text", _ALL_TERMS).select("doc_id", F.round("score", 9).alias("score"))
    return search.top(scores, "doc_id", 10).select("doc_id", F.round("score", 4).alias("score"))


@query(f"""WITH {_SCORED}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), by_vectors AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q),
a AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS a FROM by_terms), b AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS b FROM by_vectors)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0), 4) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def hybrid_search(t: Tables) -> DataFrame:
    """Terms and vectors fused: the documents' terms and the vectors of the same number, sought by the first vector."""
    e = t.embeddings
    v = e.orderBy("vec_id").limit(1).select("embedding").first()
    by_terms = cut(search.tfidf_scores(t.documents, "doc_id", "text", _ALL_TERMS))
    if v is None:
        return by_terms.select("doc_id", F.round("score", 4).alias("score"))
    asked = F.array(*[F.lit(float(x)) for x in v[0]])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    own = F.col("embedding")
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    by_vectors = e.where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"), (dot(own, asked) / (norm(own) * norm(asked))).alias("score"))
    return search.fused(by_terms, by_vectors, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {_RES} SELECT user_id, obs_id, canonical_name, round(value, 6) AS value, round(high, 6) AS high, 0.3::DOUBLE AS confidence FROM res WHERE high > 0 AND value > 10 * high")
def suspect_results(t: Tables) -> DataFrame:
    """Results above ten times their upper bound: likely misread."""
    got = _dated(t).where("high > 0 AND value > 10 * high")
    return got.select("user_id", "obs_id", "canonical_name", F.round("value", 6).alias("value"), F.round("high", 6).alias("high"), F.lit(0.3).alias("confidence"))


@query("""WITH w AS (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS started FROM events) SELECT event_type, started, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def events_sliding(t: Tables) -> DataFrame:
    """Days that begin every six hours."""
    g = t.events.groupBy("event_type", F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("started"), "n", "total")


@query(f"WITH {_RES} (SELECT 'unlisted' AS side, canonical_name FROM (SELECT DISTINCT canonical_name FROM clean_observations WHERE canonical_name IS NOT NULL EXCEPT SELECT canonical_name FROM dim_tests) WHERE length(canonical_name) < 40) UNION ALL (SELECT 'done', canonical_name FROM (SELECT canonical_name FROM dim_tests INTERSECT SELECT canonical_name FROM res)) UNION ALL (SELECT 'never', canonical_name FROM (SELECT canonical_name FROM dim_tests EXCEPT SELECT canonical_name FROM res))")
def test_sets(t: Tables) -> DataFrame:
    """Names that are no listed test, listed tests with results, and those without."""
    listed = t.dim_tests.select("canonical_name")
    done = _dated(t).select("canonical_name").distinct()
    free = t.clean_observations.select("canonical_name").where("canonical_name IS NOT NULL")
    side = lambda df, s: df.select(F.lit(s).alias("side"), "canonical_name")
    return side(free.subtract(listed).where(F.length("canonical_name") < 40), "unlisted").unionByName(side(listed.intersect(done), "done")).unionByName(side(listed.subtract(done), "never"))


@query(f"WITH g AS (SELECT *, date_effective AS text FROM clean_observations), {sql.stamps('g')}, f AS (SELECT source_doc_id, min(utc_date) AS first FROM stamps WHERE source_doc_id IS NOT NULL AND utc_date IS NOT NULL GROUP BY ALL) SELECT obs_id, first AS day FROM stamps JOIN f USING (source_doc_id) WHERE utc_date IS NULL")
def stamped_days(t: Tables) -> DataFrame:
    """Days of undated results by the other results of their document."""
    rows = records.collected(t.clean_observations.select("obs_id", "source_doc_id", "site_id", "date_effective"), t.dim_sites)
    undated = rows.where("day IS NULL").select("obs_id")
    return maintenance.stamped(rows, "source_doc_id", "day").where("day IS NOT NULL").join(undated, "obs_id", "left_semi").select("obs_id", "day")


@query("WITH w AS (SELECT greatest(max(created_at), max(corrected_at)) - INTERVAL 30 DAY AS since FROM clean_observations) SELECT obs_id, user_id FROM clean_observations, w WHERE created_at > since OR corrected_at > since")
def newly_changed(t: Tables) -> DataFrame:
    """Results made or corrected in the newest 30 days: what an incremental run takes."""
    o = t.clean_observations
    newest = maintenance.watermark(o, "created_at", "corrected_at").first()["watermark"]
    return maintenance.changed(o, F.lit(newest).cast("timestamp") - F.expr("INTERVAL 30 DAYS"), "created_at", "corrected_at").select("obs_id", "user_id")


@query("SELECT event_id, user_id FROM parsed_events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, event_id DESC) BETWEEN 11 AND 20")
def second_page(t: Tables) -> DataFrame:
    """The second page of ten of each user's messages, newest first."""
    return maintenance.page_of(t.parsed_events.select("event_id", "user_id", "created_at"), "user_id", [F.desc_nulls_last("created_at"), F.desc("event_id")], 10, 1).select("event_id", "user_id")


@query(f"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) AS s FROM documents WHERE text IS NOT NULL), i AS (SELECT *, row_number() OVER () AS k FROM s), m AS (SELECT DISTINCT doc_id, k, condition, regexp_matches(s, {_sq(knowledge.RELATIVES)}) AS f FROM i JOIN {dims.values(knowledge.CONDITION_WORDS, 'w', 'word, condition')} ON contains(s, word))
SELECT doc_id, condition, count(*) AS sentences, count(*) FILTER (f) AS of_family FROM m GROUP BY ALL""")
def condition_mentions(t: Tables) -> DataFrame:
    """Conditions that documents name, and how often beside a relative."""
    return text.condition_mentions(t.documents, "doc_id", "text", knowledge.CONDITION_WORDS, knowledge.RELATIVES)
