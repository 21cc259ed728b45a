"""Queries of the problems on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.mapping import map_fields, match
from vitalframe.llm.mixing import mix, share_report
from vitalframe.llm.packing import fill_report, pack
from vitalframe.llm.pages import page_noise, page_paragraphs
from vitalframe.llm.redaction import redact_texts
from vitalframe.llm.subjects import assign_subjects
from vitalframe.llm.tokens import token_counts
from vitalframe.plans import records as core
from vitalframe.session import cut
from vitalframe.tables import Tables


def _labels(dim: DataFrame, name: str, key: str, label: str) -> DataFrame:
    """(list_name, key, label) of a dimension with a key, a name and an array of aliases."""
    words = F.concat(F.array(F.col(key), F.col(label)), F.coalesce("aliases", F.array().cast("array<string>")))
    return dim.select(F.lit(name).alias("list_name"), F.col(key).alias("key"), F.explode(words).alias("label")).where("label IS NOT NULL")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    tests, labs = _labels(t.dim_tests, "tests", "canonical_name", "display_name"), _labels(t.dim_labs, "labs", "lab_key", "lab_name")
    literal = (
        tests.select(F.lit("test_name").alias("field_name"), "label")
        .unionByName(t.dim_tests.select(F.lit("canonical_name").alias("field_name"), F.col("canonical_name").alias("label")))
        .unionByName(labs.select(F.lit("source_lab").alias("field_name"), "label"))
    )
    fields = {"test_name": "tests", "canonical_name": "tests", "source_lab": "labs"}
    return map_fields(t.clean_observations, "obs_id", fields, tests.unionByName(labs), literal).select("obs_id", "field_name", "entry_key")


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    events = t.parsed_events.select(F.col("event_id").alias("record_id"), F.col("raw_text").alias("text"))
    return redact_texts(events.unionByName(t.redaction_results.select(F.col("result_id").alias("record_id"), "text")), "record_id", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_redacted(spark, folder).select("record_id", F.inline("items")).select("record_id", "kind", "start_pos")


def _pages(t: Tables) -> DataFrame:
    columns = ("page_id", "source_doc_id", "page_number", "text")
    return t.parsed_pages.select(*columns).unionByName(t.image_ocr_results.select(*columns))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_noise(_pages(Tables(spark, folder)), "source_doc_id", "page_id", "page_number", "text").select("page_id", "line_no", "noise")


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return page_paragraphs(_pages(Tables(spark, folder)), "source_doc_id", "page_id", "page_number", "text")


CAPACITY = 2048


def _sizes(t: Tables) -> DataFrame:
    """Documents with their sizes in tokens, kept, as they are read several times."""
    return cut(token_counts(t.documents, "doc_id", "text", ("source",)))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sizes(Tables(spark, folder)), "doc_id", "n_tokens", CAPACITY)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p8_packed(spark, folder), CAPACITY)


def p9_mixed(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return mix(_sizes(t), t.mix_targets, "doc_id", "source", "n_tokens")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return share_report(p9_mixed(spark, folder), Tables(spark, folder).mix_targets)


def p10_assigned(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return assign_subjects(t.documents, "doc_id", "text", "lang", t.dim_subjects, t.subject_labels)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_assigned(spark, folder).select("doc_id", "subject")


def p10_makeup(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents are about each subject."""
    found = p10_found(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"))
    return F.broadcast(Tables(spark, folder).dim_subjects.select("subject")).join(found, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"))


class Mapped(core.Whole):
    """Whole tables whose results also have the tests that problem 2 maps their free names to."""

    def names(self) -> DataFrame:
        """(value, entry_key) of each distinct name of a test, written to a checkpoint; marks as N/A name none."""
        o = self.clean_observations
        asked = o.select(F.explode(F.array_distinct(F.array("canonical_name", "test_name"))).alias("value")).where("value IS NOT NULL").distinct()
        asked = asked.where(~F.col("value").rlike(r"(?i)^\W*n\W+a\W*$")).select(F.lit("tests").alias("list_name"), "value")
        return cut(match(asked, _labels(self.dim_tests, "tests", "canonical_name", "display_name")).where("entry_key IS NOT NULL").select("value", "entry_key"))


def _mapped(query):  # noqa: ANN001, ANN202
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(Mapped(spark, folder))

    return run


QUERIES = {"p10_found": p10_found, "p10_assigned": p10_assigned, "p10_makeup": p10_makeup, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_mixed": p9_mixed, "p9_shares": p9_shares, "p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p2_found": p2_found, "p5_found": p5_found, "p5_redacted": p5_redacted}
QUERIES |= {f"{q.__name__}_mapped": _mapped(q) for q in (core.latest_per_test, core.lab_trends, core.critical_alerts)}
SQL: dict[str, str] = {}
