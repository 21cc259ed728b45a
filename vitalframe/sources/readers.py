"""Readers of health-data exports into flat records, by Spark's own sources.

Bad input never fails a job: what can't be read comes out in a column of its own or is counted.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Resource types that carry results, medications, conditions, allergies, immunizations, documents.
RESOURCES = ("Observation", "MedicationRequest", "MedicationStatement", "Condition", "AllergyIntolerance", "Immunization", "DiagnosticReport")
_CODING = "struct<text: string, coding: array<struct<system: string, code: string, display: string>>>"
FHIR = (
    f"resourceType string, id string, status string, code {_CODING}, category array<{_CODING}>, medicationCodeableConcept {_CODING}, vaccineCode {_CODING}, effectiveDateTime string, issued string, authoredOn string, onsetDateTime string, occurrenceDateTime string, "
    "valueQuantity struct<value: double, unit: string>, valueString string, referenceRange array<struct<low: struct<value: double>, high: struct<value: double>, text: string>>"
)


def _label(c: str):  # noqa: ANN202
    return F.coalesce(F.col(f"{c}.text"), F.get(F.col(f"{c}.coding"), F.lit(0))["display"], F.get(F.col(f"{c}.coding"), F.lit(0))["code"])


def partial_date(c):  # noqa: ANN001, ANN201
    """A date of which month and day may be missing: they are then the first."""
    s = F.substring(c, 1, 10)
    return F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01"))).when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01"))).otherwise(s).try_cast("date")


def flatten(resources: DataFrame) -> DataFrame:
    """(resource_id, kind, name, value, value_text, unit, low, high, day) of FHIR resources of the known types; other
    types are left out. Observations are labs or vitals by category, else labs if they have a quantity."""
    cat = F.lower(F.get(F.get(F.col("category"), F.lit(0))["coding"], F.lit(0))["code"])
    kind = (
        F.when((F.col("resourceType") == "Observation") & (cat == "vital-signs"), "vital")
        .when((F.col("resourceType") == "Observation") & ((cat == "laboratory") | F.col("valueQuantity.value").isNotNull()), "lab")
        .when(F.col("resourceType").isin("MedicationRequest", "MedicationStatement"), "medication")
        .when(F.col("resourceType") == "Condition", "condition").when(F.col("resourceType") == "AllergyIntolerance", "allergy").when(F.col("resourceType") == "Immunization", "immunization").when(F.col("resourceType") == "DiagnosticReport", "report")
    )
    first = F.get(F.col("referenceRange"), F.lit(0))
    return resources.select(
        F.col("id").alias("resource_id"), kind.alias("kind"), F.coalesce(_label("code"), _label("medicationCodeableConcept"), _label("vaccineCode")).alias("name"), F.col("valueQuantity.value").alias("value"), F.col("valueString").alias("value_text"), F.col("valueQuantity.unit").alias("unit"),
        first["low"]["value"].alias("low"), first["high"]["value"].alias("high"), partial_date(F.coalesce("effectiveDateTime", "authoredOn", "onsetDateTime", "occurrenceDateTime", "issued")).alias("day"),
    ).where("kind IS NOT NULL")


def read_fhir_ndjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of newline-delimited resources. Identifying fields aren't in the schema, so they are never
    read."""
    raw = spark.read.text(path).where("trim(value) != ''")
    parsed = raw.select("value", F.from_json("value", FHIR, {"mode": "PERMISSIVE"}).alias("r"))
    return flatten(parsed.where("r.resourceType IS NOT NULL").select("r.*")), parsed.where("r.resourceType IS NULL").select("value")


def read_fhir_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Records of the entries of Bundle files."""
    bundles = spark.read.text(path, wholetext=True)
    entries = bundles.select(F.explode(F.from_json(F.get_json_object("value", "$.entry"), "array<struct<resource: string>>")).alias("e"))
    return flatten(entries.select(F.from_json("e.resource", FHIR).alias("r")).select("r.*"))


def read_genotypes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variants, malformed lines) of tab- or comma-separated genotype files: rsid, chromosome, position, genotype (two
    allele columns are joined). Comments and a header line are left out; no-calls are malformed."""
    lines = spark.read.text(path).where("trim(value) != '' AND NOT startswith(value, '#') AND NOT lower(value) LIKE 'rsid%' AND NOT lower(value) LIKE '\"rsid%'")
    part = F.transform(F.split(F.regexp_replace("value", '"', ""), r"[\t,]"), lambda x: F.trim(x))
    cells = lines.select("value", part.alias("p"))
    genotype = F.upper(F.concat(F.coalesce(F.get("p", F.lit(3)), F.lit("")), F.coalesce(F.get("p", F.lit(4)), F.lit(""))))
    v = cells.select("value", F.lower(F.get("p", F.lit(0))).alias("rsid"), F.upper(F.get("p", F.lit(1))).alias("chromosome"), F.get("p", F.lit(2)).try_cast("bigint").alias("position"), genotype.alias("genotype"))
    good = F.coalesce(F.col("rsid").rlike(r"^(rs|i)\d+$") & F.col("chromosome").rlike(r"^([1-9]|1\d|2[0-2]|X|Y|MT?)$") & F.col("position").isNotNull() & F.col("genotype").rlike("^[ACGTDI]{1,2}$"), F.lit(False))
    return v.where(good).drop("value"), v.where(~good).select("value")


def genotype_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """rsids whose two files tell other alleles, in whatever order."""
    alleles = lambda c: F.array_sort(F.split(c, ""))
    return a.select("rsid", F.col("genotype").alias("old")).join(b.select("rsid", F.col("genotype").alias("new")), "rsid").where(alleles(F.col("old")) != alleles(F.col("new")))


def read_health_xml(spark: SparkSession, path: str) -> DataFrame:
    """(type, source, unit, started, ended, value, value_text) of the Record elements of a health export."""
    schema = "_type string, _sourceName string, _unit string, _startDate string, _endDate string, _value string"
    df = spark.read.format("xml").option("rowTag", "Record").schema(schema).load(path)
    at = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    return df.select(F.regexp_replace("_type", "^HK(Quantity|Category)TypeIdentifier", "").alias("type"), F.col("_sourceName").alias("source"), F.col("_unit").alias("unit"), at("_startDate").alias("started"), at("_endDate").alias("ended"), F.col("_value").try_cast("double").alias("value"), F.col("_value").alias("value_text"))


def read_metric_json(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(metric, unit, at, value) of an automatic metric export: data.metrics[].data[]; the value is the quantity, else
    the average. since: only points after this time."""
    schema = "data struct<metrics: array<struct<name: string, units: string, data: array<struct<date: string, qty: double, Avg: double>>>>>"
    m = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data.metrics").alias("m")).select("m.name", "m.units", F.explode("m.data").alias("p"))
    forms = [F.try_to_timestamp("p.date", F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
    out = m.select(F.col("name").alias("metric"), F.col("units").alias("unit"), F.coalesce(*forms).alias("at"), F.coalesce("p.qty", "p.Avg").alias("value")).where("value IS NOT NULL AND at IS NOT NULL")
    return out.where(F.col("at") > F.lit(since).cast("timestamp")) if since else out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_fhir(results: DataFrame) -> DataFrame:
    """One resource, as JSON text, for each result: (user_id, resource)."""
    code = F.struct(F.col("canonical_name").alias("text"))
    quantity = F.struct("value", "unit")
    bounds = F.array(F.struct(F.struct(F.col("low").alias("value")).alias("low"), F.struct(F.col("high").alias("value")).alias("high")))
    resource = F.struct(F.lit("Observation").alias("resourceType"), F.col("obs_id").alias("id"), F.lit("final").alias("status"), code.alias("code"), F.date_format("day", "yyyy-MM-dd").alias("effectiveDateTime"), quantity.alias("valueQuantity"), bounds.alias("referenceRange"))
    return results.select("user_id", F.to_json(resource).alias("resource"))


# Code of a section -> kind of its entries.
SECTIONS = {"30954-2": "lab", "10160-0": "medication", "11450-4": "condition", "48765-2": "allergy", "11369-6": "immunization"}


def _section_entries(content: bytes) -> list[tuple]:
    """(kind, name, code, value, unit, low, high, time) of the entries of one clinical document; none if it is no XML."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return []
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    inside = lambda e, *names: [x for x in e.iter() if tag(x) in names]
    out = []
    for section in inside(root, "section"):
        code = next((x.get("code") for x in section if tag(x) == "code"), None)
        kind = SECTIONS.get(code or "")
        if not kind:
            continue
        wanted = {"lab": ("observation",), "medication": ("manufacturedMaterial",), "immunization": ("manufacturedMaterial",), "condition": ("observation",), "allergy": ("playingEntity",)}[kind]
        for entry in (x for x in section if tag(x) == "entry"):
            times = [x.get("value") or next((y.get("value") for y in x if tag(y) in ("low", "center")), None) for x in inside(entry, "effectiveTime")]
            time = next((t for t in times if t), None)
            for item in inside(entry, *wanted):
                own = next((x.get("value") or next((y.get("value") for y in x if tag(y) in ("low", "center")), None) for x in item if tag(x) == "effectiveTime"), None)
                value = next((x for x in item if tag(x) == "value"), None)
                named = value if kind == "condition" and value is not None else next((x for x in item if tag(x) == "code"), None)
                name = None if named is None else named.get("displayName") or next((x.text for x in inside(named, "originalText") if x.text), None)
                if not name:
                    continue
                number = value.get("value") if value is not None and kind == "lab" else None
                bounds = [x for r in inside(item, "referenceRange") for x in inside(r, "low", "high")]
                bound = lambda n, bounds=bounds: next((x.get("value") for x in bounds if tag(x) == n), None)
                out.append((kind, name, named.get("code"), number if number is not None else (value.text if value is not None and kind == "lab" else None), value.get("unit") if value is not None and kind == "lab" else None, bound("low"), bound("high"), own or time))
    return out


def read_clinical_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, name, code, value_text, value, unit, low, high, day) of the labs, medications, conditions, allergies
    and immunizations of clinical XML documents, one file a document; files that are no XML give nothing."""
    schema = "path string, kind string, name string, code string, value_text string, unit string, low string, high string, at string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, c in zip(f["path"], f["content"]) for r in _section_entries(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "code", "value_text", "unit", "low", "high", "at"], dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    s = F.substring("at", 1, 8)
    day = F.when(F.length(s) == 8, F.try_to_date(s, "yyyyMMdd")).when(F.length(s) == 6, F.try_to_date(F.concat(s, F.lit("01")), "yyyyMMdd")).when(F.length(s) == 4, F.try_to_date(F.concat(s, F.lit("0101")), "yyyyMMdd"))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return files.mapInPandas(run, schema).select("path", "kind", "name", "code", "value_text", F.col("value_text").try_cast("double").alias("value"), "unit", number("low"), number("high"), day.alias("day"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, kind, content) of the files in ZIP archives: 'health_xml', 'clinical_xml', 'fhir', 'pdf', 'table' or
    'other', by name and first bytes. Broken archives give nothing."""

    def kind_of(name: str, head: bytes) -> str:
        low = name.lower()
        if low.endswith(".pdf") or head.startswith(b"%PDF"):
            return "pdf"
        if low.endswith(".xml"):
            return "clinical_xml" if b"ClinicalDocument" in head else "health_xml" if b"HealthData" in head else "other"
        if low.endswith((".json", ".ndjson")):
            return "fhir" if b"resourceType" in head else "other"
        return "table" if low.endswith((".csv", ".tsv", ".txt")) else "other"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                        for n in z.namelist():
                            if not n.endswith("/"):
                                content = z.read(n)
                                rows.append((p, n, kind_of(n, content[:4096]), content))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "kind", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, kind string, content binary")


def to_knowledge(stores: dict[str, DataFrame]) -> DataFrame:
    """(store, row) of tables as JSON lines, to be written as text."""
    parts = [df.select(F.lit(name).alias("store"), F.to_json(F.struct("*")).alias("row")) for name, df in sorted(stores.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def from_knowledge(lines: DataFrame, store: str, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a store whose keys (null equals null) existing has not, each key once."""
    from vitalframe.operators.records import anti_new

    rows = lines.where(F.col("store") == store).select(F.from_json("row", existing.schema.simpleString()).alias("r")).select("r.*")
    return anti_new(rows, existing, keys)


def to_markdown(sections: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(user_id, markdown): for each user the sections (title, table with user_id, columns), each a list of its rows in
    the order of the columns; users without rows in a section have none of it."""
    out = None
    for i, (title, df, columns) in enumerate(sections):
        line = F.concat(F.lit("- "), F.concat_ws(", ", *[F.col(c).cast("string") for c in columns]))
        text = df.groupBy("user_id").agg(F.array_sort(F.collect_list(line)).alias("_l"))
        part = text.select("user_id", F.lit(i).alias("_i"), F.concat(F.lit(f"## {title}\n"), F.array_join("_l", "\n")).alias("_t"))
        out = part if out is None else out.unionByName(part)
    parts = out.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_p"))
    return parts.select("user_id", F.array_join(F.transform("_p", lambda p: p["_t"]), "\n\n").alias("markdown"))
