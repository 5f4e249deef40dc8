"""The inventory's two tables, derived from the tables of a data folder, in Spark and as SQL for comparison."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AS_OF

_EXT = "CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.zip' WHEN 4 THEN '.log' WHEN 5 THEN '.xlsx' WHEN 6 THEN '.tmp' ELSE '.png' END"
_HASH = "CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 59 = 0 THEN '' WHEN doc_id % 61 = 0 THEN '  ' WHEN doc_id % 67 = 0 THEN 'ERROR' || CAST(doc_id AS STRING) ELSE substr(md5(text), 1, 16) END"
_ATTR = "CASE doc_id % 9 WHEN 0 THEN 'ReadOnly, Hidden, System, Archive' WHEN 1 THEN 'Hidden' WHEN 2 THEN 'hidden system' WHEN 3 THEN NULL ELSE 'Normal' END"
_SIGN = "CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN 'file.txt' ELSE 'png' END"


def _when(kind: str, days: str, how: str) -> str:
    """Text of a moment some days before the pinned time, in one of four forms."""
    spark = kind == "spark"
    moment = f"(timestamp_ntz '{AS_OF}' - make_dt_interval({days}, doc_id % 24))" if spark else f"(timestamp '{AS_OF}' - to_days(CAST({days} AS INTEGER)) - to_hours(doc_id % 24))"
    text = (lambda f: f"date_format({moment}, '{f}')") if spark else (lambda f: f"strftime({moment}, '{f}')")
    iso, day_first, date = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd") if spark else ("%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%Y-%m-%d")
    return f"CASE {how} WHEN 0 THEN {text(iso)} WHEN 1 THEN {text(day_first)} WHEN 2 THEN {text(date)} ELSE 'unknown' END"


def files_sql(kind: str) -> str:
    """The files table over documents and labels."""
    integer = "CAST(d.doc_id AS INT)" if kind == "spark" else "doc_id"
    days = [f"CAST((doc_id * {k}) % {m} AS INT)" for k, m in ((7, 2900), (11, 3300))]
    half = "CAST(floor(doc_id / 4) AS BIGINT) % 4"
    del integer
    return f"""
SELECT doc_id AS id, lang || '_' || CAST(doc_id % 400 AS STRING) || {_EXT} AS name, 'host' || CAST(doc_id % 5 AS STRING) AS host, {_EXT} AS extension,
       'user' || CAST(doc_id % 7 AS STRING) AS username, '/' || source || '/' || CAST(doc_id AS STRING) || '_' || lang || {_EXT} AS path,
       CASE WHEN doc_id % 41 = 0 THEN CAST(0 AS BIGINT) WHEN doc_id % 97 = 0 THEN NULL ELSE CAST(n_chars AS BIGINT) * 20000 END AS file_size,
       CASE WHEN doc_id % 37 = 0 THEN '' ELSE source END AS owner, {_HASH} AS fast_hash, {_ATTR} AS file_attributes, {_SIGN} AS file_signature,
       {_when(kind, days[0], 'doc_id % 4')} AS last_modified, {_when(kind, days[1], half)} AS creation_time,
       CASE WHEN doc_id % 20 = 0 THEN 'error' WHEN doc_id % 31 = 0 THEN NULL WHEN labelled THEN 'completed' ELSE 'pending' END AS status,
       CASE WHEN doc_id % 20 = 0 THEN 'reason ' || CAST(doc_id % 3 AS STRING) END AS exclusion_reason, CAST(doc_id % 101 AS INT) AS priority_score
FROM (SELECT d.*, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t"""


def responses_sql(kind: str) -> str:
    """The responses table over labels; every eleventh file has a second response."""
    pick = lambda names, m: "CASE " + m + "".join(f" WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " ELSE NULL END"
    security = "CASE WHEN turn = 1 THEN 'C3' WHEN quality = 1 AND toxic = 0 THEN 'C0' WHEN quality = 0 AND toxic = 0 THEN 'C1' WHEN quality = 1 THEN 'C2' ELSE 'C3' END"
    gdpr = pick(("none", "low", "medium", "high", "critical"), "(doc_id + turn) % 6")
    finance = pick(("none", "invoice", "contract", "budget", "accounting", "payment"), "(doc_id + turn) % 7")
    legal = pick(("none", "employment", "lease", "sale", "nda", "compliance", "litigation"), "(doc_id + turn) % 8")
    json = lambda key, value, conf: f"""CASE WHEN {value} IS NULL THEN 'null' ELSE '{{"{key}": "' || {value} || '", "confidence": ' || CAST({conf} AS STRING) || '}}' END"""
    conf = [f"CAST((doc_id * {k}) % 101 * CAST((doc_id + {k}) % 4 <> 0 AS INT) AS INT)" for k in (3, 5, 7, 9)]
    return f"""
SELECT id, fichier_id, task_id, security_analysis, rgpd_analysis, finance_analysis, legal_analysis, security_confidence, rgpd_confidence, finance_confidence, legal_confidence,
       processing_time_ms, api_tokens_used, resume, security_class, rgpd_risk, finance_type, legal_type
FROM (SELECT doc_id * 2 + turn AS id, doc_id AS fichier_id, 'task' || CAST(doc_id * 2 + turn AS STRING) AS task_id,
       {json('classification', security, conf[0])} AS security_analysis, {json('risk_level', gdpr, conf[1])} AS rgpd_analysis,
       {json('document_type', finance, conf[2])} AS finance_analysis, {json('contract_type', legal, conf[3])} AS legal_analysis,
       {conf[0]} AS security_confidence, {conf[1]} AS rgpd_confidence, {conf[2]} AS finance_confidence, {conf[3]} AS legal_confidence,
       CAST((doc_id * 13) % 5000 AS INT) AS processing_time_ms, CAST((doc_id * 17) % 900 AS INT) AS api_tokens_used, 'resume ' || CAST(doc_id AS STRING) AS resume,
       {security} AS security_class, {gdpr} AS rgpd_risk, {finance} AS finance_type, {legal} AS legal_type
FROM (SELECT doc_id, quality, toxic, 0 AS turn FROM labels UNION ALL SELECT doc_id, quality, toxic, 1 AS turn FROM labels WHERE doc_id % 11 = 0) t) u"""


def common_tables() -> str:
    """The WITH clause of the comparison SQL: files, responses, active files, current verdicts, and their joins."""
    files, responses = files_sql("duckdb"), responses_sql("duckdb")
    return f"""WITH files AS ({files.replace('AS STRING', 'AS VARCHAR')}),
responses AS ({responses.replace('AS STRING', 'AS VARCHAR')}),
active AS (SELECT id, name, path, extension, fast_hash, coalesce(file_size, 0) AS file_size, CASE WHEN coalesce(owner, '') = '' THEN 'Unknown' ELSE owner END AS owner, creation_time, last_modified, status
           FROM files WHERE status IS NULL OR status <> 'error'),
verdict AS (SELECT fichier_id, security_class, rgpd_risk, finance_type, legal_type FROM responses QUALIFY row_number() OVER (PARTITION BY fichier_id ORDER BY id DESC) = 1),
joined AS (SELECT f.*, r.id AS response_id, r.security_class, r.rgpd_risk, r.finance_type, r.legal_type, r.security_analysis, r.rgpd_analysis, r.finance_analysis, r.legal_analysis, r.processing_time_ms, r.resume,
           r.security_confidence, r.rgpd_confidence, r.finance_confidence, r.legal_confidence FROM files f LEFT JOIN responses r ON f.id = r.fichier_id),
judged AS (SELECT a.*, v.security_class, v.rgpd_risk, v.finance_type, v.legal_type FROM active a LEFT JOIN verdict v ON a.id = v.fichier_id)
"""


class Tables:
    """The tables of a data folder and the inventory's tables over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _over(self, sql: str, *names: str) -> DataFrame:
        return self.spark.sql(sql.replace("FROM documents", "FROM {documents}").replace("JOIN labels", "JOIN {labels}").replace("FROM labels", "FROM {labels}"), **{n: self.raw(n) for n in names})

    @cached_property
    def files(self) -> DataFrame:
        return self._over(files_sql("spark"), "documents", "labels")

    @cached_property
    def responses(self) -> DataFrame:
        return self._over(responses_sql("spark").replace("{", "{{").replace("}", "}}"), "labels")

    @cached_property
    def joined(self) -> DataFrame:
        from ..operators import active

        return active.with_responses(self.files, self.responses)

    @cached_property
    def active(self) -> DataFrame:
        from ..operators import active

        return active.active_files(self.files)

    @cached_property
    def judged(self) -> DataFrame:
        from ..operators import active

        return active.judged(self.active, self.responses)

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    def as_of(self) -> str:
        return AS_OF

    @staticmethod
    def moment() -> object:
        return F.to_timestamp(F.lit(AS_OF))
