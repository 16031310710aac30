"""Column expressions: labels, texts, states, keys, decoding."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from evalspark.functions import scalars, state as states, text as texts
from evalspark.operators import requests as reqs
from evalspark.operators import sampling, scoring
from evalspark.plans import catalog
from evalspark.plans.catalog import DOC_LANG, DOC_QUALITY, ORDER_STATUS
from evalspark.registry import judges, sql
from evalspark.registry.base import query
from evalspark.registry.sampling_queries import K_OF_EACH, LIMITED_LANG, SHORT_DOC, lang_train
from evalspark.session import new_path
from evalspark.sources import tables

DOC_STATE = "to_json({'document': text})"
LANG_STATE = "to_json({'article': text})"
ORDER_STATE = (
    "to_json({'order': {'priority': o_orderpriority, 'segment': c_mktsegment, 'nation': n_name, "
    "'total_price': round(o_totalprice, 2), 'account_balance': round(c_acctbal, 2)}})"
)


def key_sql(model: str, state: str, question: str) -> str:
    digest = hashlib.sha256(question.encode()).hexdigest()
    return f"sha256('{model}' || chr(1) || {state} || chr(1) || '{digest}')"


@query("load_table", "SELECT doc_id AS row_id, text, lang AS label FROM documents")
def load_table(spark, folder):
    return catalog.doc_lang_rows(spark, folder)


@query("csv_source", "SELECT page_id, url, html FROM pages")
def csv_source(spark, folder):
    """The pages written as quoted CSV with a header, and read back."""
    path = new_path(spark, "pages-csv")
    tables.write_csv(tables.load(spark, folder, "pages"), path)
    return tables.read_csv(spark, path, "page_id long, url string, html string", line_breaks=True)


ONE_LINE = "trim(regexp_replace(text, '[\\t\\r\\n ]+', ' ', 'g'))"


@query("tsv_source", f"SELECT role AS label_str, {ONE_LINE} AS text FROM conversations")
def tsv_source(spark, folder):
    """Conversation turns as tab-separated lines without a header, read back with named columns."""
    path = new_path(spark, "turns-tsv")
    one_line = F.trim(F.regexp_replace("text", r"[\t\r\n ]+", " "))
    tables.write_tsv(tables.load(spark, folder, "conversations").select("role", one_line.alias("text")), path)
    return tables.read_tsv(spark, path, tables.SMS)


@query("binary_label", "SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders")
def binary_label(spark, folder):
    orders = tables.load(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").alias("row_id"), scalars.binary_label(F.col("o_orderstatus"), "F").alias("label"))


NO_BREAKS = f"regexp_replace(html, '{texts.MARKUP_BREAK}', ' ', 'g')"


@query("strip_breaks", f"SELECT page_id, {sql.strip(NO_BREAKS)} AS text FROM pages")
def strip_breaks(spark, folder):
    return tables.load(spark, folder, "pages").select("page_id", texts.strip_breaks(F.col("html")).alias("text"))


TITLE = sql.strip("split_part(split_part(text, ',', 2), '.', 1)")


@query("extract_title", f"SELECT doc_id, CASE WHEN {TITLE} = '' THEN 'Unknown' ELSE {TITLE} END AS title FROM documents")
def extract_title(spark, folder):
    return tables.load(spark, folder, "documents").select("doc_id", texts.extract_title(F.col("text")).alias("title"))


REGIONS = {0: "region zero", 1: "region one", 2: "region two"}


@query(
    "table_features",
    """SELECT c_custkey, CAST(n_finished IS NOT NULL AS INTEGER) AS has_finished,
  coalesce(n_finished, 0) + coalesce(n_open, 0) + 1 AS family_size, round(c_acctbal, 1) AS balance,
  CASE n_regionkey WHEN 0 THEN 'region zero' WHEN 1 THEN 'region one' WHEN 2 THEN 'region two' END AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS n_finished,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def table_features(spark, folder):
    """Presence flag, derived sum, rounding and a code map where an unknown code becomes null."""
    status = F.col("o_orderstatus")
    orders = tables.load(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count_if(status == "F").alias("f"), F.count_if(status == "O").alias("n_open")
    ).select("o_custkey", F.nullif("f", F.lit(0)).alias("n_finished"), "n_open")
    customers = tables.load(spark, folder, "customer").join(
        tables.load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        "c_custkey", scalars.presence(F.col("n_finished")).alias("has_finished"),
        (F.coalesce("n_finished", F.lit(0)) + F.coalesce("n_open", F.lit(0)) + 1).alias("family_size"),
        F.round("c_acctbal", 1).alias("balance"),
        scalars.map_code(F.col("n_regionkey"), REGIONS, strict=False).alias("region"),
    )


@query("state_json", f"SELECT row_id, CAST({ORDER_STATE} AS VARCHAR) AS state, length({ORDER_STATE}) AS size FROM {sql.ORDERS}")
def state_json(spark, folder):
    rows = catalog.order_status_rows(spark, folder)
    return rows.select("row_id", ORDER_STATUS.state_json().alias("state"),
                       states.state_size(ORDER_STATUS.state()).cast("long").alias("size"))


@query("short_flag", f"SELECT row_id, {SHORT_DOC} AS short FROM {sql.DOCS}")
def short_flag(spark, folder):
    return catalog.doc_lang_rows(spark, folder).select("row_id", LIMITED_LANG.is_short().alias("short"))


@query(
    "truncate_state",
    f"SELECT doc_id, substring(text, 1, 4000) AS judged, {sql.shortened('text', 110)} AS preview FROM documents",
)
def truncate_state(spark, folder):
    return tables.load(spark, folder, "documents").select(
        "doc_id", F.substring("text", 1, 4000).alias("judged"),
        texts.truncate(F.col("text"), 110).alias("preview"),
    )


SHORT_TEXT = sql.shortened("text", LIMITED_LANG.example_text)


@query(
    "shorten_example",
    f"SELECT doc_id, CAST(to_json({{'text': {SHORT_TEXT}, 'origin': {{'source': source, 'n_chars': n_chars}}}}) AS VARCHAR) AS state FROM documents",
)
def shorten_example(spark, folder):
    docs = tables.load(spark, folder, "documents")
    nested = F.struct("text", F.struct("source", "n_chars").alias("origin"))
    packed = docs.select("doc_id", nested.alias("state"))
    short = states.shorten(F.col("state"), packed.schema["state"].dataType, LIMITED_LANG.example_text)
    return packed.select("doc_id", states.state_json(short).alias("state"))


@query(
    "criterion_key",
    f"SELECT row_id, CASE WHEN label = '1' THEN 'true' ELSE 'false' END AS criterion FROM {sql.ORDERS}",
)
def criterion_key(spark, folder):
    rows = catalog.order_status_rows(spark, folder)
    return rows.select("row_id", ORDER_STATUS.criterion_key(F.col("label")).alias("criterion"))


DOC_KEY = key_sql(judges.MODEL, LANG_STATE, DOC_LANG.question())


@query("request_key", f"SELECT row_id, {DOC_KEY} AS request_key FROM {sql.DOCS}")
def request_key(spark, folder):
    rows = catalog.doc_lang_rows(spark, folder)
    return reqs.build_requests(DOC_LANG, rows, DOC_LANG.question(), judges.MODEL).select("row_id", "request_key")


@query(
    "request_body",
    f"""SELECT row_id, '{{"model":"{judges.MODEL}","state":' || {ORDER_STATE} || ',"questions":{{"label":'
|| '{ORDER_STATUS.question()}' || '}}}}' AS body FROM {sql.ORDERS}""",
)
def request_body(spark, folder):
    rows = catalog.order_status_rows(spark, folder)
    built = reqs.build_requests(ORDER_STATUS, rows, ORDER_STATUS.question(), judges.MODEL)
    return reqs.request_body(built, ORDER_STATUS.question()).select("row_id", "body")


@query(
    "request_export",
    f"""SELECT '{{"model":"{judges.MODEL}","state":' || {ORDER_STATE} || ',"questions":{{"label":'
|| '{ORDER_STATUS.question()}' || '}}}}' AS value FROM {sql.ORDERS}""",
)
def request_export(spark, folder):
    """All request bodies written as text lines, and read back."""
    rows, path = catalog.order_status_rows(spark, folder), new_path(spark, "export")
    built = reqs.build_requests(ORDER_STATUS, rows, ORDER_STATUS.question(), judges.MODEL)
    reqs.export_requests(built, ORDER_STATUS.question(), path)
    return spark.read.text(path)


CRITERIA = " UNION ALL ".join(f"SELECT '{k}' AS criterion, '{v}' AS description" for k, v in DOC_LANG.criteria.items())


@query(
    "fewshot_criteria",
    f"""WITH {sql.split(sql.DOCS)}, {sql.shots('train', K_OF_EACH, SHORT_DOC)}
SELECT criterion, description, coalesce(examples, '') AS examples FROM ({CRITERIA}) LEFT JOIN
(SELECT label AS criterion, string_agg(to_json({{'article': {SHORT_TEXT}}}), chr(10) ORDER BY row_id) AS examples
 FROM shots GROUP BY label) USING (criterion)""",
)
def fewshot_criteria(spark, folder):
    shots = sampling.shots_k(lang_train(spark, folder), list(DOC_LANG.labels), 3, LIMITED_LANG.is_short())
    lists = reqs.fewshot_criteria(LIMITED_LANG, shots)
    return lists.select("criterion", "description", F.array_join("examples", "\n").alias("examples"))


PROBABILITY = "round(1.0 / (1.0 + exp(-(value - 20.0) / 10.0)), 6)"


@query(
    "decode_binary",
    f"SELECT event_id, CASE WHEN p >= 0.5 THEN '1' ELSE '0' END AS pred, p AS score "
    f"FROM (SELECT event_id, {PROBABILITY} AS p FROM events)",
)
def decode_binary(spark, folder):
    p = F.round(1.0 / (1.0 + F.exp(-(F.col("value") - 20.0) / 10.0)), 6)
    records = tables.load(spark, folder, "events").select("event_id", p.alias("p_yes"))
    return scoring.decode(DOC_QUALITY, records).select("event_id", "pred", "score")


@query(
    "decode_choice",
    f"SELECT row_id, choice AS pred, confidence FROM ({judges.language_sql(sql.DOCS, LANG_STATE, 'row_id, label')})",
)
def decode_choice(spark, folder):
    rows = reqs.build_requests(DOC_LANG, catalog.doc_lang_rows(spark, folder), DOC_LANG.question(), judges.MODEL)
    records = scoring.score_rows(rows, judges.LanguageJudge())
    return scoring.decode(DOC_LANG, records).select("row_id", "pred", "confidence")


@query(
    "clipped_logit",
    f"SELECT event_id, round(ln(p / (1 - p)), 6) AS logit FROM "
    f"(SELECT event_id, greatest(least({PROBABILITY}, 0.9999::DOUBLE), 0.0001::DOUBLE) AS p FROM events)",
)
def clipped_logit(spark, folder):
    p = F.round(1.0 / (1.0 + F.exp(-(F.col("value") - 20.0) / 10.0)), 6)
    return tables.load(spark, folder, "events").select("event_id", F.round(scalars.clipped_logit(p), 6).alias("logit"))

