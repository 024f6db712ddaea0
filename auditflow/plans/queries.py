"""The registry: every query with its oracle statement, where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditflow.functions.lineage import cut, scratch, state_of, written
from auditflow.operators import auditlog, corpus, restore
from auditflow.operators import events as ev
from auditflow.operators import semantic as sem
from auditflow.operators.anonymize import vault
from auditflow.operators.detect import findings, with_findings
from auditflow.operators.merge import with_merged
from auditflow.operators.requests import audit_requests as audit_all_requests
from auditflow.operators.score import audit, report, scores
from auditflow.plans import inputs as I
from auditflow.plans import oracle as O
from auditflow.rules import RULES, rules_frame
from auditflow.sources import tables
from auditflow.sources.tables import load
from auditflow.streaming import guard

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# --- Detection -----------------------------------------------------------------

def _slug(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_")


def _register_rule(rule) -> None:
    """The values one rule alone finds in the notes."""
    @query(f"rule_{_slug(rule.label)}", O.detected(
        O.NOTES, "SELECT doc_id, finding_ord, category, severity, prefix, quote FROM found", rules=(rule,)))
    def run(spark, sf_dir):
        found = findings(I.notes(spark, sf_dir), rules=(rule,))
        return found.select("doc_id", "finding_ord", "category", "severity", F.lit(rule.prefix).alias("prefix"), "quote")


for _rule in RULES:
    _register_rule(_rule)


def _register_document_rule(name: str, label: str) -> None:
    rules = tuple(r for r in RULES if r.label == label)

    @query(name, O.detected(O.DOCUMENTS, "SELECT doc_id, finding_ord, quote FROM found", rules=rules))
    def run(spark, sf_dir):
        return findings(I.documents(spark, sf_dir), rules=rules).select("doc_id", "finding_ord", "quote")


for _name, _label in (
    ("documents_card", "Credit / Debit Card"), ("documents_email", "Email Address"),
    ("documents_phone", "Phone Number"), ("documents_ipv4", "IPv4 Address"),
    ("documents_password", "Password / Credential"),
):
    _register_document_rule(_name, _label)

_BY_LABEL = """SELECT label, category, severity, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs
FROM found GROUP BY label, category, severity"""


def _by_label(found: DataFrame) -> DataFrame:
    """Findings and texts per label: a text adds one row per label before the shuffle."""
    per_label = F.transform(F.array_distinct("findings.rule_ord"), lambda r: F.struct(
        r.alias("rule_ord"), F.size(F.filter("findings", lambda f: f["rule_ord"] == r)).alias("n")))
    totals = found.select(F.explode(per_label).alias("p")).groupBy("p.rule_ord").agg(
        F.sum("p.n").alias("n_findings"), F.count("*").alias("n_docs"))
    named = rules_frame(found.sparkSession).select("rule_ord", "label", "category", "severity")
    return totals.join(F.broadcast(named), "rule_ord").drop("rule_ord")  # the catalogue: 27 rows


@query("findings_by_label", O.detected(O.DOCUMENTS, _BY_LABEL))
def findings_by_label(spark, sf_dir):
    return _by_label(with_findings(I.documents(spark, sf_dir)))


@query("page_findings", O.detected("SELECT page_id AS doc_id, html AS text FROM pages",
       "SELECT doc_id AS page_id, finding_ord, label, category, severity, quote FROM found"))
def page_findings(spark, sf_dir):
    pages = tables.spread(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return findings(pages, key="page_id", text_col="html").drop("rule_ord", "source")


@query("conversation_findings", O.detected(
    "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations", _BY_LABEL))
def conversation_findings(spark, sf_dir):
    said = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return _by_label(with_findings(tables.spread(said, "doc_id")))


@query("benchmark_findings", O.detected("SELECT item_id AS doc_id, text FROM benchmark", _BY_LABEL))
def benchmark_findings(spark, sf_dir):
    return _by_label(with_findings(load(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")))


@query("note_findings", O.detected(O.NOTES, """SELECT doc_id, finding_ord, 'p' || finding_ord AS id, category, severity,
  quote AS verbatim_quote, label AS entity_type, suggested AS suggested_synthetic,
  'Matches standard structure for sensitive ' || label || '.' AS risk_explanation, source FROM found"""))
def note_findings(spark, sf_dir):
    found = with_findings(I.notes(spark, sf_dir))
    return found.select("doc_id", F.inline_outer("findings")).where("id is not null").drop("rule_ord")


# --- Merge, spans, tokens, scores ------------------------------------------------

def _audited_notes(spark, sf_dir, **options) -> DataFrame:
    return audit(I.notes(spark, sf_dir), I.note_semantic(spark, sf_dir), **options)


@query("merged_findings", O.audited(O.NOTES, """SELECT doc_id, finding_ord, source, category, severity,
  entity AS entity_type, verbatim AS verbatim_quote FROM merged""", semantic=O.SEMANTIC))
def merged_findings(spark, sf_dir):
    merged = with_merged(with_findings(I.notes(spark, sf_dir)), I.note_semantic(spark, sf_dir))
    return merged.select("doc_id", F.explode_outer("findings").alias("f")).where("f is not null").select(
        "doc_id", "f.finding_ord", "f.source", "f.category", "f.severity", "f.entity_type", "f.verbatim_quote")


_SPANS = "SELECT doc_id, start, len, finding_ord FROM kept"


@query("spans_kept", O.audited(O.DOCUMENTS, _SPANS))
def spans_kept(spark, sf_dir):
    return corpus.spans_table(audit(I.documents(spark, sf_dir))).select("doc_id", "start", "len", "finding_ord")


@query("note_spans_kept", O.audited(O.NOTES, _SPANS, semantic=O.SEMANTIC))
def note_spans_kept(spark, sf_dir):
    return corpus.spans_table(_audited_notes(spark, sf_dir)).select("doc_id", "start", "len", "finding_ord")


@query("token_numbers", O.audited(O.NOTES, "SELECT doc_id, start, tag, token FROM tokens", semantic=O.SEMANTIC))
def token_numbers(spark, sf_dir):
    return corpus.spans_table(_audited_notes(spark, sf_dir)).select("doc_id", "start", "tag", "token")


_REWRITTEN = "SELECT doc_id, length(sanitized) AS n_chars, sha256(sanitized) AS text_sha FROM rewritten"


def _rewritten(audited: DataFrame) -> DataFrame:
    return audited.select("doc_id", F.length("sanitized_text").cast("bigint").alias("n_chars"),
                          F.sha2("sanitized_text", 256).alias("text_sha"))


@query("sanitized_text", O.audited(O.DOCUMENTS, _REWRITTEN))
def sanitized_text(spark, sf_dir):
    return _rewritten(audit(I.documents(spark, sf_dir)))


@query("note_sanitized_text", O.audited(O.NOTES, "SELECT doc_id, sanitized AS sanitized_text FROM rewritten", semantic=O.SEMANTIC))
def note_sanitized_text(spark, sf_dir):
    return _audited_notes(spark, sf_dir).select("doc_id", "sanitized_text")


@query("redacted_text", O.audited(O.NOTES, "SELECT doc_id, sanitized AS sanitized_text FROM rewritten",
                                  semantic=O.SEMANTIC, mask_mode="redacted"))
def redacted_text(spark, sf_dir):
    return _audited_notes(spark, sf_dir, mask_mode="redacted").select("doc_id", "sanitized_text")


_VAULT = "SELECT doc_id, token, original, CAST(start AS INTEGER) AS start FROM vault"


@query("vault_table", O.audited(O.DOCUMENTS, _VAULT))
def vault_table(spark, sf_dir):
    return vault(audit(I.documents(spark, sf_dir))).select("doc_id", "token", "original", "start")


@query("redacted_vault", O.audited(O.NOTES, _VAULT, mask_mode="redacted"))
def redacted_vault(spark, sf_dir):
    return vault(audit(I.notes(spark, sf_dir), mask_mode="redacted")).select("doc_id", "token", "original", "start")


_SCORED = "SELECT doc_id, n_findings, critical, high, medium, risk_score, risk_level FROM scored"


@query("severity_and_risk", O.detected(O.DOCUMENTS, _SCORED))
def severity_and_risk(spark, sf_dir):
    return scores(I.documents(spark, sf_dir)).drop("text", "findings")


@query("note_severity_and_risk", O.audited(O.NOTES, _SCORED, semantic=O.SEMANTIC))
def note_severity_and_risk(spark, sf_dir):
    return scores(I.notes(spark, sf_dir), I.note_semantic(spark, sf_dir)).drop("text", "findings")


@query("audit_report", O.audited(O.NOTES, """SELECT w.doc_id, w.text AS original_text, w.sanitized AS sanitized_text,
  'synthetic' AS mask_mode, s.n_findings AS total_risks_detected, s.risk_score, s.risk_level,
  coalesce(v.n, 0) AS vault_size, coalesce(v.listing, '') AS vault
  FROM rewritten w JOIN scored s USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(count(*) AS INTEGER) AS n,
    string_agg(token || '=' || original, '|' ORDER BY token) AS listing FROM vault GROUP BY doc_id) v USING (doc_id)""",
    semantic=O.SEMANTIC))
def audit_report(spark, sf_dir):
    r = report(_audited_notes(spark, sf_dir))
    entries = F.array_sort(F.map_entries("report.vault"))
    return r.select(
        "doc_id", "report.original_text", "report.sanitized_text", "report.mask_mode",
        "report.stats.total_risks_detected", "report.stats.risk_score", "report.stats.risk_level",
        F.size("report.vault").alias("vault_size"),
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("vault"))


@query("report_json", O.audited(O.NOTES, """SELECT w.doc_id, sha256(w.text) AS original_sha, sha256(w.sanitized) AS sanitized_sha,
  'synthetic' AS mask_mode, s.n_findings AS total_risks_detected, s.critical AS critical_risks, s.high AS high_risks, s.medium AS medium_risks,
  CAST(s.risk_score AS INTEGER) AS risk_score, s.risk_level, f.found, v.vault, CAST(NULL AS BOOLEAN) AS is_benchmark
  FROM rewritten w JOIN scored s USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(category || ':' || severity || ':' || verbatim, '|' ORDER BY finding_ord) AS found FROM merged GROUP BY doc_id) f USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(token || '=' || original, '|' ORDER BY start) AS vault FROM vault GROUP BY doc_id) v USING (doc_id)"""))
def report_json(spark, sf_dir):
    """Every field of the JSON report, read back from the JSON."""
    body = report(audit(I.notes(spark, sf_dir))).select("doc_id", "report", F.to_json("report").alias("body"))
    read = body.select("doc_id", F.from_json("body", body.schema["report"].dataType).alias("r"))
    entries = F.map_entries("r.vault")
    return read.select(
        "doc_id", F.sha2("r.original_text", 256).alias("original_sha"), F.sha2("r.sanitized_text", 256).alias("sanitized_sha"), "r.mask_mode", "r.stats.*",
        F.nullif(F.array_join(F.transform("r.findings", lambda f: F.concat_ws(":", f["category"], f["severity"], f["verbatim_quote"])), "|"), F.lit("")).alias("found"),
        F.nullif(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"), F.lit("")).alias("vault"), "r.is_benchmark")


@query("releasable_corpus", O.audited(O.NOTES, """SELECT w.doc_id, sha256(CASE WHEN risk_level <> 'CRITICAL RISK' THEN text ELSE sanitized END) AS released_sha,
  risk_level, risk_level <> 'CRITICAL RISK' AS as_it_is FROM rewritten w JOIN scored USING (doc_id)"""))
def releasable_corpus(spark, sf_dir):
    released = corpus.releasable_corpus(audit(I.notes(spark, sf_dir)), "HIGH RISK")
    return released.select("doc_id", F.sha2("released", 256).alias("released_sha"), "risk_level", "as_it_is")


@query("outgoing_text", O.audited(O.DOCUMENTS, """SELECT w.doc_id, sha256(sanitized) AS outgoing_sha,
  n_findings > 0 AND sanitized <> text AS intercepted FROM rewritten w JOIN scored USING (doc_id)"""))
def outgoing_text(spark, sf_dir):
    return corpus.outgoing_text(audit(I.documents(spark, sf_dir))).select(
        "doc_id", F.sha2("outgoing", 256).alias("outgoing_sha"), "intercepted")


# --- Restore -----------------------------------------------------------------------

_APPLY = "list_reduce([{{'t': '', 'o': {text}}}] || {entries}, lambda a, x: {{'t': '', 'o': replace(a.o, x.t, x.o)}}).o"


@query("restored_text", O.audited(O.NOTES, f"""SELECT w.doc_id, {_APPLY.format(text='w.sanitized', entries='entries')} AS restored_text
  FROM rewritten w JOIN (SELECT doc_id, list({{'t': token, 'o': original}} ORDER BY length(token) DESC, start) AS entries
    FROM vault GROUP BY doc_id) USING (doc_id)""", semantic=O.SEMANTIC))
def restored_text(spark, sf_dir):
    audited = written(_audited_notes(spark, sf_dir).select("doc_id", "sanitized_text", "spans"))  # read twice, audited once
    return restore.restore(audited.select("doc_id", "sanitized_text"), vault(audited)).select("doc_id", "restored_text")


@query("restored_redacted", O.audited(O.NOTES, f"""SELECT w.doc_id, {_APPLY.format(text='w.sanitized', entries='entries')} AS restored_text
  FROM rewritten w JOIN (SELECT doc_id, list({{'t': token, 'o': original}} ORDER BY length(token) DESC, start) AS entries
    FROM vault GROUP BY doc_id) USING (doc_id)""", mask_mode="redacted"))
def restored_redacted(spark, sf_dir):
    audited = audit(I.notes(spark, sf_dir), mask_mode="redacted")
    return restore.with_restored(audited).select("doc_id", "restored_text")


@query("roundtrip_violations", O.audited(O.DOCUMENTS, f"""SELECT count(*) AS n_docs, count(*) FILTER (out <> text AND NOT hit) AS violations FROM (
  SELECT w.doc_id, w.text, {_APPLY.format(text='w.sanitized', entries='coalesce(entries, [])')} AS out, coalesce(hit, false) AS hit
  FROM rewritten w LEFT JOIN (SELECT v.doc_id, list({{'t': token, 'o': original}} ORDER BY length(token) DESC, start) AS entries, bool_or(contains(src.text, token)) AS hit
    FROM vault v JOIN src USING (doc_id) GROUP BY v.doc_id) USING (doc_id)) r"""))
def roundtrip_violations(spark, sf_dir):
    checked = restore.roundtrip(audit(I.documents(spark, sf_dir)))
    return checked.agg(F.count("*").alias("n_docs"), F.count_if(~F.col("exact") & ~F.col("collision")).alias("violations"))


@query("roundtrip_notes", O.audited(O.NOTES, """SELECT w.doc_id, true AS exact, coalesce(c.hit, false) AS collision
  FROM rewritten w LEFT JOIN (SELECT t.doc_id, bool_or(contains(src.text, token)) AS hit FROM tokens t JOIN src USING (doc_id)
    GROUP BY t.doc_id) c USING (doc_id)""", semantic=O.SEMANTIC))
def roundtrip_notes(spark, sf_dir):
    return restore.roundtrip(_audited_notes(spark, sf_dir))


_LATEST = """latest AS (SELECT d.source AS scope, v.token, max_by(v.original, v.doc_id) AS original, min(v.doc_id) AS first_seq,
    arg_min(CAST(v.start AS INTEGER), v.doc_id) AS first_start, max(v.doc_id) AS seq
  FROM vault v JOIN documents d USING (doc_id) GROUP BY d.source, v.token)"""


def _store(audited: DataFrame) -> DataFrame:
    return restore.upsert_vault(vault(audited, scope=F.col("source")))


@query("vault_latest", O.audited(O.DOCUMENTS, "SELECT scope, token, original, seq, first_seq, first_start FROM latest", _LATEST))
def vault_latest(spark, sf_dir):
    return _store(audit(I.documents(spark, sf_dir, "source")))


@query("restore_from_store", O.audited(O.DOCUMENTS, f"""SELECT r.doc_id, sha256(out) AS restored_sha, out <> r.sanitized AS changed FROM (
  SELECT w.doc_id, w.sanitized, {_APPLY.format(text='w.sanitized', entries="coalesce(entries, [])")} AS out
  FROM rewritten w LEFT JOIN (SELECT w2.doc_id, list({{'t': token, 'o': l.original}} ORDER BY first_seq, first_start) AS entries
    FROM rewritten w2 JOIN documents d USING (doc_id) JOIN latest l ON l.scope = d.source AND contains(w2.sanitized, l.token)
    GROUP BY w2.doc_id) e USING (doc_id)) r""", _LATEST))
def restore_from_store(spark, sf_dir):
    audited = written(audit(I.documents(spark, sf_dir, "source")).select("doc_id", "source", "sanitized_text", "spans"))  # read thrice, audited once
    texts = audited.select("doc_id", F.col("source").alias("scope"), "sanitized_text")
    done = restore.restore_from_store(texts, cut(_store(audited)), text_col="sanitized_text")
    return done.select("doc_id", F.sha2("restored_text", 256).alias("restored_sha"), "changed")


_REPLY = "text || ' See [ACCOUNT_1], [PASSWORD_1] & [PASSWORD_2].'"
_ESCAPED = "replace(replace(replace(replace(x.o, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("decode_assistant", O.audited(O.NOTES, f"""SELECT c.conv_id, c.turn,
    sha256(list_reduce([{{'t': '', 'o': c.reply}}] || coalesce(entries, []), lambda a, x: {{'t': '', 'o': replace(a.o, x.t, {_ESCAPED})}}).o) AS decoded_sha,
    CAST(coalesce(len(entries), 0) AS INTEGER) AS n_decoded
  FROM (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations WHERE role = 'assistant') c
  LEFT JOIN (SELECT m.conv_id, m.turn, list({{'t': v.token, 'o': v.original}} ORDER BY v.start) AS entries
    FROM conversations m JOIN vault v ON v.doc_id = m.conv_id AND v.token IN ('[ACCOUNT_1]', '[PASSWORD_1]', '[PASSWORD_2]')
    WHERE m.role = 'assistant' GROUP BY m.conv_id, m.turn) e ON e.conv_id = c.conv_id AND e.turn = c.turn"""))
def decode_assistant(spark, sf_dir):
    said = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("conv_id").cast("string").alias("scope"), F.expr(_REPLY).alias("text"))
    store = cut(restore.upsert_vault(vault(audit(I.notes(spark, sf_dir)))))
    decoded = restore.decode_responses(said, store, ["conv_id", "turn"])
    return decoded.select("conv_id", "turn", F.sha2("decoded_text", 256).alias("decoded_sha"), "n_decoded")


# --- Audit log -----------------------------------------------------------------------

_LOG_TS = "timestamp '2024-01-01 00:00:00' + interval 1 minute * doc_id"
_LOG = f"""cats AS (SELECT doc_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM merged GROUP BY doc_id),
tokens_of AS (SELECT doc_id, string_agg(token, ' ' ORDER BY start) AS keys, string_agg(original, ' ' ORDER BY start) AS vals FROM vault GROUP BY doc_id),
log AS (SELECT w.doc_id, {I.DOC_SOURCE} AS source, n_findings AS threats_count, categories, text AS original_text,
    sanitized AS sanitized_text, keys, vals FROM rewritten w JOIN scored USING (doc_id) JOIN cats USING (doc_id) JOIN tokens_of USING (doc_id)
  WHERE n_findings > 0 AND sanitized <> text)"""


_WRITTEN: dict[tuple[str, str], tuple[tuple[int, str], str]] = {}  # (application, tables) -> state of the table, folder of the log


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log of the notes, one entry per changed text, ordered by ``doc_id``.

    It is a table: the notes are audited and the entries written once in an application, again only if
    the files of the table have changed, and every log query reads them.
    """
    at, state = (spark.sparkContext.applicationId, sf_dir), state_of(I.load(spark, sf_dir, "customer"))
    if at not in _WRITTEN or _WRITTEN[at][0] != state:
        path = f"{scratch(spark)}/log"
        _new_log(spark, sf_dir).write.parquet(path)
        _WRITTEN[at] = (state, path)
    return spark.read.parquet(_WRITTEN[at][1])


def _new_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.notes(spark, sf_dir)
    stamped = docs.withColumns({
        "source": F.expr(I.DOC_SOURCE), "ts": F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id"))})
    return auditlog.log_entries(audit(stamped), keep_original=True)


def _logged(select: str, *more: str) -> str:
    return O.audited(O.NOTES, select, _LOG, *more)


def _key(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "source", "threats_count", F.array_join("categories", ",").alias("categories"))


_LOG_ROW = "doc_id, source, threats_count, categories"


@query("log_entries", _logged(f"SELECT {_LOG_ROW}, 'SANITIZED' AS status, keys AS tokens FROM log"))
def log_entries(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.select("doc_id", "source", "threats_count", F.array_join("categories", ",").alias("categories"),
                      "status", F.array_join(F.map_keys("vault"), " ").alias("tokens"))


@query("log_entry_view", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", strftime(ts, '%H:%M:%S') AS time_short,
  strftime(ts, '%b %d') AS date_short, CASE WHEN user_id % 3 = 0 THEN 'LOCALHOST' ELSE 'host' || user_id END AS machine,
  CASE WHEN user_id % 2 = 0 THEN 'local_user' ELSE CAST(user_id AS VARCHAR) END AS "user", 'SANITIZED' AS status FROM events""")
def log_entry_view(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(
        "event_id", "ts", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("host"), "user_id")).alias("machine"),
        F.when(F.col("user_id") % 2 != 0, F.col("user_id").cast("string")).alias("user"))
    return auditlog.log_entry_view(e).drop("ts")


@query("log_ids", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def log_ids(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "ts")
    return auditlog.assign_log_ids(e, ["ts", "event_id"]).select("event_id", "id")


@query("retain_last", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def retain_last(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return auditlog.retain_last(e, order=("ts", "event_id")).drop("ts")


@query("retain_last_by_user", """SELECT event_id, user_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def retain_last_by_user(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return auditlog.retain_last(e, 20, ("ts", "event_id"), by="user_id").drop("ts")


@query("log_totals", _logged("SELECT count(*) AS total_events, CAST(sum(threats_count) AS BIGINT) AS total_threats_blocked FROM log"))
def log_totals(spark, sf_dir):
    return auditlog.log_totals(_log(spark, sf_dir))


def _bucket_sql(order) -> str:
    words = dict(auditlog.BUCKETS)
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(upper(c), '{w}')" for w in words[b]) + f" THEN '{b}'" for b in order) + " END"


def _buckets_sql(order) -> str:
    return _logged(f"""SELECT count(*) FILTER (b = 'secret') AS secrets_count, count(*) FILTER (b = 'pii') AS pii_count,
  count(*) FILTER (b = 'financial') AS financial_count FROM (SELECT {_bucket_sql(order)} AS b
    FROM (SELECT unnest(string_split(categories, ',')) AS c FROM log))""")


@query("category_buckets", _buckets_sql(("secret", "pii", "financial")))
def category_buckets(spark, sf_dir):
    return auditlog.category_buckets(_log(spark, sf_dir))


@query("category_buckets_financial_first", _buckets_sql(("secret", "financial", "pii")))
def category_buckets_financial_first(spark, sf_dir):
    return auditlog.category_buckets(_log(spark, sf_dir), financial_first=True)


@query("audit_summary", _logged(f"""SELECT (SELECT count(*) FROM log) AS total_events,
  (SELECT CAST(sum(threats_count) AS BIGINT) FROM log) AS total_threats_blocked,
  count(*) FILTER (b = 'secret') AS secrets_count, count(*) FILTER (b = 'pii') AS pii_count, count(*) FILTER (b = 'financial') AS financial_count
  FROM (SELECT {_bucket_sql(('secret', 'pii', 'financial'))} AS b FROM (SELECT unnest(string_split(categories, ',')) AS c FROM log))"""))
def audit_summary(spark, sf_dir):
    return auditlog.audit_summary(_log(spark, sf_dir))


@query("activity_bins", _logged("""SELECT CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(sum(threats_count), 0) AS BIGINT) AS threats
  FROM (SELECT unnest(range(7)) AS bin) b LEFT JOIN (SELECT threats_count, (row_number() OVER (ORDER BY doc_id) - 1) % 7 AS bin
    FROM log QUALIFY row_number() OVER (ORDER BY doc_id DESC) <= 20) x USING (bin) GROUP BY b.bin"""))
def activity_bins(spark, sf_dir):
    return auditlog.activity_bins(_log(spark, sf_dir), order=("doc_id",))


@query("activity_bins_retained", _logged("""SELECT CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(sum(threats_count), 0) AS BIGINT) AS threats
  FROM (SELECT unnest(range(7)) AS bin) b LEFT JOIN (SELECT threats_count, (id - 1) % 7 AS bin FROM (
    SELECT threats_count, row_number() OVER (ORDER BY doc_id) AS id FROM log) ORDER BY id DESC LIMIT 20) x USING (bin) GROUP BY b.bin"""))
def activity_bins_retained(spark, sf_dir):
    """The bins of a log of which the newest 500 entries are left: their ids stay."""
    numbered = auditlog.assign_log_ids(_log(spark, sf_dir).select("doc_id", "threats_count"), ["doc_id"])
    return auditlog.activity_bins(auditlog.retain_last(numbered))


@query("recent_log", _logged(f"SELECT {_LOG_ROW} FROM log ORDER BY doc_id DESC LIMIT 30"))
def recent_log(spark, sf_dir):
    return _key(auditlog.recent(_log(spark, sf_dir), order=("doc_id",)))


def _filter_sql(word: str) -> str:
    in_cats = "contains(categories, 'FINANCIAL') OR contains(categories, 'AMOUNT')" if word == "AMOUNT" else f"contains(categories, '{word}')"
    return _logged(f"SELECT {_LOG_ROW} FROM log WHERE {in_cats} OR contains(upper(keys), '{word}')")


for _word in ("SECRET", "GOVERNMENT_ID", "FINANCIAL_PII", "AMOUNT", "PERSONAL_CONTACT"):
    def _filtered(spark, sf_dir, word=_word):
        return _key(auditlog.filter_category(_log(spark, sf_dir), word))

    query(f"log_filter_{_word.lower()}", _filter_sql(_word))(_filtered)


_SEARCHED = " OR ".join(f"contains(lower({c}), 'mh-14')" for c in ("original_text", "sanitized_text", "categories", "keys", "vals"))


@query("log_search", _logged(f"SELECT {_LOG_ROW} FROM log WHERE {_SEARCHED}"))
def log_search(spark, sf_dir):
    return _key(auditlog.search(_log(spark, sf_dir), "  MH-14 "))


@query("log_page", _logged(f"SELECT {_LOG_ROW} FROM log WHERE {_SEARCHED} ORDER BY doc_id DESC LIMIT 25"))
def log_page(spark, sf_dir):
    return _key(auditlog.page(auditlog.search(_log(spark, sf_dir), "mh-14"), order=("doc_id",)))


@query("last_original", _logged("SELECT original_text FROM log ORDER BY doc_id DESC LIMIT 1"))
def last_original(spark, sf_dir):
    return auditlog.last_original(_log(spark, sf_dir), order=("doc_id",))


_COUNTERS = """count(*) AS total_scanned, CAST(coalesce(sum(n_findings), 0) AS BIGINT) AS total_threats_blocked,
  count(*) FILTER (n_findings > 0 AND source = 'desktop') AS desktop_interceptions,
  count(*) FILTER (n_findings > 0 AND source = 'extension') AS extension_interceptions"""
_SOURCED = f"(SELECT {I.DOC_SOURCE} AS source, n_findings FROM scored)"


def _sourced_scores(spark, sf_dir) -> DataFrame:
    return scores(I.documents(spark, sf_dir)).select(F.expr(I.DOC_SOURCE).alias("source"), "n_findings")


@query("guardian_counters", O.detected(O.DOCUMENTS, f"SELECT {_COUNTERS} FROM {_SOURCED}"))
def guardian_counters(spark, sf_dir):
    return auditlog.guardian_counters(_sourced_scores(spark, sf_dir))


@query("counters_by_source", O.detected(O.DOCUMENTS, f"SELECT source, {_COUNTERS} FROM {_SOURCED} GROUP BY source"))
def counters_by_source(spark, sf_dir):
    return auditlog.guardian_counters(_sourced_scores(spark, sf_dir), "source")


@query("report_categories", O.detected(O.DOCUMENTS, """SELECT doc_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
  FROM found GROUP BY doc_id"""))
def report_categories(spark, sf_dir):
    found = with_findings(I.documents(spark, sf_dir)).where(F.size("findings") > 0)
    return found.select("doc_id", F.array_join(auditlog.report_categories(F.col("findings")), ",").alias("categories"))


@query("vault_listing", O.audited(O.NOTES, "SELECT doc_id AS scope, doc_id AS seq, CAST(start AS INTEGER) AS start, token, original FROM vault"))
def vault_listing(spark, sf_dir):
    return auditlog.vault_listing(vault(audit(I.notes(spark, sf_dir)), scope=F.col("doc_id")))


@query("log_append_read", _logged("""SELECT CAST(CAST(timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) AS DATE) AS VARCHAR) AS event_date,
  count(*) AS n, CAST(sum(threats_count) AS BIGINT) AS threats FROM log GROUP BY 1"""))
def log_append_read(spark, sf_dir):
    path = scratch(spark) + "/log"
    log = _log(spark, sf_dir)
    tables.append_audit_log(log.where(F.col("doc_id") % 2 == 0), path)
    tables.append_audit_log(log.where(F.col("doc_id") % 2 == 1), path)
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("*").alias("n"), F.sum("threats_count").alias("threats"))


@query("log_export", _logged(f"SELECT {_LOG_ROW} FROM log ORDER BY doc_id DESC LIMIT 30"))
def log_export(spark, sf_dir):
    path = scratch(spark) + "/export"
    tables.export_audit_log(_log(spark, sf_dir), path, "2024-01-01", order=("doc_id",))
    ddl = "doc_id bigint, source string, threats_count int, categories array<string>"
    return _key(spark.read.schema(ddl).json(f"{path}/date=2024-01-01"))


@query("read_audit_log", _logged("""SELECT id, strftime(timestamp '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S') AS at_time, source, threats_count, categories,
  sanitized_text, 'SANITIZED' AS status FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS id FROM log) ORDER BY id DESC LIMIT 30"""))
def read_audit_log(spark, sf_dir):
    """The newest entries, exported as a JSON array and read back; broken, other and missing files add nothing."""
    path = scratch(spark)
    newest = auditlog.recent(auditlog.assign_log_ids(_log(spark, sf_dir), ["doc_id"]))
    newest.agg(F.to_json(F.collect_list(F.struct("id", "timestamp", "source", "machine", "user", "threats_count", "categories", "sanitized_text", "status")))).write.text(f"{path}/log")
    for name, body in (("broken", '[{"id": 1, '), ("other", '{"id": 1}')):
        spark.range(1).select(F.lit(body)).write.text(f"{path}/{name}")
    logs = [tables.read_audit_log(spark, f"{path}/{name}") for name in ("log", "broken", "other", "missing")]
    every = logs[0].unionByName(logs[1]).unionByName(logs[2]).unionByName(logs[3])
    return every.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at_time"), "source", "threats_count",
                        F.array_join("categories", ",").alias("categories"), "sanitized_text", "status")


# --- Requests, reported events, external findings ------------------------------------

_BODIES = f"SELECT c_custkey AS request_id, {I.REQUEST_BODY} AS body FROM customer"
_REQUESTS = f"""bodies AS ({_BODIES}),
parsed AS (SELECT request_id, coalesce(json_valid(body), false) AS ok, CASE WHEN json_valid(body) THEN body END AS j FROM bodies),
fields AS (SELECT request_id, ok, regexp_replace(coalesce(j ->> '$.text', ''), '^\\s+|\\s+$', '', 'g') AS text, j ->> '$.scenario_id' AS scenario_id,
  coalesce(j ->> '$.use_cached_benchmark', 'false') = 'true' AS use_cached_benchmark, coalesce(j ->> '$.mask_mode', 'synthetic') AS mask_mode,
  coalesce(j ->> '$.model_id', 'gemma-4-31b-it') AS model_id, trim(coalesce(j ->> '$.api_key', '')) <> '' AS has_key,
  coalesce(j ->> '$.source', 'web_app') AS source, CAST(coalesce(j ->> '$.temperature', '0.1') AS DOUBLE) AS temperature FROM parsed),
requests AS (SELECT * EXCLUDE (ok), CASE WHEN NOT ok THEN 'Invalid JSON body' WHEN text = '' THEN 'Text cannot be empty.' END AS error FROM fields)"""


def _requests(spark, sf_dir) -> DataFrame:
    bodies = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.expr(I.REQUEST_BODY).alias("body"))
    return tables.normalise_requests(bodies)


@query("normalise_requests", O.statement(_REQUESTS, select="SELECT * FROM requests"))
def normalise_requests(spark, sf_dir):
    return _requests(spark, sf_dir)


@query("ingest_interceptions", O.audited(O.NOTES, f"""SELECT w.doc_id, CASE WHEN w.doc_id % 3 = 0 THEN 'desktop' ELSE {I.DOC_SOURCE.replace('doc_id', 'w.doc_id')} END AS source,
  CASE WHEN w.doc_id % 5 = 0 THEN 0 ELSE n_findings END AS threats_count,
  w.doc_id % 7 <> 0 AND sanitized <> text AS logged FROM rewritten w JOIN scored USING (doc_id)"""))
def ingest_interceptions(spark, sf_dir):
    reported = audit(I.notes(spark, sf_dir)).select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.expr(I.DOC_SOURCE)).alias("source"),
        F.when(F.col("doc_id") % 5 != 0, F.col("n_findings")).alias("threats_count"),
        F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("map<string,string>").alias("vault"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("original_text"), "sanitized_text")
    return tables.ingest_interceptions(reported).select("doc_id", "source", "threats_count", "logged")


_MODELS = ", ".join(f"('{i}', '{n}')" for i, n, _ in sem.MODELS)


@query("resolve_model", O.statement(_REQUESTS, f"models(model_id, name) AS (VALUES {_MODELS})", select=f"""
  SELECT request_id, r.model_id, coalesce(m.model_id, '{sem.DEFAULT_MODEL}') AS model_called, coalesce(m.name, '{sem.UNKNOWN_MODEL_NAME}') AS model_name
  FROM requests r LEFT JOIN models m ON m.model_id = r.model_id"""))
def resolve_model(spark, sf_dir):
    return sem.resolve_model(_requests(spark, sf_dir).select("request_id", "model_id"))


_PROMPT = ("SELECT doc_id, 'gemma-4-31b-it' AS model_id, 'user' AS role, '0.1' AS temperature, 'application/json' AS mime, sha256("
           + O._q(f"{sem.INSTRUCTION}\n\n=== TEXT TO AUDIT FOR SENSITIVE DATA ===\n") + " || text || "
           + O._q("\n=== END TEXT ===\n\nGenerate the JSON audit report:") + ") AS prompt_sha FROM documents")


@query("prompt_requests", _PROMPT)
def prompt_requests(spark, sf_dir):
    sent = sem.build_prompt_requests(I.documents(spark, sf_dir))
    at = lambda path: F.get_json_object("body", path)
    return sent.select("doc_id", "model_id", at("$.contents[0].role").alias("role"),
                       at("$.generationConfig.temperature").alias("temperature"),
                       at("$.generationConfig.responseMimeType").alias("mime"),
                       F.sha2(at("$.contents[0].parts[0].text"), 256).alias("prompt_sha"))


_RESPONSES = f"""bodies2 AS (SELECT c_custkey AS doc_id, {I.RESPONSE_BODY} AS body FROM customer),
texts2 AS (SELECT doc_id, json_array_length(body, '$.candidates') AS nc, json_array_length(body, '$.candidates[0].content.parts') AS np,
  trim(coalesce(body ->> '$.candidates[0].content.parts[0].text', '')) AS raw FROM bodies2),
bare AS (SELECT doc_id, nc, np, trim(regexp_replace(regexp_replace(regexp_replace(raw, '^```json', ''), '^```', ''), '```$', ''), chr(10) || ' ') AS raw FROM texts2),
tried AS (SELECT *, regexp_extract(raw, '\\{{(?s:.*)\\}}') AS braces FROM bare),
answers AS (SELECT doc_id, CASE WHEN coalesce(nc, 0) = 0 THEN '{sem.NO_CANDIDATES}' WHEN coalesce(np, 0) = 0 THEN '{sem.NO_PARTS}'
    WHEN NOT json_valid(raw) AND NOT (braces <> '' AND json_valid(braces)) THEN '{sem.NOT_JSON}' END AS error,
  CASE WHEN json_valid(raw) THEN raw WHEN braces <> '' AND json_valid(braces) THEN braces END AS j FROM tried),
responses AS (SELECT doc_id, error, CASE WHEN error IS NULL THEN j ->> '$.compliance_summary' END AS compliance_summary,
  CASE WHEN error IS NULL THEN j ->> '$.findings[0].verbatim_quote' END AS quote,
  CAST(CASE WHEN error IS NULL THEN json_array_length(j, '$.findings') ELSE 0 END AS INTEGER) AS n_findings FROM answers)"""


def _parsed(spark, sf_dir) -> DataFrame:
    raw = I.bodies(spark, sf_dir, "c_name", "c_mktsegment").select(
        F.col("c_custkey").alias("doc_id"), F.lit(sem.DEFAULT_MODEL).alias("model_id"), F.expr(I.RESPONSE_BODY).alias("body"))
    return sem.parse_model_responses(raw)


@query("parse_model_responses", O.statement(_RESPONSES, select="SELECT doc_id, error, compliance_summary, quote, n_findings FROM responses"))
def parse_model_responses(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "doc_id", "error", "compliance_summary", F.get("findings", F.lit(0))["verbatim_quote"].alias("quote"),
        F.size("findings").alias("n_findings"))


@query("semantic_findings", O.statement(_RESPONSES, select="""SELECT doc_id, CAST(1 AS INTEGER) AS ord, 'SECRET' AS category,
  'HIGH' AS severity, quote AS verbatim_quote FROM responses WHERE n_findings > 0"""))
def semantic_findings(spark, sf_dir):
    return sem.semantic_findings(_parsed(spark, sf_dir)).select("doc_id", "ord", "category", "severity", "verbatim_quote")


def _scenarios(spark, sf_dir) -> DataFrame:
    """The benchmark items as prepared texts with a stored audit."""
    finding = F.struct(F.lit("f1").alias("id"), *[F.regexp_extract("text", "[a-z]+", 0).alias(c) for c in sem.FINDING_FIELDS])
    audit_ = F.struct(F.concat(F.lit("stored "), "item_id").alias("compliance_summary"), F.lit(90).alias("risk_score"),
                      F.lit("CRITICAL RISK").alias("risk_level"), F.array(finding).alias("findings"))
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("scenario_id"), F.concat(F.lit("Item "), "item_id").alias("title"),
        F.lit("benchmark item").alias("description"), "text", audit_.alias("cached_audit"))


@query("scenario_listing", "SELECT CAST(item_id AS VARCHAR) AS id, 'Item ' || item_id AS title, 'benchmark item' AS description, text FROM benchmark")
def scenario_listing(spark, sf_dir):
    return sem.scenario_listing(_scenarios(spark, sf_dir))


_CHOSEN = f"""chosen AS (SELECT request_id, r.scenario_id, r.has_key,
    r.text, r.mask_mode, r.model_id, s.item_id, s.text AS stored, a.error AS failed, a.compliance_summary AS answer, a.n_findings, a.quote,
    CASE WHEN (use_cached_benchmark OR NOT has_key) AND s.item_id IS NOT NULL THEN 'cached' WHEN NOT has_key THEN 'none'
      WHEN a.error IS NULL THEN 'model' WHEN s.item_id IS NOT NULL THEN 'cached' ELSE 'failed' END AS origin
  FROM requests r LEFT JOIN benchmark s ON CAST(s.item_id AS VARCHAR) = r.scenario_id LEFT JOIN responses a ON a.doc_id = r.request_id
  WHERE r.error IS NULL)"""


@query("choose_semantic_source", O.statement(_REQUESTS, _RESPONSES, _CHOSEN, select=f"""SELECT request_id, origin, origin = 'cached' AS is_benchmark,
  CAST(CASE origin WHEN 'cached' THEN 1 WHEN 'model' THEN n_findings ELSE 0 END AS INTEGER) AS n_findings,
  CASE origin WHEN 'cached' THEN 'stored ' || item_id WHEN 'model' THEN coalesce(answer, '')
    WHEN 'failed' THEN 'Gemma 4 service notice: ' || substring(failed, 1, {sem.NOTICE_LENGTH}) || '. High-confidence pattern firewall active.'
    ELSE {O._q(sem.NO_KEY_NOTICE)} END AS compliance_summary FROM chosen"""))
def choose_semantic_source(spark, sf_dir):
    accepted, _ = tables.split_requests(_requests(spark, sf_dir))
    requests = accepted.select("request_id", "scenario_id", F.col("use_cached_benchmark").alias("use_cached"), "has_key")
    parsed = _parsed(spark, sf_dir).withColumnRenamed("doc_id", "request_id")
    chosen = sem.choose_semantic_source(requests, _scenarios(spark, sf_dir), parsed, key="request_id")
    return chosen.select("request_id", "origin", "is_benchmark", F.size("findings").alias("n_findings"), "compliance_summary")


_CHOSEN_ROWS = f"(WITH {_REQUESTS},\n{_RESPONSES},\n{_CHOSEN} SELECT * FROM chosen)"
_CHOSEN_FINDINGS = f"""SELECT request_id AS doc_id, 1 AS ord, CASE origin WHEN 'model' THEN 'SECRET' ELSE regexp_extract(stored, '[a-z]+') END AS category,
  CASE origin WHEN 'model' THEN 'HIGH' ELSE regexp_extract(stored, '[a-z]+') END AS severity, CASE origin WHEN 'model' THEN quote ELSE regexp_extract(stored, '[a-z]+') END AS verbatim,
  CASE origin WHEN 'model' THEN '' ELSE regexp_extract(stored, '[a-z]+') END AS entity, CASE origin WHEN 'model' THEN '' ELSE regexp_extract(stored, '[a-z]+') END AS suggested
  FROM {_CHOSEN_ROWS} WHERE origin = 'cached' OR (origin = 'model' AND n_findings > 0)"""


@query("audit_requests", O.audited(
    f"SELECT request_id AS doc_id, text FROM {_CHOSEN_ROWS}", f"""SELECT w.doc_id AS request_id, c.origin, w.sanitized AS sanitized_text, c.mask_mode,
  s.n_findings, s.risk_score, c.model_id AS model_used, coalesce(m.name, '{sem.UNKNOWN_MODEL_NAME}') AS model_name
  FROM rewritten w JOIN scored s USING (doc_id) JOIN {_CHOSEN_ROWS} c ON c.request_id = w.doc_id
  LEFT JOIN (VALUES {_MODELS}) m(model_id, name) ON m.model_id = c.model_id""", semantic=_CHOSEN_FINDINGS))
def audit_requests(spark, sf_dir):
    accepted, _ = tables.split_requests(_requests(spark, sf_dir))
    parsed = _parsed(spark, sf_dir).withColumnRenamed("doc_id", "request_id")
    audited = audit_all_requests(accepted, _scenarios(spark, sf_dir), parsed)
    return audited.select("request_id", "origin", "sanitized_text", "mask_mode", "n_findings", "risk_score",
                          "model_used", "model_name")


# --- Copy and paste events --------------------------------------------------------------

# Whole texts, and short ones: the words of each text by their place.
@query("min_length_gate", """SELECT conv_id, turn, place FROM (SELECT conv_id, turn, role = 'user' AS paste, unnest([text] || string_split(text, ' ')) AS t,
    generate_subscripts([text] || string_split(text, ' '), 1) - 1 AS place FROM conversations) WHERE length(trim(t, ' ' || chr(10) || chr(9) || chr(13))) >= CASE WHEN paste THEN 6 ELSE 3 END""")
def min_length_gate(spark, sf_dir):
    e = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "extension").otherwise("desktop").alias("source"),
        F.posexplode(F.concat(F.array("text"), F.split("text", " "))).alias("place", "text"))
    return ev.min_length_gate(e).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


_CONTROL = f"""control AS (SELECT user_id, ts, event_id, {I.EVENT_PAUSED} AS paused FROM events WHERE event_type IN ('error', 'signup', 'purchase')),
numbered AS (SELECT *, sum(CASE WHEN paused IS NULL THEN 1 ELSE 0 END) OVER w AS flips FROM control WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
based AS (SELECT *, last_value(CASE WHEN paused IS NOT NULL THEN flips END IGNORE NULLS) OVER w AS from_set,
    coalesce(last_value(paused IGNORE NULLS) OVER w, false) AS base FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
states AS (SELECT user_id, ts, event_id, CASE WHEN (flips - coalesce(from_set, 0)) % 2 = 1 THEN NOT base ELSE base END AS is_paused FROM based)"""


@query("pause_states", O.statement(_CONTROL, select="""SELECT CAST(user_id AS VARCHAR) AS "user", strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at_time, is_paused FROM states"""))
def pause_states(spark, sf_dir):
    states = ev.pause_states(I.control_rows(spark, sf_dir), ["user"])
    return states.select("user", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at_time"), "is_paused")


@query("pause_gate_asof", O.statement(_CONTROL, select="""SELECT e.event_id FROM events e ASOF LEFT JOIN (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) s
  ON s.user_id = e.user_id AND e.ts >= s.ts WHERE e.event_type IN ('click', 'view') AND NOT coalesce(s.is_paused, false)"""))
def pause_gate_asof(spark, sf_dir):
    copies = I.copy_events(spark, sf_dir).where(F.col("event_type").isin("click", "view")).drop("text")
    return ev.pause_gate(copies, I.control_rows(spark, sf_dir), ["user"]).select("event_id")


@query("control_state", O.statement(_CONTROL, select="""SELECT CAST(u.user_id AS VARCHAR) AS "user", coalesce(s.is_paused, false) AS is_paused
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, last(is_paused ORDER BY ts, event_id) AS is_paused FROM states GROUP BY user_id) s USING (user_id)"""))
def control_state(spark, sf_dir):
    users = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user")).distinct()
    return ev.read_control(users, I.control_rows(spark, sf_dir))


_EVENTS = f"SELECT event_id AS doc_id, {I.EVENT_TEXT} AS text FROM events"
# The guard step by step: one recursion per event of a user, carrying (written, clean).
_GUARD = f"""looked AS (SELECT e.event_id, e.user_id, w.text, w.sanitized, s.n_findings,
    row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS n FROM events e
  JOIN rewritten w ON w.doc_id = e.event_id JOIN scored s ON s.doc_id = e.event_id
  WHERE length(trim(w.text)) >= CASE WHEN {I.EVENT_SOURCE} = 'extension' THEN 6 ELSE 3 END),
judged AS (SELECT *, CASE WHEN n_findings > 0 AND sanitized <> text THEN 'dirty' WHEN n_findings > 0 THEN 'unchanged' ELSE 'clean' END AS kind FROM looked),
steps AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS written, CAST(NULL AS VARCHAR) AS clean,
    CAST('' AS VARCHAR) AS status FROM judged GROUP BY user_id
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN status = 'intercepted' THEN sanitized ELSE written END,
    CASE WHEN status = 'intercepted' THEN NULL WHEN status = 'clean' THEN text ELSE clean END, status
  FROM (SELECT s.user_id, j.n, j.event_id, j.text, j.sanitized, s.written, s.clean,
      CASE WHEN j.text IS NOT DISTINCT FROM s.written THEN 'own_output' WHEN j.text IS NOT DISTINCT FROM s.clean THEN 'clean_repeat'
        WHEN j.kind = 'clean' THEN 'clean' WHEN j.kind = 'dirty' THEN 'intercepted' ELSE 'unchanged' END AS status
    FROM steps s JOIN judged j ON j.user_id = s.user_id AND j.n = s.n + 1))"""
_STATUSES = O.audited(_EVENTS, "SELECT event_id, status FROM steps WHERE n > 0", _GUARD, recursive=True)


@query("guard_decisions", _STATUSES)
def guard_decisions(spark, sf_dir):
    looked_at = ev.min_length_gate(I.copy_events(spark, sf_dir, audited=True))
    return ev.guard_decisions(audit(looked_at), ["user"], ["ts", "event_id"]).select("event_id", "status")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of copy and paste events."""
    schema = load(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    user = F.col("user_id").cast("string")
    return raw.select(
        user.alias("user"), F.lit("host").alias("machine"), F.lit("tab").alias("session_id"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr(I.EVENT_SOURCE).alias("source"), F.expr(I.EVENT_TEXT).alias("text"), F.lit(None).cast("boolean").alias("paused"))


@query("stream_guard", _STATUSES)
def stream_guard(spark, sf_dir):
    path = scratch(spark)
    events = _event_stream(spark, sf_dir)
    running = guard.start_guard(guard.guard_stream(events), f"{path}/out", f"{path}/checkpoint", availableNow=True)
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out/statuses").select(F.col("seq").alias("event_id"), "status")


#: Files, each a micro-batch, in which the events of a guarded stream arrive.
ARRIVALS = 10


# The same guard with pause rows in the stream: purchases flip, errors pause, signups resume.
_BY_SEQ = _CONTROL.replace("ORDER BY ts, event_id", "ORDER BY event_id")
_GATED = """gated AS (SELECT e.event_id, e.user_id, e.ts, coalesce(s.is_paused, false) AS paused FROM events e
  ASOF LEFT JOIN states s ON s.user_id = e.user_id AND e.event_id >= s.event_id WHERE e.event_type IN ('click', 'view'))"""
_LONG_ENOUGH = f"length(trim(w.text)) >= CASE WHEN {I.EVENT_SOURCE} = 'extension' THEN 6 ELSE 3 END"
_GUARD_GATED = _GUARD.replace("FROM events e", "FROM gated e").replace("  WHERE length", "  WHERE NOT paused AND length")


def _events_with_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` written as a source writes them, and read as a stream."""
    path, kind = f"{scratch(spark)}/in", F.col("event_type")
    copied = kind.isin("click", "view")
    rows = load(spark, sf_dir, "events").where(copied | kind.isin("error", "signup", "purchase")).select(
        F.col("user_id").cast("string").alias("user"), F.lit("host").alias("machine"), F.lit("tab").alias("session_id"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.expr(I.EVENT_SOURCE).alias("source"),
        F.when(copied, F.expr(I.EVENT_TEXT)).alias("text"), F.expr(I.EVENT_PAUSED).alias("paused"))
    # One file after the other, as they arrive at a source: every file is a micro-batch.
    ends = rows.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    edges = [ends["a"] + (ends["b"] + 1 - ends["a"]) * k // ARRIVALS for k in range(ARRIVALS + 1)] if ends["a"] is not None else []
    for low, high in zip(edges, edges[1:], strict=False):
        rows.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(path)
    return tables.read_event_stream(spark, path, "parquet", files_per_trigger=1)


def _guarded_with_pauses(spark: SparkSession, sf_dir: str, sessions: bool = False) -> str:
    path = scratch(spark)
    stream = guard.guard_stream(_events_with_pauses(spark, sf_dir))
    guard.start_guard(stream, f"{path}/out", f"{path}/checkpoint", sessions=sessions, availableNow=True).awaitTermination()
    return f"{path}/out"


@query("stream_guard_pauses", O.audited(_EVENTS, f"""SELECT event_id, status FROM steps WHERE n > 0
  UNION ALL SELECT event_id, 'control' FROM control
  UNION ALL SELECT event_id, 'paused' FROM gated g JOIN rewritten w ON w.doc_id = g.event_id WHERE paused AND {_LONG_ENOUGH}""",
    _BY_SEQ, _GATED, _GUARD_GATED, recursive=True))
def stream_guard_pauses(spark, sf_dir):
    return spark.read.parquet(f"{_guarded_with_pauses(spark, sf_dir)}/statuses").select(F.col("seq").alias("event_id"), "status")


@query("stream_vault", O.audited(_EVENTS, """SELECT CAST(s.user_id AS VARCHAR) || '/host/tab' AS scope, v.token, max_by(v.original, s.event_id) AS original
  FROM steps s JOIN vault v ON v.doc_id = s.event_id WHERE s.status = 'intercepted' GROUP BY s.user_id, v.token""",
    _BY_SEQ, _GATED, _GUARD_GATED, recursive=True))
def stream_vault(spark, sf_dir):
    """The vault of each session after the stream, as the batches kept it."""
    return guard.session_store(spark, _guarded_with_pauses(spark, sf_dir, sessions=True)).select("scope", "token", "original")


@query("live_summary", O.audited(_EVENTS, f"""SELECT (SELECT count(*) FROM log) AS total_events, (SELECT CAST(sum(threats_count) AS BIGINT) FROM log) AS total_threats_blocked,
    count(*) FILTER (b = 'secret') AS secrets_count, count(*) FILTER (b = 'pii') AS pii_count, count(*) FILTER (b = 'financial') AS financial_count,
    (SELECT string_agg(id || ':' || event_id || ':' || source, ',' ORDER BY id DESC) FROM (SELECT * FROM log ORDER BY id DESC LIMIT 30)) AS recent,
    (SELECT string_agg(t, ',' ORDER BY bin) FROM (SELECT r.bin, coalesce(sum(threats_count), 0) AS t FROM (SELECT unnest(range(7)) AS bin) r
      LEFT JOIN (SELECT (id - 1) % 7 AS bin, threats_count FROM log ORDER BY id DESC LIMIT 20) x USING (bin) GROUP BY r.bin)) AS activity, false AS is_paused
  FROM (SELECT {_bucket_sql(('secret', 'pii', 'financial'))} AS b FROM (SELECT unnest(string_split(categories, ',')) AS c FROM log))""",
    "cats AS (SELECT doc_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM merged GROUP BY doc_id)",
    f"""log AS (SELECT e.event_id, {I.EVENT_SOURCE} AS source, n_findings AS threats_count, categories, row_number() OVER (ORDER BY e.ts, e.event_id) AS id
  FROM events e JOIN rewritten w ON w.doc_id = e.event_id JOIN scored s ON s.doc_id = e.event_id JOIN cats c ON c.doc_id = e.event_id
  WHERE n_findings > 0 AND sanitized <> w.text)"""))
def live_summary(spark, sf_dir):
    path = scratch(spark)
    log = auditlog.log_entries(audit(_event_stream(spark, sf_dir)))
    guard.start_summary(log, f"{path}/summary", f"{path}/checkpoint", availableNow=True).awaitTermination()
    written = spark.read.schema(guard.SUMMARY_DDL + ", batch_id int").parquet(f"{path}/summary")
    last = written.orderBy(F.col("batch_id").desc()).limit(1)
    return last.select(
        "total_events", "total_threats_blocked", "secrets_count", "pii_count", "financial_count",
        F.array_join(F.transform("recent", lambda r: F.concat_ws(":", r["id"], r["seq"], r["source"])), ",").alias("recent"),
        F.array_join(F.col("activity").cast("array<string>"), ",").alias("activity"), "is_paused")


@query("stream_counters", O.detected(_EVENTS, f"""SELECT source, {_COUNTERS} FROM (SELECT {I.EVENT_SOURCE} AS source, n_findings
  FROM events e JOIN scored s ON s.doc_id = e.event_id) GROUP BY source"""))
def stream_counters(spark, sf_dir):
    path = scratch(spark)
    audits = scores(_event_stream(spark, sf_dir)).select("source", "n_findings")
    name = "counters_" + re.sub(r"\W", "", path[-12:])
    guard.start_live_summary(audits, name, f"{path}/checkpoint", availableNow=True).awaitTermination()
    return spark.table(name)


@query("session_vault", O.audited(_EVENTS, """SELECT CAST(e.user_id AS VARCHAR) AS scope, v.token, max_by(v.original, e.event_id) AS original
  FROM vault v JOIN events e ON e.event_id = v.doc_id GROUP BY e.user_id, v.token"""))
def session_vault(spark, sf_dir):
    audited = audit(I.copy_events(spark, sf_dir, audited=True))
    return guard.session_vault(vault(audited, "event_id", F.col("user"))).select("scope", "token", "original")


# --- Reports over the corpus ------------------------------------------------------------

@query("exposure_rollup", O.detected(O.DOCUMENTS, """SELECT d.source, label, severity, CAST(grouping_id(d.source, label, severity) AS INTEGER) AS level,
  count(*) AS n_findings, count(DISTINCT f.doc_id) AS n_docs FROM found f JOIN documents d USING (doc_id)
  GROUP BY ROLLUP (d.source, label, severity)"""))
def exposure_rollup(spark, sf_dir):
    return corpus.exposure_rollup(with_findings(I.documents(spark, sf_dir, "source")))


@query("findings_vs_labels", O.detected(O.DOCUMENTS, """SELECT label, quality, toxic, count(*) AS n_findings, count(DISTINCT f.doc_id) AS n_docs
  FROM found f JOIN labels USING (doc_id) GROUP BY label, quality, toxic"""))
def findings_vs_labels(spark, sf_dir):
    labelled = I.documents(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id")
    per_label = F.transform(F.array_distinct("findings.entity_type"), lambda e: F.struct(
        e.alias("label"), F.size(F.filter("findings", lambda f: f["entity_type"] == e)).alias("n")))
    counted = with_findings(labelled).select("quality", "toxic", F.explode(per_label).alias("p"))
    return counted.groupBy("p.label", "quality", "toxic").agg(F.sum("p.n").alias("n_findings"), F.count("*").alias("n_docs"))


@query("top_risk_documents", O.detected(O.DOCUMENTS, """SELECT doc_id, risk_score, risk_level, n_findings FROM scored
  ORDER BY risk_score DESC, doc_id LIMIT 20"""))
def top_risk_documents(spark, sf_dir):
    return corpus.top_risk_documents(scores(I.documents(spark, sf_dir)), 20)


@query("repeated_values", O.detected(O.DOCUMENTS, """SELECT sha256(quote) AS value_hash, label, count(DISTINCT doc_id) AS n_docs
  FROM found GROUP BY quote, label HAVING count(DISTINCT doc_id) >= 2"""))
def repeated_values(spark, sf_dir):
    return corpus.repeated_values(findings(I.documents(spark, sf_dir)))


_SECRET = "demo"


@query("stable_tokens", O.audited(O.DOCUMENTS, f"""SELECT d.source, tag, sha256(original) AS value_hash,
  '[' || tag || '_' || upper(sha256('{len(_SECRET)}:{_SECRET}' || length(tag) || ':' || tag || original)) || ']' AS token, count(*) AS n_spans
  FROM tokens JOIN documents d USING (doc_id) GROUP BY d.source, tag, original"""))
def stable_tokens(spark, sf_dir):
    spans = corpus.spans_table(audit(I.documents(spark, sf_dir, "source")), keep=("source",))
    return corpus.stable_tokens(spans, "source", _SECRET)
