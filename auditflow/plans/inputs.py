"""Texts, events and messages derived from the given tables.

The corpus tables hold few kinds of sensitive values, so the rules that do not
occur there are exercised on notes written from the rows of ``customer``.  The
expressions below are plain SQL that Spark and DuckDB read alike; the queries and
their oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditflow.sources.tables import load, spread

# Nine digits that vary with the customer, and letters made from them.
_A = "lpad(cast((c_custkey * 48271 + 7) % 1000000007 as varchar(20)), 10, '0')"
_B = "lpad(cast((c_custkey * 69621 + 12345) % 1000000007 as varchar(20)), 10, '0')"
_L = f"translate({_A}, '0123456789', 'QWERTYUIOP')"


def _a(start: int, n: int) -> str:
    return f"substr({_A}, {start}, {n})"


def _b(start: int, n: int) -> str:
    return f"substr({_B}, {start}, {n})"


def _l(start: int, n: int) -> str:
    return f"substr({_L}, {start}, {n})"


# One sentence per line; where a line has several forms, the customer key picks one.
_SENTENCES: tuple[tuple[str, ...], ...] = (
    (f"'My password: Pw' || {_a(2, 6)} || '!'", f"'the token is x' || {_b(3, 5)}", f"'Passwords ' || {_a(2, 6)}",
     f"'secret=é' || {_a(4, 6)} || 'ß, ok'"),
    (f"'otp ' || {_a(4, 4)}", f"'security code: ' || {_b(4, 3)}", "'pin 12'"),
    (f"'adhar: 4' || {_a(2, 3)} || ' ' || {_a(5, 4)} || ' ' || {_b(5, 4)}",
     f"'aadhar 45' || {_a(3, 4)} || ' 25009 42009'", f"'code 7' || {_a(2, 9)} || {_b(8, 2)}",
     f"'ref 1' || {_a(2, 9)} || {_b(8, 2)}"),
    (f"'tax ' || {_l(1, 5)} || {_b(3, 4)} || 'K'", f"'pan card is ' || lower({_l(1, 5)}) || {_b(2, 5)}",
     f"'tax é' || {_l(1, 5)} || {_b(3, 4)} || 'K'"),
    (f"'passport no: Z' || {_a(3, 7)}", f"'travels on R1' || {_a(4, 1)} || ' ' || {_b(4, 4)} || '7'",
     f"'travels on Q1' || {_a(4, 1)} || {_b(4, 4)} || '7'"),
    (f"'voter id: XYZ/' || {_b(3, 7)}", f"'roll ABC' || {_a(3, 7)}", f"'roll ABCD' || {_a(3, 7)}"),
    (f"'driving licence: MH-14 ' || {_a(3, 7)}", f"'licensed DL14 2011 ' || {_a(3, 7)}",
     f"'licensed KA-05-2019' || {_b(3, 7)}"),
    (f"'car no KA01MJ' || {_a(6, 4)}", f"'parks KA-05-MX-' || {_b(6, 4)}", f"'parks K-05-MX-' || {_b(6, 4)}"),
    (f"'invoice 27' || {_l(2, 5)} || {_b(3, 4)} || 'A1Z5'", f"'gst no is 29ab' || {_a(2, 9)} || 'xz'",
     f"'invoice 27' || {_l(2, 5)} || {_b(3, 4)} || 'A1X5'"),
    (f"'tan number: ' || {_l(1, 4)} || {_a(5, 5)} || 'f'", f"'deducted by ' || {_l(1, 4)} || {_a(5, 5)} || 'F'",
     "'tan line'"),
    (f"'company U' || {_a(5, 5)} || 'MH2010PTC' || {_b(4, 6)}", f"'company X' || {_a(5, 5)} || 'MH2010PTC' || {_b(4, 6)}"),
    (f"'din ' || {_a(3, 8)}", f"'DIN no: ' || {_b(3, 8)}", f"'dine ' || {_b(3, 8)}"),
    (f"'uan is 10' || {_a(2, 9)} || ';'", f"'pf account: MH/BAN/' || {_a(3, 7)} || ';'", "'epf office'"),
    (f"'health 91-' || {_a(3, 4)} || '-' || {_a(7, 4)} || '-' || {_b(7, 4)}", f"'abha no: 91 ' || {_a(3, 4)} || ' ' || {_b(3, 6)} || ';'"),
    (f"'ration card no: RC' || {_a(2, 8)} || ';'", f"'ration cards ' || {_a(2, 8)}"),
    (f"'fir no: ' || {_a(7, 3)} || '/2024;'", f"'survey no ' || {_a(7, 3)} || ' B;'", f"'plots no ' || {_a(7, 3)}"),
    (f"'sent ' || {_b(8, 2)} || 'k home'", f"'worth Rs. ' || {_b(8, 2)} || ',' || {_a(8, 3)} || '.50 net'", f"'salary of ' || {_a(6, 5)} || ' inr'",
     f"'5.5 crore plus 2.5L'", f"'fee ₹' || {_a(6, 4)}", f"'amount: €' || {_a(6, 4)} || '.25'"),
    (f"'hdfc account'", f"'A/C ' || {_a(1, 10)} || ' open'", f"'please transfer to ' || {_a(1, 9)}", f"'acct no: AB-' || {_b(1, 6)}", "'hdfcs account'"),
    ("'Beneficiary: Asha Rao, local'", "'payee name is Ravi'", "'account holder Mina Das pan none'", "'Payee: José, abroad'"),
    ("'rqavi transferred it'", "'money was paid to suresh'", "'Client: Nora Blum; new'", "'Kiran Shah, phone off'",
     "'Ananya called'", "'Developers called'", "'Mr: Bean pass by'"),
    (f"'4' || {_a(2, 3)} || ' ' || {_a(5, 4)} || '-' || {_b(2, 4)} || ' ' || {_b(6, 4)}", f"'card no: 5' || {_a(2, 8)} || ' ' || {_b(2, 6)} || ';'",
     f"'9' || {_a(2, 8)} || {_b(2, 8)}"),
    (f"'mail ' || lower({_l(1, 4)}) || '.x@mail' || {_a(9, 1)} || '.example.com'", f"'é.' || {_a(8, 2)} || '@post.example.org'", "'mail x@y'"),
    (f"'call 98' || {_a(3, 8)}", f"'call +91 9' || {_b(2, 9)}", f"'call (555) ' || {_a(4, 3)}||'-' || {_b(4, 4)}", f"'contact no: ' || {_a(2, 4)} || ' ' || {_b(2, 6)} || ';'",
     f"'call 58' || {_a(3, 8)}"),
    (f"'pay ' || lower({_l(1, 5)}) || '@okbank'", f"'pay ' || lower({_l(1, 5)}) || '@ok7'"),
    (f"'key AKIA' || {_l(1, 8)} || {_a(3, 8)}", f"'key AKIA' || {_l(1, 8)} || {_a(3, 7)}"),
    (f"'use sk_live_' || {_a(1, 9)} || lower({_l(1, 9)})", f"'use ghp_' || {_a(1, 9)} || '-' || {_b(1, 8)}", f"'use ghx_' || {_a(1, 9)} || {_b(1, 8)}"),
    (f"'host 10.' || cast(c_custkey % 300 as varchar(20)) || '.8.21'", "'version 1.2.3'"),
    (f"'branch HDFC0' || {_a(4, 6)}", f"'branch HDFC1' || {_a(4, 6)}"),
)


def _pick(i: int, forms: tuple[str, ...]) -> str:
    cases = " ".join(f"when {n} then {form}" for n, form in enumerate(forms))
    return f"(case (c_custkey + {i}) % {len(forms)} {cases} end)"


NOTE_TEXT = "(" + " || '. ' || ".join(_pick(i, forms) for i, forms in enumerate(_SENTENCES)) + f" || '. Again: ' || {_pick(3, _SENTENCES[3])})"

# External findings on the notes: grounded, padded, ungrounded and repeated quotes.
SEMANTIC_BRANCHES = (
    ("1", "'PERSONAL_CONTACT'", "'HIGH'", "'Asha Rao'", "'Customer Full Name'", "'[PERSON_1]'"),
    ("2", "'BUSINESS_CONFIDENTIAL'", "'CRITICAL'", "'  called '", "'Deal Note'", "''"),
    ("3", "'FINANCIAL_PII'", "'MEDIUM'", _pick(17, _SENTENCES[17]), "'Salary Bank Account Number'", "'account'"),
    ("4", "'SECRET'", "'CRITICAL'", "'no such words here'", "'Key'", "'[KEY_1]'"),
    ("5", "'PERSONAL_CONTACT'", "'HIGH'", "'Asha Rao '", "'Name again'", "'[DUPLICATE_1]'"),
    ("6", "'GOVERNMENT_ID'", "'HIGH'", _pick(5, _SENTENCES[5]), "'EPIC'", "'[ROLL_NO_9]'"),
)

DOC_SOURCE = "(case doc_id % 4 when 0 then 'web_app' when 1 then 'desktop' when 2 then 'extension' else 'desktop_guard' end)"

# Copy and paste texts of the users in `events`, with repeats and pasted-back output.
EVENT_TEXT = (
    "(case event_id % 7 when 0 then 'password hunter' || cast(event_id % 2 as varchar(20))"
    " when 1 then 'password [PASSWORD_1]' when 2 then 'plain note' when 3 then 'plain note'"
    " when 4 then 'call 98260' || cast(10000 + event_id % 3 as varchar(20)) || ' or mail a' || cast(event_id % 2 as varchar(20)) || '@b.example'"
    " when 5 then 'call [PHONE_1] or mail [EMAIL_1]' else ' x ' end)"
)
EVENT_SOURCE = "(case when event_id % 5 = 0 then 'extension' else 'desktop' end)"
EVENT_PAUSED = "(case event_type when 'error' then true when 'signup' then false end)"



def _json(sql: str) -> str:
    """JSON text with ``^`` for the backslash: the dialects read ``\\`` in literals differently."""
    return f"replace({sql}, '^', chr(92))"


# Request bodies as a client would send them, some of them broken or empty.
_SCENARIO = "cast(c_custkey % 50 as varchar(20))"
REQUEST_BODY = _json(f"""(case c_custkey % 6
 when 0 then '{{"text": "  ' || c_name || '^n", "scenario_id": "' || {_SCENARIO} || '"}}'
 when 1 then '{{"text": "' || c_mktsegment || '", "use_cached_benchmark": true, "scenario_id": "' || {_SCENARIO} || '", "mask_mode": "redacted"}}'
 when 2 then '{{"text": "   ", "source": "desktop"}}' || case when c_custkey % 4 = 0 then ' and more' else '' end
 when 3 then '{{"text": "' || c_name || '", "api_key": " k ", "model_id": "gemma-4-26b-a4b-it", "temperature": ' || case when c_custkey % 4 = 1 then '0.5' else '"0.7"' end || '}}'
 when 4 then '{{"text": "' || c_name || '", "api_key": "k", "model_id": "other", "source": "extension", "scenario_id": "3"}}'
 else 'text=' || c_name end)""")

# Raw model responses: plain, fenced, wrapped in prose, empty, without parts, broken.
_ANSWER = (
    """'{^"findings^": [{^"id^": ^"f1^", ^"category^": ^"SECRET^", ^"severity^": ^"HIGH^", """
    """^"verbatim_quote^": ^"' || c_name || '^"}], ^"compliance_summary^": ^"' || c_mktsegment || '^"}'"""
)


def _envelope(inner: str) -> str:
    return f"""'{{"candidates": [{{"content": {{"parts": [{{"text": "' || {inner} || '"}}]}}}}]}}'"""


RESPONSE_BODY = _json(
    f"(case c_custkey % 7 when 0 then {_envelope(_ANSWER)}"
    f" when 1 then {_envelope("'```json^n' || " + _ANSWER + " || '^n```'")}"
    f" when 2 then {_envelope("'Here it is: ' || " + _ANSWER + " || ' - done'")}"
    """ when 3 then '{"candidates": []}' when 4 then '{"candidates": [{"content": {"parts": []}}]}'"""
    f""" when 5 then {_envelope("'no findings today'")}"""
    f""" else {_envelope("'{broken '")} end)"""
)


#: Rows that a task makes texts from and audits: some half a minute of work.
NOTES_A_TASK, EVENTS_A_TASK = 10_000, 100_000
#: Rows that a task makes bodies from and parses: some ten seconds of work.
BODIES_A_TASK = 100_000


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text", *cols), "doc_id")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per customer, with values of every kind."""
    rows = spread(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", rows=NOTES_A_TASK)
    return rows.select(F.col("c_custkey").alias("doc_id"), F.expr(NOTE_TEXT).alias("text"))


def bodies(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The rows of ``customer`` that bodies of requests and responses are made from."""
    return spread(load(spark, sf_dir, "customer").select("c_custkey", *cols), "c_custkey", rows=BODIES_A_TASK)


def note_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings an external model might have reported for the notes."""
    branches = [
        f"struct({o} as ord, {c} as category, {s} as severity, {q} as verbatim_quote, {e} as entity_type, "
        f"{g} as suggested_synthetic, 'reported' as risk_explanation)" for o, c, s, q, e, g in SEMANTIC_BRANCHES
    ]
    rows = load(spark, sf_dir, "customer").select("c_custkey")
    return rows.selectExpr("c_custkey as doc_id", f"inline(array({', '.join(branches)}))")


def copy_events(spark: SparkSession, sf_dir: str, audited: bool = False) -> DataFrame:
    """Copy and paste events per user, from ``events``; those to be ``audited`` are spread."""
    events = load(spark, sf_dir, "events")
    rows = spread(events.select("event_id", "user_id", "ts", "event_type"), "event_id", rows=EVENTS_A_TASK) if audited else events
    return rows.select(
        "event_id", F.col("user_id").cast("string").alias("user"), "ts",
        F.expr(EVENT_SOURCE).alias("source"), F.expr(EVENT_TEXT).alias("text"), "event_type")


def control_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pause rows per user: errors pause, signups resume, purchases flip."""
    return load(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup", "purchase")).select(
        F.col("user_id").cast("string").alias("user"), "ts", F.col("event_id").alias("seq"), F.expr(EVENT_PAUSED).alias("paused"))
