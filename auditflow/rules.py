"""The rule catalogue: what is looked for, and how a hit is classified.

Patterns are written in the usual Perl-style notation with Unicode ``\\b``,
``\\s`` and ``\\d``.  :mod:`auditflow.functions.dialect` turns them into
``java.util.regex`` for Spark.  A pattern with a capturing group yields group 1,
any other the whole match.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Rule(NamedTuple):
    label: str
    category: str
    severity: str
    prefix: str
    patterns: tuple[str, ...]


class Pattern(NamedTuple):
    """One regex of the catalogue, numbered in evaluation order."""

    pattern_ord: int
    rule_ord: int
    regex: str
    group: int


_NAME_STOP = r"(?=\s+(?:pass|pwd|pw|amount|amt|acc|a/c|ifsc|pan|adhar|aadhar|phone|mob|email|upi)|[,\n\r\.\;]|\s*$)"

# Labels, classes and patterns, in evaluation order.  A value is
# reported by the first pattern that finds it, so the order is part of the result.
# "Account Holder / Beneficiary" is classed as an account, not as a person.
RULES: tuple[Rule, ...] = (
    Rule("Password / Credential", "SECRET", "CRITICAL", "PASSWORD", (
        r"(?i)\b(?:pass(?:word|wrd)?|pwd|pw|secret|token|credential|creds?)\s*(?:is\s*|[:=]\s*|\s+)([^\s,;]+)",
        r"(?i)\b(?:pin|otp|cvv|security\s*code)\s*(?:is\s*|[:=]\s*|\s+)([0-9]{3,8})\b",
    )),
    Rule("Aadhaar Number", "GOVERNMENT_ID", "CRITICAL", "AADHAAR", (
        r"(?i)\b(?:aad?ha?a?r|uidai|adhar)\s*(?:no\.?|num(?:ber)?|is|card|[:=]|\s+)\s*([0-9\s-]{10,24})\b",
        r"\b[2-9]{1}[0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b",
        r"\b[2-9]{1}[0-9]{11}\b",
    )),
    Rule("PAN Card Number", "GOVERNMENT_ID", "CRITICAL", "PAN_CARD", (
        r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b",
        r"(?i)\b(?:pan(?:\s*card|\s*no|\s*num|\s*number)?)\s*(?:is|[:=]|\s+)\s*([A-Za-z0-9]{10})\b",
    )),
    Rule("Indian Passport Number", "GOVERNMENT_ID", "CRITICAL", "PASSPORT", (
        r"(?i)\b(?:passport(?:\s*no|\s*num|\s*number)?)\s*(?:is|[:=]|\s+)\s*([A-Za-z0-9]{8,12})\b",
        r"\b[A-PR-WYa-pr-wy][1-9]\d\s?\d{4}[1-9]\b",
    )),
    Rule("Voter ID / EPIC Card", "GOVERNMENT_ID", "HIGH", "VOTER_ID", (
        r"\b[A-Z]{3}[0-9]{7}\b",
        r"(?i)\b(?:voter\s*id|epic(?:\s*no|\s*num)?|election\s*card)\s*(?:is|[:=]|\s+)\s*([A-Za-z0-9/]{8,18})\b",
    )),
    Rule("Driving License (DL)", "GOVERNMENT_ID", "HIGH", "DRIVING_LICENSE", (
        r"(?i)\b(?:driving\s*licen[sc]e|dl\s*no|licen[sc]e\s*no)\s*(?:is|[:=]|\s+)\s*([A-Za-z0-9\s-]{8,22})\b",
        r"\b[A-Z]{2}[0-9]{2}\s?[0-9]{4}\s?[0-9]{7}\b",
        r"\b[A-Z]{2}[ -]?[0-9]{2}[ -]?[0-9]{11}\b",
    )),
    Rule("Vehicle Registration / RC", "GOVERNMENT_ID", "HIGH", "VEHICLE_RC", (
        r"(?i)\b(?:rc\s*no|vehicle\s*no|car\s*no|bike\s*no|reg(?:istration)?\s*no)\s*(?:is|[:=]|\s+)\s*([A-Za-z0-9\s-]{6,16})\b",
        r"\b[A-Z]{2}[ -]?[0-9]{1,2}[ -]?[A-Z]{1,3}[ -]?[0-9]{4}\b",
    )),
    Rule("GSTIN / GST Number", "GOVERNMENT_ID", "CRITICAL", "GSTIN", (
        r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}\b",
        r"(?i)\b(?:gstin|gst\s*no|gst\s*number)\s*(?:is|[:=]|\s+)\s*([0-9A-Za-z]{15})\b",
    )),
    Rule("TAN (Tax Deduction Number)", "GOVERNMENT_ID", "HIGH", "TAN", (
        r"(?i)\b(?:tan(?:\s*no|\s*num|\s*number)?)\s*(?:is|[:=]|\s+)\s*([A-Za-z0-9]{10})\b",
        r"\b[A-Z]{4}[0-9]{5}[A-Z]{1}\b",
    )),
    Rule("CIN (Corporate Identity No)", "GOVERNMENT_ID", "HIGH", "CIN", (
        r"\b[UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}\b",
    )),
    Rule("DIN (Director Identity No)", "GOVERNMENT_ID", "HIGH", "DIN", (
        r"(?i)\b(?:din(?:\s*no|\s*number)?)\s*(?:is|[:=]|\s+)\s*([0-9]{8})\b",
    )),
    Rule("EPFO / UAN / PF Account", "GOVERNMENT_ID", "CRITICAL", "UAN", (
        r"(?i)\b(?:uan(?:\s*no|\s*number)?|epf(?:\s*no)?|pf\s*acc(?:ount)?)\s*(?:is|[:=]|\s+)\s*([0-9A-Za-z\s/-]{8,24})\b",
    )),
    Rule("ABHA / Health ID / PMJAY", "GOVERNMENT_ID", "CRITICAL", "HEALTH_ID", (
        r"\b[0-9]{2}-[0-9]{4}-[0-9]{4}-[0-9]{4}\b",
        r"(?i)\b(?:abha(?:\s*id|\s*no)?|pmjay|health\s*id)\s*(?:is|[:=]|\s+)\s*([0-9\s-]{12,18})\b",
    )),
    Rule("Ration Card Number", "GOVERNMENT_ID", "HIGH", "RATION_CARD", (
        r"(?i)\b(?:ration\s*card(?:\s*no|\s*number)?)\s*(?:is|[:=]|\s+)\s*([0-9A-Za-z\s-]{8,20})\b",
    )),
    Rule("Legal Court Case / FIR / Property Deed", "GOVERNMENT_ID", "HIGH", "LEGAL_DOC", (
        r"(?i)\b(?:fir\s*no|case\s*no|crime\s*no|registry\s*no|deed\s*no|khasra\s*no|khatauni|survey\s*no|property\s*id|plot\s*no)\s*(?:is|[:=]|\s+)\s*([0-9A-Za-z\s/-]{3,24})\b",
    )),
    Rule("Financial Amount", "FINANCIAL_PII", "HIGH", "AMOUNT", (
        r"(?i)\b([0-9]+(?:\.[0-9]+)?\s*(?:k|m|l|cr|lac|lacs|lakh|lakhs|crore|crores|rupees|bucks|dollars|rs|inr|usd|eur|cents))\b",
        r"(?i)\b(?:(?:rs\.?|inr|₹|\$|usd|eur|€|£|gbp)\s*[0-9]+(?:,[0-9]{2,3})*(?:\.[0-9]{1,2})?(?:\s*(?:lakhs?|crores?|k|m|million|billion|thousand))?)\b",
        r"(?i)\b(?:amount|amt|balance|bal|salary|transfer|paid|fee|cost|price|payout|sum)\s*(?:is|of|[:=]|\s+)\s*([₹\$€£]?[0-9,]+(?:\.[0-9]{1,2})?(?:\s*(?:lakhs?|crores?|k|m|inr|usd|rupees))?)\b",
    )),
    Rule("Bank Account & Bank Reference", "FINANCIAL_PII", "CRITICAL", "ACCOUNT", (
        r"(?i)\b((?:hdfc|icici|sbi|axis|pnb|bob|kotak|canara|yes\s*bank|indusind|idfc|citi|hsbc|barclays|chase|wells\s*fargo)\s+(?:bank|account|a/c|acc|branch))\b",
        r"(?i)\b(?:a/c|acct|acc(?:ount)?(?:\s*no|\s*num|\s*number)?|bank\s*acc(?:ount)?)\s*(?:is|[:=]|\s+)\s*([0-9A-Za-z-]{6,24})\b",
        r"(?i)\b(?:transfer\s+to|credit\s+to|debit\s+from|bank\s+account)\s*[:=]?\s*([0-9]{8,18})\b",
    )),
    Rule("Account Holder / Beneficiary", "FINANCIAL_PII", "CRITICAL", "ACCOUNT", (
        r"(?i)\b(?:beneficiary|payee|acc(?:ount)?\s*holder|holder\s*name|account\s*name)\s*(?:is|[:=]|\s+)\s*([A-Za-z]+(?:\s+[A-Za-z]+){0,3}?)" + _NAME_STOP,
    )),
    Rule("Customer / Transactor / Person Name", "PERSONAL_CONTACT", "HIGH", "CUSTOMER", (
        r"(?i)\b([a-z]{3,20})\s+(?:transferred|transfered|sent|send|paid|payed|received|recieved|deposited|withdrew|debited|credited|swiped|borrowed|lent)\b",
        r"(?i)\b(?:transferred\s+to|sent\s+to|paid\s+to|received\s+from|credited\s+to|debited\s+from)\s+([A-Za-z]{3,20})\b",
        r"(?i)\b(?:Name|Customer|Client|User|Patient|Emp(?:loyee)?|Mr\.?|Mrs\.?|Ms\.?|Dr\.?)\s*[:=]\s*([A-Za-z]+(?:\s+[A-Za-z]+){0,3}?)" + _NAME_STOP,
        r"\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)?)\s*,\s*(?:adhar|aadhar|pan|passw|pwd|pw|phone|mobile|email|\+?91|[0-9]{4})\b",
        r"\b(Rajesh|Rahul|Vikram|Vikramaditya|Priya|Sneha|Amit|Suresh|Ramesh|Rohan|Pooja|Neha|Ananya|Deepak|Manoj|Kavita|Sunil|Anil|Sanjay|Ajay|Alok|Naveen|Alka|Gaurav|Sachin|Manish|Harsh|Dev|Ravi|John|Jane|Alice|Bob|David|Michael|Sarah|Emma)\b",
    )),
    Rule("Credit / Debit Card", "FINANCIAL_PII", "CRITICAL", "CARD", (
        r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
        r"(?i)\b(?:card|cc)\s*(?:no\.?|num|number)?\s*[:=]?\s*([0-9\s-]{15,19})\b",
    )),
    Rule("Email Address", "PERSONAL_CONTACT", "HIGH", "EMAIL", (
        r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    )),
    Rule("Phone Number", "PERSONAL_CONTACT", "HIGH", "PHONE", (
        r"\b(?:\+?91[\s-]?)?[6-9]\d{9}\b|\b(?:\+?1[\s-]?)?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{4}\b",
        r"(?i)\b(?:mob(?:ile)?|phone|ph|contact)\s*(?:no\.?|num|number)?\s*[:=]?\s*(\+?[0-9\s-]{10,15})\b",
    )),
    Rule("UPI ID / VPA", "FINANCIAL_PII", "CRITICAL", "UPI_ID", (
        r"\b[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}\b",
    )),
    Rule("AWS Access Key", "SECRET", "CRITICAL", "API_KEY", (
        r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    )),
    Rule("Generic API / Secret Key", "SECRET", "CRITICAL", "API_KEY", (
        r"\b(?:sk_live_|ghp_|gho_|xoxb-|eyJh|AIzaSy)[a-zA-Z0-9_\-\.]{16,}\b",
    )),
    Rule("IPv4 Address", "SECRET", "MEDIUM", "IP_ADDRESS", (
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    )),
    Rule("Indian IFSC Code", "FINANCIAL_PII", "HIGH", "IFSC", (
        r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    )),
)

RULE_SCHEMA = "rule_ord INT, label STRING, category STRING, severity STRING, prefix STRING"


def patterns(rules: tuple[Rule, ...] = RULES) -> list[Pattern]:
    """All regexes of ``rules`` in evaluation order; ``rule_ord`` counts from 1."""
    flat = [(rule_ord, regex) for rule_ord, rule in enumerate(rules, 1) for regex in rule.patterns]
    return [
        Pattern(i, rule_ord, regex, min(1, re.compile(regex).groups))
        for i, (rule_ord, regex) in enumerate(flat)
    ]


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The catalogue as a dimension table; its size is that of the constant above."""
    rows = [(i, r.label, r.category, r.severity, r.prefix) for i, r in enumerate(rules, 1)]
    return spark.createDataFrame(rows, RULE_SCHEMA)
