"""Personal data by anchor expansion over whole texts.

An Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits, URL schemes and
identifier cues. From each anchor a deterministic local parser grows the span to both sides and
validates it. Base kinds are email, ip, card and phone (leftmost, non-overlapping per kind, failing
matches dropped without a retry); the anchors add ``account`` (a value named by an identifier cue in
any case, checked by what the cue says: IBAN by its check number, SSN by its ranges, others by length
and digits) and ``url`` (an address with credentials). Every parser is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url")
CUES = ("account", "acct", "iban", "ssn", "passport", "password", "passwd", "token", "secret", "api_key", "apikey")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LEAD = re.compile(r"(?:[\x20_-]?(?:number|no|id|key))?+[\x20.:=#\"']{1,6}+", re.I)
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]{5,63}+(?![A-Za-z0-9-])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([\x20-]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![A-Za-z0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", re.I)
# The user part ends at the first colon and every part is possessive, so a failed match costs its own length only.
_AUTHORITY = re.compile(r"[^\s/?#@:\"'<>]++:[^\s/?#@\"'<>]++@[A-Za-z0-9.-]++(?::[0-9]++)?+[^\s\"'<>]*+")
_LENGTHS = {"passport": (6, 9), "account": (6, 34), "acct": (6, 34)}
_FOLD = {c: c + 32 for c in range(65, 91)}
_DOUBLED = tuple(int(c) for c in "0246813579")


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for anchor, kind in [("@", 0), ("+", 1), *((d, 2) for d in "0123456789"), ("://", 3)]:
        found.add_word(anchor, (kind, len(anchor)))
    for cue in CUES:
        found.add_word(cue, (4, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        total += _DOUBLED[int(c)] if k % 2 else int(c)
    return total % 10 == 0


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The longest run of 15 to 34 letters and digits from ``at``, single spaces allowed, whose check number (mod 97) is right."""
    if not (m := _IBAN.match(text, at)):
        return None
    end = m.end()
    while end > at:
        code = text[at:end].replace(" ", "").upper()
        if len(code) < 15:
            return None
        whole = end == len(text) or not (text[end].isascii() and text[end].isalnum())
        if whole and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return at, end
        end -= 2 if text[end - 2] == " " else 1
    return None


def _account(text: str, cue: str, at: int) -> tuple[int, int] | None:
    """The value that a cue ending at ``at`` names, checked by what the cue says it is; four digits at least."""
    if not (lead := _LEAD.match(text, at)):
        return None
    at = lead.end()
    if cue == "iban":
        return _iban(text, at)
    if not (m := (_SSN if cue == "ssn" else _VALUE).match(text, at)):
        return None
    least, most = _LENGTHS.get(cue, (6, 64))
    fits = cue == "ssn" or (least <= len(m.group()) <= most and sum("0" <= c <= "9" for c in m.group()) >= 4)
    return m.span() if fits else None


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive, by start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = phone_end = account_end = url_end = 0
    folded = text.translate(_FOLD)
    for last, (kind, size) in _automaton().iter(folded):
        at = last - size + 1
        if kind == 2:
            if at >= card_end:
                if m := _CARD.match(text, at):
                    card_end = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(m.span())
                else:
                    card_end = at + 1
            if at >= ip_end:
                if m := _IP.match(text, at):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                        spans["ip"].append(m.span())
                else:
                    ip_end = _DIGITS.match(text, at).end()
        elif kind == 0:
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans["email"].append((start, email_end))
        elif kind == 1:
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans["phone"].append(m.span())
        elif kind == 3:
            if at >= url_end and (m := _AUTHORITY.match(text, last + 1)):
                start = at
                while start > url_end and text[start - 1].isascii() and text[start - 1].isalnum():
                    start -= 1
                if start < at:
                    url_end = m.end()
                    spans["url"].append((start, url_end))
        elif at >= account_end and (at == 0 or not text[at - 1].isalnum()) and (span := _account(text, folded[at : last + 1], last + 1)):
            account_end = span[1]
            spans["account"].append(span)
    return spans


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with every span (overlaps merged, first kind named) replaced by ``[KIND]``."""
    flat = sorted((s, e, k) for k in KINDS for s, e in spans[k])
    out, at = [], 0
    for s, e, k in flat:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _say(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def scan_pii(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts by kind, base_sha256, spans.

    With ``with_text`` also the redacted text, null where the text is null. A null text has no
    spans; null ids and repeated rows pass through; other columns are ignored; no rows: no rows.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_account long, n_url long, redacted string"

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in range(9)]
                for text in part.column(1).to_pylist():
                    spans = find_spans(text or "")
                    for k, kind in enumerate(BASE_KINDS):
                        out[k].append(len(spans[kind]))
                    out[4].append(hashlib.sha256(_say(spans, BASE_KINDS).encode()).hexdigest())
                    out[5].append(_say(spans, KINDS))
                    out[6].append(len(spans["account"]))
                    out[7].append(len(spans["url"]))
                    out[8].append(redact(text, spans) if with_text and text is not None else None)
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
                names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_account", "n_url", "redacted"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = ids.mapInArrow(scan, schema)
    return found if with_text else found.drop("redacted")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, personal data in ``text`` replaced, n_chars counted anew.

    Null texts stay null; every row stays; other columns are untouched whatever their names.
    """
    at = docs.columns.index("text")

    def scan(batches):
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(scan, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
