"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, address schemes and identifier
cues.  Around each anchor a local parser expands to the boundaries of an address, number or account
and validates it.  Parsers never look back before the end of their kind's last span.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import id_and_text

BASE_KINDS = ("email", "ip", "card", "phone")
# Further kinds: addresses with a user part, accounts with a check, access keys, assigned secrets, national numbers.
MORE_KINDS = ("url", "iban", "ssn", "key", "secret", "tel")
KINDS = BASE_KINDS + MORE_KINDS

# The base patterns' character sets.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER_URL = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
# Between a cue and what it announces: marks and a few filler words.
FILLER = r"(?:[\s:=#.]|(?:is|was|no|nr|num|number)\b)*+"
IBAN = re.compile(FILLER + r"([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})")
SSN = re.compile(FILLER + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
ACCESS_KEY = re.compile(
    r"(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
)
BARE_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
TEL = re.compile(r"\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[.-][0-9]{4}(?![0-9-])")
ASSIGNED = re.compile(r"\s*(?:is\s|[:=])\s*[\"']?([A-Za-z0-9_/+-]{16,})")

CUES = {"iban": "iban", "ssn": "ssn", "token": "secret", "secret": "secret", "password": "secret", "api_key": "secret",
        "apikey": "secret", "api key": "secret", "api-key": "secret", "passwd": "secret"}
KEY_HEADS = ("akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "-----begin ")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
# Countries with the length of their accounts.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 "
    "EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 "
    "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 "
    "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@functools.lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Anchors of a text with A-Z lower-cased."""
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    for head in KEY_HEADS:
        automaton.add_word(head, ("key", len(head)))
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", 1))
    for scheme in SCHEMES:
        automaton.add_word(scheme, ("scheme", len(scheme)))
    for cue, kind in CUES.items():
        automaton.add_word(cue, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


def ascii_lower(text: str) -> str:
    """A-Z lower-cased and nothing else, so that places stay."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        n = ord(char) - 48
        if place % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """The end of the account at the start of ``text[start:end]`` that passes its check, or -1.

    A country's accounts have one length; those of countries not listed end at the last place that passes.
    """
    length = IBAN_LENGTHS.get(text[start:start + 2])
    for stop in range(end, start + 14, -1):
        inside = stop < len(text) and text[stop].isascii() and text[stop].isalnum()
        if inside or text[stop - 1] == " ":
            continue
        if (not length or stop - start - text.count(" ", start, stop) == length) and iban_ok(text[start:stop]):
            return stop
    return -1


def small_number(digits: str) -> bool:
    """At most 255, however long the digits."""
    plain = digits.lstrip("0")
    return len(plain) < 3 or len(plain) == 3 and plain <= "255"


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` of one text by start, then kind; code points, end exclusive."""
    found = []
    email_end = chain_end = card_end = phone_end = 0
    last = dict.fromkeys(MORE_KINDS, 0)
    for at_end, (what, length) in anchors().iter(ascii_lower(text)):
        at = at_end + 1 - length
        if what == "digit":
            before = text[at - 1] if at else ""
            if "A" <= before <= "Z" and at >= 2 and at - 2 >= last["iban"] and (at == 2 or not text[at - 3].isalnum()):
                # An account carries its own check, so a listed country needs no cue.
                if text[at - 2:at] in IBAN_LENGTHS and (account := BARE_IBAN.match(text, at - 2)):
                    end = iban_end(text, at - 2, account.end())
                    if end > 0:
                        last["iban"] = end
                        found.append(("iban", at - 2, end))
            if not before.isalnum() and before not in tuple("+.-") and at >= max(phone_end, last["tel"]):
                start = at - (before == "(")
                if number := TEL.match(text, start):
                    last["tel"] = number.end()
                    if not text[max(start - 3, 0):start].strip().endswith(tuple("+0123456789")):
                        found.append(("tel", start, number.end()))
            if at >= chain_end:
                chain = DIGIT_CHAIN.match(text, at)
                chain_end = chain.end()
                if text.count(".", at, chain_end) >= 3:
                    parts = [m.span() for m in DIGITS.finditer(text, at, chain_end)]
                    for first in range(0, len(parts) - 3, 4):
                        four = parts[first:first + 4]
                        if all(small_number(text[s:e]) for s, e in four):
                            found.append(("ip", four[0][0], four[3][1]))
            if at >= card_end:
                card_end = CARD.match(text, at).end()
                if card_end - at >= 12:
                    digits = text[at:card_end].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", at, card_end))
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            domain = DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                email_end = domain.end()
                found.append(("email", start, email_end))
        elif what == "plus":
            if at >= phone_end and (number := PHONE.match(text, at)):
                phone_end = number.end()
                if 9 <= sum(map(len, DIGITS.findall(text, at, phone_end))) <= 15:
                    found.append(("phone", at, phone_end))
        elif what == "scheme":
            if at >= last["url"] and (address := USER_URL.match(text, at_end + 1)):
                last["url"] = address.end()
                found.append(("url", at, address.end()))
        elif what == "key":
            if (at == 0 or not text[at - 1].isalnum()) and (key := ACCESS_KEY.match(text, at)):
                found.append(("key", at, key.end()))
        else:
            pattern = {"iban": IBAN, "ssn": SSN, "secret": ASSIGNED}[what]
            inner = (at == 0 or not text[at - 1].isalnum()) and pattern.match(text, at_end + 1)
            if inner and inner.start(1) >= last[what]:
                start, end = inner.span(1)
                if what == "iban":
                    end = iban_end(text, start, end)
                if end > 0 and (what != "secret" or _mixed(inner.group(1))):
                    last[what] = end
                    found.append((what, start, end))
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{kind}:{start}:{end}" for kind, start, end in spans])


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per document.

    Null and empty texts have no spans; repeated rows repeat.  No shuffle, one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                spans = find(text.as_py())
                base = [s for s in spans if s[0] in BASE_KINDS]
                kinds = [s[0] for s in base]
                rows.append((*map(kinds.count, BASE_KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]],
                 *[pa.array(c, pa.string()) for c in columns[4:]]],
                names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"],
            )

    return id_and_text(docs).mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    )


def redact(text: str) -> str:
    """Every span replaced by its kind in brackets; of overlapping spans the first, longest one."""
    out, done = [], 0
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null, other columns pass through."""

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(redact, na_action="ignore")

    return docs.withColumn("text", cleaned("text"))
