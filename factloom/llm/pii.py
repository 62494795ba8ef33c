"""Personal data and secrets: proposed by patterns, confirmed by checksums, scored by context (operator 9).

Regular expressions propose spans over the whole text, none with a bound on its length but those that
its kind's standard has.  A validator then confirms
or refuses each one (Luhn for cards, mod-97 for IBANs, octet ranges for IPv4, parsing for IPv6, a JSON head for
web tokens, issued ranges for social security numbers, digit variety for secrets).  Of a
refused card or IBAN the shorter parts that end with a group (of an IBAN, at its
country's length) are tried, then the search goes on behind its first character.
A private key goes up to its END line, however long; without one only its BEGIN line is found.  Words
within ``CONTEXT_CHARS`` characters raise the score of a span (or lower it, as a
version number does an address); spans of at least ``MIN_SCORE`` are findings.
Of overlapping spans the one of higher score stays, then the longer, then the
earlier.

Defined results: a null or empty text has no findings, and redaction leaves it as
it is; a text is searched whole, however long.  An empty table gives no rows.  Findings only carry ``doc_id``; redaction keeps
all columns, whatever their names.  Of equal overlapping spans the kind that sorts first stays.  Offsets count characters (code points), the end is exclusive.  Repeated
rows each give their findings.  Other columns are left alone; redaction sets
``n_chars`` to the new length where the text changed and the column exists.
"""

from __future__ import annotations

import base64
import ipaddress
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import pieces, relax
from ._util import documents, fresh

MIN_SCORE = 0.5
CONTEXT_CHARS = 48
CONTEXT_GAIN = 0.3
#: Characters of an account number, by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def luhn(digits: str) -> bool:
    """Checksum of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Checksum of bank account numbers: moved to the back and read as a number, it leaves 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _card(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and d[0] in "23456" and len(set(d)) > 1 and luhn(d)


def _iban(s: str) -> bool:
    """An account number in capitals, or in another case of a known country's length."""
    t = s.replace(" ", "").upper()
    n = IBAN_LENGTHS.get(t[:2])
    return (len(t) == n if n else 15 <= len(t) <= 34 and t == s.replace(" ", "")) and mod97(t)


def _card_ends(s: str) -> Iterator[int]:
    """Ends of the shorter cards that stop where a group does, longest first."""
    return (i for i in range(len(s) - 1, 12, -1) if s[i] in " -" and s[i - 1] not in " -")


def _iban_ends(s: str) -> Iterator[int]:
    """The end that the country's length gives; of an unknown country all ends of groups, longest first."""
    n = IBAN_LENGTHS.get(s[:2].upper())
    return (i for i in range(len(s) - 1, 14, -1) if s[i] == " " and (n is None or i - s.count(" ", 0, i) == n))


def _ssn(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"


def _ipv4(s: str) -> bool:
    parts = s.split(".")
    return all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts) and parts[0] != "0"


def _ipv6(s: str) -> bool:
    """An address of a range in use: global, unique local or link local."""
    try:
        a = ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return s[0] in "23" or s[:2].lower() in ("fc", "fd") or a.is_link_local


def _phone(s: str) -> bool:
    d = _digits(s)
    return 10 <= len(d) <= 15 and len(set(d)) > 2


def _secret(s: str) -> bool:
    return len(set(s)) >= 8 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def _email(s: str) -> bool:
    local, _, host = s.rpartition("@")
    return not local.startswith(".") and ".." not in s and not host.startswith("-")


def _jwt(s: str) -> bool:
    """A signed or encrypted token: the first part is the base64 of a JSON object."""
    head = s[: s.index(".")]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except ValueError:
        return False


@dataclass(frozen=True)
class Detector:
    kind: str
    pattern: re.Pattern
    valid: Callable[[str], bool]
    score: float  #: of a confirmed span without context
    words: frozenset = field(default_factory=frozenset)  #: context that raises the score
    against: frozenset = field(default_factory=frozenset)  #: context that lowers it
    needs: str = ""  #: character without which the pattern can't match
    ends: Callable[[str], Iterator[int]] | None = None  #: shorter ends of a span to try if it is refused
    until: re.Pattern | None = None  #: a span goes on to the next match of this, if it comes before the next beginning


def _set(words: str) -> frozenset:
    return frozenset(words.split())


_D = "(?<![0-9A-Za-z_])"
_E = "(?![0-9A-Za-z_])"
DETECTORS = (
    Detector("EMAIL", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}(?![A-Za-z0-9])"), _email, 0.9, _set("email mail e-mail contact correo courriel"), needs="@"),
    Detector("CARD", re.compile(_D + r"[2-6][0-9](?:[ -]?[0-9]){11,17}" + _E), _card, 0.6, _set("card credit visa mastercard amex payment pay karte tarjeta carte cvv"), ends=_card_ends),
    Detector("IBAN", re.compile(_D + r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}" + _E), _iban, 0.9, _set("iban account bank konto compte cuenta"), ends=_iban_ends),
    Detector("SSN", re.compile(r"(?<![0-9A-Za-z_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_-])"), _ssn, 0.5, _set("ssn social security"), _set("isbn part order")),
    Detector("IP", re.compile(r"(?<![0-9A-Za-z_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_]|\.[0-9])"), _ipv4, 0.6, _set("ip host server address client adresse"), _set("version v release section chapter"), needs="."),
    Detector("IP", re.compile(r"(?<![0-9A-Za-z_:.])[0-9A-Fa-f]{4}:(?:[0-9A-Fa-f]{0,4}:){1,6}(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9A-Fa-f]{1,4})?(?![0-9A-Za-z_:]|\.[0-9])"), _ipv6, 0.6, _set("ip host server address client adresse"), needs=":"),
    Detector("PHONE", re.compile(r"(?<![0-9A-Za-z_.+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z_])"), _phone, 0.7, _set("phone tel call mobile fax telefon"), needs="+"),
    Detector("PHONE", re.compile(r"(?<![0-9A-Za-z_.+])\(?[2-9][0-9]{2}(?:\) ?|[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z_-])"), _phone, 0.5, _set("phone tel call mobile fax telefon"), _set("order part id")),
    Detector("PHONE", re.compile(_D + r"[2-9][0-9]{9}" + _E), _phone, 0.25, _set("phone tel call mobile fax telefon")),
    Detector("ACCESS_KEY", re.compile(r"(?<![0-9A-Za-z_])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z_])"), lambda s: True, 0.9, _set("aws key secret access"), needs="A"),
    Detector("SECRET", re.compile(r"(?<![0-9A-Za-z_.-])eyJ[A-Za-z0-9_-]+(?:\.{1,2}[A-Za-z0-9_-]+)+"), _jwt, 0.95, needs="eyJ"),
    Detector("SECRET", re.compile(r"(?:(?<=[=:\"'\s(\[{,;>])|(?<![^\n]))[A-Za-z0-9_+/-]{20,}(?![0-9A-Za-z_+/-])"), _secret, 0.25, _set("token secret password passwd pwd api_key apikey key bearer authorization")),
    Detector("SECRET", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), lambda s: True, 1.0, needs="-----B", until=re.compile(r"-----END [A-Z ]{0,30}PRIVATE KEY-----")),
)
_WORD = re.compile(r"[^\W\d]+(?:[-_][^\W\d]+)*")
_ANY_DIGIT = re.compile(r"[0-9]")


def _confirmed(d: Detector, text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of the spans that the validator confirms, of a refused one the longest shorter part that it does."""
    at = 0
    while (m := d.pattern.search(text, at)) is not None:
        a, b = m.span()
        if d.until is not None:
            after = d.pattern.search(text, b)
            if (end := d.until.search(text, b, after.start() if after else len(text))) is not None:
                b = end.end()
        if not d.valid(m[0]):
            b = -1 if d.ends is None else next((a + e for e in d.ends(m[0]) if d.valid(m[0][:e])), -1)
        if b > a:
            yield a, b
            at = b
        else:
            at = m.end() if d.ends is None else a + 1


def spans(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, begin, end, score) of the findings of a text, in order."""
    if not text:
        return []
    digit = _ANY_DIGIT.search(text) is not None
    found = []
    for d in DETECTORS:
        if d.needs and d.needs not in text or not (digit or d.kind in ("EMAIL", "SECRET", "ACCESS_KEY")):
            continue
        if d.kind == "SECRET" and not d.needs and not digit:
            continue
        for a, b in _confirmed(d, text):
            score = d.score
            if d.words or d.against:
                near = {w.lower() for w in _WORD.findall(text[max(0, a - CONTEXT_CHARS) : a])} | {w.lower() for w in _WORD.findall(text[b : b + CONTEXT_CHARS])}
                score += CONTEXT_GAIN * bool(near & d.words) - CONTEXT_GAIN * bool(near & d.against)
            if (score := round(min(1.0, score), 4)) >= min_score:
                found.append((d.kind, a, b, score))
    if len(found) < 2:
        return found
    found.sort(key=lambda x: (x[1], -x[2]))
    out, group, reach = [], [], -1
    for f in [*found, ("", 1 << 62, 1 << 62, 0.0)]:  # only spans of one overlapping run can collide
        if f[1] >= reach and group:
            kept: list[tuple[str, int, int, float]] = []
            for g in sorted(group, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
                if all(g[2] <= k[1] or g[1] >= k[2] for k in kept):
                    kept.append(g)
            out += sorted(kept, key=lambda x: x[1])
            group = []
        group.append(f)
        reach = max(reach, f[2])
    return out


def redacted(text: str | None, min_score: float = MIN_SCORE) -> str | None:
    """The text with each finding replaced by its kind in brackets."""
    got = spans(text, min_score)
    if not got:
        return text
    out, at = [], 0
    for kind, a, b, _ in got:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def findings(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, kind, begin, stop, score): one row for each finding; a narrow map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, kind, begin, stop, score = [], [], [], [], []
            for i, t in enumerate(b["text"]):
                for k, lo, hi, s in spans(t.as_py(), min_score):
                    row.append(i)
                    kind.append(k)
                    begin.append(lo)
                    stop.append(hi)
                    score.append(s)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row, pa.int64())), pa.array(kind, pa.string()), pa.array(begin, pa.int32()), pa.array(stop, pa.int32()), pa.array(score, pa.float64())], ["doc_id", "kind", "begin", "stop", "score"])
            relax()

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, f"doc_id {key}, kind string, begin int, stop int, score double")


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with every finding replaced in ``text``; all rows and columns stay."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        done = [pa.array([redacted(t.as_py(), min_score) for t in part], pa.string()) for _, part in pieces(texts)]
        out = pa.concat_arrays(done) if done else pa.array([], pa.string())
        del done
        relax()
        return out

    new = fresh("masked")
    out = docs.withColumn(new, masked("text"))
    cols = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "text":
            c = F.col(new).alias("text")
        elif f.name == "n_chars" and f.dataType.simpleString() in ("int", "bigint"):
            c = F.when(F.col(new) != F.col("text"), F.char_length(new).cast(f.dataType)).otherwise(c).alias("n_chars")
        cols.append(c)
    return out.select(*cols)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in every document."""
    return findings(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_pii": op9_pii}
