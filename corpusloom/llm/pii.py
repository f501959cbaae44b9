"""Personal data: anchors found by an Aho-Corasick automaton, each expanded and validated by a small local parser.

Anchors are at-signs, "://", plus signs, digits and identifier cues ("IBAN", "account", "token" ...) in any case of A-Z.
Base kinds, leftmost and without overlaps within a kind: email, ip, card, phone. From the cues come iban (mod 97 holds),
account (6 to 17 digits after an account cue), ssn (after its cue), tel (7 to 15 digits without a plus, after a cue), secret
(a key, token or password that is assigned to its name) and login (user:password in a URL). All offsets are code points.

Cases: a null text is an empty one and has no spans; texts are scanned whole, in time linear in their length; of kinds that
start at one place the one that is listed first comes first; repeated rows give the same spans; an empty table gives no
rows; other columns pass through unread, one of the result's name is replaced.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Kinds in the order in which equal starts are listed.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "account", "ssn", "tel", "secret", "login"]

#: Fixed values of the formats.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_IBAN = re.compile(r"[\x20:#]{0,3}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20(?:no\.?|number|nr\.?))?[\x20:#=]{0,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
_SSN = re.compile(r"[\x20:#=]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_TEL = re.compile(r"(?:\x20(?:no\.?|number|nr\.?))?[\x20.:#=]{0,3}(\(?[0-9][\x20().0-9/-]{5,24}[0-9])(?![0-9])", re.IGNORECASE)
_SECRET = re.compile(r"[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?([^\s\"',;]{12,})")
_PASSWORD = re.compile(r"[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?([^\s\"',;]{6,})")
_LOGIN = re.compile(r"([^\s/@:]++:[^\s/@]++)@")  # stops at a "/", so that the next "://" begins behind it
_CUES = {
    "iban": ["iban"],
    "account": ["account", "acct", "konto", "compte", "cuenta"],
    "ssn": ["ssn", "social security number"],
    "tel": ["phone", "tel", "telephone", "mobile", "fax", "téléphone", "telefon", "teléfono"],
    "secret": ["token", "secret", "api_key", "api-key", "apikey", "api key", "access_key", "access key", "private_key", "private key"],
    "password": ["password", "passwd", "pwd", "passwort", "contraseña", "mot de passe"],
}
_PARSERS = {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN, "tel": _TEL, "secret": _SECRET, "password": _PASSWORD}
_UPPER = re.compile(r"[A-Z]+")


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, what in [("@", "at"), ("://", "scheme"), ("+", "plus"), *[(d, "digit") for d in "0123456789"], *[(w, k) for k, ws in _CUES.items() for w in ws]]:
        found.add_word(word, what)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in a text, by start, then kind."""
    text = text or ""
    found: list[tuple[str, int, int]] = []
    mail = ip = card = run = told = 0  # ends of the last email, ip, card and secret and of the last run of digits
    for last, what in _automaton().iter(text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text)):
        if what == "digit":
            if last < run:
                continue
            run = _DIGITS.match(text, last).end()
            if last >= ip and (m := _IP.match(text, last)):  # what follows the run decides, so one attempt for each run is enough
                ip = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append(("ip", last, ip))
            if last >= card and (m := _CARD.match(text, last)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "") if card - last < 64 else ""
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", last, card))
        elif what == "at":
            if m := _DOMAIN.match(text, last + 1):
                start = last
                while start > mail and text[start - 1] in _LOCAL:
                    start -= 1
                if start < last:
                    mail = m.end()
                    found.append(("email", start, mail))
        elif what == "plus":
            if (m := _PHONE.match(text, last)) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", last, m.end()))
        elif what == "scheme":
            if m := _LOGIN.match(text, last + 1):
                found.append(("login", m.start(1), m.end(1)))
        elif what in ("secret", "password"):
            if last >= told and (m := _PARSERS[what].match(text, last + 1)):  # a cue inside a secret is part of it
                told = m.end()
                if what == "password" or any(c.isdigit() for c in m[1]):
                    found.append(("secret", m.start(1), told))
        elif m := _PARSERS[what].match(text, last + 1):
            if what == "iban":
                if (end := _iban_end(text, m.start(1), m.end(1))) is not None:
                    found.append((what, m.start(1), end))
            elif what != "tel" or 7 <= sum(c.isdigit() for c in m[1]) <= 15:
                found.append((what, m.start(1), m.end(1)))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _iban_end(text: str, start: int, end: int) -> int | None:
    """The longest end at which the letters and digits from start make a valid number."""
    while end - start >= 15:
        plain = text[start:end].replace(" ", "").upper()
        if text[end - 1] != " " and len(plain) >= 15 and _mod97(plain):
            return end
        end -= 1
    return None


SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))


@F.pandas_udf(SPANS)
def pii_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in texts.tolist()], dtype=object)


@F.pandas_udf(T.StringType())
def redact(texts: pd.Series, found: pd.Series) -> pd.Series:
    """Each text with its spans replaced by their kinds, as in "<email>"; spans that overlap become one, named after the first."""

    def of(text, marks):
        if text is None or not len(marks):
            return text
        parts, at = [], 0
        for m in marks:
            if m["start"] >= at:
                parts += [text[at : m["start"]], f"<{m['kind']}>"]
            at = max(at, m["end"])
        return "".join([*parts, text[at:]])

    return pd.Series([of(t, m) for t, m in zip(texts.tolist(), found.tolist(), strict=True)], dtype=object)


def find_pii(documents: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """documents with the spans of each text added, as an array of (kind, start, end)."""
    return documents.withColumn(name, pii_spans(F.col(text)))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")

    def n(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin(BASE))
    return found.select("doc_id", *map(n, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), n("secret"))
