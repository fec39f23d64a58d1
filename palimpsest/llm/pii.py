"""Personal data by anchor expansion.

An Aho-Corasick automaton finds what personal data can't do without: the at-sign, ``://``, digits, ``+`` and the cues of
identifiers.  From each anchor a deterministic parser expands left and right and validates what it has.  Every parser moves
forward only, so the work is in proportion to the text.

Kinds: ``email``, ``ip``, ``card``, ``phone`` (spans as the leftmost non-overlapping matches of fixed grammars), and, found
besides, ``secret`` (keys, tokens and passwords behind a cue), ``login`` (user and password inside a URL), ``iban`` (by its
country's length and its check digits) and ``account`` (a number behind an account cue).  All are found whole, whatever their length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_bpe import loaded

#: The grammars.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@")
SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,})")
AWS = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Z0-9])")
ACCOUNT = re.compile(r"(?: (?:number|no|nr|num))?[.:#]{0,2} {0,2}([0-9]+(?:[ -][0-9]+)*)")
#: How many characters the international account numbers of a country have.
IBAN_CHARS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 "
    "LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
#: Cues, in lower case, and what follows each.
CUES = {"password": "secret", "passwd": "secret", "token": "secret", "api_key": "secret", "apikey": "secret", "secret": "secret", "akia": "aws", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account"}
KINDS = ("email", "ip", "card", "phone", "secret", "login", "iban", "account")
BASE = KINDS[:4]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


class Finder:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for a in ("@", "://", "+", *"0123456789", *CUES):
            self.anchors.add_word(a, (a if a in CUES or len(a) > 1 else "0" if a.isdigit() else a, len(a)))
        self.anchors.make_automaton()
        # What makes a scan needless: none of the anchors is there.
        self.any = re.compile(r"[@+0-9]|://|" + "|".join(CUES), re.IGNORECASE).search
        self.iban_chars = {x[:2]: int(x[2:]) for x in IBAN_CHARS.split()}

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans, by kind as in KINDS, then by start."""
        if not self.any(text):
            return []
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(("email", "ip", "card", "phone", "secret", "login", "iban", "account"), 0)  # where each parser stands
        # Only A-Z are lowered: lower() can change the length of a text.
        low = text.lower() if text.isascii() else text.translate(LOWER)

        def add(kind: str, start: int, end: int) -> None:
            found[kind].append((start, end))
            done[kind] = end

        digit_end = -1
        for last, (anchor, n) in self.anchors.iter(low):
            at = last + 1 - n
            if anchor == "0":
                if at >= digit_end:  # once for each run of digits
                    digit_end = DIGITS.match(text, at).end()
                    if at >= done["ip"] and text.startswith(".", digit_end) and (m := IP.match(text, at)):
                        done["ip"] = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                            add("ip", at, m.end())
                    if at - 2 >= done["iban"] and (n_chars := self.iban_chars.get(text[at - 2 : at])) and (end := self.iban_end(text, at - 2, n_chars)):
                        add("iban", at - 2, end)
                    if at >= done["card"] and (m := CARD.match(text, at)):
                        done["card"] = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            add("card", at, m.end())
            elif anchor == "@":
                start = at
                while start > done["email"] and LOCAL.match(text, start - 1):
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    add("email", start, m.end())
            elif anchor == "+":
                if at >= done["phone"] and (m := PHONE.match(text, at)):
                    done["phone"] = m.end()
                    if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                        add("phone", at, m.end())
            elif anchor == "://":
                if at >= done["login"] and (m := LOGIN.match(text, at + 3)):
                    add("login", at + 3, m.end() - 1)
            elif (kind := CUES[anchor]) == "aws":
                if at >= done["secret"] and (m := AWS.match(text, at)):
                    add("secret", at, m.end())
            elif kind == "secret":
                if at >= done["secret"] and (m := SECRET.match(text, at + n)) and any(c.isdigit() for c in m[1]):
                    add("secret", m.start(1), m.end(1))
            elif at >= done["account"] and not low[at - 1 : at].isalpha() and (m := ACCOUNT.match(low, at + n)) and sum(c.isdigit() for c in m[1]) >= 6:
                add("account", m.start(1), m.end(1))
        return [(k, *s) for k in KINDS for s in found[k]]

    @staticmethod
    def iban_end(text: str, start: int, n_chars: int) -> int:
        """Where the account number of so many characters that begins at ``start`` ends, if there is one: capitals and digits, with single
        spaces between, no letter or digit right before or behind, and the check digits hold; else 0."""
        if start and text[start - 1].isalnum():
            return 0
        value, at = "", start
        while len(value) < n_chars:
            if at + 1 < len(text) and text[at] == " " and value:
                at += 1
            if at >= len(text) or not (text[at].isascii() and (text[at].isdigit() or text[at].isupper())):
                return 0
            value += text[at]
            at += 1
        good = value[2:4].isdigit() and (at == len(text) or not text[at].isalnum())
        return at if good and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1 else 0


LOWER = {c: c + 32 for c in range(65, 91)}


def _find(batches):
    finder = loaded(Finder)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    for b in batches:
        texts = b.column(1)
        got = [[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in finder.spans(t.as_py() or "")] for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, span)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for each row: ``spans`` is an array of ``(kind, start, stop)`` in code points, ``stop`` exclusive.

    A null or empty text has no spans (an empty array).  Null ids and repeated rows stay as they are.  Only the two named
    columns are read, so that others may have any name; an empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_find, f"doc_id {kind}, spans array<struct<kind:string,start:int,stop:int>>")
