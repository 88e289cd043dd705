"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, schemes of web addresses and cue words of account identifiers. At
each anchor a small deterministic parser expands to the left and right and
validates what it has: an email's local part and domain, an address's four
parts, a card's check digit, a phone's digits, a web address's host, an
account's form and, for an IBAN, its remainder. The pass is linear in the
text; no pattern is tried where no anchor stands.

Kinds, in the order they are listed: email, ip, card, phone (the base ones:
leftmost, non-overlapping per kind, failing matches dropped without another
try), url, account. Spans of different kinds may overlap. Cue words and
schemes are known in lower case, capitalised and in capitals.

Defined results: a null text is an empty one, without spans; every row is
searched by itself, whether its identifier is null or repeated. Extra
columns are ignored. No rows in, no rows out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4

SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("iban", "account", "acct", "ssn", "passport")

OUT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
       "n_url long, n_account long")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9][^\s<>\"'`{}|\\^]*")
_AFTER_CUE = re.compile(r"[ \t:#=.]{0,4}(?:(?:no|nr|number|num|id)\b[ \t:#=.]{0,4})?", re.IGNORECASE | re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"[A-Z]{0,3}[0-9](?:[ -]?[0-9]){5,19}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, (c if c in "@+" else "0", 1))
    for kind, words in (("url", SCHEMES), ("account", CUES)):
        for w in words:
            for form in {w, w.capitalize(), w.upper()}:
                found.add_word(form, (kind, len(w)))
    found.make_automaton()
    return found


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    start = at
    while start > done and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _url(text: str, at: int, after: int) -> tuple[int, int] | None:
    rest = _URL.match(text, after)
    if not rest:
        return None
    end = rest.end()
    while end > after and text[end - 1] in ".,;:!?)]*":
        end -= 1
    host = re.split(r"[/?#:]", text[after:end], maxsplit=1)[0]
    return (at, end) if "." in host or text[at:after].endswith("//") and host else None


def _account(text: str, at: int, after: int) -> tuple[int, int] | None:
    if at and text[at - 1].isalnum() or after < len(text) and text[after].isalnum():
        return None
    begin = _AFTER_CUE.match(text, after).end()
    for pattern, valid in ((_IBAN, iban), (_ACCOUNT, lambda v: True)):
        if m := pattern.match(text, begin):
            # an IBAN may be followed by a word in capitals: shorten it group by group until its remainder fits
            end = m.end()
            while end - begin >= 7:
                if (end == len(text) or not text[end].isalnum()) and valid(re.sub("[ -]", "", text[begin:end])):
                    return begin, end
                cut = text.rfind(" ", begin, end)
                end = cut if cut > 0 else 0
    return None


def spans(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans, sorted."""
    out, done = [], [0] * len(KINDS)

    def take(kind: int, start: int, end: int, valid: bool) -> None:
        done[kind] = end
        if valid:
            out.append((start, kind, end))

    for last, (what, size) in anchors.iter(text):
        at = last - size + 1
        if what == "0":
            if at and "0" <= text[at - 1] <= "9":
                continue                                    # only where a run of digits begins
            if at >= done[1] and (m := _IP.match(text, at)):
                parts = [p.lstrip("0") for p in m.group().split(".")]
                take(1, at, m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts))
            if at >= done[2] and (m := _CARD.match(text, at)):
                digits = m.group().replace(" ", "").replace("-", "")
                take(2, at, m.end(), 12 <= len(digits) <= 19 and luhn(digits))
        elif what == "@":
            if at >= done[0] and (m := _email(text, at, done[0])):
                take(0, *m, True)
        elif what == "+":
            if at >= done[3] and (m := _PHONE.match(text, at)):
                take(3, at, m.end(), 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15)
        else:
            kind, parser = (4, _url) if what == "url" else (5, _account)
            if at >= done[kind] and (m := parser(text, at, last + 1)):
                take(kind, *m, True)
    return sorted(out)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document the number of spans of each kind, the spans as
    ``kind:start:end`` (code points, end exclusive) and a digest of the base ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in slices(batches):
            counts, digests, all_spans = [[] for _ in KINDS], [], []
            for text in batch["text"].to_pylist():
                found = spans(text, anchors)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(joined([x for x in found if x[1] < BASE]).encode()).hexdigest())
                all_spans.append(joined(found))
            ints = [pa.array(c, pa.int64()) for c in counts]
            yield pa.record_batch([batch["doc_id"], *ints[:BASE], pa.array(digests), pa.array(all_spans), *ints[BASE:]],
                                  names=[c.split()[0] for c in OUT.split(", ")])

    return texts(docs).mapInArrow(run, OUT)
