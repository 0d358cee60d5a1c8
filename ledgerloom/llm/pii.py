"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes, identifier cues); a local parser for
each kind of anchor expands it to the left and right, validates it and says where the next search may begin. Parsers
look only at the characters around an anchor, so the cost is one automaton pass plus the lengths of what is found.

Base kinds (leftmost, non-overlapping per kind; a match that fails validation is consumed, not retried):

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip    four dotted numbers, each at most 255
* card  14 to 19 digits, single spaces or hyphens between, passing Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 10 to 15 digits

The method adds: ``handle`` (an account name of three characters or more after an at-sign that is no email), ``url``
(after a scheme), ``ident`` (after a cue such as iban, ssn, passport or account, in any casing, and any number of
separators: letters and digits, six or more, four of them digits, in groups that spaces or hyphens part).

Null text is empty; an empty text has no spans; long texts are scanned whole; rows with equal ids are scanned one by one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame

from . import spans as S

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "handle", "url", "ident")
CUES = ("iban", "ssn", "passport", "account", "acct", "routing", "tax id", "licence no", "license no", "konto", "cuenta")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_HANDLE = frozenset(string.ascii_letters + string.digits + "_")
_DIGIT = frozenset(string.digits)
_PHONE = frozenset(string.digits + " ().-")
_URL = frozenset(string.ascii_letters + string.digits + "-._~:/?#[]@!$&'()*+,;=%")
_IDENT = frozenset(string.ascii_letters + string.digits + "- ")
_GAP = frozenset(" :#.=-nNoO\t")
_LOWER = dict(zip(map(ord, string.ascii_uppercase), string.ascii_lowercase, strict=True))  # one character for one


def _run(text: str, at: int, chars: frozenset, n: int) -> int:
    while at < n and text[at] in chars:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The email around the at-sign at ``at`` that begins at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    n = len(text)
    end = _run(text, at + 1, _LABEL, n)
    if end == at + 1:
        return None
    labels = 0
    while end < n and text[end] == "." and (more := _run(text, end + 1, _LABEL, n)) > end + 1:
        end, labels = more, labels + 1
    return (start, end) if labels else None


def ips_at(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """From the first digit of a dotted chain: its groups of four numbers that are addresses, and the chain's end."""
    n, runs = len(text), []
    while True:
        end = _run(text, at, _DIGIT, n)
        runs.append((at, end))
        if end + 1 < n and text[end] == "." and text[end + 1] in _DIGIT:
            at = end + 1
        else:
            break
    good = []
    for i in range(0, len(runs) - 3, 4):
        four = runs[i : i + 4]
        if all(b - a < 4 and int(text[a:b]) < 256 or len(text[a:b].lstrip("0")) < 4 and int(text[a:b].lstrip("0") or 0) < 256 for a, b in four):
            good.append((four[0][0], four[3][1]))
    return good, runs[-1][1]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def card_at(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """From the first digit of a chain with single separators: the card, if it is one, and the chain's end."""
    n, digits, end = len(text), [], at
    while True:
        more = _run(text, end, _DIGIT, n)
        digits.append(text[end:more])
        end = more
        if end + 1 < n and text[end] in " -" and text[end + 1] in _DIGIT:
            end += 1
        else:
            break
    d = "".join(digits)
    return ((at, end) if 14 <= len(d) <= 19 and luhn(d) else None), end


def phone_at(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """From a plus sign: the number, if it is one, and where the search goes on."""
    n = len(text)
    if at + 1 >= n or text[at + 1] not in _DIGIT:
        return None, at + 1
    end = _run(text, at + 2, _PHONE, n)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    if end < at + 4:
        return None, at + 1
    count = sum(c in _DIGIT for c in text[at:end])
    return ((at, end) if 10 <= count <= 15 else None), end


def handle_at(text: str, at: int) -> tuple[int, int] | None:
    if at and (text[at - 1] in _LOCAL or text[at - 1] == "@"):
        return None
    end = _run(text, at + 1, _HANDLE, len(text))
    return (at, end) if end - at - 1 >= 3 else None


def url_at(text: str, at: int, scheme: int) -> tuple[int, int] | None:
    end = _run(text, at + scheme, _URL, len(text))
    while end > at + scheme and text[end - 1] in ".,;:!?')]":
        end -= 1
    return (at, end) if end - at - scheme >= 3 and "." in text[at + scheme - 1 : end] else None


def ident_at(text: str, at: int, cue: int) -> tuple[int, int] | None:
    """The identifier after a cue and separators: letters and digits, six or more, four of them digits. A group after a
    space or hyphen belongs to it as long as it begins with a digit or a capital."""
    n = len(text)
    if at and text[at - 1].isalnum():
        return None
    start = _run(text, at + cue, _GAP, n)
    kept, last, digits, i = 0, start, 0, start
    while i < n and (c := text[i]) in _IDENT:
        i += 1
        if c in "- ":
            if i < n and text[i] in _IDENT and text[i] not in _DIGIT and not text[i].isupper():
                break
            continue
        kept, digits, last = kept + 1, digits + (c in _DIGIT), i
    return (start, last) if kept >= 6 and digits >= 4 else None


def finder():
    """A function from a text to its base spans and the added spans."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for c in string.digits:
        machine.add_word(c, ("0", 1))
    machine.add_word("@", ("@", 1))
    machine.add_word("+", ("+", 1))
    for scheme in SCHEMES:
        machine.add_word(scheme, ("s", len(scheme)))
    for cue in CUES:
        machine.add_word(cue, ("c", len(cue)))
    machine.make_automaton()

    def find(text: str) -> tuple[list[S.Span], list[S.Span]]:
        base: list[S.Span] = []
        more: list[S.Span] = []
        mail_end = ip_end = card_end = phone_end = url_end = ident_end = 0
        for last, (kind, size) in machine.iter(text.translate(_LOWER)):
            at = last - size + 1
            if kind == "0":
                if at >= ip_end:
                    good, ip_end = ips_at(text, at)
                    base += [("ip", a, b) for a, b in good]
                if at >= card_end:
                    card, card_end = card_at(text, at)
                    if card:
                        base.append(("card", *card))
            elif kind == "@":
                if found := email_at(text, at, mail_end) if at >= mail_end else None:
                    base.append(("email", *found))
                    mail_end = found[1]
                elif found := handle_at(text, at):
                    more.append(("handle", *found))
            elif kind == "+":
                if at >= phone_end:
                    phone, phone_end = phone_at(text, at)
                    if phone:
                        base.append(("phone", *phone))
            elif kind == "s":
                if at >= url_end and (found := url_at(text, at, size)):
                    more.append(("url", *found))
                    url_end = found[1]
            elif at >= ident_end and (found := ident_at(text, at, size)):
                more.append(("ident", *found))
                ident_end = found[1]
        return base, more

    return find


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, base, more) with arrays of structs kind, start, stop (code points, end exclusive)."""
    return S.scan(docs, finder, id_column, text_column)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each of ``find_personal_data``, nulls, repeats and long texts included; see ``spans.digest``."""
    return S.digest(found, id_column, BASE, KINDS)
