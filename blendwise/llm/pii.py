"""Personal data: plain identifiers, and disguised ones found through an offset-preserving transducer.

The transducer rewrites look-alike characters, spelled digits and at/dot disguises and remembers for every
character it writes which source characters it stands for. Identifiers are searched in the rewritten text and
their spans mapped back, so that results are positions in the text as given.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from blendwise.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])(?>[0-9]+)(?>\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".",
}
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}

SPELLED_DIGITS = frozenset(SPELLED.values())

_number = "(?:" + "|".join(SPELLED) + "|oh)"
_gap = r"(?:[\x20\t\n,.()-]{1,3})"
_open, _close = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_letter = r"[^\W\d_]"
_figure = rf"(?:(?<!{_letter}){_number}(?!{_letter})|(?<![0-9])(?>[0-9]+))"
_point = rf"(?:{_open}(?:dot|point|\.){_close}|{_gap}?(?<!{_letter})(?:dot|point)(?!{_letter}){_gap}?)"
# Spelled digits and numerals of any length, in any order; a written dot counts only between two of them.
RUN = re.compile(
    rf"(?i)(?:(?:(?<!{_letter})plus(?!{_letter})|\+){_gap}?)?{_figure}(?:(?:{_point}|{_gap})?{_figure})+"
)
FIGURE = re.compile(rf"(?i){_figure}")
POINT = re.compile(rf"(?i){_point}")
RUN_MARK = re.compile(r"(?i)[a-z]|[\[({<]\s*\.\s*[\])}>]")
_label = r"[A-Za-z0-9-]+"
_at = rf"(?:{_open}at{_close}|{_open}@{_close}|\s+at\s+|\s*@\s*)"
_dot = rf"(?:{_open}(?:dot|\.){_close}|\s+dot\s+|\.)"
# A plain "at" counts only where a disguised dot follows: prose has "at" before real host names. A local part without
# a host matches too, so that the search goes on behind it and long chains cost linear time.
MAIL = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])(?>[A-Za-z0-9_%+-]+(?:{_dot}[A-Za-z0-9_%+-]+)*)"
    rf"(?P<host>{_open}(?:at|@){_close}{_label}(?:{_dot}{_label})+|(?:\s+at\s+|@){_label}(?:{_dot}{_label})+)?"
)
MAIL_PART = re.compile(rf"(?i){_open}(?:at|@){_close}|\s+at\s+|{_open}(?:dot|\.){_close}|\s+dot\s+")
FOREIGN = re.compile(
    "[" + re.escape("".join(ALIKE)) + INVISIBLE + "٠-٩۰-۹०-९！-～\U0001d7ce-\U0001d7ff]"
)
DISGUISED_MARK = re.compile(r"(?i)[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]")
DISGUISED_DOT = re.compile(r"(?i)\sdot\s")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern local@domain, but started from each @, so that long runs cost linear time."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
            last = host.end()
        at = text.find("@", max(at + 1, last))
    return found


def identifiers(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain identifiers in kind order; each kind leftmost and not overlapping."""
    found = [(s, "email", e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), "phone", m.end()))
    return found


READINGS = [(tight, first, last) for tight in (0, 1) for first in (0, 1) for last in (0, 1)]


def run_edits(text: str, run: re.Match, reading: tuple[int, int, int], ip_ends: set[int]) -> list[tuple[int, int, str]]:
    """Figures of a run as digits, written dots as dots.

    Gaps between single figures stand for nothing. Those beside longer numerals become one blank, as in phone and card
    numbers, or in a tight reading nothing, as within an address. A plain dot at a numeral stays, and so do the ends of
    plain addresses. A reading can leave the first or last figure to the prose, where it is a word.
    """
    tight, first, last = reading
    figures = list(FIGURE.finditer(text, run.start(), run.end()))
    head = text[run.start() : figures[0].start()]
    if first and not head and not figures[0][0].isdigit():
        figures = figures[1:]
    if last and figures and not figures[-1][0].isdigit():
        figures = figures[:-1]
    if len(figures) < 2:
        return []
    edits = [(run.start(), figures[0].start(), "+")] if head else []
    for f in figures:
        if not f[0].isdigit():
            edits.append((f.start(), f.end(), SPELLED.get(f[0].lower(), "0")))
    # Whether the figure is one digit, standing alone.
    single = [not f[0].isdigit() or len(f[0]) == 1 and text[f.start() - 1 : f.start()] != "." for f in figures]
    for k, (f, g) in enumerate(zip(figures, figures[1:])):
        start, end = f.end(), g.start()
        numerals = f[0].isdigit() + g[0].isdigit()
        if POINT.fullmatch(text, start, end):
            edits.append((start, end, "."))
        elif start == end or text[start:end] == "." and numerals:
            continue
        elif single[k] and single[k + 1] or tight and numerals < 2 and start not in ip_ends and end not in ip_ends:
            edits.append((start, end, ""))
        elif numerals < 2:
            edits.append((start, end, " "))
    return edits


def replacements(
    text: str, reading: tuple[int, int, int] = READINGS[0], plain: list[tuple[int, str, int]] = ()
) -> list[tuple[int, int, str]]:
    """What the transducer rewrites: (start, end, new text), in order and not overlapping."""
    edits: list[tuple[int, int, str]] = []
    ip_ends = {at for s, kind, e in plain if kind == "ip" for at in (s, e)}
    for run in RUN.finditer(text):
        if RUN_MARK.search(text, run.start(), run.end()):
            edits += run_edits(text, run, reading, ip_ends)
    if DISGUISED_MARK.search(text) or DISGUISED_DOT.search(text):
        for mail in MAIL.finditer(text):
            if not mail["host"]:
                continue
            parts = list(MAIL_PART.finditer(text, mail.start(), mail.end()))
            plain_at = any(p[0].strip().lower() == "at" for p in parts)
            hidden_dot = any("dot" in p[0].lower() or any(b in p[0] for b in "[({<") for p in parts)
            if parts and (not plain_at or hidden_dot):
                edits += [(p.start(), p.end(), "@" if "at" in p[0].lower() or "@" in p[0] else ".") for p in parts]
    for m in FOREIGN.finditer(text):
        c = m[0]
        new = "" if c in INVISIBLE else ALIKE.get(c) or unicodedata.normalize("NFKC", c)
        digit = unicodedata.decimal(c, None)
        edits.append((m.start(), m.end(), str(digit) if digit is not None else new))
    edits.sort()
    kept, last = [], 0
    for start, end, new in edits:
        if start >= last and end > start:
            kept.append((start, end, new))
            last = end
    return kept


def disguised(text: str, plain: list[tuple[int, str, int]] = ()) -> list[tuple[int, str, int]]:
    """Identifiers that show only in the rewritten text, as spans of the source: the widest of all readings."""
    edits = replacements(text, plain=plain)
    if not edits:
        return []
    found = set(_shown(text, edits))
    # Readings differ only in runs with words.
    if any(new in SPELLED_DIGITS for _, _, new in edits):
        seen = [edits]
        for reading in READINGS[1:]:
            edits = replacements(text, reading, plain)
            if edits not in seen:
                seen.append(edits)
                found.update(_shown(text, edits))
    kept: list[tuple[int, str, int]] = []
    for kind in KINDS:
        last = -1
        for s, _, e in sorted((f for f in found if f[1] == kind), key=lambda f: (f[0], -f[2])):
            if e > last:
                kept.append((s, kind, e))
                last = e
    return kept


def _shown(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, str, int]]:
    out, begin, finish, touched, at = [], [], [], [], 0
    for start, end, new in [*edits, (len(text), len(text), "")]:
        out.append(text[at:start])
        begin.extend(range(at, start))
        finish.extend(range(at + 1, start + 1))
        touched.extend([False] * (start - at))
        out.append(new)
        begin.extend([start] * len(new))
        finish.extend([end] * len(new))
        touched.extend([True] * len(new))
        at = end
    spans = [(begin[s], kind, finish[e - 1], s, e) for s, kind, e in identifiers("".join(out))]
    # A removed blank or mark leaves no character, so a span that grew also counts as touched.
    return [(s, kind, e) for s, kind, e, a, b in spans if any(touched[a:b]) or e - s != b - a]


def personal_data(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Plain and all spans (start, kind, end), ordered by start, then kind as in ``KINDS``."""
    if not text:
        return [], []
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(identifiers(text), key=order)
    known = {(kind, s, e) for s, kind, e in base}
    more = [
        (s, kind, e)
        for s, kind, e in set(disguised(text, base))
        if not any(k == kind and a <= s and e <= b for k, a, b in known)
    ]
    return base, sorted(base + more, key=order)


def redact(text: str | None, spans: list[tuple[int, str, int]]) -> str | None:
    """Each span, or overlapping spans as one, replaced by the name of its first kind in angle brackets."""
    if text is None:
        return None
    out, at, name = [], 0, None
    for start, kind, end in spans:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """doc_id, base and all spans of each row; with ``redacted`` also the text without them.

    Offsets count code points, ends are exclusive. NULL and empty texts have no spans and stay as they are;
    repeated rows are judged one by one; an empty table gives an empty result; other columns are not read.
    """
    def make():
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = batch.column(0), batch.column(1)
            base, every, clean = [], [], []
            for value in texts:
                text = value.as_py()
                plain, found = personal_data(text)
                base.append([{"kind": k, "start": s, "end": e} for s, k, e in plain])
                every.append([{"kind": k, "start": s, "end": e} for s, k, e in found])
                if redacted:
                    clean.append(redact(text, found))
            columns = [ids, pa.array(base, spans), pa.array(every, spans)]
            names = ["doc_id", "base", "spans"]
            if redacted:
                columns.append(pa.array(clean, pa.string()))
                names.append("redacted")
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, base {SPAN}, spans {SPAN}" + (", redacted string" if redacted else "")
    return map_rows(docs.select(id_col, text_col), make, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with personal data replaced by marks like <EMAIL>, and the length column brought up to date.

    All other columns and rows stay as they are.
    """
    at, size = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(batch.columns)
            clean, sizes = [], []
            old = columns[size] if size is not None else [None] * batch.num_rows
            for value, length in zip(columns[at], old):
                text = value.as_py()
                spans = personal_data(text)[1]
                clean.append(redact(text, spans) if spans else text)
                sizes.append(len(clean[-1]) if spans else length and length.as_py())
            columns[at] = pa.array(clean, columns[at].type)
            if size is not None:
                columns[size] = pa.array(sizes, columns[size].type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return work

    return map_rows(docs, make, docs.schema)
