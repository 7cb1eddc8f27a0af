"""Personal data: exact detectors, and the same detectors behind offset-preserving transducers.

A transducer rewrites a text as characters that each keep the source span they stand for. The
chain folds look-alike letters and digits, spelled-out digits and disguised at and dot signs. What the
detectors find in its output is mapped back to the source; a find that holds no rewritten character
is left to the plain pass, which sees the source itself.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import map_lists

Span = tuple[str, int, int]
#: The kinds, in the order in which spans at the same place are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Found from their at signs: what stands before one is the longest run of local characters."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail its test are dropped."""
    out = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Letters of other scripts that look like ASCII ones, and signs that look like at, dot, plus and hyphen.
LOOK_ALIKES = dict(zip(
    "АВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοιν",
    "ABEKMHOPCTYXIJSaeopcyxijshdqwABEZHIKMNOPTYXaoiv", strict=True,
)) | dict.fromkeys("﹫＠", "@") | dict.fromkeys("。․．｡", ".") | dict.fromkeys("‐‑‒–−－", "-") | dict.fromkeys("＋﹢", "+")
#: Characters of no width, which a rewritten text leaves out.
NO_WIDTH = frozenset("­​‌‍⁠﻿")
#: Digits as English spells them.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
DIGIT_RUN = re.compile(rf"(?<![^\W_])(?:{DIGIT_WORD}|[0-9]+)(?:[\x20,-]{{1,3}}(?:{DIGIT_WORD}|[0-9]+))*(?![^\W_])", re.I)
#: Runs with dots and brackets between them, as in addresses and phone numbers.
STRETCH = re.compile(rf"(?<![^\W_])(?:{DIGIT_WORD}|[0-9]+)(?:[\x20,().-]+(?:{DIGIT_WORD}|[0-9]+))+(?![^\W_])", re.I)
DIGIT_HINT = re.compile(rf"(?<![^\W_])(?:{DIGIT_WORD}[\x20,().-]+(?:{DIGIT_WORD}|[0-9])|[0-9]+[\x20,().-]+{DIGIT_WORD})", re.I)
UNIT = re.compile(rf"{DIGIT_WORD}|[0-9]+", re.I)
PLUS = re.compile(r"(?<![^\W_])plus[\x20-]$", re.I)
#: A disguised or plain at sign, before it a name, after it labels with disguised or plain dots between them.
AT = re.compile(r"[\x20]?[\(\[\{<][\x20]?(?:at|@)[\x20]?[\)\]\}>][\x20]?|[\x20](?:at|@)[\x20]|@", re.I)
DOT = r"(?:[\x20]?[\(\[\{<][\x20]?(?:dot|\.)[\x20]?[\)\]\}>][\x20]?|[\x20](?:dot)[\x20]|\.)"
HIDDEN_DOT = re.compile(r"[\x20]?[\(\[\{<][\x20]?(?:dot|\.)[\x20]?[\)\]\}>][\x20]?|[\x20](?:dot)[\x20]", re.I)
#: Four numbers, of figures or spelled digits, with dots between them of which some are disguised.
PART = rf"(?:{DIGIT_WORD}|[0-9]{{1,3}})(?:[\x20-]?(?:{DIGIT_WORD}|[0-9])){{0,3}}"
DOTTED = re.compile(rf"(?<![^\W_.]){PART}(?:{DOT}{PART}){{3}}(?![^\W_])", re.I)
#: A dot that stands alone counts in an address that has an at sign.
APART = re.compile(r"[\x20]\.[\x20]")
#: Top-level names that a label must be where signs are bare words or stand alone, besides names of two letters; and words of two letters that prose has there.
TOP = frozenset("com net org edu gov mil int info biz name io ai dev app".split())
SHORT_WORDS = frozenset("am an as at be by do go he if in is it me my no of oh on or so to up us we".split())
LABEL = r"[A-Za-z0-9-]+"
ANY_DOT = rf"(?:{DOT}|[\x20]\.[\x20])"
LABELS = re.compile(rf"{LABEL}(?:{ANY_DOT}{LABEL})+", re.I)
ADDRESS_HINT = re.compile(r"[\(\[\{<][\x20]?(?:at|@|dot|\.)[\x20]?[\)\]\}>]|[\x20](?:dot|@)[\x20]", re.I)
DOTS = re.compile(ANY_DOT, re.I)
STRANGE = re.compile("[" + re.escape("".join(LOOK_ALIKES) + "".join(sorted(NO_WIDTH))) + "²³¹⁰-ₜ①-⓿！-～\U0001d400-\U0001d7ff]|(?![0-9])\\d")


class Tape:
    """A rewritten text and its pieces: stretches of the source as they are, and rewritten ones, each with its source span.

    Memory grows with the rewrites, not with the characters.
    """

    def __init__(self, text: str):
        self.text = text
        self.pieces = [(0, len(text), 0, len(text), False)]  # place in the text, source span, whether rewritten
        self.at = [0]

    def holding(self, a: int, b: int) -> list[tuple[int, int, int, int, bool]]:
        """The pieces that hold the characters from a to b."""
        return self.pieces[bisect_right(self.at, a) - 1 : bisect_right(self.at, b - 1)] if a < b else []

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span that the characters from a to b stand for."""
        own = self.holding(a, b)
        (lo, _, start, _, new), (last, _, begin, end, rewritten) = own[0], own[-1]
        return start if new else start + a - lo, end if rewritten else begin + b - last

    def rewritten(self, a: int, b: int) -> bool:
        return any(p[4] for p in self.holding(a, b))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts a string for each (from, to) of this tape; edits are in order and don't overlap. What stands before something left out counts as rewritten."""
        text, pieces, done = [], [], 0

        def put(s: str, start: int, end: int, new: bool) -> None:
            at = pieces[-1][1] if pieces else 0
            text.append(s)
            pieces.append((at, at + len(s), start, end, new))

        def copy(a: int, b: int) -> None:
            for lo, hi, start, end, new in self.holding(a, b):
                x, y = max(a, lo), min(b, hi)
                put(self.text[x:y], *((start, end) if new else (start + x - lo, start + y - lo)), new)

        for a, b, s in edits:
            copy(done, a)
            if s:
                put(s, *self.source(a, b), True)
            elif pieces and not pieces[-1][4]:
                lo, hi, start, end, _ = pieces.pop()
                pieces += [(lo, hi - 1, start, end - 1, False)] * (hi - lo > 1) + [(hi - 1, hi, end - 1, end, True)]
            done = b
        copy(done, len(self.text))
        self.text, self.pieces, self.at = "".join(text), pieces, [p[0] for p in pieces]


def fold_look_alikes(tape: Tape) -> None:
    edits = []
    for m in STRANGE.finditer(tape.text):
        c = m[0]
        if c in NO_WIDTH:
            edits.append((*m.span(), ""))
        else:
            to = LOOK_ALIKES.get(c) or unicodedata.normalize("NFKC", c)
            if c.isdecimal():
                to = str(unicodedata.decimal(c))
            if to.isascii() and len(to) == 1:
                edits.append((*m.span(), to))
    if edits:
        tape.replace(edits)


def spelled_stretches(text: str) -> list[re.Match]:
    """Stretches that hold a spelled digit and the digits that some detector asks for: ten, or four parts with dots, or are spelled four times."""
    out = []
    for m in STRETCH.finditer(text):
        units = UNIT.findall(m[0])
        spelled = sum(u.lower() in SPELLED for u in units)
        digits = sum(1 if u.lower() in SPELLED else len(u) for u in units)
        if spelled and (spelled >= 4 or digits >= 10 or m[0].count(".") >= 3):
            out.append(m)
    return out


def fold_spelled_digits(tape: Tape) -> None:
    """Runs of spelled digits, with digits among them, become one number; a `plus` before them its sign.

    Whether that is an identifier is for detect() to say. A run with few spelled digits that touches
    what the text shows as it is stays, as the words beside a plain number are prose.
    """
    edits = []
    plain = None
    for s in spelled_stretches(tape.text):
        for m in DIGIT_RUN.finditer(tape.text, s.start(), s.end()):
            units = list(UNIT.finditer(m[0]))
            spelled = sum(u[0].lower() in SPELLED for u in units)
            if not spelled:
                continue
            if spelled < 4:
                plain = detect(tape.text) if plain is None else plain
                if any(a < m.end() and m.start() < b for _, a, b in plain):
                    continue
            plus = PLUS.search(tape.text, max(0, m.start() - 6), m.start())
            digits = "".join(SPELLED.get(u[0].lower(), u[0]) for u in units)
            edits.append((plus.start() if plus else m.start(), m.end(), "+" * bool(plus) + digits))
    if edits:
        tape.replace(edits)


def name_before(text: str, end: int, least: int, dots: dict[int, int]) -> int:
    """Where the name that ends at `end` begins: runs of local characters with disguised dots between them."""
    at = start = end
    while True:
        while at > least and text[at - 1] in LOCAL:
            at -= 1
        if at == start:
            return end if start == end else before
        before = at
        if (at := dots.get(at, -1)) < least:
            return before
        start = at


def fold_dotted_numbers(tape: Tape) -> None:
    """Disguised dots between four numbers; detect() says whether that is an address."""
    edits = [(m.start() + d.start(), m.start() + d.end(), ".") for m in DOTTED.finditer(tape.text) for d in HIDDEN_DOT.finditer(m[0])]
    if edits:
        tape.replace(edits)


def named_end(labels: str, strict: bool) -> list[re.Match] | None:
    """The dots of the longest start of labels that ends in what may be a top-level name: two letters or more, and, if strict, a known one."""
    dots = list(DOTS.finditer(labels))
    for k in range(len(dots), 0, -1):
        last = labels[dots[k - 1].end() : dots[k].start() if k < len(dots) else len(labels)].lower()
        bare = strict or any(APART.fullmatch(d[0]) or d[0].strip().isalpha() for d in dots[:k])
        if len(last) >= 2 and last.isalpha() and (not bare or last in TOP or len(last) == 2 and last not in SHORT_WORDS):
            return dots[:k]
    return None


def fold_addresses(tape: Tape) -> None:
    """Disguised at and dot signs, found from the at signs.

    A bare word `at` counts only with a disguised dot after it, as prose has `at example.com`. Prices and times
    after an at sign end in no name; where signs are words or stand alone, as prose has them too, the name must be a known one.
    """
    text, edits, done = tape.text, [], 0
    dots = {m.end(): m.start() for m in HIDDEN_DOT.finditer(text)}
    for m in AT.finditer(text):
        if m.start() < done or (start := name_before(text, m.start(), done, dots)) == m.start() or start and text[start - 1] in LOCAL or not (domain := LABELS.match(text, m.end())):
            continue
        after = named_end(domain[0], strict=m[0].strip() in ("at", "AT", "At", "aT") or m[0] == " @ ")
        if after is None or m[0].strip().isalpha() and all(d[0] == "." for d in after):
            continue
        found = [(start + d.start(), start + d.end(), ".") for d in HIDDEN_DOT.finditer(text[start : m.start()])] + [(*m.span(), "@")] + [(m.end() + d.start(), m.end() + d.end(), ".") for d in after]
        edits += [e for e in found if text[e[0] : e[1]] != e[2]]
        done = m.end() + after[-1].end()
    if edits:
        tape.replace(edits)


def disguised(text: str) -> list[Span]:
    """Source spans of identifiers that only the rewritten text shows."""
    lower = text.lower()
    strange = not text.isascii() and STRANGE.search(text)
    spelled = any(w in lower for w in SPELLED) and DIGIT_HINT.search(text) and spelled_stretches(text)
    address = ("dot" in lower or any(c in text for c in "@([{<")) and ADDRESS_HINT.search(text)  # the hint implies what stands before it
    if not (strange or spelled or address):
        return []
    tape = Tape(text)
    if strange:
        fold_look_alikes(tape)
    if address or strange:
        fold_dotted_numbers(tape)
    if spelled or strange or address:
        fold_spelled_digits(tape)
    if address or strange:
        fold_addresses(tape)
    return [(kind, *tape.source(a, b)) for kind, a, b in detect(tape.text) if tape.rewritten(a, b)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and those that the transducers add."""
    base = detect(text)
    extra = [s for s in disguised(text) if s not in base]
    return base, sorted({*base, *extra}, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if extra else base


def redact(text: str, spans: list[Span]) -> str:
    """The text with <KIND> for each span; of spans that overlap, one mark that takes the first one's kind."""
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def find_pii(df: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, counts of base spans, base_sha256, spans[, redacted]) a row of df.

    Null and empty texts have no spans. One narrow pass over whole texts, without a shuffle; repeated
    rows and null ids each give their row.
    """

    def batch(ids: list, texts: list) -> tuple:
        out: list[list] = [[] for _ in range(8)]
        for i, t in zip(ids, texts):
            base, every = spans_of(t or "")
            kinds = [k for k, _, _ in base]
            row = (i, *(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), redact(t, every) if with_text and t is not None else None)
            for col, v in zip(out, row):
                col.append(v)
        return tuple(out[: 8 if with_text else 7])

    kind = df.select(F.col(id_col)).dtypes[0][1]
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * with_text
    return map_lists(df.select(id_col, text), batch, schema)


def redacted(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with personal data in its text replaced by marks, and its length where that changed. Null texts stay null."""
    names = docs.columns
    at, length = names.index(text), names.index(size)

    def batch(*cols: list) -> tuple:
        out = list(cols)
        out[at] = [t if t is None or not (s := spans_of(t)[1]) else redact(t, s) for t in cols[at]]
        out[length] = [n if old == new else len(new) for n, old, new in zip(cols[length], cols[at], out[at])]
        return tuple(out)

    return map_lists(docs, batch, ", ".join(f"`{n}` {kind}" for n, kind in docs.dtypes))
