"""Personal data: candidate spans scored by gradient-boosted trees.

High-recall generators propose spans, which may overlap: anything like an address, a dotted number,
a run of digits, a number of an identity card or bank account. A span that a strict rule confirms
(format, ranges, Luhn) is a base span and always stays. Whatever else comes back is chosen by boosted
trees. They see format (shape, and whether Luhn, mod 97, number ranges, country lengths, groupings and
address syntax hold) and context (what stands beside the span, and how near cue words of its own kind, of
other kinds and of other things are).

They learn from two sets. Planted proposals (``planted``, made by a fixed rule) are spans that the
base rules miss, and decoys, after cue words of their own kind, of another kind, of things that are no
personal data (orders, builds, parts), or after none. Where a shape can be either, the nearest cue word
decides the label, and without one a coin does; numbers that fail a check of their kind are never
personal data. All other proposals in a planted text are decoys. Of the table's proposals all are learnt
from whose label is certain: base spans are personal data, numbers that can't be of their kind are none, and
the rest have no label. Those of one label and description are one row with their number as its weight.
Where the table has more than ``table_weight`` of them, all their weights are halved until they add up to no
more, or the planted ones would count for nothing in a large table. A quarter of either set is held out: each
kind's threshold is the lowest score, of a half at least, at which, on held-out proposals that overlap no
base span, ``precision`` of what it lets through, by weight, is personal data. Proposals that overlap no base
span and reach their kind's threshold are added, best first, and no added span overlaps another.

The trees are Spark's. They get as many bins as it takes for Spark to read all rows, not a sample, when it
looks for places to split.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, needed, text_or_empty
from ledgerlens.sources.tables import table

KINDS = ("email", "ip", "card", "phone", "id", "bank")
BASE_KINDS = 4
TABLE_WEIGHT = 20_000
PRECISION = 0.9
TREES, DEPTH = 20, 5
PLANTED = 6000
TASK_ROWS, MIN_BINS = 100_000, 32

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# A match that starts within a run of digits would also start at the run's first digit: the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What the generators propose, by kind.
GENERATORS = (
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[](?:dot|DOT)[)\]]\x20?[A-Za-z0-9_%+-]{1,64}){0,8}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]+)+")),
    (1, re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")),
    (2, re.compile(r"(?<![0-9])[0-9]{3,6}(?:[\x20.-]?[0-9]{2,6}){2,4}(?![0-9])")),
    (3, re.compile(r"(?:(?<![0-9])|(?=[+(]))\+?\(?[0-9]{2,4}\)?(?:[\x20.-]{0,2}\(?[0-9]{2,5}\)?){2,4}(?![0-9])")),
    (4, re.compile(r"(?<![0-9-])[0-9]{3}([-\x20]?)[0-9]{2}\1[0-9]{4}(?![0-9-])")),
    (5, re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")),
)
# Characters of an IBAN by country.
IBAN_CHARS = {"NO": 15, "BE": 16, **dict.fromkeys(("DK", "FI", "FO", "GL", "NL", "SD"), 18), **dict.fromkeys(("MK", "SI"), 19), **dict.fromkeys(("AT", "BA", "EE", "KZ", "LT", "LU", "XK"), 20), **dict.fromkeys(("CH", "CR", "HR", "LI", "LV"), 21)}
IBAN_CHARS |= {**dict.fromkeys(("BG", "BH", "DE", "GB", "GE", "IE", "ME", "RS", "VA"), 22), **dict.fromkeys(("AE", "GI", "IL", "IQ", "TL"), 23), **dict.fromkeys(("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"), 24), "LY": 25, "PT": 25, "ST": 25}
IBAN_CHARS |= {**dict.fromkeys(("IS", "TR"), 26), **dict.fromkeys(("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"), 27), **dict.fromkeys(("AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "NI", "PL", "SV"), 28), **dict.fromkeys(("BR", "EG", "PS", "QA", "UA"), 29), "JO": 30, "KW": 30, "MU": 30, "MT": 31, "SC": 31, "LC": 32, "RU": 33}
# Cue words by kind; planted contexts take the first PLANTED_CUES of each, so the others are new to them.
CUES = {
    "email": ("mail", "email", "contact", "write", "address", "correo", "courriel", "inbox", "reply", "mailto"),
    "ip": ("ip", "host", "server", "client", "gateway", "subnet", "router", "login"),
    "card": ("card", "visa", "credit", "debit", "karte", "mastercard", "amex", "carte", "tarjeta", "kreditkarte"),
    "phone": ("tel", "phone", "call", "mobile", "telefon", "cell", "fax", "dial", "telephone", "ring", "sms", "whatsapp", "handy", "reach", "t\u00e9l\u00e9phone", "tel\u00e9fono", "anrufen"),
    "id": ("id", "ssn", "security", "identity", "taxpayer", "social", "tin", "itin", "citizen", "nif", "dni", "insurance"),
    "bank": ("iban", "account", "bank", "konto", "transfer", "compte", "cuenta", "wire", "sepa", "payee"),
    "other": ("order", "ref", "build", "ticket", "version", "part", "invoice", "serial", "item", "sku", "model", "batch", "lot", "tracking", "parcel", "case", "isbn", "article", "reference", "release", "bestellung", "commande", "pedido", "rev", "error", "page"),
}
PLANTED_CUES = 5
_KIND_OF_CUE = {w: kind for kind, words in CUES.items() for w in words}
_WORD = re.compile(r"[^\W\d_]+")
BEFORE_CHARS, AFTER_CHARS = 48, 24
CHECKS = ("whole", "luhn", "mod97", "country_chars", "identity", "address", "octets", "card_groups", "phone_groups", "national")
CONTEXT = ("before", "after", "line_start", "own_cue", "kind_cue", "other_cue", "cue_lead")
FEATURES = ("kind", "chars", "digits", "letters", "groups", "longest", "shortest", "spaces", "dashes", "dots", "brackets", "plus", "distinct", *CONTEXT, *CHECKS)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """A number of at most 255, with any zeros before it (int() refuses very long ones)."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the confirmed spans, in order. Leftmost matches of a kind that don't
    overlap; those that fail a check are dropped and not tried again."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(_octet(p) for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _iban_end(text: str, start: int, end: int) -> int:
    """Where the country's IBAN ends, if the match goes on behind it (words in capitals)."""
    left = IBAN_CHARS.get(text[start : start + 2].upper(), 0)
    for at in range(start, end):
        left -= text[at] != " "
        if left == 0:
            return at + 1 if not text[at + 1 : at + 2].isalnum() else end
    return end


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _country_chars(s: str) -> bool:
    """The country's number of characters; of countries not listed, any in capitals."""
    s = s.replace(" ", "")
    return IBAN_CHARS.get(s[:2].upper(), len(s) if s[:2].isupper() else 0) == len(s)


def _identity(s: str) -> bool:
    """Area, group and serial of a social security number, or the ranges of a taxpayer number."""
    digits = re.sub(r"[^0-9]", "", s)
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    taxpayer = area >= 900 and (50 <= group <= 65 or 70 <= group <= 88 or 90 <= group <= 92 or 94 <= group <= 99)
    return taxpayer or (0 < area < 900 and area != 666 and group > 0 and serial > 0)


def _address(s: str) -> bool:
    plain = re.sub(r"\x20?[(\[](?:dot|DOT)[)\]]\x20?", ".", re.sub(r"\x20?[(\[](?:at|AT)[)\]]\x20?", "@", s))
    return re.fullmatch(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", plain) is not None


def _whole(text: str, start: int, end: int) -> bool:
    """Not a part of a longer number."""
    return not (re.search(r"[0-9A-Za-z][.-]?$|[0-9]\x20$", text[max(0, start - 2) : start]) or re.match(r"[A-Za-z0-9]|[\x20.-][0-9]", text[end : end + 2]))


def _phone_groups(runs: list[str]) -> bool:
    digits, sizes = "".join(runs), [len(r) for r in runs]
    return (sizes == [3, 3, 4] and digits[0] > "1" and digits[3] > "1") or (digits.startswith("00") and len(runs) > 2 and 12 <= len(digits) <= 17)


def checks(text: str, kind: int, start: int, end: int) -> list[bool]:
    """Which checks of its kind hold of a proposal, by CHECKS."""
    s = text[start:end]
    runs = re.findall(r"[0-9]+", s)
    sizes = [len(r) for r in runs]
    return [
        _whole(text, start, end),
        kind == 2 and _luhn("".join(runs)),
        kind == 5 and _mod97(s),
        kind == 5 and _country_chars(s),
        kind == 4 and _identity(s),
        kind == 0 and _address(s),
        kind == 1 and all(map(_octet, runs)),
        sizes in ([4, 4, 4, 4], [4, 4, 4, 4, 3], [4, 6, 4], [4, 6, 5]),
        kind == 3 and _phone_groups(runs),
        kind == 3 and len(runs) > 1 and s[s[:1] == "("] == "0" and runs[0][1] != "0" and 9 <= sum(sizes) <= 11,
    ]


def possible(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a proposal holds the checks that all personal data of its kind holds."""
    held = dict(zip(CHECKS, checks(text, kind, start, end), strict=True))
    of_kind = (("address",), ("whole", "octets"), ("whole", "luhn"), ("whole",), ("identity",), ("mod97", "country_chars"))
    return all(held[c] for c in of_kind[kind]) and (kind != 3 or 7 <= sum("0" <= c <= "9" for c in text[start:end]) <= 15)


def cues(text: str, kind: int, start: int, end: int) -> tuple[float, float, float, float]:
    """How near the nearest cue word of the proposal's kind stands, of another kind, and of other things:
    1 for the next word, 1/2 for the one beyond, 0 for none; and by how much the own kind leads. A cue
    behind the proposal counts half."""
    near = dict.fromkeys(CUES, 0.0)
    around = (reversed(_WORD.findall(text[max(0, start - BEFORE_CHARS) : start].lower())), 1.0), (_WORD.findall(text[end : end + AFTER_CHARS].lower()), 0.5)
    for words, weight in around:
        for i, w in enumerate(words):
            if (of := _KIND_OF_CUE.get(w)) is not None:
                near[of] = max(near[of], weight / (1 + i))
    own, other = near.pop(KINDS[kind]), near.pop("other")
    foreign = max(near.values())
    return own, foreign, other, own - max(foreign, other)


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def described(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a proposal, by FEATURES."""
    s = text[start:end]
    runs = re.findall(r"[0-9]+", s) or [""]
    line = text[max(0, start - BEFORE_CHARS) : start].rpartition("\n")[2]
    return [float(x) for x in (
        kind, len(s), sum(map(len, runs)), sum(c.isalpha() for c in s), len(runs), max(map(len, runs)), min(map(len, runs)),
        s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count("["), s.startswith("+"), len(set(s)),
        _side(text[start - 1 : start]), _side(text[end : end + 1]), line.strip() == "", *cues(text, kind, start, end), *checks(text, kind, start, end),
    )]


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Distinct proposals (start, kind, end): the generators' and the base spans."""
    found = set(base)
    if _DIGIT.search(text):
        for kind, pattern in GENERATORS[1:5]:
            # a card has 12 digits at least
            found.update((m.start(), kind, m.end()) for m in pattern.finditer(text) if kind != 2 or sum("0" <= c <= "9" for c in m[0]) >= 12)
        at = 0
        while m := GENERATORS[5][1].search(text, at):  # on behind the account number, not behind the words after it
            at = _iban_end(text, *m.span())
            if text[m.start() : m.start() + 2].isupper() or text[m.start() : m.start() + 2].upper() in IBAN_CHARS:
                found.add((m.start(), 5, at))
    if any(x in text for x in ("at)", "at]", "AT)", "AT]")):
        found.update((m.start(), 0, m.end()) for m in GENERATORS[0][1].finditer(text))
    return sorted(found)


def _example(r: random.Random, kind: int, good: bool, weak: bool) -> str:
    """A span of a kind that can be personal data and is no base span, or a decoy that can't be. Of phones
    and ids a weak shape is one that other numbers have as often."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    if kind == 0:
        at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "."), (" (at) ", "."), ("(at)", "(dot)"), (" [AT] ", " [DOT] "), ("[at]", "[dot]")])
        name = f"{letters(r.randint(2, 8))}{r.choice(['', '.', '_'])}{letters(r.randint(1, 8))}{r.choice(['', digits(2)])}"
        if good:
            return f"{name}{at}{letters(r.randint(3, 9))}{dot}{r.choice(['com', 'org', 'example.com' if dot == '.' else 'net', 'de'])}"
        return r.choice([f"{letters(5)}{at}{letters(4)}{dot}{digits(r.randint(1, 2))}", f"{letters(4)}{at}{digits(2)}{dot}{digits(3)}"])
    if kind == 1:
        return f"{r.randint(256, 999)}.{r.randint(0, 999)}.{digits(1)}.{digits(2)}"
    if kind == 2:
        sizes, sign = (r.choice([[4, 4, 4, 4], [4, 6, 5]]), ".") if good else (r.choice([[4, 4, 4, 4], [4, 6, 5], [16], [15], [5, 5, 5], [14]]), r.choice([".", " ", "-"]))
        body = "4" + digits(sum(sizes) - 2)
        last = next(c for c in "0123456789" if _luhn(body + c))
        number = body + (last if good else r.choice([c for c in "0123456789" if c != last]))
        cuts = list(accumulate(sizes, initial=0))
        return sign.join(number[i:j] for i, j in zip(cuts, cuts[1:], strict=False))
    if kind == 3:
        high = lambda: f"{r.randint(2, 9)}{digits(2)}"
        if good and weak:
            area = f"0{r.randint(1, 9)}"
            return r.choice([*[f"{high()}{c}{high()}{c}{digits(4)}" for c in "-. "], f"{area}{digits(1)} {digits(4)} {digits(4)}", f"{area}{digits(2)} {digits(3)} {digits(4)}", f"{area} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"{area}{digits(1)}-{digits(7)}"])
        if good:
            return r.choice([f"({high()}) {high()}-{digits(4)}", f"({high()}) {high()} {digits(4)}", f"00{r.randint(20, 99)} {digits(3)} {digits(3)} {digits(4)}"])
        return r.choice([f"20{digits(2)}-{digits(2)}-{digits(2)} {digits(2)}", f"{digits(3)}-1{digits(2)}-{digits(4)}", f"{digits(5)} {digits(5)} {digits(3)}", f"{digits(4)} {digits(4)}", f"{digits(3)}.{digits(2)}.{digits(3)}", f"{digits(12)}", f"{digits(4)}-{digits(4)}-{digits(4)}"])
    if kind == 4:
        sign = r.choice(["", " ", " "]) if weak else "-"
        if good:
            parts = r.choice([(f"{r.choice([r.randint(1, 665), r.randint(667, 899)]):03d}", f"{r.randint(1, 99):02d}", f"{r.randint(1, 9999):04d}"), (f"{r.randint(900, 999)}", f"{r.randint(70, 88)}", digits(4))])
        else:
            parts = r.choice([("000", digits(2), digits(4)), ("666", digits(2), digits(4)), (f"{r.randint(900, 999)}", f"{r.randint(1, 49):02d}", digits(4)), (f"{r.randint(1, 665):03d}", "00", digits(4)), (f"{r.randint(1, 665):03d}", f"{r.randint(1, 99):02d}", "0000")])
        return sign.join(parts)
    land = r.choice(sorted(IBAN_CHARS))
    body = "".join(r.choice("0123456789" if r.random() < 0.8 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(IBAN_CHARS[land] - 4))
    sums = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    number = f"{land}{sums if good else (sums + r.randint(1, 90)) % 97 + 2:02d}{body}"
    if not good and _mod97(number):
        number = number[:2] + f"{(sums + 1) % 97 + 2:02d}" + body
    number = number.lower() if r.random() < 0.3 else number
    return " ".join(number[i : i + 4] for i in range(0, len(number), 4)) if r.random() < 0.5 else number


def planted(n: int = PLANTED, seed: int = 11) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, label) of n proposals that overlap no base span (no addresses of hosts: the
    base rules find all of these). A third can't be of their kind and have label 0. For the others the
    nearest cue word counts. Accounts and mail addresses are personal data whatever it is; cards and the
    strong shapes of phones and ids unless it speaks of other things; weak shapes only if it is one of their
    own kind, and without a cue every other one."""
    r, out = random.Random(seed), []
    letters = "abcdefghijklmnoprstuvwyz\u00e9\u00fc\u00f1"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    words = lambda most: [w for w in (word() for _ in range(r.randint(0, most))) if w not in _KIND_OF_CUE]
    cue = lambda kind: r.choice(CUES[kind][:PLANTED_CUES] if kind != "other" else CUES[kind][: 2 * PLANTED_CUES])
    while len(out) < n:
        kind, good, weak = r.randrange(len(KINDS)), r.random() < 0.67, r.random() < 0.6
        if kind == 1 and good:
            continue
        nearest = r.choice([KINDS[kind], KINDS[kind], "other", "other", r.choice([k for k in KINDS if k != KINDS[kind]]), None, None])
        further = r.choice([*CUES, None, None, None]) if nearest else None
        behind = nearest is not None and r.random() < 0.15
        before = words(3) + ([cue(further)] + words(2) + [word()] if further and not behind else [])
        before += [] if behind or nearest is None else [cue(nearest), *r.choice([[], [], ["is"], ["no"], ["me", "at"], ["number"]])]
        after = [cue(nearest)] if behind else []
        lead = r.choice([" ", " ", " ", "\n", ", ", "; "]).join([" ".join(before[:-1]), before[-1]]) if len(before) > 1 else " ".join(before)
        lead += r.choice([" ", " ", ": ", " #"] if lead else [""])
        span = _example(r, kind, good, weak)
        text = f"{lead}{span}{r.choice([' ', ' ', ', ', '. ', ' (', chr(10)])}{' '.join([*after, *words(3)])}"
        sure = kind in (0, 5) or (nearest != "other" and (kind == 2 or not weak))
        own = nearest == KINDS[kind]
        label = good and (sure or own or (nearest is None and r.random() < 0.5))
        place, base = (len(lead), kind, len(lead) + len(span)), base_spans(text)
        if place in proposals(text, base) and not any(s < place[2] and place[0] < e for s, _, e in base):
            out.append((text, kind, place[0], place[2], int(label)))
    return out


SPAN = "struct<start:int,kind:int,end:int>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("free", pa.bool_()), ("label", pa.float64()), ("x", pa.list_(pa.float64()))])


def scanned_text(text: str) -> tuple[list[dict], list[dict]]:
    """The base spans of a text, and its proposals with label and features."""
    base = base_spans(text)
    known, starts = set(base), [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    out = []
    for s, k, e in proposals(text, base):
        before = bisect_left(starts, e)
        free = not (before and reach[before - 1] > s)
        out.append({"start": s, "kind": k, "end": e, "free": free, "label": 1.0 if (s, k, e) in known else None if possible(text, k, s, e) or not free else 0.0, "x": described(text, k, s, e)})
    return [{"start": s, "kind": k, "end": e} for s, k, e in base], out


def _scan(docs: DataFrame, keep_text: bool) -> DataFrame:
    """Rows keep their id, whatever its type and value, and their text where it is asked for."""
    texts = needed(docs, "doc_id", "text").select("doc_id", text_or_empty(F.col("text")).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [scanned_text(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), pa.array([b for b, _ in both], pa.list_(_SPAN)), pa.array([f for _, f in both], pa.list_(_FOUND))]
            names = ["doc_id", "base", "found"]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("text")], names=[*names, "text"]) if keep_text else pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, base array<{SPAN}>, found array<struct<start:int,kind:int,end:int,free:boolean,label:double,x:array<double>>>"
    return texts.mapInArrow(scan, schema + (", text string" if keep_text else ""))


def _rows(scanned: DataFrame) -> DataFrame:
    one = scanned.select("rid", F.explode("found").alias("f"))
    return one.select("rid", "f.start", "f.kind", "f.end", "f.label", "f.free", F.xxhash64("rid", "f.start", "f.kind", "f.end").alias("place"), "f.x")


def _examples(spark: SparkSession, n: int) -> DataFrame:
    """Planted proposals and the others of their texts, which are decoys; every fourth text is held out."""
    made = []
    for i, (text, kind, start, end, label) in enumerate(planted(n)):
        places = {(s, k, e): 0 for s, k, e in proposals(text, base_spans(text)) if s < end and start < e} | {(start, kind, end): label}
        made += [(float(is_personal), k, i % 4 == 0, described(text, k, s, e)) for (s, k, e), is_personal in places.items()]
    return spark.createDataFrame(made, "label double, kind int, held boolean, x array<double>")


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector("x"))


def _weighed(rows: DataFrame, table_weight: int) -> DataFrame:
    """The proposals of the table with a certain label, all of them, as distinct (label, kind, held, free, x)
    with their weight. Powers of two keep sums of weights exact in any order."""
    sure = rows.where("label is not null").select("label", "kind", (F.pmod("place", F.lit(4)) == 0).alias("held"), "free", "x")
    counted = materialize(sure.groupBy(*sure.columns).agg(F.count("*").cast("double").alias("weight")), "pii-counted")
    total, share = counted.agg(F.sum("weight")).first()[0] or 0.0, 1.0
    while total * share > table_weight:
        share /= 2
    return counted.withColumn("weight", F.col("weight") * share)


def learnt(rows: DataFrame, table_weight: int = TABLE_WEIGHT, n_planted: int = PLANTED) -> tuple[GBTClassificationModel, DataFrame]:
    """The trees, and the held-out proposals (kind, label, weight, x) that overlap no base span."""
    spark = rows.sparkSession
    made = _examples(spark, n_planted).withColumn("free", F.lit(True)).withColumn("weight", F.lit(1.0))
    sample = _weighed(rows, table_weight).unionByName(made)
    by = [c for c in sample.columns if c != "weight"]
    sample = materialize(sample.groupBy(*by).agg(F.sum("weight").alias("weight")), "pii-learnt")
    train = sample.where("not held").select("label", "kind", "x", "weight")
    n = train.count()
    # a fixed order, so that reruns add up the same
    train = train.repartition(1 + n // TASK_ROWS, "x").sortWithinPartitions("kind", "x", "label")
    # Spark takes a sample to find splits where there are more rows than 10,000 and the square of the bins
    bins = max(MIN_BINS, isqrt(n) + 1 if n > 10_000 else 0)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3, weightCol="weight", maxBins=bins).fit(_vectors(train))
    return model, sample.where("held and free").select("kind", "label", "weight", "x")


def _scored(rows: DataFrame, table_weight: int, n_planted: int) -> DataFrame:
    """Proposals to choose from (free ones, rid not null) and held-out ones (rid null), with scores."""
    model, held = learnt(rows, table_weight, n_planted)
    held = held.select(F.lit(None).cast("long").alias("rid"), F.lit(0).alias("start"), "kind", F.lit(0).alias("end"), "label", F.lit(True).alias("calibrates"), "weight", "x")
    free = rows.where("free").select("rid", "start", "kind", "end", "label", F.lit(False).alias("calibrates"), F.lit(1.0).alias("weight"), "x")
    scored = model.transform(_vectors(free.unionByName(held))).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return materialize(scored.select("rid", "start", "kind", "end", "label", "calibrates", "weight", "score"), "pii-scored")


def thresholds(scored: DataFrame, precision: float = PRECISION) -> dict[int, float]:
    """Each kind's lowest hundredth, of a half at least, at which precision holds from there up, of all
    held-out proposals by weight; kinds without one are absent. Sums per kind and hundredth reach the driver."""
    cells = scored.where("calibrates and score >= 0.5").groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("cell")).agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good")).collect()
    out = {}
    for kind in {c["kind"] for c in cells}:
        n = good = 0
        for c in sorted((c for c in cells if c["kind"] == kind), key=lambda c: -c["cell"]):
            n, good = n + c["n"], good + c["good"]
            if good < precision * n:
                break
            out[kind] = c["cell"] / 100
    return out


def chosen(found: list) -> list[tuple[int, int, int]]:
    """Of proposals (score, start, kind, end) the best that overlap none chosen before: by score, then
    longest, then place."""
    starts, ends, out = [], {}, []
    for score, start, kind, end in sorted(found, key=lambda p: (-p[0], p[1] - p[3], p[1], p[2])):
        at = bisect_left(starts, end)
        if at and ends[starts[at - 1]] > start:
            continue
        insort(starts, start)
        ends[start] = end
        out.append((start, kind, end))
    return out


def pii_spans(docs: DataFrame, table_weight: int = TABLE_WEIGHT, precision: float = PRECISION, n_planted: int = PLANTED, keep_text: bool = False) -> DataFrame:
    """One row per document: rid, doc_id, base and spans, arrays of (start, kind, end) in order; and the
    text, if asked for."""
    scanned = materialize(_scan(docs, keep_text).withColumn("rid", F.monotonically_increasing_id()), "pii-scan")
    scored = _scored(_rows(scanned), table_weight, n_planted)
    over = F.lit(False)
    for kind, bar in sorted(thresholds(scored, precision).items()):
        over = over | ((F.col("kind") == kind) & (F.col("score") >= bar))
    choose = F.udf(lambda found: chosen(found), f"array<{SPAN}>")
    added = scored.where(F.col("rid").isNotNull() & over).groupBy("rid").agg(F.collect_list(F.struct("score", "start", "kind", "end")).alias("found")).select("rid", choose("found").alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return scanned.drop("found").join(materialize(added, "pii-added"), "rid", "left").withColumn("spans", spans).drop("added")


def pii(docs: DataFrame, table_weight: int = TABLE_WEIGHT, precision: float = PRECISION) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans. Null and repeated ids come back as they are, a row for each
    input row; an empty table gives no rows; further columns are ignored. Which spans are added
    depends on what the trees learn, so on the table too; base spans don't."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def digest(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    def count(no: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == no)).cast("long")

    return pii_spans(docs, table_weight, precision).select(
        "doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(BASE_KINDS)], F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans")
    )


def redacted(docs: DataFrame, table_weight: int = TABLE_WEIGHT, precision: float = PRECISION) -> DataFrame:
    """doc_id and text with each span replaced by its kind in brackets, one row per input row: a row's
    own spans, whatever its id. Of spans that overlap, the first is replaced and the rest of the others
    goes with it."""
    found = pii_spans(docs, table_weight, precision, keep_text=True)

    def clean(text: str, spans: list) -> str:
        out, at = [], 0
        for start, kind, end in spans:
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind]}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    return found.select("doc_id", F.when(F.size("spans") > 0, F.udf(lambda text, spans: clean(text, spans), "string")("text", "spans")).otherwise(F.col("text")).alias("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))
