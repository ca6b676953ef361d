"""Redaction of personal data and secrets by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: anything like an e-mail address, an IP address, a telephone number, a
payment card, a bank account, a social security number or a secret key. Of digits next to each other, every run of whole groups that
has a kind's shape is proposed, so that a number is found beside a date or another number; of NAME=key, the key too. Boosted trees judge each by features of its format (digits,
check sums, octets, separators, entropy) and of its context (the characters on either side, words before it). They are fitted on
made-up examples, true ones and look-alikes (numbers of orders, versions, dates, failed check sums, hashes), as no labelled text
exists; a held-out half calibrates the probabilities and gives each kind the lowest threshold at which its precision is ``PRECISION``.
Of the spans that pass, overlapping ones are settled in favour of the more probable, then longer, then earlier. Each is replaced by
its kind in square brackets.

Whole texts are searched: every generator needs a digit, an @, three colons close together or a run of 16 bytes that a key may hold, so
only the words around those are looked at, of whatever length; the tests hold that against a search of everything. Whole candidates are
judged. The windows of a batch are searched and judged together, in arrays.

Defined results: a null text stays null and has no spans; empty texts, texts without spans and rows without doc_id are left as they
are; repeated rows are treated alike; an empty table gives none. ``redact`` keeps all columns and changes ``text`` and, if it is
there, ``n_chars``; ``redactions`` ignores other columns. Starts and ends count characters of the original text. Very long texts, and
texts dense with numbers, take time in proportion to their length (a number of four groups has some twenty candidates); of spans
that tie in probability the longer one stays, then the earlier, then the kind first in ``KINDS``.
"""

from __future__ import annotations

import bisect
import dataclasses
import functools
import random as rnd
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import boosting
from graphloom.llm.textkit import chunks, lowered

PRECISION = 0.99
LEAST = 0.2
KINDS = ["EMAIL", "IP", "PHONE", "CARD", "BANK", "SSN", "SECRET"]
EMAIL, IP, PHONE, CARD, BANK, SSN, SECRET = range(len(KINDS))
#: Every pattern takes time in proportion to the text: none looks ahead further than a span's greatest length from more than one place in a run.
GENERATORS = [
    (IP, re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")),
    (IP, re.compile(r"(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}")),
    (IP, re.compile(r"(?<![^\W_])(?=((?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4})(?![^\W_]))")),
    *[(BANK, re.compile(rf"(?=([A-Za-z]{{2}}[0-9]{{2}}(?: ?[A-Za-z0-9]{{4}}){{{n}}}{tail})(?![A-Za-z0-9]))")) for n in range(2, 8) for tail in ("", " ?[A-Za-z0-9]{1,3}")],
    (SSN, re.compile(r"(?<![0-9])(?=([0-9]{3}[- ][0-9]{2}[- ][0-9]{4})(?![0-9]))")),
    (SECRET, re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+")),
    (SECRET, re.compile(r"(?<![A-Za-z0-9_+/-])(?:[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=-]))?|[A-Za-z0-9_+/-]{15}=(?![A-Za-z0-9_+/=-])|[A-Za-z0-9_+/-]{14}==(?![A-Za-z0-9_+/=-]))")),
    (SECRET, re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]++=++([A-Za-z0-9_+/-][A-Za-z0-9_+/=-]{15,}+)")),
]
DOMAIN = re.compile(r"[\w-]++(?:\.[\w-]++)*+")
NOT_LOCAL = frozenset("<>\"'(),;:[]#*%&$!|@")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
KEY = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-", np.uint8))
#: Kinds made of whole groups of digits: how many digits, and what may stand between two groups.
GROUPS = [(PHONE, 7, 17, re.compile(r"[ ./()-]{1,2}")), (CARD, 13, 19, re.compile(r"[ -]"))]
HINTS = [
    re.compile(p, re.IGNORECASE)
    for p in (r"mail|contact|write", r"tel|phone|call|fax|mobil|handy", r"\bip\b|server|host|addr", r"card|visa|master|credit|karte|tarjeta", r"token|secret|passw|api|key|bearer|auth|pwd", r"ssn|social", r"iban|account|bank|konto", r"\bv\b|vers|release|build", r"order|invoice|ref|isbn|article|page|\bid\b|\bno\b|serial", r"commit|hash|sha|md5|uuid|digest|checksum")
]
BEFORE = 24  # characters of context
#: Stands between texts that are searched together: no candidate, and no context, reaches across it.
GAP = "\n" * (BEFORE + 8)
YEAR_FIRST = re.compile(r"(?=((?:19|20)[0-9]{2}[-./][0-9]{1,2}?[-./][0-9]))")
DATE = re.compile(r"(?=([0-9]{1,2}?[-./][0-9]{1,2}?[-./][0-9]{2}|[0-9]{4}[-./][0-9]{1,2}?[-./][0-9]))")
BLOCK = 20_000  # candidates described at once


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return bool(d) and (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return len(s) >= 15 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 if len(s) < 40 else False


def _table(test, chars: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.array([test(chr(c)) for c in chars], bool)[of]


class Page:
    """A text as an array of its characters, with what candidates are judged by. It begins and ends with GAP."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, of = np.unique(self.code, return_inverse=True)
        self.digit = (self.code >= 48) & (self.code <= 57)
        self.space, self.letter = _table(str.isspace, chars, of), _table(str.isalpha, chars, of)
        self.upper, self.lower = _table(str.isupper, chars, of), _table(str.islower, chars, of)
        self.word = _table(str.isalnum, chars, of)
        self.outside, self.local = _table(lambda c: c.isspace() or c in NOT_LOCAL, chars, of), _table(lambda c: c in LOCAL, chars, of)
        edge = np.flatnonzero(np.diff(self.digit.astype(np.int8)))
        self.run, self.run_end = edge[0::2] + 1, edge[1::2] + 1  # runs of digits

    def total(self, mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask)])

    def last(self, mask: np.ndarray) -> np.ndarray:
        """For each place, the last one up to it where the mask holds, or -1."""
        return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds, starts and ends, by start; spans may overlap, of one kind too."""
        found = [(m.start(m.lastindex or 0), m.end(m.lastindex or 0), kind) for kind, pattern in GENERATORS for m in pattern.finditer(self.text)]
        at = np.flatnonzero(self.code == 64)
        if len(at):
            wide, tight = self.last(self.outside)[at - 1] + 1, self.last(~self.local)[at - 1] + 1
            for p, *starts in zip(at.tolist(), wide.tolist(), tight.tolist()):
                if m := DOMAIN.match(self.text, p + 1):
                    found += [(a, m.end(), EMAIL) for a in set(starts) if a < p]
        found += self._digit_runs()
        out = np.array(sorted(set(found)), np.int64).reshape(-1, 3)
        return out[:, 2], out[:, 0], out[:, 1]

    def _digit_runs(self) -> Iterator[tuple[int, int, int]]:
        """Every run of whole groups of digits with as many digits as a kind of GROUPS has."""
        text, starts, ends = self.text, self.run.tolist(), self.run_end.tolist()
        for kind, low, high, gap in GROUPS:
            joined = [b - a <= 2 and gap.fullmatch(text, a, b) is not None for a, b in zip(ends, starts[1:])]
            for i, start in enumerate(starts):
                begins, digits = [start], 0
                if kind == PHONE:  # with and without a bracket and a plus before it
                    begins += [start - len(x) for x in ("(", "+", "+(") if text.endswith(x, 0, start)]
                for j in range(i, len(starts)):
                    digits += ends[j] - starts[j]
                    if digits > high or j > i and not joined[j - 1]:
                        break
                    if digits >= low:
                        yield from ((a, ends[j], kind) for a in begins)

    @functools.cached_property
    def sums(self) -> dict[str, np.ndarray]:
        c, one = self.code, lambda s: np.isin(self.code, [ord(x) for x in s])
        turn = np.zeros(len(c), bool)
        turn[1:] = self.upper[1:] != self.upper[:-1]
        masks = {"digit": self.digit, "letter": self.letter, "upper": self.upper, "lower": self.lower, "word": self.word, "turn": turn, "hex": one("0123456789abcdefABCDEF"), "dot": one("."), "colon": one(":"), "at": one("@"), "gap": one(" .-/"), "dash": one("-"), "open": one("("), "close": one(")")}
        return {k: self.total(m) for k, m in masks.items()}

    @functools.cached_property
    def side(self) -> np.ndarray:
        """What stands there: nothing or white space 0, sentence and path marks 2, letters 3, digits 4, anything else 1."""
        return np.select([self.space, self.digit, self.letter, np.isin(self.code, [ord(x) for x in ".,-_/"])], [0.0, 4.0, 3.0, 2.0], 1.0)

    @functools.cached_property
    def hints(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [tuple(np.array([m.span() for m in h.finditer(self.text)], np.int64).reshape(-1, 2).T) for h in HINTS]

    @functools.cached_property
    def near(self) -> dict[str, np.ndarray]:
        """By place: whether digits stand before it or begin at it beyond a few separators, and where what looks like a bank account before it began."""
        n = len(self.code)
        between = np.isin(self.code, [ord(x) for x in " ./()+-"])
        before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        for k in (1, 2, 3):
            some = between[: n - k + 1].copy()
            for i in range(1, k):
                some &= between[i : n - k + 1 + i]
            at = np.flatnonzero(some)  # k separators begin here
            before[at + k] |= (at > 0) & self.digit[at - 1]
            after[at] |= self.digit[np.minimum(at + k, n - 1)] & (at + k < n)
        plain = (self.code < 128) & self.word
        letter = plain & ~self.digit
        four = np.zeros(n + 1, bool)
        four[: n - 3] = plain[: n - 3] & plain[1 : n - 2] & plain[2 : n - 1] & plain[3:]
        head = np.flatnonzero(letter[: n - 3] & letter[1 : n - 2] & self.digit[2 : n - 1] & self.digit[3:])
        began = np.full(n + 6, -1, np.int64)
        began[head + 4] = head
        reach = np.flatnonzero(began >= 0)
        while len(reach):
            reach = reach[(reach < n) & (reach - began[reach] <= BEFORE)]
            ahead = [(p + 4, began[p]) for p in (reach[four[reach]],)] + [(p + 5, began[p]) for p in (reach[(self.code[np.minimum(reach, n - 1)] == 32) & four[np.minimum(reach + 1, n)]],)]
            where, who = np.concatenate([a for a, _ in ahead]), np.concatenate([b for _, b in ahead])
            new = who > began[where]
            where, who = where[new], who[new]
            np.maximum.at(began, where, who)
            reach = np.unique(where)
        began[1 : n + 1] = np.maximum(began[1 : n + 1], np.where(self.code == 32, began[:n], -1))
        return {"digit_before": before, "digit_after": after, "account": began}

    @functools.cached_property
    def dates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a date that begins with its year may end, by place; places of all dates, and the first end of any from there on."""
        first = np.full(len(self.code) + 1, len(self.code) + 1, np.int64)
        for m in YEAR_FIRST.finditer(self.text):
            first[m.start()] = m.end(1)
        found = np.array([(m.start(), m.end(1)) for m in DATE.finditer(self.text)], np.int64).reshape(-1, 2)
        return first, found[:, 0], np.minimum.accumulate(found[::-1, 1])[::-1]

    def describe(self, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Features of the candidates, a row each. Whole candidates are read, of any length."""
        n, s = (end - start).astype(float), self.sums
        count = {k: (t[end] - t[start]).astype(float) for k, t in s.items()}
        # The runs of digits of each candidate, in a row; a run may begin before it or end after it.
        a, b = np.searchsorted(self.run_end, start, "right"), np.searchsorted(self.run, end, "left")
        groups = np.maximum(b - a, 0)
        some = groups > 0
        row = np.repeat(np.arange(len(kind)), groups)
        which = np.arange(len(row)) - np.repeat(np.cumsum(groups) - groups, groups)
        run = np.repeat(a, groups) + which
        size = np.minimum(self.run_end[run], end[row]) - np.maximum(self.run[run], start[row])
        begin = (np.cumsum(groups) - groups)[some]

        def over(f: np.ufunc, x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(kind))
            out[some] = f.reduceat(x, begin) if len(begin) else 0
            return out

        longest, shortest = over(np.maximum, size), over(np.minimum, size)
        first, last = over(np.add, np.where(which == 0, size, 0)), over(np.add, np.where(which == groups[row] - 1, size, 0))
        value = np.zeros(len(row), np.int64)
        for k in range(3):
            place = np.minimum(self.run[run] + k, len(self.code) - 1)
            value = np.where(k < size, value * 10 + self.code[place].astype(np.int64) - 48, value)
        octet = (size <= 3) & (value < 256) & ((size == 1) | (self.code[self.run[run]] != 48))
        octets = (kind == IP) & (count["colon"] == 0) & (count["dot"] == 3) & (groups == 4) & (over(np.minimum, octet.astype(float)) > 0)
        fours = over(np.minimum, np.where(which == groups[row] - 1, size <= 4, size == 4).astype(float)) > 0
        # The characters of each candidate, for its entropy, its separators and its check digit.
        chars = (end - start).astype(np.int64)
        of = np.repeat(np.arange(len(kind)), chars)
        place = np.arange(len(of)) - np.repeat(np.cumsum(chars) - chars, chars) + np.repeat(start, chars)
        key, times = np.unique((of.astype(np.int64) << 21) | self.code[place], return_counts=True)
        owner, share = key >> 21, times / n[key >> 21]
        entropy = -np.bincount(owner, share * np.log2(share), len(kind))
        uniques, back = np.unique(key & 0x1FFFFF, return_inverse=True)
        separators = np.bincount(owner, ~_table(str.isalnum, uniques, back), len(kind))
        own = (kind[of] == CARD) & self.digit[place]
        d, left = self.code[place[own]].astype(np.int64) - 48, s["digit"][end[of[own]]] - s["digit"][place[own]] - 1
        d = np.where(left % 2 == 1, d * 2 - 9 * (d > 4), d)
        valid = (kind == CARD) & (np.bincount(of[own], d, len(kind)) % 10 == 0) & (count["digit"] > 0)
        digits = np.append(np.flatnonzero(self.digit), len(self.code) - 1)
        i = np.searchsorted(digits, start)
        lead = [np.where(count["digit"] > k, self.code[digits[np.minimum(i + k, len(digits) - 1)]].astype(np.int64) - 48, -1) for k in range(3)]
        two = lead[0] * 10 + lead[1]
        issuer = (kind == CARD) & (np.isin(lead[0], [4, 5, 6]) | np.isin(two, [34, 35, 36, 37, 38, 22, 23, 24, 25, 26, 27]))
        top, named, account = np.zeros(len(kind)), count["word"] > 0, np.zeros(len(kind))
        for k in np.flatnonzero(kind == EMAIL).tolist():
            local, _, domain = self.text[start[k] : end[k]].rpartition("@")
            label = domain.rpartition(".")[2]
            top[k] = "." in domain and label.isalpha() and 2 <= len(label) <= 24
            named[k] = any(c.isalnum() for c in local)
        for k in np.flatnonzero(kind == BANK).tolist():
            account[k] = iban(self.text[start[k] : end[k]])
        mark = self.last(self.code != 32)[start - 1]
        quoted = (mark >= start - BEFORE) & np.isin(self.code[mark], [34, 39])
        # After NAME= or NAME:, with blanks and a quote between.
        unquoted = np.where(np.isin(self.code[start - 1], [34, 39]), start - 2, start - 1)
        sign = self.last(self.code != 32)[unquoted]
        assigned = (sign >= start - BEFORE) & np.isin(self.code[sign], [58, 61])
        year_first, dates, ends = self.dates
        nth = np.searchsorted(dates, start)
        dated = np.append(ends, len(self.code) + 1)[nth] <= end if len(dates) else np.zeros(len(kind), bool)

        def hint(begins: np.ndarray, until: np.ndarray) -> np.ndarray:
            if not len(until):
                return np.zeros(len(kind), bool)
            k = np.searchsorted(until, start, "right") - 1
            return (k >= 0) & (begins[k] >= start - BEFORE)

        card = (kind == CARD) & ((groups == 1) | ((groups == 3) & (first == 4) & (longest == 6) & (last == 5)) | fours)
        columns = [
            *[kind == k for k in range(len(KINDS))],
            n, count["digit"], count["letter"], count["digit"] / n, count["hex"] / n, entropy, valid, issuer, octets, count["dot"] + 1, count["colon"], top, named, count["at"],
            self.code[start] == 43, (count["open"] > 0) & (count["close"] > 0), count["gap"], groups, longest, account, count["dash"], (count["upper"] > 0) & (count["lower"] > 0),
            self.side[start - 1], self.side[end], quoted, year_first[start] <= end, (lead[0] == 9) | (((lead[0] == 0) | (lead[0] == 6)) & (lead[1] == lead[0]) & (lead[2] == lead[0])),
            first, last, shortest, separators, (kind == CARD) & np.isin(count["digit"], [13, 14, 15, 16, 19]), card, count["upper"] / n, (s["turn"][end] - s["turn"][start + 1]) / n,
            self.near["digit_before"][start], self.near["digit_after"][end], (self.near["account"][start] >= 0) & (self.near["account"][start] >= start - BEFORE), dated,
            *[hint(x, y) for x, y in self.hints], assigned,
        ]
        return np.stack([np.asarray(c, float) for c in columns], axis=1)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end); spans may overlap, of one kind too."""
    kind, start, end = Page(GAP + text + GAP).candidates()
    return sorted(zip(kind.tolist(), (start - len(GAP)).tolist(), (end - len(GAP)).tolist()))


def _examples(random: np.random.Generator, n: int) -> list[tuple[str, str | None, int, int]]:
    """(text, kind or None, start, end) of made-up spans in made-up contexts."""
    own = rnd.Random(int(random.integers(1 << 62)))  # many small draws
    pick = lambda *x: own.choice(x)
    num = lambda k: "".join(own.choices("0123456789", k=k))
    word = lambda low=2, high=9: "".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=own.randint(low, high)))
    hexa = lambda k: "".join(own.choices("0123456789abcdef", k=k))
    letters = lambda k: "".join(own.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=k))
    alnum = lambda k: "".join(own.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))

    unlike = lambda k: next(s for s in iter(lambda: num(k), "") if not luhn(s))  # noqa: E731  what passes by chance is no look-alike

    def card(good: bool) -> str:
        k = pick(15, 16, 16, 16, 16, 13, 19)
        lead = pick("4", "4", "4", "51", "53", "55", "34", "37", "6011", "65", "2221", "2500", "36", "35") if good else pick("", "", "4", "5", "6", "0", "1", "7", "8", "9")
        body = lead + num(k - len(lead) - 1)
        s = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        if not good and (lead in ("", "4", "5", "6")):
            s = body + str((int(s[-1]) + own.randrange(1, 10)) % 10)
        return s if own.random() < 0.6 else pick(" ", "-").join(s[i : i + 4] for i in range(0, len(s), 4))

    def bank(good: bool) -> str:
        land, body = pick("DE", "FR", "ES", "GB", "NL"), num(own.randrange(14, 21))
        rest = int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        check = 98 - rest if good else (98 - rest + own.randrange(1, 90)) % 97
        s = f"{land}{check:02d}{body}"
        return s if own.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+{pick('1', '44', '49', '33', '34')} ({a}) {b}-{c}", f"+{pick('1', '44', '49')} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{pick('1', '49', '33')}{a}{b}{c}", f"+{pick('1', '33')}-{a}-{b}-{c}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{a}.{b}.{c}")

    octet = lambda: str(own.randrange(0, 256))
    ip = lambda: ".".join(octet() for _ in range(4))
    out = []
    for _ in range(n):
        kind = pick(*KINDS)
        good = own.random() < 0.5
        hint = ""
        if kind == "EMAIL":
            local = pick(word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}.{num(2)}", f"{word()}_{word()}+{word()}")
            s = f"{local}@{pick(word(), f'{word()}{num(1)}.{word()}', f'{word()}-{word()}')}.{pick('com', 'org', 'net', 'de', 'io', 'example', 'co.uk', 'museum')}" if good else pick(f"{word()}@{word()}", f"{word()}@{num(3)}", f"{word()}@{num(1)}.{num(1)}", f"{word()}@v{num(1)}.{num(1)}")
            hint = pick("", "", "", "mail: ", "contact ")
        elif kind == "IP":
            if good:
                s = ip() if own.random() < 0.85 else ":".join(hexa(4) for _ in range(8))
                hint = pick("", "", "", "", "ip: ", "server ", "host=")
            else:
                s, hint = pick((f"{octet()}.{octet()}.{octet()}.{own.randint(256, 999)}", pick("", "server ")), (f"{own.randint(256, 999)}.{octet()}.{octet()}.{octet()}", ""), (f"{ip()}.{octet()}", ""), (".".join(num(1) for _ in range(4)), pick("version ", "v ", "release ")), (f"0{num(2)}.{octet()}.{octet()}.0{num(1)}", ""), (f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", ""))
        elif kind == "PHONE":
            s = phone() if good else pick(num(8), num(10), unlike(14), f"20{num(2)}-0{num(1)}-1{num(1)}", f"20{num(2)}-0{num(1)}-1{num(1)} 10", f"{num(2)} {num(3)} {num(3)}", f"{num(4)}-{num(4)}", f"{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{num(7)}", f"{unlike(16)}", f"{num(3)}/{num(2)}/{num(4)}")
            hint = pick("", "", "tel. ", "call ", "phone: ") if good else pick("", "", "order ", "invoice no ", "isbn ")
        elif kind == "CARD":
            s = card(good) if good or own.random() < 0.8 else pick(num(20), num(24), unlike(13), unlike(14))
            hint = pick("", "", "", "card ", "visa: ") if good else pick("", "", "", "order ", "serial ", "ref ")
        elif kind == "BANK":
            s = bank(good)
            hint = pick("", "", "iban ", "account: ") if good else pick("", "", "ref ", "serial ")
        elif kind == "SSN":
            s = f"{pick('1', '2', '3', '4', '5', '7')}{num(2)}-{num(2)}-{num(4)}" if good else pick(f"9{num(2)}-{num(2)}-{num(4)}", f"000-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}-{num(3)}", f"{num(2)}{num(3)}-{num(2)}-{num(4)}")
            hint = pick("", "", "ssn ", "social security: ") if good else pick("", "order ", "serial ")
        else:
            s = pick(hexa(40), hexa(32), hexa(64), alnum(20), alnum(32), alnum(40), alnum(38) + "==", "AKIA" + alnum(16).upper(), "ghp_" + alnum(36), "sk-" + alnum(32), "".join(own.choices("abcdef", k=pick(32, 40))), letters(own.randrange(16, 41)), letters(own.randrange(16, 41)).upper())
            quote = pick("", '"', "'")
            lead = pick("token", "api_key", "secret", "password", "access key", "auth", "bearer", "SECRET_KEY", "aws_secret_access_key") + pick(" = ", "=", ": ", " ")
            if good:
                hint = lead + quote
            else:
                s, hint = pick((hexa(40), pick("commit ", "sha ", "hash: ", "commit=", "")), (hexa(64), pick("digest ", "checksum ", "sha256=", "")), (f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", pick("uuid ", "id ", "")), (f"{word(9, 12)}{word(9, 12)}{num(1)}", ""), (f"{word()}-{word()}-{word()}-{num(2)}", ""), (unlike(18), ""), ("-" * 20 + num(1), ""), (word(8, 9) + "_" + word(8, 9) + num(1), lead), (pick("_", "-", "/").join(word() for _ in range(5)) + "_" + word(8, 9), pick("", lead)), (word(16, 24), ""), (word(4, 8) + "".join(word(4, 8).title() for _ in range(3)), pick("", lead)), (pick("-", "=", "_") * own.randrange(16, 60), ""))
        if own.random() < 0.15 and (good or not s.isalpha()):
            s, hint = s.upper(), hint.upper()
        head = " ".join(word() for _ in range(own.randrange(0, 5)))
        start = head + pick(" ", " ", " ", "\n", ", ") + hint if head else hint
        if good and own.random() < 0.05:
            head = (head + " " + num(16)).strip()
            start = f"{head} {hint}"
        digits = lambda: pick(num(2), num(3), num(4), f"20{num(2)}-0{num(1)}-1{num(1)}", f"0{num(1)}/2{num(1)}", f"{num(2)}.{num(2)}.20{num(2)}", s, s, s)
        if good and kind != "SECRET" and own.random() < 0.25:  # other digits stand next to it
            start += f"{pick('', '', 'id ', 'order ', 'no ')}{digits()} "
        tail = pick("", "", " ", ".", ",", '"', "###", "!!", "%%%", "$$$", "***", ")", ";") + " " + " ".join(word() for _ in range(own.randrange(0, 4)))
        if good and kind != "SECRET" and own.random() < 0.25:
            tail = f" {digits()}" + tail
        out.append((start + s + tail, kind if good else None, len(start), len(start) + len(s)))
    return out


def settled(kind: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray, least: np.ndarray) -> list[int]:
    """The candidates, in order, that reach their kind's least probability and win overlaps: within each cluster of spans that touch
    no others, the best first, each looked up among those taken by its place."""
    some = np.flatnonzero(p >= least[kind])
    order = some[np.lexsort((end[some], start[some]))]
    if not len(order):
        return []
    reach = np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[order][1:] >= reach[:-1]]))  # spans before it end before it
    out: list[int] = []
    for cluster in np.split(order, new[1:]):
        if len(cluster) == 1:
            out.append(int(cluster[0]))
            continue
        best = cluster[np.lexsort((kind[cluster], start[cluster], start[cluster] - end[cluster], -p[cluster]))]
        taken: list[tuple[int, int, int]] = []
        for c, a, b in zip(best.tolist(), start[best].tolist(), end[best].tolist()):
            i = bisect.bisect_left(taken, (a,))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                taken.insert(i, (a, b, c))
        out += [c for _, _, c in taken]
    return out


@dataclasses.dataclass
class Model:
    trees: boosting.Trees
    thresholds: np.ndarray

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """For each text (start, end, kind, probability) of what is to be redacted, in order."""
        page = Page(GAP + "".join(t + GAP for t in texts))
        kind, start, end = page.candidates()
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        if not len(kind):
            return out
        p = np.concatenate([self.trees.probability(page.describe(kind[i : i + BLOCK], start[i : i + BLOCK], end[i : i + BLOCK])) for i in range(0, len(kind), BLOCK)])
        begin = len(GAP) + np.cumsum([0, *[len(t) + len(GAP) for t in texts[:-1]]])
        for c in settled(kind, start, end, p, self.thresholds):
            t = int(np.searchsorted(begin, start[c], "right")) - 1
            out[t].append((int(start[c] - begin[t]), int(end[c] - begin[t]), int(kind[c]), float(p[c])))
        return out

    def spans(self, text: str) -> list[tuple[int, int, int, float]]:
        return self.search([text])[0]


def _rows(examples: list[tuple[str, str | None, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, truths, kinds, starts and ends of the candidates that overlap their example's span."""
    page = Page(GAP + "".join(t + GAP for t, _, _, _ in examples))
    kind, start, end = page.candidates()
    begin = len(GAP) + np.cumsum([0, *[len(t) + len(GAP) for t, _, _, _ in examples[:-1]]])
    of = np.searchsorted(begin, start, "right") - 1
    low, high = begin + [a for _, _, a, _ in examples], begin + [b for _, _, _, b in examples]
    own = (end > low[of]) & (start < high[of])
    kind, start, end, of = kind[own], start[own], end[own], of[own]
    true = np.array([-1 if k is None else KINDS.index(k) for _, k, _, _ in examples])
    y = (kind == true[of]) & (start == low[of]) & (end == high[of])
    x = np.concatenate([page.describe(kind[i : i + BLOCK], start[i : i + BLOCK], end[i : i + BLOCK]) for i in range(0, len(kind), BLOCK)])
    return x, y.astype(float), kind, start, end


@functools.cache
def train(examples: int = 7000, seed: int = 11) -> Model:
    """The detector; made once a process for the same arguments."""
    random = np.random.default_rng(seed)
    trees = boosting.fit(*_rows(_examples(random, examples))[:2], trees=90, depth=4, rate=0.25, sample=0.6, columns=0.6)
    x, y, kinds, start, end = _rows(_examples(random, examples // 2))
    boosting.calibrate(trees, x, y)
    p, thresholds = trees.probability(x), np.full(len(KINDS), 0.5)
    won = np.zeros(len(p), bool)  # precision is that of the spans left when overlaps are settled
    won[settled(kinds, start, end, p, np.full(len(KINDS), LEAST))] = True
    for k in range(len(KINDS)):
        q, t = p[won & (kinds == k)], y[won & (kinds == k)]
        order = np.argsort(-q, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        if (good := np.flatnonzero(right >= PRECISION)).size:  # between the last span that passes and the next one
            i = good[-1]
            thresholds[k] = (q[order][i] + q[order][i + 1]) / 2 if i + 1 < len(q) else LEAST
    return Model(trees, thresholds)


def windows(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end): the bytes around digits, @, runs that may be keys and colons close together, out to white space, nearby ones joined."""
    marked = ((data >= 48) & (data <= 57)) | (data == 64)
    edge = np.flatnonzero(np.diff(KEY[data].astype(np.int8), prepend=0, append=0))
    marked[edge[0::2][edge[1::2] - edge[0::2] >= 16]] = True
    colon = np.flatnonzero(data == 58)
    marked[colon[:-2][colon[2:] - colon[:-2] <= 10]] = True
    anchor = np.flatnonzero(marked)
    if not len(anchor):
        return []
    space = np.flatnonzero(data <= 32)  # each text ends with one
    after = np.concatenate([[0], space + 1])
    doc = np.searchsorted(at, anchor, "right") - 1
    word = after[np.searchsorted(space, anchor)]  # a span begins in its anchor's word; 24 characters before it have up to 96 bytes
    left = np.maximum(after[np.searchsorted(space, np.maximum(word - 96, 0))], at[doc])
    right = np.minimum(space[np.minimum(np.searchsorted(space, np.minimum(anchor + 44, len(data) - 1)), len(space) - 1)], at[doc + 1] - 1)
    new = np.ones(len(anchor), bool)
    reach = np.maximum.accumulate(right)
    new[1:] = (left[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return list(zip(doc[first].tolist(), left[first].tolist(), np.maximum.reduceat(right, first).tolist()))


def _found(model: Model, texts: pa.Array) -> dict[int, list[tuple[int, int, str, float]]]:
    """Of each text with spans: (start, end, kind, probability) in characters."""
    data, at = lowered(texts, lower=False)
    own = windows(data, at)
    out: dict[int, list[tuple[int, int, str, float]]] = {}
    if not own:
        return out
    count = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    for (d, a, _), spans in zip(own, model.search([data[a:b].tobytes().decode("utf-8", "replace") for _, a, b in own])):
        base = int(count[a] - count[at[d]])
        if spans:
            out.setdefault(d, []).extend((base + s, base + e, KINDS[k], p) for s, e, k, p in spans)
    return out


def replaced(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    parts, last = [], 0
    for start, end, kind, _ in spans:
        parts += [text[last:start], f"[{kind}]"]
        last = end
    return "".join([*parts, text[last:]])


SPANS = "array<struct<kind:string,start:int,end:int,probability:double>>"


def redactions(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, text, n_redacted, spans)`` of the rows in which something is redacted."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in chunks(batches, "text"):
            found = _found(shared.value, batch.column("text"))
            if found:
                rows = list(found)
                own = batch.take(pa.array(rows))
                texts = [replaced(t, found[d]) for d, t in zip(rows, own.column("text").to_pylist())]
                spans = [[dict(kind=k, start=s, end=e, probability=p) for s, e, k, p in found[d]] for d in rows]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, kind)], ["doc_id", "text", "n_redacted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, text string, n_redacted int, spans {SPANS}")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows and columns of docs, with redacted texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = _found(shared.value, batch.column("text"))
            if found:
                names, cols = batch.schema.names, list(batch.columns)
                i = names.index("text")
                rows, mask = sorted(found), np.zeros(batch.num_rows, bool)
                mask[rows] = True
                old = batch.column("text").take(pa.array(rows)).to_pylist()
                cols[i] = pc.replace_with_mask(cols[i], pa.array(mask), pa.array([replaced(t, found[d]) for d, t in zip(rows, old)], cols[i].type))
                if "n_chars" in names:
                    j = names.index("n_chars")
                    cols[j] = pc.if_else(pa.array(mask), pc.utf8_length(cols[i]).cast(cols[j].type), cols[j])
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
