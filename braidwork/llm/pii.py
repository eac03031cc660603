"""Personal information in free text, by a semi-Markov conditional random field over candidate segments.

Simple patterns propose segments of each kind, more of them than are right, and of bounded length. Each is
scored as a whole: its shape, its words, how rare they are in the corpus, the words around it. A dynamic
program over the proposed segments picks the likeliest set without overlap, so boundaries and kinds are
chosen together. The weights are those of the conditional likelihood, maximised by gradient over the same
lattices, on sentences that are made up here: contexts with invented persons, numbers and addresses, and
contexts with numbers and words that look alike but mean something else.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .names import PARTICLES, fold
from .texts import different

KINDS = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]

_WORD = re.compile(r"[^\W\d_]{3,}")
_AT = re.compile(r"\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?")
_SPELLED_AT = re.compile(r".?[\[(]\s?at\s?[\])]")
_LOCAL = re.compile(r"(?:mailto:)?[a-z0-9][\w.+%'-]{0,63}\Z")
_DOMAIN = re.compile(r"[a-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[a-z0-9-]+){0,4}(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[a-z]{2,12}(?![\w@])")
_NUMBER = re.compile(
    r"(?<![\w.@#/+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}+(?:(?:[ .-]|-?\(0\))?\(?\d{1,5}+\)?)*(?:[ .-]five five five[ .-]\d{4})?(?: ?(?:ext|x)\.? ?\d{1,5})?(?![\w@]|[./:-]\d)"
)
_NUMBER_HIT = re.compile(r"\d[\d().\- ]{5,}\d")
_SPELLED_HIT = re.compile(r"\d{3}[ .-]five five five[ .-]\d{4}")
_PLAIN_THING = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}|(?:19|20)\d\d-\d\d-\d{2,3}(?:[ t]\d\d)?")
_LETTERED = re.compile(r"\d{3}(?:\.\d{3}\.\d{2}|\d{3,4}[a-z]?)(?![\w@-])")
_PAIRED = re.compile(r"\d\d \d\d \d\d [a-z](?![\w@-])")
_LETTERS = re.compile(r"(?<![\w.@#/-])[a-z]{2}-?\Z")
_LETTERS_SPACE = re.compile(r"(?<![\w.@#/-])[a-z]{2} \Z")
_WAY = r"(?:street|st|road|rd|avenue|ave|lane|ln|close|way|drive|dr|blvd|boulevard|court|ct|place|pl|square|sq|terrace|crescent)"
_TOWN_WORD = r"[^\W\d_][\w'’-]*"
_POST = r"(?:\d{4,5}(?:-\d{4})?|[a-z]{1,2}\d[\da-z]?\s\d[a-z]{2})(?!\w)"
_NUMBERED = re.compile(
    rf"(?<![\w.#-])\d{{1,5}}[a-z]?(?:\s(?:{_TOWN_WORD}\s){{1,3}}?{_WAY}\b\.?(?:\s(?:apt|unit|suite|flat)\.?\s\w{{1,5}})?"
    rf"|(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée)\s{_TOWN_WORD}(?:\s{_TOWN_WORD}){{0,2}}(?=,))"
)
_FLAT = re.compile(r"(?<![\w.#-])(?:flat|apt|apartment|unit|suite)\s\w{1,5},\s*\Z")
_COMPOUND = re.compile(rf"(?<!\w){_TOWN_WORD}(?:straße|strasse|weg|platz|gasse)\s\d{{1,4}}[a-z]?\b|(?<!\w)p\.?\s?o\.?\s?box\s\d{{1,6}}")
_REST = re.compile(rf"(?:,\s*|\s*\n\s*)(?:\d{{5}}\s)?({_TOWN_WORD})((?:\s{_TOWN_WORD})?)((?:\s{_TOWN_WORD})?)")
_REST_POST = re.compile(rf"\s{_POST}")
_COMPOUND_WORDS = ["straße ", "strasse ", " box ", "weg ", "platz ", "gasse "]
_STREET_WORDS = set("street st road rd avenue ave lane ln close way drive dr blvd boulevard court ct place pl square sq terrace crescent rue chemin allée".split())
_NAME_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*\.?")
SHORT_WORDS = set("by to on in is at of or as if an no do go up us we me my it so be he am id ok vs".split())
#: Words that are nobody's surname.
FUNCTION_WORDS = SHORT_WORDS | set(
    "the and for not but nor are was were has had have with from that this these those than then they them their there here his her its our your you she who whom whose what which when where why how all any each every some "
    "can could may might must shall should will would did does done been being into onto over under about after before because while until unless only also very just more most less such per via und der die das les des est une".split()
)
#: A longer word is no name.
LONGEST_TOKEN = 80
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "herr", "frau", "mme"}


def lower(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_LETTERS_ONLY = {i: " " for i in range(128) if not chr(i).isalpha()}


def _every(text: str, part: str) -> Iterator[int]:
    i = text.find(part)
    while i >= 0:
        yield i
        i = text.find(part, i + 1)


_TOKEN = re.compile(r"[^\W\d_]+")
# The word behind a given name or title, with initials, particles or a nickname in quotes between; the one before it; initials.
_AFTER = re.compile(rf"""\.?[ \t\n]{{1,3}}(?:(?:[^\W\d_]\.?|{'|'.join(sorted(PARTICLES))}|["“][^\W\d_]+["”])\s){{0,2}}([^\W\d_]{{2,40}})(?![\w@])""")
_BEFORE_GIVEN = re.compile(r"(?<![\w@])([^\W\d_]{2,40})(?:,?[ \t]{1,3}|,[ \t]?\n)\Z")
_TITLE_STOP = re.compile(r"\b(mr|mrs|ms|dr|prof)\. ")
_DOTTED = re.compile(r"(?<![\w.])[A-Z]\.(?=\s[A-Z])")


def runs(low: str) -> set[str]:
    """The different runs of letters of a lower-case text."""
    return set(low.translate(_LETTERS_ONLY).split()) if low.isascii() else set(_TOKEN.findall(low))


def words(low: str) -> set[str]:
    """The different words of a lower-case text: runs of three letters and more."""
    return {w for w in runs(low) if len(w) > 2}


class Tagger:
    """Proposes, scores and chooses segments.

    common: words that stand in many rows; what isn't among them is rare. given: given names and nicknames,
    folded. weights: of the features.
    """

    MOST_WORDS = 5

    def __init__(self, common: set[str], given: set[str], weights: dict[str, float] | None = None) -> None:
        self.common, self.given, self.weights = common, given, weights or {}
        self.given_or_title = given | TITLES

    # -- candidates -------------------------------------------------------------------------------------
    def candidates(self, text: str) -> list[tuple[int, int, str]]:
        low = lower(text)
        out: set[tuple[int, int, str]] = set()
        at = [(i, i + 1) for i in _every(low, "@")]
        for word in ("at)", "at]"):
            at += [m.span() for i in _every(low, word) if (m := _SPELLED_AT.match(low, max(0, i - 2)))]
        for i, j in at:
            i -= low[i - 1 : i].isspace()
            j += low[j : j + 1].isspace()
            if (d := _DOMAIN.match(low, j)) and (b := _LOCAL.search(low[max(0, i - 72) : i])):
                out.add((i - len(b[0]), d.end(), "EMAIL"))
        for m in self._numbers(low):
            digits = sum(c.isdigit() for c in m[0])
            # numbers of telephones have 15 digits at most, beside an extension
            if 7 <= digits + 3 * ("five" in m[0]) <= (15 if m[0].isdigit() else 18):
                out.add((m.start(), m.end(), "PHONE"))
                if m[0][0] not in "+(" and digits <= 12 and "five" not in m[0]:
                    out.add((m.start(), m.end(), "ID_NUMBER"))
        for m in _LETTERED.finditer(low):
            if b := _LETTERS.search(low[max(0, m.start() - 4) : m.start()]):
                out.add((m.start() - len(b[0]), m.end(), "ID_NUMBER"))
        for m in _PAIRED.finditer(low):
            if b := _LETTERS_SPACE.search(low[max(0, m.start() - 4) : m.start()]):
                out.add((m.start() - len(b[0]), m.end(), "ID_NUMBER"))
        tokens = runs(low)
        self._addresses(low, tokens, out)
        self._names(text, low, tokens, out)
        return sorted(out)

    @staticmethod
    def _numbers(low: str) -> Iterator[re.Match[str]]:
        last = -1
        for h in _NUMBER_HIT.finditer(low):
            if _PLAIN_THING.fullmatch(h[0].strip(" (.-")):
                continue
            # an extension or spelt digits may follow, of fewer characters than these
            for m in _NUMBER.finditer(low, max(0, last, h.start() - 2), h.end() + 48):
                if m.start() >= h.end():
                    break
                if m.end() > last and not _PLAIN_THING.fullmatch(m[0]):
                    last = m.end()
                    yield m
        if "five five five" in low:
            yield from _SPELLED_HIT.finditer(low)

    @staticmethod
    def _addresses(low: str, tokens: set[str], out: set[tuple[int, int, str]]) -> None:
        """The street, alone and with a town of one word, two or three, with and without a postal code."""
        found = [] if tokens.isdisjoint(_STREET_WORDS) else [m.span() for m in _NUMBERED.finditer(low)]
        if any(w in low for w in _COMPOUND_WORDS):
            found += [m.span() for m in _COMPOUND.finditer(low)]
        for s, e in found:
            if flat := _FLAT.search(low[max(0, s - 24) : s]):
                s -= len(flat[0])
            out.add((s, e, "ADDRESS"))
            rest = _REST.match(low, e)
            if rest:
                for end in {rest.end(1), rest.end(2), rest.end(3)}:
                    out.add((s, end, "ADDRESS"))
                    if post := _REST_POST.match(low, end):
                        out.add((s, post.end(), "ADDRESS"))

    def _names(self, text: str, low: str, tokens: set[str], out: set[tuple[int, int, str]]) -> None:
        rare = {w for w in tokens - self.common if len(w) >= 4}
        beside = self._beside(text, low, tokens)
        if not rare and not beside:
            return
        spans = {w.span() for w in _WORD.finditer(low) if w[0] in rare} if rare else set()
        done = -1
        for s, e in sorted(spans | beside):
            if s < done:
                continue
            weak = (s, e) not in spans
            # the whole token, with its hyphens
            while s and (low[s - 1].isalpha() or low[s - 1] in "-'’" and s > 1 and low[s - 2].isalpha()):
                s -= 1
            while e < len(low) and (low[e].isalpha() or low[e] in "-'’" and e + 1 < len(low) and low[e + 1].isalpha()):
                e += 1
            done = e
            if (s and low[s - 1] in "@_/\\+.$#0123456789" and not (low[s - 1] == "." and s > 1 and low[s - 2].isalpha() is False)) or (e < len(low) and low[e] in "@_/\\+0123456789$"):
                continue
            if low[e : e + 2].startswith((".", "=")) and low[e + 1 : e + 2].isalnum() or (e - s > LONGEST_TOKEN):
                continue
            before = [(m.start() + max(0, s - 60), m[0]) for m in _NAME_TOKEN.finditer(low[max(0, s - 60) : s])]
            after = [(m.start() + e, m.end() + e, m[0]) for m in _NAME_TOKEN.finditer(low[e : e + 48])]
            starts, at, sure = [s], s, False
            for b, t in reversed(before[-4:]):
                gap = low[b + len(t) : at]
                if gap.strip(" \t\"“”") or len(gap) > 4 or "\n" in gap and gap.count("\n") > 1:
                    break
                bare = t.rstrip(".")
                if bare in TITLES or bare in PARTICLES or fold(bare) in self.given or len(bare) == 1 or bare not in self.common and t[-1] != ".":
                    at = b
                    sure = sure or fold(bare) in self.given or bare in TITLES or len(bare) == 1 and t[-1] == "."
                    if sure or not weak:
                        starts.append(b)
                else:
                    break
            ends = [e]
            if after:
                b, c, t = after[0]
                gap = low[e:b]
                if re.fullmatch(r",?[ \t\n]{1,3}", gap):
                    bare = t.rstrip(".")
                    if fold(bare) in self.given:
                        stop = c - (t[-1] == ".")
                        ends.append(stop)
                        if m := re.match(r"\s[a-z]\.(?!\w)", low[stop:]):
                            ends.append(stop + m.end())
                    elif weak:
                        pass  # a common or short word needs a given name
                    elif "," not in gap and "\n" not in gap and text[s].isupper() and text[b].isupper() and len(bare) > 1 and bare not in FUNCTION_WORDS and bare not in TITLES:
                        ends.append(c - (t[-1] == "."))  # a given name that no list holds, and a surname that is short or a word
                    elif len(bare) <= 2 and bare not in SHORT_WORDS and text[b:c].rstrip(".").isupper():
                        ends.append(b + len(bare))
                    elif len(bare) == 1 and t[-1] == "." and "," in gap:
                        ends.append(c)
            for x in starts:
                for y in ends:
                    if not weak or x < s or y > e:
                        out.add((x, y, "NAME"))

    def _beside(self, text: str, low: str, tokens: set[str]) -> set[tuple[int, int]]:
        """Where words stand that are surnames only by the given name, title or initial beside them, however common or short."""
        first = tokens & self.given_or_title
        if not low.isascii():
            first |= {t for t in tokens if not t.isascii() and fold(t) in self.given}
        out: set[tuple[int, int]] = set()

        def add(m: re.Match[str] | None, lower_too: bool) -> None:
            if m and m.end(1) - m.start(1) > 1 and m[1] not in FUNCTION_WORDS and m[1] not in TITLES and (lower_too or text[m.start(1)].isupper()):
                out.add(m.span(1))

        for w in first:
            title = w in TITLES
            for at in _every(low, w):
                end = at + len(w)
                if at and low[at - 1].isalpha() or low[end : end + 1].isalpha():
                    continue
                add(_AFTER.match(low, end), not title)
                if not title:
                    add(_BEFORE_GIVEN.search(low, max(0, at - 44), at), False)
        if "." in low:
            for f in _DOTTED.finditer(text):
                add(_AFTER.match(low, f.end() - 1), False)
        return out

    # -- features ---------------------------------------------------------------------------------------
    def features(self, text: str, low: str, seg: tuple[int, int, str]) -> list[str]:
        s, e, kind = seg
        span = low[s:e]
        left, right = low[max(0, s - 40) : s], low[e : e + 24]
        before = re.findall(r"[^\W_]+|[^\w\s]", left)[-3:]
        prev = next((w for w in reversed(before) if w[0].isalnum()), "^")
        prev2 = " ".join([w for w in before if w[0].isalnum()][-2:])
        follow = (re.findall(r"[^\W_]+|[^\w\s]", right) or ["$"])[0]
        out = [f"{kind}", f"{kind} prev {prev if not prev.isdigit() else '0'}", f"{kind} prev2 {re.sub(r'[0-9]+', '0', prev2)}", f"{kind} next {follow if not follow.isdigit() else '0'}"]
        glue = low[s - 1 : s]
        out.append(f"{kind} glue {glue if not glue.isalnum() else 'w'}")
        if kind in ("PHONE", "ID_NUMBER"):
            shape = re.sub(r"[0-9]", "0", re.sub(r"ext.*$|x ?\d+$", "x", span))
            groups = "-".join(str(len(g)) for g in re.findall(r"\d+", span))
            out += [f"{kind} shape {shape}", f"{kind} groups {groups}", f"{kind} first {span[:1]}", f"{kind} n {sum(c.isdigit() for c in span)}"]
            if span.isdigit():
                out.append(f"{kind} plain{len(span)} {span[:1]}")
            if re.fullmatch(r"(19|20)\d\d[-. ].*", span):
                out.append(f"{kind} year")
            left = _TITLE_STOP.sub(r"\1 ", left)
            near = re.split(r"[\n;|]|\. |\", ", left)[-1]  # the same clause or field
            if re.search(r"phone|call|tel|mobile|ring|fax|contact|reach", near):
                out.append(f"{kind} callword")
            if re.search(r"\bid\b|passport|tax|national|identity|ssn|social|insurance|licen[cs]e|personal", near):
                out.append(f"{kind} idword")
            if re.search(r"batch|invoice|build|epoch|order|version|release|range|peer|run|trace|serial|item|rows|tag|sku|part\b|model|ticket|timestamp|checksum|\bport\b", near[-18:]):
                out.append(f"{kind} thingword")
        elif kind == "EMAIL":
            out += ["EMAIL url" if re.search(r"://\S*\Z", left) or re.search(r"://[^\s]*:", left + span) else "EMAIL free", f"EMAIL local {min(4, len(_AT.split(span)[0]))}"]
            if left.endswith(":") and "mailto" not in span:
                out.append("EMAIL colon")
        elif kind == "ADDRESS":
            words = re.findall(r"[^\W\d_]+", span)
            out += [f"ADDRESS town {',' in span}", f"ADDRESS caps {sum(w[:1].isupper() for w in re.findall(r'[^\W\d_]+', text[s:e])) * 2 > len(words)}"]
            out.append(f"ADDRESS small {bool({'the', 'of', 'in', 'a', 'to', 'and', 'by', 'for', 'on', 'is', 'was', 'all', 'this', 'that', 'no', 'any', 'with'} & set(words))}")
            out.append(f"ADDRESS post {bool(re.search(r'[0-9]{5}|[a-z][0-9][0-9a-z]? [0-9][a-z]{2}', span))}")
            out.append(f"ADDRESS words {min(6, len(words))}")
        else:
            ts = [t.rstrip(".") for t in _NAME_TOKEN.findall(span)]
            orig = [t.rstrip(".") for t in _NAME_TOKEN.findall(text[s:e])]
            kinds = "".join("T" if t in TITLES else "P" if t in PARTICLES else "G" if fold(t) in self.given else "I" if len(t) == 1 else "R" if not (set(_WORD.findall(t)) & self.common) else "C" for t in ts)
            if "," in span:
                kinds = kinds.replace("G", "g")
            case = "".join("U" if t.isupper() and len(t) > 1 else "A" if t[:1].isupper() else "a" for t in orig)
            last = [t for t, k in zip(ts, kinds) if k == "R"]
            out += [f"NAME form {kinds}", f"NAME case {''.join(sorted(set(case)))}", f"NAME form {kinds} {''.join(sorted(set(case)))}", f"NAME long {min(3, max(map(len, last), default=0) // 4)}"]
            out.append(f"NAME more {self._more(low, s, e)}")
            if not _STREET_WORDS.isdisjoint(ts):
                out.append("NAME way")
        return out

    def _more(self, low: str, s: int, e: int) -> str:
        """Whether a token just outside might belong to the name."""
        m = re.search(r"([^\W\d_]+)\.?\s\Z", low[max(0, s - 24) : s])
        b = m[1] if m else ""
        return "".join("T" if b in TITLES else "G" if fold(b) in self.given else "")

    def score(self, text: str, low: str, seg: tuple[int, int, str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in self.features(text, low, seg))

    # -- the dynamic program ----------------------------------------------------------------------------
    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The likeliest segments, in order."""
        segs = self.candidates(text)
        if not segs:
            return []
        low = lower(text)
        scored = [(g, v) for g in segs if (v := self.score(text, low, g)) > 0.0]  # others never help
        points = sorted({x for g, _ in scored for x in g[:2]})
        at = {x: i for i, x in enumerate(points)}
        best: list[tuple[float, object]] = [(0.0, None)] * (len(points) or 1)
        by_end: dict[int, list] = defaultdict(list)
        for g, v in scored:
            by_end[at[g[1]]].append((at[g[0]], v, g))
        for i in range(1, len(points)):
            best[i] = (best[i - 1][0], (i - 1, None))
            for j, v, g in by_end[i]:
                if best[j][0] + v > best[i][0]:
                    best[i] = (best[j][0] + v, (j, g))
        out, i = [], len(points) - 1
        while i > 0:
            j, g = best[i][1]  # type: ignore[misc]
            if g:
                out.append(g)
            i = j
        return out[::-1]

    def gradient(self, text: str, gold: list[tuple[int, int, str]]) -> tuple[Counter, float]:
        """Gradient of the log-likelihood of the gold segments among all sets of candidates, and its value."""
        segs, low = self.candidates(text), lower(text)
        feats = [self.features(text, low, g) for g in segs]
        values = [sum(self.weights.get(f, 0.0) for f in fs) for fs in feats]
        points = sorted({x for g in segs for x in g[:2]})
        at, n = {x: i for i, x in enumerate(points)}, len(points)
        grad: Counter = Counter()
        if not n:
            return grad, 0.0
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        fwd, bwd = [0.0] * n, [0.0] * n
        ends, begins = defaultdict(list), defaultdict(list)
        for k, g in enumerate(segs):
            ends[at[g[1]]].append(k)
            begins[at[g[0]]].append(k)
        for i in range(1, n):
            fwd[i] = fwd[i - 1]
            for k in ends[i]:
                fwd[i] = add(fwd[i], fwd[at[segs[k][0]]] + values[k])
        for i in range(n - 2, -1, -1):
            bwd[i] = bwd[i + 1]
            for k in begins[i]:
                bwd[i] = add(bwd[i], bwd[at[segs[k][1]]] + values[k])
        total, right = fwd[-1], set(gold)
        value = -total
        for k, g in enumerate(segs):
            p = math.exp(min(0.0, fwd[at[g[0]]] + values[k] + bwd[at[g[1]]] - total))
            d = (g in right) - p
            if g in right:
                value += values[k]
            if abs(d) > 1e-3:
                for f in feats[k]:
                    grad[f] += d
        return grad, value


# -- training ---------------------------------------------------------------------------------------------
# What the made-up sentences are made of. Slots: {N} name, {E} address for mail, {P} phone, {I} identity number, {A} address,
# {x} a product-like word, {n} a small number, {R} a rare word that is no name, {B} a number of a thing, {G} a given name that
# is a word here, {C} a common word, {K} a common word in capitals, {w} a filler, {D}, {h} long numbers and hashes, {T} a time,
# {U} an address with a login, {V} a rare word in capitals.
WITH = r"""Reviewed by {N} on 2024-03-02.|Signed, {N}|requester: {N}|owner={N}, team=blue|"author": "{N}"|cc {E}, thanks.|phone: {P}|phone={P}; ticket={n}|"phone": "{P}"|contact={E}|contact: {E}|mail {E} or phone {P}
id={I}; name={N}|national id: {I}|identity card {I} was shown|ssn {I} on file|tax number {I}|ship to={A}; opened=2024-02-01|lives at {A}|user: my name is {N}|assistant: thanks, {N}!|from {N}|To: {N} <{E}>
{N} wrote to {E}.|Spoke to {N} and {N} today.|tel {P}|Fax {P}|- {N}|(c) {N}|approved by {N}.|{N} signed the form.|INFO user="{N}" ip=10.2.3.4|# contact {N}|// ask {N} first|-- owner: {N}|The visit was arranged by {N}.
A letter from {N} arrived on Monday.|We spoke with {N}, who lives at {A}.|Her number is {P} and her mail is {E}.|Send a copy to {N}, {A}.|Question for {N}: is {x} still in use?|Thanks to {N} for the fix.
{N} joined the call late.|Hi {N},|Dear {N},|Regards, {N}|Best, {N}|assigned to {N}|Author: {N}|reporter={N} priority={n}|manager: {N}, floor {n}|- {N} ({E})|* {N}, {P}|{N};{E};{P}|{N},{E},{A}|contact person {N}
handled by {N} on the second day|According to {N}, {x} failed {n} times.|As {N} wrote, the rows are gone.|the tenant {N} moved out|patient {N} came in at noon|invoice address: {N}, {A}|his lawyer {N} sent {n} pages
{N} and {N} disagreed about {x}.|{w} {w} to {A} {w} {w}|{w} to {A} before {w}|bring it to {A}|{w} {w} at {A} {w}|sent to {A} on {w}|{A} is where {w} {w}.|Her new flat is at {A} as of May.|Pick the parcel up at {A}.|office: {A}|address={A}; floor={n}|"address": "{A}"|The van goes to {A} twice a week.|home address {A}
The garden behind {A} floods.|from {A} to {A}|{A} was sold.|If {x} stops, phone {P}.|Her extension changed, dial {P} now.|mobile {P}, office {P}|You can reach me at {P} until six.|hotline={P}|"mobile": "{P}"|call {P}
call me back on {P}|The old line {P} is dead.|SMS to {P} failed|fax: {P}|email={E}|"email": "{E}"|E-mail {E} bounced {n} times.|write to {E} for a copy|{E} was unsubscribed|from: {E}|to {E} and {E}
The alias {E} forwards to {E}.|Forwarded by {E}|author <{E}>|sender {E}; retries={n}|Her passport, {I}, has expired.|The tax office knows the case as {I}.|passport: {I}|passport no {I}, issued in May
social security number {I}|ssn={I}|"ssn": "{I}"|insurance no. {I} of {N}|Citizen {I} applied twice.|personal code {I}; floor={n}|licence {I} was renewed|id card {I} was copied|tax id {I}|taxpayer {I} moved|national no {I}, {N}|"tax id": "{I}"|national insurance {I}|identity {I} was checked by {N}|tax no. {I} / {N}|id document {I}|the {w} tax number is {I}|ident={I}; tax={I}|national identity no: {I}
{w} {w}. {N} asked {w}|{w} {w} {w}. {N} {w}|{w}! {N} wrote.|{w} {n} ms. {N} {w}|{n} ms. {N} asked {w}|took {n} Ms. {N} wrote|{w} number: {P}|telephone number {P}|number to call: {P}|call {N} on {P}|ring Mr. {N} at {P} {w}|{w} {w} or call {P}.|{E} / {P}|{N} / {P}|{P} ({N})|{N}, {A}|label: {N}, {A}|{w} {w}: {N}, {A}|
{w} {w} {N} {w} {w}.|{w} {N} {w}
{w} {w} {w} {E} {w}|{w} {A}, {w} {w}|{w} {w} {N}, {w} {w} {n}|{N}: {w} {w} {w}|{w}={N}|{w}: {N}|"{w}": "{N}"|{w} {w} by {N}.|{w} {w} to {N}.|{w} {w} from {N} {w} {w}|{N} {w} {w} {w}.""".replace("\n", "|").split("|")
WITHOUT = """peer=10.22.8.22 took=3945ms|2024-06-08T17:08:00Z WARN trace=918448efc38f|The checksum 7609{n} belongs to {x}.|Use p@6 and n@3842 as the two metrics.|Suite 15 of the {x} tests covers the layouts.
redis://svc:Pw9xx@cache.{x}.example:8080/db|Grace period for {x} is {n} days.|On 2024-05-10, the step pinned {n} rows in 2850 ms.|version {n}.{n}.{n} of {x}|ticket CQ00000{n}1234 by {R}|The {R} parser failed.
set {R} to {n}|const {R} = {n};|{R}_{n} = load({n})|see {R}.{x} for more|order {B} shipped|serial {B}|timestamp {T}|epoch={T}|{n} retries on the way|{n} rows took the long way, {x} said|In {n} ms the drive was full
file {R}.txt|{R} {R} {R}|run {R} again|key={R}{n}|{x} asked why it was slow.|Signed, {x}|The step by {R} was slow.|a {R} of {x}|{h},{D},{h},{h},{D},{D},{h}|{R}{n}:{h},{D},{h},{D}|{D}, {D}, {h}|values ({D}, {D}, {n})
"opened": "2024-01-214"|ALTER ROLE app3 {R} BY "x9"|SELECT {R}, {R} FROM {R}_{n}|export {R}={n}|def {R}(rows):|import {R}|{R} {R} = {n}|{x} and {R} were merged.|{G} {C} of {x} was {n}.|The step kept {G} {C} low.
set {G} {C} to {n}|{G} {C}: {n}|- {G} {C}|{G} {C} and {C} of {x} are kept.|In short, {G} {C} fell. {G} {C} rose.|## {C} {G} the {C} of {x} rise?|{C} {G} a {C} still take {n}?|Lot {B} went back to the press.
Bill {B} was paid by {x}.|{x} ships build {B} next week.|The counter stood at {T} when {x} began.|subnet 10.{n}.7.0/16 holds {x}|hash {R} of {x}|mention @{x} or use #{n}|ratio @{n} and gain x@{n}
Row 15 of the plan covers {x}.|Lane 2 is slow, lane 7 is not.|A street, a road and a way are all edges here.|Mr. and Dr. are cut off by {x}.|Drop the note once {x} was read.|Count frank remarks on {x}.
A grace of {n} days holds for {x}.|{n} rows hit: {B}|{x} owns it.|{x} found it.|Pennies saved by {x}: {n}|art, sound and maps are kept apart by {x}|The court of {x} has {n} notes.|{G} {C} was {n} before {x} came.
In {n} s. {G} {C} shrank.|why does {G} {C} take {n}?|All {G} {C} of {x}|No {G} {C} was left.|{G}: {C} and {C}|Read {G} {C} first.|When {G} {C} ends, {C} {G} starts.|{C}, {G} {C}, {C}|{n} {G} {C}|the {G} {C}
a {G} {C} of {n}|new {C} for {G} {C}|{R} {K} failed.|The {R} {K} is down.|Restart {R} {K} at night.|{R} {K} and {R} {K}|see {R} {K}, page {n}|{K} {R} took {n} ms|{R} {K}: {n}|Deploy {R} {K} to {x}.|{K} of {R} {K}
{w} {w} {R} {w} {w}.|{w} {R} {w}|{w} {w} {R}, {w} {w} {n}|{R}: {w} {w}|{w}={R}|{w}: {R}|{w} {w} by {R}.|{w} {w} by {x}.|{w} {w} to {R}.|{R} {w} {w} {w}.|{x} {w} {w}|{w} {n} {w} {B}|{w} {B} {w}|{w}={B}|"{w}": "{B}"|job {B}
{w} number {B}|ref {B} of {x}|{D} {w}|{w} {h}|pid={D}|seq {D}|{D} rows|lot {B}, crate {n}|opened on 2024-03-0{n}|from 2024-05-1{n} to 2024-06-11|port 80{n} of 10.2.{n}.4|size {D} bytes|ticket #{D}|{w} {x}: {n}, {n}, {n}
v{n}.{n}|step {n} of {n}|{n} {w} and {n} {w} were {w}|range {D}-{D}|ISBN {D}|order no {B}|parcel {D} left|line {n}: {R}({D})
{U}|{U}|url={U}|{w}={U}|"{w}": "{U}"|connect("{U}")|{w} {w} {U} {w}|export {R}={U}|client -u root -p'{R}'|client -u app -p'{R}{n}' {w}|tool -h {w} -u {R} -p {R}|dump -u {w} {w}|{R} {R} {K} {K} {w}|The {K} Had Finished. {R} {K} At {n}|{n} ms. {K} {w}|in {n} Ms. {K} {w} {w}|took {n} Ms. Later {w}|{w} {n} MS. {K}: {w}|{n} Ms. {G} {C} {w}|{w} {n} ms. {G} {C} {w}|After {n} ms.   {K}   {w}|{w} {w}. Dr. {K} {w}|{w} {w}. Dr. Later {w}|{w} with {w}\n{B}. {w}|{w} build\n{B}|{w} Build {B}. {K} {w}|-----BEGIN {V} PRIVATE KEY-----|# -----END {V} PRIVATE KEY-----|  -----BEGIN {V} PUBLIC KEY-----|{V} ERROR {w}|{V} NOT NULL|{w} {V} PRIMARY KEY|{V} {V} FAILED: {n}|{w} {V} TABLE {w}|user: {G} {C} at {n} {w}|{w} {w}. {G} {C} At {n} {w}|user: {G} {C} {w} {n}|assistant: {G} {C} {w}|{w}: {G} {C} at {n}|{w} {w} {G} {C} at {n} {w}|{G} {C} at {n} {w} {x}|user: {w} {G} {C} {w}|user: {C} {C} {w} {n}|CREATE USER {w} IDENTIFIED BY "{R}!{R}{n}"|GRANT {K} TO {w} IDENTIFIED BY '{R}{n}{R}';""".replace("\n", "|").split("|")


#: Surnames that are short, or that are common words and known as such in training.
COMMON_SURNAMES = "Kim Lee Cox Ng Li Fox May Brown Short Stone Field Banks Price Rivers Marsh Bell Cook Page".split()


#: Common words that stand behind words which are also given names.
PLAIN_WORDS = "engine cache planner sources step rows order report filter form version serial batch queue record feedback rules layouts notes".split()


def _made_up(rng: random.Random, given: list[str], having: list[str] = WITH, lacking: list[str] = WITHOUT) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence with persons' data, or one without, and where its segments are."""
    pick, d = rng.choice, lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syllables = lambda k: "".join(pick("bdfghjklmnprstvz") + pick("aeiou") for _ in range(k))

    def surname() -> str:
        if rng.random() < 0.12:
            return pick(COMMON_SURNAMES)
        s = (syllables(rng.randint(2, 4)) + pick(["", "n", "r", "sk", "rt", "ck", "th", "l", "x", "nd", "m"])).capitalize()
        return pick([s] * 6 + [s + "-" + syllables(3).capitalize(), "van " + s, "Ó" + s])

    def name() -> str:
        # some given names aren't in any list
        g, s = (pick(given) if rng.random() < 0.85 else syllables(pick([1, 2])) + pick(["", "m", "n", "lt"])).capitalize(), surname()
        n = pick(
            [f"{g} {s}"] * 8
            + [f"{s}, {g}", f"{s}, {g}", f"{g} {pick('ABCDEFGHKLMNPRST')}. {s}", f"{pick(['Mr', 'Ms', 'Dr', 'Prof', 'Mrs', 'Dr.', 'Prof.', 'Mr.', 'Ms.'])} {s}", f"{pick(['Mr', 'Ms', 'Dr.', 'Prof.'])} {g} {s}", f"{g[0]}. {s}", f'{g} "{g[:3]}" {s}', f"{s} {g}"]
        )
        return pick([n] * 8 + [n.lower(), n.upper()])

    def mail() -> str:
        local = pick([f"{pick(given)}{d(2)}", syllables(4), f"{syllables(3)}_{pick('abcdefg')}", f"{pick(given)}.{syllables(4)}", f"{pick(given)}-{syllables(4)}+ctx"])
        dom = pick([f"{syllables(3)}.example", f"mail.{syllables(3)}.test", f"{syllables(2)}.com", f"dept.{syllables(3)}.invalid"])
        m = pick([f"{local}@{dom}"] * 5 + [f"{local} @ {dom}", f"{local} [at] {dom}", f"mailto:{local}@{dom}", f"{local} (at) {dom.replace('.', ' dot ')}"])
        return pick([m] * 6 + [m.upper()])

    def phone() -> str:
        a, b = d(3).replace("0", "4"), d(4)
        return pick([f"+1 ({a}) 555-{b}", f"({a}) 555 {b} ext. {d(2)}", f"{a}-555-{b}", f"{a}.555.{b}", f"{a} five five five {b}", f"1{a}555{b}", f"+44 20 7946 {b}", f"+44 (0)7700-900-{d(3)}", f"+33 1 99 00 {d(2)} {d(2)}", f"01.99.00.{d(2)}.{d(2)}", f"+49 (0)30 23125 {d(3)}", f"+49 30 {d(7)}", f"0{d(3)} {d(6)}", f"({a}) {d(3)}-{b}", f"00{pick(['61', '44', '33', '1'])} {a} {d(3)} {d(3)}"])

    def ident() -> str:
        return pick([f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"9{d(8)}", f"XK-{d(3)}.{d(3)}.{d(2)}", f"XK{d(7)}", f"ZZ{d(6)}{pick('ABCD')}", f"{pick('456789')}{d(10)}", f"{pick('456789')}{d(10)}", f"{pick('456789')}{d(10)}", f"9{d(8)}", f"{d(9)}", f"{pick('ABGHJQQ')}{pick('BCGHQQ')} {d(2)} {d(2)} {d(2)} {pick('ABCD')}"])

    def address() -> str:
        st = pick([syllables(3).capitalize(), "Old " + syllables(3).capitalize(), syllables(2).capitalize() + " Hollow"])
        town = pick([syllables(3).capitalize(), "New " + syllables(3).capitalize(), "Little " + syllables(2).capitalize()])
        a = pick([f"{rng.randint(1, 900)} {st} {pick(['Street', 'St.', 'Ave', 'Road', 'Way', 'Dr', 'Lane'])}, {town}", f"{rng.randint(1, 900)} {st} Blvd Apt {rng.randint(1, 30)}{pick('ABC')}, {town} {d(5)}", f"Flat {rng.randint(1, 30)}, {rng.randint(1, 99)} {st} Road, {town}", f"{rng.randint(1, 99)} bis, rue {st}, {d(5)} {town}", f"{st.replace(' ', '')}straße {rng.randint(1, 50)}a, {d(5)} {town}", f"{rng.randint(1, 99)} {st} {pick(['Close', 'Lane'])}, {town} TQ0 {d(1)}ZZ", f"PO Box {d(4)}, {town}", f"{rng.randint(1, 900)} {st} Way\n{town} {d(5)}"])
        return pick([a] * 6 + [a.lower(), a.upper()])

    secret = lambda: "".join(pick([syllables(2), syllables(1).capitalize(), d(3), pick("!*^_-#+.~"), d(1)]) for _ in range(rng.randint(3, 6)))
    word = syllables(rng.randint(2, 4))
    spelt = pick([str.lower, str.capitalize, str.capitalize, str.upper, str.swapcase])
    make = {
        "U": (lambda: f"{pick(['redis', 'amqp', 'postgresql', 'https', 'jdbc:mysql', 'smtp'])}://{pick(['svc', 'root', 'app', syllables(2)])}:{secret()}@{pick(['db', 'cache', 'mail.' + syllables(2), 'dept'])}.{syllables(3)}.{pick(['example', 'test', 'com'])}:{d(4)}/{syllables(2)}", ""),
        "V": (lambda: syllables(rng.randint(2, 4)).upper(), ""), "w": (lambda: pick(FILLERS), ""), "K": (lambda: pick(THINGS), ""), "G": (lambda: spelt(pick(given)), ""), "C": (lambda: pick([str.lower, str.lower, spelt])(pick(PLAIN_WORDS)), ""),
        "N": (name, "NAME"), "E": (mail, "EMAIL"), "P": (phone, "PHONE"), "I": (ident, "ID_NUMBER"), "A": (address, "ADDRESS"), "x": (lambda: pick(["Kilnworth", "Foxhall", "engine", "cache"]), ""), "n": (lambda: str(rng.randint(2, 4000)), ""),
        "R": (lambda: pick([word, word.capitalize(), word.upper(), word + word]), ""), "B": (lambda: pick([f"{d(4)}-{d(3)}-{d(2)}", f"2024-{d(4)}-{d(3)}", f"{d(4)}.{d(2)}.{d(1)}", f"{d(4)}.{d(1)}.{d(2)}", d(5), f"{d(3)}-{d(3)}-{d(2)}", f"2024-{d(3)}-{d(3)}"]), ""), "T": (lambda: f"1718{d(7)}", ""),
        "D": (lambda: f"{pick('123456789')}{d(pick([7, 8, 9, 10]))}", ""), "h": (lambda: pick([f"{d(4)}a{d(2)}fe{d(1)}", f"de{d(7)}", f"{d(3)}{pick('abcdef')}{d(6)}"]), ""),
    }
    out, gold = "", []
    if rng.random() < 0.45:
        out = pick(["ticket: CQ X000003119\n", "opened=2024-02-01; ", '"rows affected": "812", ', "severity: 3\n", "retries: 5\nrows affected: 20391\n", "depends on=cache; ", "user: ", "- ", "The planner moved several sources. ", "12. ", "// ", "# ", "> "])
    for part in re.split(r"(\{\w\})", pick(having if rng.random() < 0.6 else lacking)):
        if re.fullmatch(r"\{\w\}", part) and part[1] in make:
            f, kind = make[part[1]]
            v = f()
            if kind:
                gold.append((len(out), len(out) + len(v), kind))
            out += v
        else:
            out += part
    return out + pick(["", " The step was slow.", "\n", " Later it stopped"]), gold


#: Fillers: words of any text.
FILLERS = "once later note list early paper seen from about with under both near again part asked sent copy plan room half open kept time found below quite three left told next week gone".split()
THINGS = "Engine Cache Planner Server Table Index Queue Worker Report Service Team Office Press House Bank Station North Street Valley Group".split()


#: So many made-up sentences train the weights, seen so often.
SENTENCES, EPOCHS = 4000, 4


def train(common: set[str], given: set[str], seed: int = 11, having: list[str] = WITH, lacking: list[str] = WITHOUT) -> dict[str, float]:
    """Weights of the features, by AdaGrad on the conditional likelihood."""
    rng = random.Random(seed)
    frequent = {w for s in having + lacking for w in _WORD.findall(lower(s))} | {"kilnworth", "foxhall", "engine", "cache", "five"} | {"old", "new", "little", "hollow", "planner", "moved", "several", "sources", "step", "slow", "later", "stopped", "user"}
    frequent |= {w.lower() for w in COMMON_SURNAMES if len(w) > 3} | set(PLAIN_WORDS) | set(FILLERS) | {w.lower() for w in THINGS}
    tagger = Tagger(frequent | {w for w in common if len(w) < 4}, given)
    first = sorted(g for g in given if g.isalpha()) or ["maria", "peter", "robert"]
    data = [_made_up(rng, first, having, lacking) for _ in range(SENTENCES)]
    seen: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(EPOCHS):
        rng.shuffle(data)
        for text, gold in data:
            grad, _ = tagger.gradient(text, gold)
            for f, g in grad.items():
                seen[f] += g * g
                tagger.weights[f] = tagger.weights.get(f, 0.0) + 0.5 * g / math.sqrt(seen[f])
    return tagger.weights


def common_words(texts: DataFrame, text: str, share: float, least: int) -> set[str]:
    """Words that stand in at least that share of the rows given; there are no more than words of a row, by the share."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(words(lower(t)))
                n += 1
            if len(found) > 500_000:
                yield table(found, n)
                n, found = 0, Counter()
        yield table(found, n)

    def table(found: Counter, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["", *found], pa.string()), pa.array([n, *found.values()], pa.int64())], ["word", "n"])

    counts = texts.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).checkpoint()
    rows = (counts.where("word = ''").first() or [0, 0])[1] or 0
    return {r.word for r in counts.where((F.col("n") >= max(least, share * rows)) & (F.col("word") != "")).select("word").collect()}


#: A word in at least this share of all different texts, and in so many, is common.
COMMON_SHARE, COMMON_LEAST = 0.002, 12


def find(texts: DataFrame, key: list[str], text: str, given: set[str], placeholders: bool = False, common_share: float = COMMON_SHARE, common_least: int = COMMON_LEAST) -> DataFrame:
    """``key``, ``kind`` and ``n``: how many segments of each kind a text has; or with ``placeholders``, ``key``
    and ``redacted``: each text with its segments replaced by ``[KIND]`` and all else unchanged.

    Words that stand in ``common_share`` of all different texts, and in ``common_least``, are common; others are rare, which
    is a feature of names and no condition: beside a given name, title or initial any word is proposed.

    Null and empty texts hold nothing: they have no rows, or come out as they are. Whole texts are read,
    whatever their length. Row by row: repeated rows are repeated in the result. Further columns are
    dropped, whatever their names; an empty table gives no rows.
    """
    spark = texts.sparkSession
    ship(spark)
    full = texts.where(F.col(text) != "")
    common = common_words(different(full, key, text), text, common_share, common_least)
    shared = spark.sparkContext.broadcast((common, given, train(common, given)))
    rows = (texts if placeholders else full).select(*key, text)
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*shared.value)
        for b in batches:
            keys = b.select(key)
            if placeholders:
                out = [None if t is None else redact(t, tagger.decode(t)) for t in b.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(out, pa.string())], [*key, "redacted"])
                continue
            at, kind, count = [], [], []
            for i, t in enumerate(b.column(n).to_pylist()):
                for k, c in Counter(g[2] for g in tagger.decode(t)).items():
                    at.append(i)
                    kind.append(k)
                    count.append(c)
            idx = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(idx) for c in keys.columns), pa.array(kind, pa.string()), pa.array(count, pa.int32())], [*key, "kind", "n"])

    schema = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in key)
    return rows.mapInArrow(run, schema + (", redacted string" if placeholders else ", kind string, n int"))


def redact(text: str, segments: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for s, e, kind in segments:
        out += [text[last:s], f"[{kind}]"]
        last = e
    return "".join([*out, text[last:]])
