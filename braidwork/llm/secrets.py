"""Credentials in source code and configuration: found by line, and redacted in place.

A literal counts by its place and its form. Places are assignments, arguments, options and headers whose
name ends in a word for credentials, logins in URLs, logins in command lines, encoded logins, and the
markers of private keys. There, the literal is split into dictionary words by Viterbi's algorithm, the
dictionary being the words of the corpus itself; what no word explains is its residual. A long residual is
a secret, a literal that words explain is a name, a reference or a placeholder. People make passwords from
words, so in places for passwords a shorter residual will do, and digits are never explained there. Known
hash formats under names of hashes are no secrets.

Two kinds come by their form alone: private keys, by their markers, and pass phrases, several plain words in
quotes under the name of a password, none of which belongs to a sentence.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, checked_broadcast, once, ship
from .texts import different

#: A word of the dictionary stands in so many different texts at least, and in one of so many.
WORD_ROWS, WORD_SHARE = 3, 20_000

_WORDS = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}(?![a-z])")
# Long literals of letters and digits: keys, hashes, ids. What letters stand in them are no words.
_LITERAL = re.compile(r"(?i:\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b)|(?=[A-Za-z+=]*[0-9])(?=[0-9+=]*[A-Za-z])[A-Za-z0-9+=]{12,}")


def _words(text: str) -> set[str]:
    return {w.lower() for w in set(_WORDS.findall(text)) if len(w) <= 20}


def word_counts(df: DataFrame, key: str, text: str, least_rows: int = WORD_ROWS, one_in: int = WORD_SHARE) -> dict[str, int]:
    """The dictionary: in how many different texts each word stands outside long literals.

    Words of fewer than ``least_rows`` texts, or of less than one in ``one_in``, are none; so the dictionary has at most
    ``one_in`` times the words of a text, however large the corpus, and grows no false words as it does. Letters that
    stand inside long literals in more texts than outside are no word, however many texts there are.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[str] = Counter()
            inside: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                found.update(_words(_LITERAL.sub(" ", t)))
                inside.update(_words(" ".join(_LITERAL.findall(t))))
            every = list(found | inside)
            every.append("")  # stands for the texts
            found[""] = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in (found, inside))], ["word", "n", "inside"])

    texts = different(df, [key], text)
    counts = texts.mapInArrow(run, "word string, n bigint, inside bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).checkpoint()
    total = (counts.where("word = ''").first() or ["", 0])[1]
    words = counts.where((F.col("n") >= max(least_rows, total / one_in)) & (F.col("n") >= F.col("inside")) & (F.col("word") != ""))
    return {r.word: r.n for r in words.select("word", "n").collect()}


class Segmenter:
    """Splits literals into dictionary words and unexplained characters at the least cost."""

    UNKNOWN = 4.5

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) + 1
        # words of three or four letters also turn up by chance: rare ones cost what they are rare, up to more than unknown letters
        self.cost = {w: 1.0 + math.log(total / n) if len(w) < 5 else min(11.0, 1.0 + math.log(total / n)) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)

    def residual(self, literal: str, digits: bool = True) -> int:
        """How many letters and digits of a literal no word explains. With ``digits``, runs of up to 4 beside words are
        explained; without, none is."""
        left = 0
        for run in re.findall(r"[A-Za-z0-9]+", literal):
            for i in range(0, len(run), self.PART):
                left += self._run(run[i : i + self.PART], digits)
        return left

    #: Runs are split in parts of so many characters, so that one of any length is read in linear time and little memory.
    PART = 4096

    def _run(self, s: str, digits: bool = True) -> int:
        low, n = s.lower(), len(s)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(1e9, 0)] * n
        for i in range(n):
            c, r = best[i]
            if low[i].isdigit():
                j = i
                while j < n and low[j].isdigit():
                    j += 1
                clean = digits and j - i <= 4 and (i == 0 or low[i - 1].isalpha()) and r == 0
                step = (c + (3.0 if clean else self.UNKNOWN * (j - i)), r + (0 if clean else j - i))
                best[j] = min(best[j], step)
            best[i + 1] = min(best[i + 1], (c + self.UNKNOWN, r + 1))
            for j in range(i + 3, min(n, i + self.longest) + 1):
                k = self.cost.get(low[i:j])
                if k is not None:
                    best[j] = min(best[j], (c + k, r))
        return best[n][1]


# Words for credentials, at the end of names; fixed values.
_PASSWORD = r"pass(?:word|wd|phrase)?|pwd"
_OTHER = r"secret|token|key|authorization|auth|bearer|credentials?|hmac|apikey"
_QUOTED = r"""(?P<q{0}>\\?["'`])(?P<v{0}>(?:(?!(?P=q{0}))[^\n\\]|\\.)+?)(?P=q{0})"""
_PLAIN = r"(?P<{0}>[^\s\"'`,;(){{}}<>\[\]|]+)(?![(\[])"

#: Places where literals stand; the named groups q*, v*, p* hold the literal.
_PLACES = re.compile(
    "|".join(
        [
            # name = literal, name: literal, "name", "literal", name("literal"), also over a line end before a quote
            rf"(?P<k>{_PASSWORD}|{_OTHER})\d*[\"'\]]*\s*(?:=>|:=|==?|:|,|\()\s*(?:\(\s*)?(?:{_QUOTED.format(1)}|(?<=[:=]){_PLAIN.format('p1')}|(?<=[:=][ \t]){_PLAIN.format('p2')})",
            # --name literal, WITH PASSWORD 'literal', login x password literal
            rf"(?<=--)(?P<k2>{_PASSWORD}|{_OTHER})[ \t]+(?:{_QUOTED.format(2)}|{_PLAIN.format('p3')})",
            rf"\bpassword\s+{_QUOTED.format(3)}",
            rf"\blogin\s+\S+\s+password\s+{_PLAIN.format('p4')}",
            rf"\bidentified\s+by\s+(?:{_QUOTED.format(4)}|{_PLAIN.format('p5')})",
            rf"\blogin\s*:\s*[\w.@-]+\s*/\s*{_PLAIN.format('p6')}",
            rf"(?<=\s)-u\s*[\"']?[\w.@-]+:{_PLAIN.format('p7')}",
            rf"(?<=\s)-p{_QUOTED.format(5)}",
            # a login in a URL; an address that is itself a secret
            r"://[^\s:/@\"'`<>]*:(?P<url>[^\s/\"'`<>]+)@",
            r"https?://(?P<hook>[^\s\"'`<>]+)",
            # forms that are credentials anywhere
            r"\b(?P<form>AKIA[0-9A-Z]{16}\b|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})",
            r"\bname\s*:\s*[\"']?(?P<env>[A-Za-z0-9_]+)[\"']?\s*\n\s*(?:-\s*)?value\s*:\s*(?:" + _QUOTED.format(6) + "|" + _PLAIN.format("p8") + ")",
            r"-----BEGIN (?P<pem>(?:[A-Z0-9]+ )*)PRIVATE KEY-----",
        ]
    ),
    re.I,
)
_VALUES = ["v1", "p1", "p2", "v2", "p3", "v3", "p4", "v4", "p5", "p6", "p7", "v5", "url", "hook", "form", "v6", "p8"]
_ALWAYS_PASSWORD = {"v3", "p4", "v4", "p5", "p6", "p7", "v5", "url"}
# What stands before or at the start of every place, for lower-case text: a quick search for lines worth a look.
_HIT = re.compile(
    r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|authorization|auth|bearer|credentials?|hmac)\d*(?:[\"'\]]*\s*(?:[:=,(]|\n)|[ \t]+[^ \t])"
    r"|login[ :]|identified|://|akia|eyj|[ \t]-[up]|-----begin|_(?:token|key|secret|password)\b"
)
_BEFORE = re.compile(r"[\w.\-]{0,64}\Z")
_NO_NAME = re.compile(
    r"hash|digest|checksum|public|pub_|_pub|fingerprint|etag|keyboard|monkey|turkey|commit(?!t)"
    r"|(?:cache|sort|primary|foreign|partition|index|object|s3)[-_. ]?(?:key|token)s?\d*$",
    re.I,
)
#: Parts of names of hashes and ids; fixed values.
_HASH_PARTS = {"id", "ids", "sum", "sha", "md", "rev", "revision"}
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PLACEHOLDER = re.compile(
    r"^\$[\w{(]|^%[sd({]|^%\w+%$|^:\w+$|^<|\$\{|\{\{|^\W*$|^(?:x+|\*+|\.+|null|none|nil|true|false|undefined|todo|tbd|password|passwd|secret|token|changeme|change[-_ ]?it|redacted|placeholder|example|dummy|default|required)\W*$"
    r"|^your\b|your[-_]|[-_]here$|^<|^(?:sha\d+|md5)[:-]|^\$2[aby]\$|\*{3,}|x{5,}|^env[.:]|^vault:|^file:|^/(?:run|etc|var|home|opt)/",
    re.I,
)
#: Words of sentences: a text that has one of them is no pass phrase.
_SENTENCE = set(
    "the and for not must your you with that this from into have has was were will can may are any all please enter type use used new old set change changed reset password passphrase secret token user login invalid wrong required missing here "
    "value string least characters long should when then else than only very more most our their its but per via after before until because while about over under".split()
)
#: With a digit, or with both cases.
_MIXED = re.compile(r"[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]", re.S)
_FORM = re.compile(r"AKIA[0-9A-Z]{16}")
_SCHEME = re.compile(r"^(bearer|basic|token|digest)\s+", re.I)
_HEX = re.compile(r"^[0-9a-f]{32}$|^[0-9a-f]{40}$|^[0-9a-f]{56}$|^[0-9a-f]{64}$|^[0-9a-f]{96}$|^[0-9a-f]{128}$", re.I)
_CODE = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)+;?$")


#: The kind of a further part of a value: it is redacted and is no value of its own.
CONTINUED = "continued"
_CONTINUED = re.compile(r"""["'](?:[ \t]*\\?\n\s*|[ \t]*\+\s*)["']([\w+/=.\-]{6,})(?=["'])""")


class Finder:
    """Finds credentials in one text."""

    def __init__(self, counts: dict[str, int], least: int = 8) -> None:
        self.words, self.least = Segmenter(counts), least

    def _login(self, encoded: str) -> bool:
        """Whether a literal is a login in base64, and no words."""
        try:
            raw = base64.b64decode(encoded + "=" * (-len(encoded) % 4), validate=True)
        except (binascii.Error, ValueError):
            return False
        user, colon, rest = raw.partition(b":")
        return bool(user and colon and rest) and all(32 <= c < 127 for c in raw) and self.words.residual(encoded) >= self.least // 2

    def _password(self, v: str) -> bool:
        if len(v) < 6 or _PLACEHOLDER.search(v):
            return False
        if " " in v.strip():
            return self._phrase(v)
        digits = any(c.isdigit() for c in v)
        if _CODE.match(v) and not digits:
            return False
        marks = sum((digits, any(c.isalpha() for c in v), any(not c.isalnum() for c in v)))
        # with digits, which no word explains, or with other marks, a short residual will do
        return self.words.residual(v, digits=False) >= (1 if digits and marks >= 2 else self.least)

    def _phrase(self, v: str) -> bool:
        """A literal with blanks: plain words in a row that make no sentence, or mostly residual."""
        ws = v.split()
        if {w.lower() for w in ws} & _SENTENCE:
            return False
        if len(ws) >= 4 and all(re.fullmatch(r"[a-z]{3,}|[A-Z][a-z]{2,}", w) for w in ws):
            return True
        left = self.words.residual(v)
        return bool(_MIXED.search(v)) and left >= self.least and 2 * left >= sum(c.isalnum() for c in v)

    def _secret(self, v: str, name: str) -> bool:
        if _PLACEHOLDER.search(v) or len(v) < 8 or v.isdigit() or " " in v.strip():
            return False
        if _NO_NAME.search(name) or (_HEX.match(v) and {p.lower() for p in _NAME_PART.findall(name)} & _HASH_PARTS):
            return False
        if not _MIXED.search(v) and not _FORM.fullmatch(v):
            return False
        left = self.words.residual(v)
        return left >= self.least and 2 * left >= sum(c.isalnum() for c in v)

    @staticmethod
    def _places(text: str) -> Iterator[re.Match[str]]:
        """Matches of places, in the lines with a hit and the two lines after each."""
        low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
        lo = hi = -1
        for h in _HIT.finditer(low):
            at = h.start()
            start = text.rfind("\n", 0, at) + 1
            if start > hi:
                if hi > lo >= 0:
                    yield from _PLACES.finditer(text, lo, hi)
                lo = start
            end = h.end()
            for _ in range(3):
                end = text.find("\n", end)
                if end < 0:
                    end = len(text)
                    break
                end += 1
            hi = max(hi, end)
        if hi > lo >= 0:
            yield from _PLACES.finditer(text, lo, hi)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Where values of usable credentials stand: start, end, kind; in order, without overlap."""
        out: list[tuple[int, int, str]] = []
        for m in self._places(text):
            if m["pem"] is not None:
                end = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY-----", re.I).search(text, m.end())
                out.append((m.start(), end.end() if end else m.end(), "private_key"))
                continue
            group = next(g for g in _VALUES if m[g] is not None)
            v, start, end = m[group], m.start(group), m.end(group)
            name = m["k"] or m["k2"] or m["env"] or ""
            if group == "hook" and (inside := re.match(r"[^\s:/@]*:([^\s/]+)@", v)):
                if self._password(inside[1]):
                    out.append((start + inside.start(1), start + inside.end(1), "url_login"))
                continue
            if group == "hook":
                if self._hook(text, m, v):
                    out.append((start, end, "secret_url"))
                continue
            if group == "form":
                if self.words.residual(v) >= self.least:
                    out.append((start, end, "token"))
                continue
            if m["k"]:
                name = _BEFORE.search(text[max(0, m.start() - 64) : m.start()])[0] + name
            if group in ("v6", "p8") and not re.search(rf"(?:{_PASSWORD}|{_OTHER})\d*$", name, re.I):
                continue
            if "-----BEGIN" in v and (key := re.search(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", v)):
                close = re.search(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----", v)
                out.append((start + key.start(), start + close.end() if close else end, "private_key"))
                continue
            scheme = _SCHEME.match(v)
            if not scheme and group in ("p1", "p2") and v.lower() in ("bearer", "basic", "token"):
                # an unquoted header: the value is the next word
                rest = re.compile(r"[ \t]+([^\s\"'`,;]+)").match(text, end)
                if rest:
                    scheme, start, end = _SCHEME.match(v + " "), rest.start(1), rest.end(1)
                    v = f"{v} {rest[1]}"
            if scheme:
                inner = v[scheme.end() :].strip()
                if start == m.start(group):
                    start += scheme.end()
                ok = self._login(inner) if scheme[1].lower() == "basic" else self._secret(inner, "bearer")
                if ok:
                    out.append((start, end, "token"))
                continue
            if group.startswith("p"):
                v = v.rstrip(".;,)")
                end = start + len(v)
                if "://" in v:
                    continue
            elif "://" in v and (inside := re.search(r"://[^\s:/@]*:([^\s/]+)@", v)):
                if self._password(inside[1]):
                    out.append((start + inside.start(1), start + inside.end(1), "url_login"))
                continue
            password = group in _ALWAYS_PASSWORD or re.search(rf"(?:{_PASSWORD})\d*$", name, re.I)
            if password and _NO_NAME.search(name) and group == "v1":
                continue
            if (self._password(v) if password else self._secret(v, name) or (not _NO_NAME.search(name) and self._login(v) and len(v) >= 8)):
                out.append((start, end, "url_login" if group == "url" else "password" if password else "token"))
                # literals that the code puts together: the value goes on in the next one
                while group.startswith("v") and (more := _CONTINUED.match(text, end)):
                    start, end = more.span(1)
                    out.append((start, end, CONTINUED))
        out.sort()
        kept: list[tuple[int, int, str]] = []
        for s in out:
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
        return kept

    def _hook(self, text: str, m: re.Match[str], address: str) -> bool:
        host, _, path = address.partition("/")
        before = text[max(0, m.start() - 40) : m.start()]
        if not re.search(r"hook", host + before + path[:12], re.I):
            return False
        return any(len(p) >= 12 and _MIXED.search(p) and self.words.residual(p) >= 10 and not _HEX.match(p) for p in re.split(r"[/?&=]", path))


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder for each value; quotes, names and the lines of a key's markers stay."""
    out, last = [], 0
    for start, end, kind in found:
        if kind == "private_key":
            inner = re.search(r"-----BEGIN [^-]*-----(.*?)-----END [^-]*-----\Z", text[start:end], re.S)
            if not inner:
                continue
            body = inner[1]
            lead = re.match(r"(?:\s|\\n)*(?:[#/*-]+\s*)?", body)[0]
            tail = re.search(r"(?:(?:\\n|\s)(?:\s*[#/*-]+\s*)?)*\Z", body)[0]
            out += [text[last : start + inner.start(1)], lead, "REDACTED", tail if tail != body else "\n"]
            last = start + inner.end(1)
        else:
            out += [text[last:start], f"REDACTED_{kind.upper()}"]
            last = end
    return "".join([*out, text[last:]])


def scan(files: DataFrame, contents: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, least_rows: int = WORD_ROWS, one_in: int = WORD_SHARE, redacted: bool = True) -> DataFrame:
    """Credentials of the listed sources: ``source_id``, ``line_no``, ``kind``, ``start``, ``end`` (offsets), ``redacted``.

    ``files`` has source_id, ``contents`` id and content. One row for each value; ``redacted`` is the whole
    text with all values replaced, in the first row of each source, null in its others (and in all, if it isn't
    wanted). A line's number counts from 1, lines ending at ``\\n``. Rows repeated under one id count once (the
    smallest content); null and empty contents have no rows; sources that aren't listed are not read. Further
    columns are ignored. ``least_rows`` and ``one_in`` decide what is a word, see ``word_counts``.
    """
    spark = files.sparkSession
    ship(spark)
    listed, _ = checked_broadcast(files.select("source_id").where("source_id IS NOT NULL").distinct(), broadcast_bytes)
    rows = once(contents.select(F.col("id").alias("source_id"), "content").where("content <> ''").join(listed, "source_id"), ["source_id"], "content", broadcast_bytes)
    counts = spark.sparkContext.broadcast(word_counts(rows, "source_id", "content", least_rows, one_in))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(counts.value)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = finder.find(t)
                line, at = 1, 0
                for k, (start, end, kind) in enumerate(found):
                    if kind == CONTINUED:
                        continue
                    line, at = line + t.count("\n", at, start), start
                    for c, x in zip(cols, (i, line, kind, start, end, redact(t, found) if redacted and k == 0 else None)):
                        c.append(x)
            types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], ["source_id", "line_no", "kind", "start", "end", "redacted"])

    return rows.mapInArrow(run, "source_id string, line_no int, kind string, start int, end int, redacted string")
