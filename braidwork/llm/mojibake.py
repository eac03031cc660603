"""Text that was decoded with a wrong encoding: found and, where possible, restored.

A smoothed character trigram model is trained on the tokens with a character beyond ASCII, of all clean
records. Its counts lie in tables of a bounded size, by a hash of the n-gram, so the model has a bound
whatever the corpus. For each such token of a text, every chain "encode as W, decode as T" that goes
through without error gives a candidate, and so do two such steps of mis-decoded UTF-8; the likeliest
candidate is accepted if it beats the token as it stands by a margin. The margin is validated on the tokens of
all clean records, each record held out of the model once: it is the one that best tells them as they are from
the same tokens decoded wrongly, in every way there is.

Texts are read by Python once, for their tokens. All else is done on the different tokens of the corpus,
each of which is judged once, and joined back.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, once, ship, spread

# Encodings in which text is often stored, and those that it is wrongly decoded with. Fixed values.
TRUE = ["utf-8", "cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850", "cp852", "cp932", "euc-jp", "gb18030", "big5"]
WRONG = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850", "cp852", "cp932", "euc-jp", "gb18030", "big5"]

_BEYOND = re.compile(r"[^\x00-\x7f]+")
_TO_SPACE = re.compile(r"[^\x00-\x20]+")
_NEXT_WORD = re.compile(r"[\x00-\x20]+([^\x00-\x20]{1,12})")
_LAST_WORD = re.compile(r"([^\x00-\x20]{1,12})[\x00-\x20]+\Z")
_STOP = re.compile(r"(?<=[。！？、，；：])")
_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_CONTROL = re.compile(r"[\x80-\x9f�]")
# Stretches of one script, with what belongs to none (ASCII, general punctuation, the replacement character) in and after them: half-width kana from four on, CJK
# with fewer of them, anything else.
_CJK, _HALF, _ANY = "\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uff60\uffe0-\uffee\U00020000-\U0003ffff", "\uff61-\uff9f", "\x00-\x7f\u2010-\u2027\ufffd"
_SCRIPTS = re.compile(rf"[{_ANY}]*(?:[{_HALF}]{{4,}}[{_HALF}{_ANY}]*|[{_CJK}{_HALF}](?:(?![{_HALF}]{{4}})[{_CJK}{_HALF}{_ANY}])*|[^{_CJK}{_HALF}{_ANY}][^{_CJK}{_HALF}]*)")
# What CJK stops became: those of EUC-JP and GB2312 as latin-1 and as half-width kana, those of UTF-8 as cp1252.
_DAMAGED_STOP = re.compile(r"(?<=¡£)|(?<=£¬)|(?<=｡｣)|(?<=､｣)|(?<=ã€‚)|(?<=ï¼Œ)")

#: Sizes of the count tables: trigrams, bigrams (also the contexts of trigrams), characters.
BITS3, BITS2, BITS1 = 22, 20, 16
M3, M2, M1 = (1 << BITS3) - 1, (1 << BITS2) - 1, (1 << BITS1) - 1


def _bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that were decoded to this text, or None. What cp1252 and the like leave undefined stands for itself."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not "\x80" <= c <= "\x9f":
                return None
            out.append(ord(c))
    return bytes(out)


def _parts(word: str) -> list[str]:
    return _STOP.split(word) if len(word) > 8 else [word]


def spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Where the tokens with a character beyond ASCII stand, and each as it is judged.

    White space and CJK stops end a token. One of a single character or two tells little by itself: it is
    judged with the word after it, or else the word before it.
    """
    if text.isascii():
        return
    end = 0
    for m in _BEYOND.finditer(text):
        if m.start() < end:
            continue
        start, end = m.span()
        while start and text[start - 1] > " ":
            start -= 1
        if inner := _TO_SPACE.match(text, end):
            end = inner.end()
        w = text[start:end]
        if len(w) > 2:
            at = start
            for p in _parts(w):
                if not p.isascii():
                    yield at, at + len(p), p
                at += len(p)
        elif after := _NEXT_WORD.match(text, end):
            yield start, end, f"{w} {after[1]}"
        elif before := _LAST_WORD.search(text[max(0, start - 40) : start]):
            yield start, end, f"{before[1]} {w}"
        else:
            yield start, end, w


def pieces(token: str) -> list[str]:
    """A token cut where its script changes and behind damaged stops; together, the pieces are the token."""
    if len(token) < 4:
        return [token]
    cut = _SCRIPTS.findall(token)
    if (rest := len(token) - sum(map(len, cut))) or not cut:  # neither script: ASCII and punctuation only
        cut.append(token[len(token) - rest :])
    return [p for x in cut for p in _DAMAGED_STOP.split(x) if p]


def tokens(text: str) -> list[str]:
    """The tokens with a character beyond ASCII as they are judged, digits made alike."""
    return [_DIGITS.sub("0", t) for _, _, t in spans(text)]


#: So many characters have to read as UTF-8 in a row before a record counts as unclean.
PROOF = {"cp1252": 1, "latin-1": 1, "cp1251": 4, "koi8-r": 4, "cp866": 4, "cp932": 4, "euc-jp": 4, "gb18030": 4, "big5": 4}


def utf8_inside(token: str) -> bool:
    """Whether a token, or a run of it beyond ASCII, reads as UTF-8 under a wrong encoding.

    One character that reads so is proof only for the two most usual encodings; letters of other scripts
    read so by chance, and need ``PROOF`` characters in a row.
    """
    for part in {token, *_RUN.findall(token)}:
        for w in WRONG:
            b = _bytes(part, w)
            if b and not b.isascii():
                try:
                    made = b.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                # a character of four bytes that fit is as good as two of fewer
                if sum((c > "\x7f") + (c > "\uffff") for c in made) >= PROOF.get(w, 2):
                    return True
    return False


def _h3(a: int, b: int, c: int) -> int:
    x = ((a * 0x9E3779B1 + b) * 0x85EBCA77 + c) * 0xC2B2AE3D
    return (x >> 17) & M3


def _h2(a: int, b: int) -> int:
    return (((a * 0x9E3779B1 + b) * 0x85EBCA77) >> 13) & M2


def count_tokens(found: Mapping[str, int]) -> tuple[Counter[int], Counter[int], Counter[int]]:
    """Counts by slot of a bag of tokens; each token stands between two marks of its start and one of its end."""
    n3, n2, n1 = Counter(), Counter(), Counter()
    for t, n in found.items():
        s = [2, 2, *map(ord, t), 3]
        for i in range(2, len(s)):
            n3[_h3(s[i - 2], s[i - 1], s[i])] += n
            n2[_h2(s[i - 1], s[i])] += n
            n1[s[i] & M1] += n
    return n3, n2, n1


class _Sparse(dict):
    """Counts of which most are 0."""

    def __missing__(self, slot: int) -> int:
        return 0


def _table(slots: np.ndarray, counts: np.ndarray, size: int) -> _Sparse | array:
    if 16 * len(slots) < size:
        return _Sparse(zip(slots.tolist(), counts.tolist()))
    full = np.zeros(size, np.int64)
    full[slots] = counts
    out = array("q")
    out.frombytes(full.tobytes())
    return out


class Model:
    """Trigram probabilities, interpolated with those of bigrams and characters and an even share for the unseen.

    Made of slots and counts for trigrams, bigrams and characters.
    """

    def __init__(self, *tables: tuple[np.ndarray, np.ndarray]) -> None:
        self.n3, self.n2, self.n1 = (_table(slots, counts, m + 1) for (slots, counts), m in zip(tables, (M3, M2, M1)))
        self.total = max(1, int(tables[2][1].sum()))
        self.starts = max(1, int(self.n1[3]))
        self._fitting: dict[tuple, list[str]] = {}

    def fitting(self, *how: object) -> list[str]:
        """``_fitting``, of the characters that the model has seen."""
        found = self._fitting.get(how)
        if found is None:
            found = self._fitting[how] = [c for c in _fitting(*how) if self.n1[ord(c) & M1]]  # type: ignore[arg-type]
        return found

    @classmethod
    def of(cls, found: Mapping[str, int]) -> Model:
        return cls(*((np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))) for c in count_tokens(found)))

    def near(self, a: int, b: int) -> float:
        """How likely one character follows another."""
        before = self.starts if a == 2 else self.n1[a & M1]
        return 0.005 / 5000 + 0.25 * self.n1[b & M1] / self.total + (0.75 * self.n2[_h2(a, b)] / before if before else 0.0)

    def log_likelihood(self, token: str, least: float = -math.inf) -> float:
        """Of a token; less than ``least`` if it is, without the exact value then."""
        n3, n2, n1, total, out = self.n3, self.n2, self.n1, self.total, 0.0
        s = [2, 2, *map(ord, token), 3]
        for i in range(2, len(s)):
            a, b, c = s[i - 2], s[i - 1], s[i]
            p = 0.005 / 5000 + 0.045 * n1[c & M1] / total
            before = self.starts if b == 2 else n1[b & M1]
            if before:
                p += 0.25 * n2[_h2(b, c)] / before
                pair = self.starts if b == 2 else n2[_h2(a, b)]
                if pair:
                    p += 0.7 * min(1.0, n3[_h3(a, b, c)] / pair)
            out += math.log(min(p, 1.0))
            if out < least:  # it can only fall
                return -math.inf
        return out


def candidates(token: str) -> Iterator[tuple[str, str]]:
    """Texts that the token may have been, each with its chain."""
    seen = {token}
    for w in WRONG:
        b = _bytes(token, w)
        if b is None or b.isascii():
            continue
        for t in TRUE:
            if t == w:
                continue
            try:
                made = b.decode(t)
            except UnicodeDecodeError:
                continue
            if made in seen or _CONTROL.search(made):
                if t != "utf-8" or made in seen:
                    continue
            seen.add(made)
            yield made, f"{w}>{t}"
            if t == "utf-8":
                for w2 in WRONG:
                    b2 = _bytes(made, w2)
                    if b2 and not b2.isascii():
                        try:
                            twice = b2.decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        if twice not in seen:
                            seen.add(twice)
                            yield twice, f"{w}>{t} {w2}>utf-8"


#: A token with a candidate so much likelier is left out of the next round's training; no margin is less.
DOUBT = 2.0
#: What it costs that characters were lost: natural logarithm of how seldom it happens.
LOST = 6.0
#: Beyond this gain a token is damaged, whatever else may be likelier still.
EVIDENT = 12.0
#: Lead bytes of UTF-8 as they stand in text that was read wrongly twice, by cp1252.
_LEADS = "ÃÂâ"
#: Bytes that are dropped: all that latin-1 has for control characters, or those that cp1252 leaves undefined.
_DROPPED = [bytes(range(0x80, 0xA0)), b"\x81\x8d\x8f\x90\x9d"]
_GONE = re.compile(r"[\x80-\x9f\ufffd]")


@lru_cache(100_000)
def _fitting(lead: int, left: bytes, need: int, gone: bytes) -> tuple[str, ...]:
    """The characters of a lead byte and what is left of its continuation, if bytes of ``gone`` were dropped."""
    tails = [bytes([x]) for x in gone]
    if need == 2:
        tails = [t for x in gone for t in (bytes([x, left[0]]), bytes([left[0], x]))] if left else [bytes([x, y]) for x in gone for y in gone]
    out = []
    for t in tails:
        try:
            out.append((bytes([lead]) + t).decode("utf-8"))
        except UnicodeDecodeError:
            continue
    return tuple(dict.fromkeys(out))


def _fill(model: Model, b: bytes, gone: bytes, only: str = "") -> tuple[str, int]:
    """Bytes read as UTF-8 of which those of ``gone`` were dropped: the text, and how many characters had to be guessed.

    A character with missing bytes is one that fits those that are left: that of ``only``, or else the likeliest after the
    one before and before the one that follows, among those the model has seen. Where none fits, nothing stands.
    """
    out: list[str] = []
    lost, i = 0, 0
    while i < len(b):
        lead = b[i]
        need = 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
        j = i + 1
        while j < len(b) and j - i <= need and 0x80 <= b[j] < 0xC0:
            j += 1
        left = b[i + 1 : j]
        if lead < 0x80:
            out.append(chr(lead))
        elif need and len(left) == need:
            try:
                out.append(b[i:j].decode("utf-8"))
            except UnicodeDecodeError:
                lost += 1
        elif need in (1, 2):
            fits = [c for c in _fitting(lead, left, need, gone) if c in only] if only else model.fitting(lead, left, need, gone)
            lost += 1
            if fits:
                before = ord(out[-1]) if out else 2
                after = b[j] if j < len(b) and b[j] < 0x80 else None
                out.append(max(fits, key=lambda c: (model.near(before, ord(c)) * (model.near(ord(c), after) if after else 1.0), c)))
        else:
            lost += 1
        i = j
    return "".join(out), lost


@lru_cache(100_000)
def _pair(b: bytes, encoding: str) -> str | None:
    """The one character of two bytes beyond ASCII."""
    try:
        c = b.decode(encoding)
    except UnicodeDecodeError:
        return None
    return c if len(c) == 1 and not _CONTROL.search(c) else None


def _fill_pairs(model: Model, b: bytes, encoding: str) -> str | None:
    """Bytes read as characters of two, of which those that cp1252 leaves undefined were dropped; None if they can't be.

    A dynamic program over the bytes keeps the likeliest text up to each.
    """
    gone = _DROPPED[1]
    top: list[tuple[float, str, int]] = [(0.0, "\x02", -1)] + [(-math.inf, "", -1)] * len(b)
    for i, x in enumerate(b):
        v, last, _ = top[i]
        if v == -math.inf:
            continue
        steps = [(1, chr(x))] if x < 0x80 else []
        steps += [(1, c) for g in gone if (c := _pair(bytes([g, x]), encoding))]
        if x >= 0x80:
            steps += [(1, c) for g in gone if (c := _pair(bytes([x, g]), encoding))]
            if i + 1 < len(b) and (c := _pair(b[i : i + 2], encoding)):
                steps.append((2, c))
        for n, c in steps:
            if c < "\x80" or model.n1[ord(c) & M1]:
                w = v + math.log(model.near(ord(last), ord(c)))
                if w > top[i + n][0]:
                    top[i + n] = (w, c, i)
    if top[-1][0] == -math.inf:
        return None
    out, i = [], len(b)
    while i > 0:
        out.append(top[i][1])
        i = top[i][2]
    return "".join(reversed(out))


def lossy(model: Model, token: str) -> Iterator[tuple[str, str, float]]:
    """Texts that the token may have been before it lost characters besides, each with its chain and what the loss costs.

    Where bytes are dropped by a rule, that costs once; else each character costs that can't be read.
    """
    b = _bytes(token, "cp1252")
    if b is None or b.isascii():
        return
    for gone in _DROPPED:
        if any(x in gone for x in b):
            continue
        made, lost = _fill(model, b, gone)
        if not lost:
            break
        yield made, "cp1252>utf-8", LOST
        for lead in _LEADS:
            once, _ = _fill(model, b, gone, lead)
            b2 = _bytes(once, "cp1252")
            if b2 and not b2.isascii():
                yield _fill(model, b2, gone)[0], "cp1252>utf-8 cp1252>utf-8", LOST
    if sum(x >= 0x80 for x in b) >= 4:
        for t in ("cp932", "euc-jp", "gb18030", "big5"):
            made = b.decode(t, "replace")
            if lost := len(_GONE.findall(made)):
                yield _GONE.sub("", made), f"cp1252>{t}", LOST * lost
        if not any(x in _DROPPED[1] for x in b):
            for t in ("cp932", "gb18030"):
                if filled := _fill_pairs(model, b, t):
                    yield filled, f"cp1252>{t}", LOST


def best(model: Model, token: str, enough: float = math.inf) -> tuple[float, str, str]:
    """The likeliest candidate: how much likelier than the token it is (natural logarithm), the text, the chain; or one
    that is likelier by ``enough``.

    A token with replacement characters can't be restored: what its letters would gain without them is the evidence. Where
    characters may have been lost, that costs ``LOST``, and the token stays as it stands, as a guess restores nothing.
    """
    if "\ufffd" in token:
        return model.log_likelihood(token.replace("\ufffd", "")) - model.log_likelihood(token), token, "lost"
    own, top = None, (0.0, token, "")
    for made, chain in candidates(token):
        if own is None:
            own = model.log_likelihood(token)
        gain = model.log_likelihood(_DIGITS.sub("0", made), own + top[0]) - own
        if gain > top[0]:
            top = (gain, made, chain)
    if top[0] > enough:
        return top
    for made, chain, lost in lossy(model, token):
        if own is None:
            own = model.log_likelihood(token)
        gain = model.log_likelihood(_DIGITS.sub("0", made), own + top[0] + lost) - own - lost
        if gain > top[0]:
            top = (gain, token, f"{chain} lost")
    return top


#: Gains are told apart by tenths as far as ``EVIDENT``, as no margin is more.
TENTHS = round(10 * EVIDENT)
#: What a token counts once, so that shares of it are whole numbers, whose sums don't depend on their order.
WHOLE = 1 << 20


def _tenths(gain: float) -> int:
    """A gain in tenths, rounded up; all beyond ``EVIDENT`` are one."""
    return math.ceil(10 * gain) if gain <= EVIDENT else TENTHS + 1


def damaged_forms(token: str) -> dict[str, tuple[int, bool]]:
    """All that a clean token becomes where it is decoded wrongly: in how many ways, and whether ``candidates`` leads back."""
    out: dict[str, tuple[int, bool]] = {}
    for true in TRUE:
        try:
            b = token.encode(true)
        except UnicodeEncodeError:
            continue
        back = not b.isascii() and b.decode(true) == token and not _CONTROL.search(token)
        for w in WRONG:
            if w != true:
                try:
                    x = b.decode(w)
                except UnicodeDecodeError:
                    continue
                if x != token:
                    n, leads = out.get(x, (0, False))
                    out[x] = n + 1, leads or (back and _bytes(x, w) == b)
    return out


def validated_gains(model: Model, token: str) -> tuple[int, Counter[int]]:
    """By a model without it: the gain of a clean token as it stands, and in how many ways decoded wrongly it has which.

    Where the clean token itself gains more than ``EVIDENT``, no other candidate has to be looked at.
    """
    own, bad = model.log_likelihood(token), Counter()
    for x, (n, leads) in damaged_forms(token).items():
        evident = leads and model.log_likelihood(x, own - EVIDENT) == -math.inf
        bad[TENTHS + 1 if evident else _tenths(best(model, x, EVIDENT)[0])] += n
    return _tenths(best(model, token, EVIDENT)[0]), bad


def validated_margin(good: Mapping[int, int], bad: Mapping[int, int]) -> float:
    """The margin with the fewest errors on clean tokens and on the same tokens decoded wrongly, of which there are so many
    by gain in tenths; the middle of the range where several have as few."""
    if not bad:
        return 4.0
    # a clean token taken for damaged costs as much as five that are missed: clean ones are the rule
    cost = {m: 5 * sum(n for g, n in good.items() if g > m) + sum(n for g, n in bad.items() if g <= m) for m in range(round(10 * DOUBT), TENTHS + 1)}
    least = [m for m in cost if cost[m] == min(cost.values())]
    return (least[0] + least[-1]) / 20


#: Records are dealt to so many parts by the hash of their key; each part is held out of a model that validates the margin on it.
PARTS = 8


def occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``tokens`` (the different ones of a text, as they are judged) and ``clean``, for texts beyond ASCII.

    A record counts as clean if it has no replacement or C1 control character and none of its tokens reads as UTF-8
    under a wrong encoding.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unclean = _UNCLEAN
        for b in batches:
            found, clean = [], []
            for t in b.column(1).to_pylist():
                ts = list(dict.fromkeys(tokens(t)))
                if len(unclean) > 300_000:
                    unclean.clear()
                for x in ts:
                    if x not in unclean:
                        unclean[x] = utf8_inside(x)
                found.append(ts)
                clean.append(not _CONTROL.search(t) and not any(unclean[x] for x in ts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string())), pa.array(clean, pa.bool_())], [key, "tokens", "clean"])

    return df.select(key, text).where(F.col(text).rlike(r"[^\x00-\x7F]")).mapInArrow(run, f"`{key}` {kind}, tokens array<string>, clean boolean")


def vocabulary(found: DataFrame, key: str) -> DataFrame:
    """``token``, and ``n``: in how many clean records of each part it stands. Every token once; counted before the shuffle."""
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    every = found.select(F.explode("tokens").alias("token"), *((F.col("clean") & (part == k)).cast("bigint").alias(f"n{k}") for k in range(PARTS)))
    counted = every.groupBy("token").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(PARTS)))
    return spread(counted.select("token", F.array(*(f"n{k}" for k in range(PARTS))).alias("n")).checkpoint())


def train(words: DataFrame, rounds: int = 2) -> tuple[Model, float]:
    """The model of a vocabulary (token, n), and its margin.

    From the second round on, tokens that the model of the round before doubts are left out, else damage that is
    frequent would be learnt. The margin is validated on all tokens that are left: on those of each part by a model without
    the records of that part. What is collected are counts of n-grams by slot and of tokens by gain in tenths, of which there
    is a fixed number.
    """
    spark = words.sparkSession
    ship(spark)
    rows = words.where(F.exists("n", lambda n: n > 0))
    model = None
    for _ in range(rounds):
        made = _train_once(rows, None if model is None else spark.sparkContext.broadcast(model))
        total = _slots(made)
        model = Model(*total)
    good, bad = Counter(), Counter()
    for k in range(PARTS):
        part = made.where(F.col("part") == k)
        held = _slots(part)
        if not len(held[2][0]):
            continue
        rest = spark.sparkContext.broadcast(Model(*(_less(a, b) for a, b in zip(total, held))))
        for r in _gains(part.where("kind = 0").select("token", "n"), rest).collect():
            (bad if r.bad else good)[r.gain] += r.n
        rest.destroy()
    return model, validated_margin(good, bad)


def _slots(made: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and counts of trigrams, bigrams and characters."""
    summed = made.where("kind > 0").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    kind, slot, n = (summed.column(i).to_numpy() for i in range(3))
    return [(slot[kind == k].astype(np.int64), n[kind == k]) for k in (3, 2, 1)]


def _less(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts without those of a part."""
    order = np.argsort(a[0])
    slots, counts = a[0][order], a[1][order]
    counts[np.searchsorted(slots, b[0])] -= b[1]
    return slots[counts > 0], counts[counts > 0]


def _train_once(rows: DataFrame, before: object) -> DataFrame:
    """Of one round and each part of the records: slots and counts, ``kind`` 3, 2 and 1, and the tokens that took part with
    their number, ``kind`` 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(before.value, DOUBT) if before else None  # type: ignore[attr-defined]
        for b in batches:
            rows = [r for r in zip(*(b.column(i).to_pylist() for i in range(2))) if judge is None or not judge.damaged(r[0])]
            for part in range(PARTS):
                found = {t: n[part] for t, n in rows if n[part]}
                for k, counts in zip((3, 2, 1), count_tokens(found)):
                    m = len(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * m, pa.int32()), pa.array([k] * m, pa.int32()), pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.nulls(m, pa.string())], names
                    )
                m = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([0] * m, pa.int32()), pa.array([0] * m, pa.int32()), pa.array(list(found.values()), pa.int64()), pa.array(list(found), pa.string())], names)

    names = ["part", "kind", "slot", "n", "token"]
    return rows.select("token", "n").mapInArrow(run, "part int, kind int, slot int, n bigint, token string").checkpoint()


def _gains(tokens: DataFrame, model: object) -> DataFrame:
    """``bad`` (decoded wrongly), ``gain`` in tenths, and how many of the tokens (token, n) have it, in parts of ``WHOLE``.

    All ways in which a token can be decoded wrongly count as much together as the token as it stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Counter()
        for b in batches:
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                good, bad = validated_gains(model.value, t)  # type: ignore[attr-defined]
                out[False, good] += n * WHOLE
                for gain, ways in bad.items():
                    out[True, gain] += n * WHOLE * ways // bad.total()
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.bool_()), pa.array([g for _, g in out], pa.int32()), pa.array(list(out.values()), pa.int64())], ["bad", "gain", "n"])

    return tokens.mapInArrow(run, "bad boolean, gain int, n bigint").groupBy("bad", "gain").agg(F.sum("n").alias("n"))


#: A token of one or two characters, judged with a neighbour, needs so much more evidence.
SHORT_EXTRA = 2.0


def _short(key: str) -> bool:
    return " " in key and min(map(len, key.split(" "))) <= 2


class Judge:
    """Judges tokens by a model and a margin; remembers what it judged."""

    def __init__(self, model: Model, margin: float) -> None:
        self.model, self.margin, self.known, self.made = model, margin, {}, {}

    def damaged(self, key: str) -> bool:
        """Whether a token, with its digits made alike, is damaged."""
        bad = self.known.get(key)
        if bad is None:
            bad = best(self.model, key, EVIDENT)[0] > self.margin + (SHORT_EXTRA if _short(key) else 0.0)
            if not bad:
                runs = _RUN.findall(key)
                bad = (len(runs) > 1 or len(runs[0]) < len(key)) and any(len(r) > 1 and best(self.model, r, EVIDENT)[0] > self.margin and utf8_inside(r) for r in runs)
            if not bad:
                cut = pieces(key)
                bad = len(cut) > 1 and any(self._piece(p) is not None for p in cut)
            if len(self.known) > 300_000:
                self.known.clear()
            if len(key) <= 64:
                self.known[key] = bad
        return bad

    def _piece(self, p: str) -> str | None:
        """What a damaged piece of a token becomes, None for a clean one. One of two characters beyond ASCII needs more evidence."""
        n = sum(c > "\x7f" for c in p)
        if n < 2 or "\ufffd" in p:
            return None
        gain, made, _ = best(self.model, p)
        return made if gain > self.margin + (SHORT_EXTRA if n == 2 else 0.0) else None

    def token(self, t: str) -> tuple[bool, str]:
        """Whether a token is damaged, and what it becomes. Digits are as in the text."""
        if not self.damaged(_DIGITS.sub("0", t)):
            return False, t
        made = self.made.get(t)
        if made is None:
            made = self._restored(t)
            if len(self.made) > 300_000:
                self.made.clear()
            if len(t) <= 64:
                self.made[t] = made
        return True, made

    def _restored(self, t: str) -> str:
        gain, made, _ = best(self.model, t)
        if gain > self.margin or " " in t:
            return made
        run = lambda m: found[1] if (found := best(self.model, m[0]))[0] > self.margin else m[0]
        out, rest = [], ""
        cut = pieces(t)
        for p in cut:
            if len(cut) > 1 and (whole := self._piece(p)) is not None:
                out += [_RUN.sub(run, rest), whole]
                rest = ""
            else:
                rest += p
        return "".join([*out, _RUN.sub(run, rest)])

    def text(self, s: str | None) -> tuple[bool, str | None]:
        """Whether a text holds damage, and the text with what could be restored."""
        if not s or s.isascii():
            return False, s
        out, damaged, last = [], False, 0
        for start, end, seen in spans(s):
            bad, new = self.token(seen)
            if not bad:
                continue
            damaged = True
            if end - start < len(seen):  # judged with a neighbour
                first, _, second = new.partition(" ")
                new = first if seen.startswith(s[start:end] + " ") else second
            out += [s[last:start], new]
            last = end
        return damaged, "".join([*out, s[last:]])


# What a worker has looked at stays while the worker does: whether tokens are unclean.
_UNCLEAN: dict[str, bool] = {}


class Damage:
    """What is damaged in a table: ``found``, the keys of the rows, and the model that tells.

    Rows with null, empty or plain ASCII text are never damaged. Whole texts are judged, whatever their length. Rows
    repeated under one key are one row of the result. A table without any character beyond ASCII gives no rows. Further
    columns are dropped, whatever their names.
    """

    def __init__(self, df: DataFrame, key: str, text: str) -> None:
        self.df, self.key, self.text, self.spark = df, key, text, df.sparkSession
        where = occurrences(df, key, text).checkpoint()
        words = vocabulary(where, key)
        self.model, self.margin = train(words)
        shared = self.spark.sparkContext.broadcast((self.model, self.margin))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            j = Judge(*shared.value)
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([t for t in b.column(0).to_pylist() if j.damaged(t)], pa.string())], ["token"])

        bad, _ = checked_broadcast(words.select("token").mapInArrow(judge, "token string").checkpoint())
        self.shared = shared
        self.found = where.select(key, F.explode("tokens").alias("token")).join(bad, "token", "left_semi").select(key).distinct()

    def repaired(self) -> DataFrame:
        """``key``, ``restored`` (the text with what could be restored), ``whole`` (nothing is left of the damage)."""
        key, shared = self.key, self.shared
        kind = self.df.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = Judge(*shared.value)
            for b in batches:
                texts, whole = [], []
                for t in b.column(1).to_pylist():
                    _, new = judge.text(t)
                    texts.append(new)
                    whole.append(not _CONTROL.search(new) and not judge.text(new)[0])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(whole, pa.bool_())], [key, "restored", "whole"])

        ids, _ = checked_broadcast(self.found.checkpoint())
        rows = self.df.select(key, self.text).where(F.col(self.text).rlike(r"[^\x00-\x7F]")).join(ids, key, "left_semi")
        return once(rows, [key], self.text).mapInArrow(run, f"`{key}` {kind}, restored string, whole boolean")


def repair(df: DataFrame, key: str, text: str) -> DataFrame:
    """The damaged rows and their texts; see ``Damage``."""
    return Damage(df, key, text).repaired()


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of the damaged rows; see ``Damage``."""
    return Damage(df, key, text).found
