"""Variant spellings of the names of persons, organisations and projects, linked.

Names are read into parts: a core (surname, or the invented word of a firm or project), given names and
initials, the words that describe a firm, its legal form, a version. What given names and describing words
there are is learnt from how often tokens stand in all names. Candidates share a suffix of the core, or of
its mirror image, of at least five characters. That of five stands for all longer ones, as who shares a
longer one shares it too; where it is overly common it is refined with other fields (initial, version,
describing words) and lengthened, and blocks that are still large are shared by several tasks, so none is
dropped. Long cores are also indexed by suffixes without their last letters, as they may have a slip in each
end. Equal cores always meet; where very many do, by given names, initials and nicknames.

Pairs are compared by the ratio of the longest common subsequence of their cores and by whether their other
parts agree. Full forms that agree are one entity; a short form (initials, or a core alone) joins the one
entity that it can mean.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, ship

# Titles, particles, legal forms.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "herr", "frau", "mme"}
PARTICLES = {"van", "von", "de", "der", "den", "di", "da", "del", "la", "le", "bin", "al"}
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "llc": "llc", "ltd": "ltd", "limited": "ltd",
    "gmbh": "gmbh", "sa": "sa", "ag": "ag", "plc": "plc", "bv": "bv", "nv": "nv", "kg": "kg", "oy": "oy", "ab": "ab",
}
_FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"})
_LEGAL_END = re.compile(r"[,\s]+((?:[a-z]\.){1,3}[a-z]\.?|[a-z]+\.?)\s*$")
_PROJECT = [
    re.compile(r"^(?:project|proj\.?)\s+(.*?)[\s_-]*(?:v|version)\.?\s*(\d+)$"),
    re.compile(r"^(.*?)\s+project\s*\(?\s*(?:v|version)\.?\s*(\d+)\)?$"),
    re.compile(r"^(.*?)[\s_-]+\(?(?:v|version)\.?\s*(\d+)\)?$"),
    re.compile(r"^(?:project|proj\.?)\s+(.+?)()$"),
]
_TOKEN = re.compile(r"[a-z0-9]+")
_CAPITALS = re.compile(r"^((?:[^\W\d_a-z]|['’-]){4,})\s+([A-Z]{1,2})$")
MIN_SUFFIX, COMMON = 5, 200
#: Cores of so many letters may have a slip in each end and still be alike; they are indexed at so many places more.
LONG_CORE, SKIPPED = 11, 3
#: Cores are alike from this ratio of the longest common subsequence on.
ALIKE = 0.9


def fold(s: str) -> str:
    """Case and accents aside."""
    s = unicodedata.normalize("NFKD", s.casefold().translate(_FOLD))
    return "".join(c for c in s if not unicodedata.combining(c))


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence, by both lengths."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2.0 * row[-1] / (len(a) + len(b))


def one_slip(a: str, b: str) -> bool:
    """Whether one inserted, left out, replaced or swapped letter makes the difference."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


@dataclass
class Lexicon:
    """What is known of tokens: given names, names for each nickname, words that describe firms."""

    given: set[str] = field(default_factory=set)
    full: dict[str, set[str]] = field(default_factory=dict)
    words: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.word_set = set(self.words)
        self._seen: dict[str, str | None] = {}

    def is_given(self, t: str) -> bool:
        return t in self.given or t in self.full

    def word(self, t: str) -> str | None:
        """The describing word that a token is, abbreviates or misspells."""
        if t in self.word_set:
            return t
        if t not in self._seen:
            if len(self._seen) > 100_000:
                self._seen.clear()
            self._seen[t] = self._word(t)
        return self._seen[t]

    def _word(self, t: str) -> str | None:
        if len(t) < 3:
            return None
        starts = [w for w in self.words if w.startswith(t)]
        if len(starts) >= 1 and len(t) >= 3:
            return starts[0] if len(starts) == 1 else min(starts, key=len)
        for w in self.words:
            if len(t) >= 4 and one_slip(t, w):
                return w
        if len(t) <= 6:
            for w in self.words:
                if w[0] == t[0] and w[-1] == t[-1] or w[0] == t[0] and len(t) <= 4:
                    it = iter(w)
                    if all(c in it for c in t):
                        return w
        return None


def parse(name: str, lex: Lexicon) -> dict | None:
    """The parts of a name: kind (P, O, J), core, given, initials, words, legal, version; None without a letter or digit."""
    raw = name.strip()
    f = fold(raw)
    if not _TOKEN.search(f):
        return None
    part = {"kind": "P", "core": "", "given": "", "initials": "", "words": "", "legal": "", "version": ""}
    for p in _PROJECT:
        if m := p.match(f):
            core = "".join(_TOKEN.findall(m[1]))
            if core:
                return part | {"kind": "J", "core": core, "version": m[2]}
    # a word in capitals and a few letters more: a surname with initials, whatever else the letters may mean
    if (m := _CAPITALS.match(raw)) and not lex.word(fold(m[1])):
        return part | {"core": "".join(_TOKEN.findall(fold(m[1]))), "initials": fold(m[2])}
    if (m := _LEGAL_END.search(f)) and (legal := LEGAL.get(m[1].replace(".", ""))):
        part["legal"] = legal
        f = f[: m.start()]
    f = re.sub(r"^the\s+", "", f.strip()) if (the := bool(re.match(r"the\s", f.strip()))) else f
    slug = bool(re.fullmatch(r"[a-z0-9]+(?:[-_][a-z0-9]+){2,}", raw))
    before, comma, after = f.partition(",")
    tokens = _TOKEN.findall(f"{after} {before}" if comma else f)
    described = [t for t in tokens if lex.word(t) and not lex.is_given(t)]
    caps = re.fullmatch(r"\s*\S*[a-z]\S*\s+([A-Z]{2,3})\s*", raw)
    if part["legal"] or the or slug or (described and (len(tokens) > 2 or any(t in lex.word_set for t in tokens))) or caps:
        rest = [t for t in tokens if t not in described]
        if not rest:  # all tokens read as words: the first is the core
            rest, described = tokens[:1], tokens[1:]
        part |= {"kind": "O", "core": rest[0] if len(rest[0]) > 2 or len(rest) == 1 else "".join(rest)}
        if caps and len(rest) == 2:
            part |= {"core": rest[0], "initials": rest[1]}
        elif len(rest) > 1:
            # a word that the lexicon doesn't hold; the rarest-looking, longest token is the core
            core = max(rest, key=lambda t: (len(t), t))
            part["core"], described = core, [*described, *(t for t in rest if t != core)]
        part["words"] = " ".join(sorted(lex.word(t) or t for t in described))
        return part
    # a person
    nick = re.search(r"[\"“”(]\s*([^\"“”()]+?)\s*[\"“”)]", f)
    if nick:
        f = f[: nick.start()] + " " + f[nick.end() :]
        before, comma, after = f.partition(",")
    reading = lambda s: [t for t in re.findall(r"[a-z0-9]+(?:['’-][a-z0-9]+)*\.?", s) if t.rstrip(".") not in PARTICLES and not (t.rstrip(".") in TITLES and (t.endswith(".") or len(t) > 1))]
    if comma and after.strip():
        last, first = reading(before), reading(after)
    else:
        ts = reading(f)
        if len(ts) < 2:
            last, first = ts, []
        elif lex.is_given(ts[-1]) and not lex.is_given(ts[0]) and len(ts[0].rstrip(".")) > 1:
            last, first = ts[:-1], ts[-1:]
        else:
            last, first = ts[-1:], ts[:-1]
            if len(first) > 1 and not len(first[-1].rstrip(".")) == 1 and not lex.is_given(first[-1]) and lex.is_given(first[0]):
                last, first = [*first[1:], *last], first[:1]
    part["core"] = "".join(_TOKEN.findall(" ".join(last)))
    full = [t.rstrip(".") for t in first if len(t.rstrip(".")) > 1]
    single = "".join(t.rstrip(".") for t in first if len(t.rstrip(".")) == 1)
    part["given"] = full[0] if full else ""
    part["initials"] = (full[0][0] if full else "") + single
    if not part["core"]:
        part["core"], part["given"] = part["given"], ""
    return part if part["core"] else None


def given_agree(a: str, b: str, lex: Lexicon) -> float:
    """How well two given names agree: 1 the same or a known nickname, .8 a slip, .6 perhaps a nickname, 0 not."""
    if a == b or (lex.full.get(a, {a}) | {a}) & (lex.full.get(b, {b}) | {b}):
        return 1.0
    known = a in lex.given and b in lex.given
    if known and not one_slip(a, b):
        return 0.0
    if len(a) > 3 and len(b) > 3 and (one_slip(a, b) or lcs_ratio(a, b) >= 0.84):
        return 0.0 if known else 0.8
    if not known:
        for x, y in ((a, b), (b, a)):
            if len(x) < len(y) or x not in lex.given:
                for z in lex.full.get(x, {x}) | {x}:
                    if z[:3] == y[:3] or (z[:2] == y[:2] and len(x) <= 6):
                        return 0.6
    return 0.0


def agree(a: dict, b: dict, lex: Lexicon) -> int:
    """2 if two names mean the same, 1 if a short form may mean the other, 0 if not."""
    if a["kind"] != b["kind"]:
        return 0
    same = a["core"] == b["core"]
    if not same and not (min(len(a["core"]), len(b["core"])) >= 5 and (one_slip(a["core"], b["core"]) or (lcs_ratio(a["core"], b["core"]) >= ALIKE and a["kind"] != "J"))):
        return 0
    if a["kind"] == "J":
        return 2 if a["version"] == b["version"] else 0
    if a["kind"] == "O":
        if a["legal"] and b["legal"] and a["legal"] != b["legal"]:
            return 0
        if a["words"] and b["words"]:
            return 2 if a["words"] == b["words"] or _words_agree(a["words"].split(), b["words"].split()) else 0
        if not same:
            return 0
        long, short = (a, b) if a["words"] else (b, a)
        if not long["words"]:
            return 2 if a["initials"] == b["initials"] else 1 if not (a["initials"] and b["initials"]) else 0
        if short["initials"]:
            return 1 if sorted(short["initials"]) == sorted(w[0] for w in long["words"].split()) else 0
        return 1
    ia, ib = a["initials"], b["initials"]
    if len(ia) > 1 and len(ib) > 1 and ia[1:] != ib[1:]:
        return 0
    if a["given"] and b["given"]:
        g = given_agree(a["given"], b["given"], lex)
        if not same:
            return 2 if a["given"] == b["given"] else 1 if g == 1.0 else 0
        return 2 if g >= 0.8 else 1 if g else 0
    if not same:
        return 0
    first = lambda p: {x[0] for x in lex.full.get(p["given"], {p["given"]}) | {p["given"]}} if p["given"] else set(p["initials"][:1])
    if not first(a) or not first(b):
        return 1
    if not first(a) & first(b):
        return 0
    return 2 if not a["given"] and not b["given"] and ia == ib else 1


def _words_agree(a: list[str], b: list[str]) -> bool:
    if len(a) != len(b):
        return False
    return all(x == y or one_slip(x, y) or (x[0] == y[0] and (x.startswith(y) or y.startswith(x))) for x, y in zip(a, b))


def is_short(p: dict) -> bool:
    """Whether a name is a short form: initials without a given name, or a firm's core without its words."""
    return (p["kind"] == "P" and not p["given"]) or (p["kind"] == "O" and not p["words"])


PARTS = ["kind", "core", "given", "initials", "words", "legal", "version"]


def learn(names: DataFrame, nicknames: DataFrame, one_in: int = 1500, least: int = 12) -> Lexicon:
    """Given names and describing words by how often tokens stand in all names, and the table of nicknames.

    A token counts as frequent if it stands in one name of ``one_in``, and in ``least`` at least; there can be no more
    than ``one_in`` times the tokens of a name, however many names there are.
    """
    nick: dict[str, set[str]] = {}
    given: set[str] = set()
    for r in nicknames.where("given_name IS NOT NULL AND nickname IS NOT NULL").collect():
        nick.setdefault(fold(r.nickname), set()).add(fold(r.given_name))
        given.add(fold(r.given_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, legal = [], []
            for n in b.column(0).to_pylist():
                f = fold(n)
                ts = set(_TOKEN.findall(f))
                m = _LEGAL_END.search(f.strip())
                firm = bool(m and m[1].replace(".", "") in LEGAL)
                token += ts
                legal += [firm] * len(ts)
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(legal, pa.bool_())], ["token", "legal"])

    total = names.count()
    counts = names.select("name").mapInArrow(run, "token string, legal boolean").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("legal").alias("firms"))
    words: list[str] = []
    for r in counts.where(F.col("n") >= max(least, total // one_in)).collect():
        t = r.token
        if len(t) < 3 or t in LEGAL or t in TITLES or t in PARTICLES or t in ("the", "project", "proj", "version") or re.fullmatch(r"v?\d+", t):
            continue
        if r.firms * 4 >= r.n:
            words.append(t)
        elif r.firms == 0 and t not in nick:
            given.add(t)
    # abbreviations that are frequent by themselves are no words of their own
    words = [w for w in sorted(words, key=lambda w: (-len(w), w))]
    whole = [w for w in words if not any(len(w) <= 6 and len(x) > len(w) and x[0] == w[0] and _inside(w, x) for x in words)]
    return Lexicon(given - set(whole), nick, sorted(whole))


def _parsed(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """(id, parts) of the rows with a name that can be read."""
    lexicon = rows.sparkSession.sparkContext.broadcast(lex)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for b in batches:
            ids, parts = [], []
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = parse(n, lex)
                if p:
                    ids.append(i)
                    parts.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array([p[k] for p in parts], pa.string()) for k in PARTS)], ["id", *PARTS])

    return rows.select("id", "name").mapInArrow(read, "id string, " + ", ".join(f"{k} string" for k in PARTS))


def _recurring_nicknames(parsed: DataFrame, lex: Lexicon) -> dict[str, set[str]]:
    """Nicknames that the table lacks: given names of few letters, unknown so far, that stand beside the same known
    given name under three surnames or more, and beside no other nearly as often.

    A surname has at most as many different given names as there are, so the pairs of a surname are bounded. What
    is collected is one row for each nickname that recurs.
    """
    known = parsed.sparkSession.createDataFrame([(g,) for g in sorted(lex.given)] or [("",)], "given string")
    people = parsed.where("kind = 'P' AND given <> ''").select("core", "given").distinct()
    full = people.join(F.broadcast(known), "given", "left_semi").withColumnRenamed("given", "full")
    table = parsed.sparkSession.createDataFrame([(n,) for n in sorted(lex.full)] or [("",)], "given string")
    short = people.join(F.broadcast(known), "given", "left_anti").join(F.broadcast(table), "given", "left_anti").where(F.length("given").between(2, 8))
    pairs = short.join(full, "core").groupBy("given", "full").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    cores = short.join(full.select("core").distinct(), "core", "left_semi").groupBy("given").agg(F.count(F.lit(1)).alias("cores"))
    out: dict[str, set[str]] = {}
    for r in pairs.join(cores, "given").where("n >= 0.6 * cores").collect():
        out.setdefault(r.given, set()).add(r.full)
    return {k: v for k, v in out.items() if len(v) == 1}


def lexicon_of(rows: DataFrame, nicknames: DataFrame, one_in: int = 1500, least: int = 12) -> Lexicon:
    """What ``learn`` finds in rows (id, name), with the nicknames that recur beside full names."""
    ship(rows.sparkSession)
    lex = learn(rows, nicknames, one_in, least)
    more = _recurring_nicknames(_parsed(rows, lex).checkpoint(), lex)
    return Lexicon(lex.given, {k: lex.full.get(k, set()) | more.get(k, set()) for k in {*lex.full, *more}}, lex.words)


def _inside(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def _suffix_keys(nodes: DataFrame) -> DataFrame:
    """(node, core, key): suffixes of the core and of its mirror image, overly common ones refined, then lengthened."""
    f = F.coalesce(F.nullif(F.col("version"), F.lit("")), F.nullif(F.substring("initials", 1, 1), F.lit("")), F.nullif(F.substring("words", 1, 3), F.lit("")), F.lit(""))
    skips = F.when(F.length("core") >= LONG_CORE, F.sequence(F.lit(1), F.lit(SKIPPED + 1))).otherwise(F.array(F.lit(1)))
    ends = nodes.select("node", "kind", "core", f.alias("__f"), F.explode(F.array(F.lit("s"), F.lit("m"))).alias("__side"), F.explode(skips).alias("__at"))
    ends = ends.withColumn("__t", F.when(F.col("__side") == "s", F.reverse("core")).otherwise(F.col("core")))  # the suffix, read backwards
    part = lambda n: F.substr("__t", F.col("__at"), F.lit(n))
    steps = [part(MIN_SUFFIX), F.concat_ws("|", part(MIN_SUFFIX), "__f"), F.concat_ws("|", part(MIN_SUFFIX + 2), "__f"), F.concat_ws("|", part(MIN_SUFFIX + 2), "__f", F.length("__t").cast("string"))]
    out, level = None, ends
    for i, k in enumerate(steps):
        keyed = level.withColumn("key", F.concat_ws("|", F.lit(str(i)), "kind", "__side", k))
        common = None
        if i < len(steps) - 1:
            common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("key").checkpoint()
            if not common.limit(1).count():
                common = None
        done = keyed if common is None else keyed.join(checked_broadcast(common)[0], "key", "left_anti")
        done = done.select("node", "core", "key")
        out = done if out is None else out.unionByName(done)
        if common is None:
            break
        level = keyed.join(checked_broadcast(common)[0], "key", "left_semi").drop("key")
    return out


def _core_keys(nodes: DataFrame, lex: Lexicon) -> tuple[DataFrame, DataFrame | None]:
    """(node, core, key) by which equal cores meet; and the pairs (x, y) of short forms and the nodes they ask, if any.

    Where a core has very many nodes, those with given names meet by what two given names that agree have in common: a
    name that both may stand for, or their first two or last two letters. Short forms of such a core ask the nodes with
    their initial, or all; there are few, as forms that read alike are one node.
    """
    keyed = nodes.withColumn("key", F.concat_ws("|", F.lit("w"), "kind", "core"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("key").checkpoint()
    if not hot.limit(1).count():
        return keyed.select("node", "core", "key"), None
    hot, _ = checked_broadcast(hot)
    many = keyed.join(hot, "key", "left_semi")
    names = nodes.sparkSession.createDataFrame(sorted((n, f) for n, fs in lex.full.items() for f in fs) or [("", "")], "given string, alias string")
    every = F.array_distinct(F.concat(F.array("given"), F.coalesce("aliases", F.array().cast("array<string>"))))
    many = many.join(checked_broadcast(names.groupBy("given").agg(F.collect_set("alias").alias("aliases")))[0], "given", "left").withColumn("aliases", every)
    full = F.col("kind") == "J"
    full = full | ((F.col("kind") == "P") & (F.col("given") != "")) | ((F.col("kind") == "O") & (F.col("words") != ""))
    mark = lambda name, c: F.concat_ws("|", "key", F.lit(name), c)
    by_name = F.transform("aliases", lambda x: mark("n", x))
    by_ends = F.transform("aliases", lambda x: mark("p", F.substring(x, 1, 2)))
    whole = F.when(F.col("kind") == "P", F.array_distinct(F.concat(by_name, by_ends, F.array(mark("q", F.substring(F.reverse("given"), 1, 2)))))).when(F.col("kind") == "O", F.array(mark("o", F.substring("words", 1, 1)))).otherwise(F.array(mark("v", F.col("version"))))
    meet = many.where(full).withColumn("key", F.explode(whole))
    # short forms: those with an initial are asked by it, the others by the core
    first = F.transform("aliases", lambda x: mark("i", F.substring(x, 1, 1)))
    asked = many.withColumn("__k", F.explode(F.array_distinct(F.concat(F.array(mark("b", F.lit(""))), F.when(F.col("given") != "", first).otherwise(F.array(mark("i", F.substring("initials", 1, 1))))))))
    ask = many.where(~full).withColumn("key", F.when((F.col("kind") == "P") & (F.col("initials") != ""), mark("i", F.substring("initials", 1, 1))).otherwise(mark("b", F.lit(""))))
    columns = ["node", "core", "key"]
    # who asks, and who is asked by none: a node without initial is met by those that have one through the core
    bare = many.where(~full & (F.col("kind") == "P") & (F.col("initials") == "")).withColumn("key", mark("b", F.lit("")))
    asks = _sided(ask.unionByName(bare).select(*columns).distinct(), asked.drop("key").withColumnRenamed("__k", "key").select(*columns))
    return keyed.join(hot, "key", "left_anti").select(*columns).unionByName(meet.select(*columns)), asks


def _sided(ask: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs of those that ask and those they ask; blocks of many are shared by several tasks."""
    size, _ = checked_broadcast(asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / COMMON).cast("int").alias("__salts")).where("__salts > 1"))
    one = lambda df: df.select("node", "key").join(size, "key", "left").withColumn("__salts", F.coalesce("__salts", F.lit(1)))
    x = one(ask).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).select("key", "__s", F.col("node").alias("x"))
    y = one(asked).withColumn("__s", F.pmod(F.xxhash64("node"), F.col("__salts")).cast("int")).select("key", "__s", F.col("node").alias("y"))
    return x.join(y, ["key", "__s"]).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _pairs(nodes: DataFrame, lex: Lexicon) -> DataFrame:
    """Candidate pairs (a, b) of nodes whose cores are alike, once each; a and b have the node and its parts."""
    equal, asks = _core_keys(nodes, lex)
    keyed = _suffix_keys(nodes).unionByName(equal).checkpoint()
    # a replaced letter is one edit and two of the subsequence's; a swap is two edits
    room = F.greatest(F.lit(2), F.floor((F.length("ca") + F.length("cb")) * (1 - ALIKE)).cast("int"))
    alike = (F.col("ca") == F.col("cb")) | ((F.abs(F.length("ca") - F.length("cb")) <= room) & (F.levenshtein(F.col("ca"), F.col("cb")) <= room))
    left = lambda df, *more: df.select("key", F.col("node").alias("x"), F.col("core").alias("ca"), *more)
    right = lambda df, *more: df.select("key", F.col("node").alias("y"), F.col("core").alias("cb"), *more)
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("key", F.ceil(F.col("n") / COMMON).cast("int").alias("__salts")).checkpoint()
    if hot.limit(1).count():  # blocks of many are shared by several tasks
        hot, _ = checked_broadcast(hot)
        many = keyed.join(hot, "key")
        a = left(many, F.pmod(F.xxhash64("node"), F.col("__salts")).cast("int").alias("__s"))
        b = right(many, F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__s"))
        few = keyed.join(hot, "key", "left_anti")
        met = left(few).join(right(few), "key").where("x < y").where(alike).select("x", "y").unionByName(a.join(b, ["key", "__s"]).where("x < y").where(alike).select("x", "y"))
    else:
        met = left(keyed).join(right(keyed), "key").where("x < y").where(alike).select("x", "y")
    found = (met if asks is None else met.unionByName(asks)).distinct()
    side = lambda x, p: nodes.select(F.col("node").alias(x), F.struct("node", *PARTS).alias(p))
    return found.join(side("x", "a"), "x").join(side("y", "b"), "y").select("a", "b")


def _components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes at edges (a, b): the smallest node that each is linked with over any number of edges.

    Rows are as many as nodes at edges. Labels are taken from neighbours and then from labels, so the rounds grow with the
    logarithm of a chain's length.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    state = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label").checkpoint()
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("l"))
        new = state.join(near, state.node == near.a).select("node", F.least("label", "l").alias("label"), (F.col("l") < F.col("label")).alias("moved"))
        # jump: take the label of one's label as well; a label has one row, so only that side is copied where many share it
        jump, _ = checked_broadcast(state.select(F.col("node").alias("label"), F.col("label").alias("next")).where("label <> next").join(state.select("label").distinct(), "label", "left_semi"))
        new = new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "moved").checkpoint()
        if not new.where("moved").limit(1).count():
            return new.select("node", "label")
        state = new.select("node", "label")


def _relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, label) after edges (a, b) between labels joined some: only these are walked."""
    moved, _ = checked_broadcast(_components(edges).select(F.col("node").alias("label"), F.col("label").alias("to")))
    return labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _only_one(weak: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) from each group to the one group of full forms that its weak links lead to; to the one group of
    short forms if they lead to no full one; none where there are several."""
    ends = weak.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
    full = F.when(~F.col("short_b"), F.col("y"))
    one = ends.groupBy("x").agg(F.min(full).alias("lo"), F.max(full).alias("hi"), F.min("y").alias("lo2"), F.max("y").alias("hi2"))
    return one.where("coalesce(lo = hi, lo2 = hi2)").select(F.col("x").alias("a"), F.coalesce("lo", "lo2").alias("b")).checkpoint()


def resolve(entities: DataFrame, nicknames: DataFrame, one_in: int = 1500, least: int = 12) -> DataFrame:
    """(id, entity): the entity of each row, named by its smallest id.

    Rows repeated under one id count once (the smallest name stands for them); rows with a null id, or with a
    null name or one without a letter or digit, are no entities. ``entity_type`` and users are not used, as
    they are typed unevenly. Rows whose names read into the same parts are compared as one, so groups of
    equal names cost no comparisons. Further columns are ignored. An empty table gives no rows. ``one_in`` and
    ``least`` decide which tokens are frequent, see ``learn``.
    """
    spark = entities.sparkSession
    ship(spark)
    rows = entities.where("id IS NOT NULL AND name IS NOT NULL").groupBy("id").agg(F.min("name").alias("name")).checkpoint()
    lex = lexicon_of(rows, nicknames, one_in, least)
    parsed = _parsed(rows, lex).checkpoint()
    lexicon = spark.sparkContext.broadcast(lex)
    nodes = parsed.groupBy(*PARTS).agg(F.min("id").alias("node")).checkpoint()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for b in batches:
            a_s, b_s, how, short_a, short_b, new_a, new_b = [], [], [], [], [], [], []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = agree(x, y, lex)
                if v:
                    a_s.append(x["node"])
                    b_s.append(y["node"])
                    how.append(v)
                    short_a.append(is_short(x))
                    short_b.append(is_short(y))
                    new_a.append(x["given"] not in lex.given)
                    new_b.append(y["given"] not in lex.given)
            names = ["a", "b", "how", "short_a", "short_b", "new_a", "new_b"]
            types = [pa.string(), pa.string(), pa.int32(), *[pa.bool_()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((a_s, b_s, how, short_a, short_b, new_a, new_b), types)], names)

    links = _pairs(nodes, lex).mapInArrow(compare, "a string, b string, how int, short_a boolean, short_b boolean, new_a boolean, new_b boolean").checkpoint()
    # full forms first, and short forms that are alike
    at_edges = _components(links.where("how = 2"))
    labels = nodes.select("node").join(at_edges, "node", "left").select("node", F.coalesce("label", "node").alias("label")).checkpoint()
    weak = links.where("how = 1")
    weak = weak.select("a", "b", "short_a", "short_b", "new_a", "new_b").unionByName(
        weak.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("short_b").alias("short_a"), F.col("short_a").alias("short_b"), F.col("new_b").alias("new_a"), F.col("new_a").alias("new_b"))
    )
    # then what may be a nickname joins the one group it can mean, and after that each short form
    labels = _relabel(labels, _only_one(weak.where("NOT short_a AND NOT short_b AND new_a"), labels)).checkpoint()
    labels = _relabel(labels, _only_one(weak.where("short_a"), labels))
    whole = parsed.join(nodes, PARTS).join(labels, "node").select("id", "label").checkpoint()
    return whole.join(whole.groupBy("label").agg(F.min("id").alias("entity")), "label").select("id", "entity")


#: The rows of one entity are paired in blocks of so many.
PAIRED = 1000


def links(entities: DataFrame, nicknames: DataFrame) -> DataFrame:
    """All pairs ``id_a`` < ``id_b`` of rows that mean the same; see ``resolve``, which gives one row for each id instead.

    An entity of n rows has n (n - 1) / 2 pairs; those of a large one are made by several tasks.
    """
    found = resolve(entities, nicknames).checkpoint()
    size = found.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity", F.ceil(F.col("n") / PAIRED).cast("int").alias("__salts"))
    rows = found.join(size, "entity")
    a = rows.select("entity", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("__salts")).cast("int").alias("__s"))
    b = rows.select("entity", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__s"))
    return a.join(b, ["entity", "__s"]).where("id_a < id_b").select("id_a", "id_b")
