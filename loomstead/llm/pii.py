"""Personal details in free text: overlapping candidates from high-recall generators, judged by boosted trees."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.boosting import BoostedTrees
from loomstead.session import cut_lineage

#: Share of details among what a kind's threshold lets through, as the calibrated scores expect it.
PRECISION = 0.98
#: Candidates whose weight draws the share of a form towards that of all forms as settled as it is.
FEW = 4.0
#: No candidate of a lower chance is a detail, whatever precision would allow.
LEAST_CHANCE = 0.05
NAMES_AT_MOST = 100_000
#: Characters on either side of a candidate, within its line, that features are drawn from.
CONTEXT = 60
#: Features that take part in the trees, and counts that a task holds before it hands them on.
FEATURES = 1_500
HELD_COUNTS = 200_000
#: What parts the features of a candidate where they are written as one text; they are drawn from within a line.
PART_MARK = "\n"

#: Ways to write the at sign, with the ways to write a dot that go with them.
AT_SIGNS = ("@", "%40", "&#64;", " [at] ", " (at) ", " AT ", "[at]", "(at)", " at ")
DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| DOT | dot )"
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+-")
DOMAIN = re.compile(rf"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+", re.I)
TLD = re.compile(r"[a-z]{2,}\Z", re.I)

#: Telephone number formats. B is a blank or a kind of hyphen.
B = "[ .\\-\u2010\u2011\u00a0]"
PHONES = {
    "us_plain": rf"\d{{3}}(?P<sep>{B})\d{{3}}(?P=sep)\d{{4}}",
    "us_paren": rf"\(\d{{3}}\){B}?\d{{3}}{B}\d{{4}}",
    "us_long": rf"(?:\+1|001){B}?\(?\d{{3}}\)?{B}?\d{{3}}{B}?\d{{4}}",
    "uk_area": r"0\d{4} \d{6}",
    "uk_london": r"0\d{2} \d{4} \d{4}",
    "intl": r"\+\d{2}[ \-.]?(?:\(0\)[ ]?)?\d{2,4}(?:[ \-./]?\d{2,8}){1,4}",
    "slash": r"0\d{2,4}[/]\d{3,8}(?:-\d{1,5})?",
}
PHONE = re.compile("(?<![\\w+./\\-\u2010\u2011(])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in PHONES.items()) + ")(?![\\w\\-\u2010\u2011]|[./]\\d)", re.A)
DIGIT_RUN = re.compile(r"(?<![\w.\-])\d{6,14}(?![\w.\-])|(?<![\w.\-])\d{1,4}(?:[.\-]\d{1,5}){2,3}(?![\w.\-])", re.A)

#: A number before two words, which is a street only if its words say so.
COUNTED = re.compile(r"(?<![\w.\-/:])\d{1,5} [^\W\d_]{3,} [^\W\d_]{3,}\b")

#: Identity numbers.
HY = "\u2010\u2011"
SSN = re.compile(rf"(?<![\w.+/\-{HY}])\d{{3}}([ \-{HY}]?)\d{{2}}\1\d{{4}}(?![\w\-/{HY}]|\.\d)", re.A)
NINO_END = re.compile(r"[0-9]{2}([ \-]?)[0-9]{2}\1[0-9]{2}\1[A-Za-z](?![\w\-])", re.A)
NINO_START = re.compile(r"(?<![\w\-])[A-Za-z]{2}([ \-]?)\Z", re.A)
#: Stretches that may hold a number; their first character is one a search can skip to.
NUMERIC = re.compile(f"[+(0-9][0-9 ()./\\-{HY}\u00a0]{{7,}}")

#: Words of streets.
STREET_TYPES = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Square|Sq|Crescent|Close|Parkway|Pkwy|Circle|Cir|Highway|Hwy|Trail|Row|Alley"
STREET = re.compile(
    rf"[0-9](?<![\w.\-/:][0-9])[0-9]{{0,4}}[A-Za-z]?,? (?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West|Old|New|Upper|Lower|Great|Little|Saint|St)\.? )?[^\W\d_][^\W\d_'’\-]+(?: [A-Z][^\W\d_]+)? (?:{STREET_TYPES})\b\.?(?! \d)",
    re.I,
)
ROMANCE = re.compile(
    r"[0-9](?<![\w.\-/][0-9])[0-9]{0,3}(?: ?(?:bis|ter|[A-Za-z]))?,? (?:rue|avenue|impasse|place|chemin|boulevard|quai|allée|allee|cours|route|square|passage) (?:(?:de la|de l'|du|des|de|d'|la|le|les) ?)?[^\W\d_][\w'’\-]+",
    re.I,
)
SOUTHERN = re.compile(
    r"(?<!\w)(?:via|viale|piazza|corso|calle|avenida|paseo|plaza|rua|travessa|largo) (?:(?:de la|de los|del|della|dei|de|da|do|dos|di) )?[^\W\d_][\w'’\-]+,? \d{1,4}[A-Za-z]?(?![\w.])",
    re.I,
)
GERMAN = re.compile(r"(?<!\w)[^\W\d_][^\W\d_\-]*?[ \-]?(?:weg|straße|strasse|str\.|allee|platz|gasse|ring|damm|ufer) \d{1,4}[A-Za-z]?(?![\w.])", re.I)
GERMAN_ENDS = ("weg ", "straße ", "strasse ", "str. ", "allee ", "platz ", "gasse ", "damm ", "ufer ")
SOUTHERN_STARTS = ("via ", "viale ", "piazza ", "corso ", "calle ", "avenida ", "paseo ", "plaza ", "rua ", "travessa ", "largo ")

#: Words that follow a name in the name of a firm, product or street, and that people are not called.
NOT_PEOPLE = frozenset(
    "systems labs lab cooperative sons ltd inc llc gmbh corp corporation company group scheduler server service engine driver module manager project foundation team software solutions technologies industries partners holdings association institute university "
    "street st avenue ave road rd boulevard blvd lane ln drive dr court ct way place unit apt suite via calle avenida rue upper old the this that todo fixme note copyright license licence all uses code generated auto string map list int set new return public private final static class "
    "author contact maintainer owner reviewed signed written thanks ship".split()
)
CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
PAIR = re.compile(rf"(?<![\w.@/$])(?:({CAP}(?:-{CAP})?) (?:([A-Z])\.? )?({CAP}(?:-{CAP})?)|({CAP}(?:-{CAP})?), ({CAP}(?:-{CAP})?)(?: ([A-Z])\.)?)(?![\w@]|-\w|\.\w)")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
NEXT_PART = re.compile(r"(,? (?:[^\W\d_]\.? )?)([^\W\d_]{2,}(?:-[^\W\d_]{2,})?)(?![\w@]|-\w|\.\w)")
PART = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]{2,})?\Z")
HYPHENED = re.compile(r"(?:-[^\W\d_]+)+(?![\w@])")
INITIAL = re.compile(r" [^\W\d_]\.")

TYPES = ("email", "street_address", "phone", "identity_number", "person_name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    form: str
    sure: int | None  # what the form alone says: 1 yes, 0 no, None open


def plain_letters(word: str) -> str:
    """The word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def part_before(text: str, end: int) -> int | None:
    """Where the name part before another one begins, over a blank, with a comma or an initial in between."""
    if not end or text[end - 1] != " ":
        return None
    stops = [end - 1]
    if end > 3 and text[end - 2] == "." and text[end - 3].isalpha() and text[end - 4] == " ":
        stops.append(end - 4)
    elif end > 2 and text[end - 2].isalpha() and text[end - 3] == " ":
        stops.append(end - 3)
    for stop in stops:
        stop -= stop > 0 and text[stop - 1] == ","
        begin = stop
        while begin and (text[begin - 1].isalpha() or text[begin - 1] == "-"):
            begin -= 1
        if PART.match(text[begin:stop]) and not (begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.@/$-")):
            return begin
    return None


class Generators:
    """All candidate spans of a text. Overlaps are wanted here; the judge and the choice come later."""

    def __init__(self, given: frozenset[str], family: frozenset[str]) -> None:
        self.given, self.family = given, family
        self.names = ahocorasick.Automaton()
        for n in given | family:
            self.names.add_word(n, n)
        if len(self.names):
            self.names.make_automaton()

    def emails(self, text: str) -> Iterator[Candidate]:
        for sign in AT_SIGNS:
            at = text.find(sign)
            while at >= 0:
                after = at + len(sign)
                right = DOMAIN.match(text, after)
                start = at
                while start and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    while start < at and text[start] in ".-+":
                        start += 1
                    if start < at and right:
                        end = right.end()
                        domain = right.group()
                        spelled = re.search(r"dot", domain, re.I) is not None and not re.fullmatch(r"[\w.\-]+", domain)
                        if sign == " at " and not (spelled and " dot " in domain):
                            at = text.find(sign, at + 1)
                            continue
                        if sign in ("@", "%40", "&#64;", " (at) ", "(at)") and not spelled:
                            plain = re.match(r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+", text[after : end], re.I)
                            end = after + plain.end() if plain else end
                        last = re.split(DOT, text[after:end], flags=re.I)[-1]
                        ok = TLD.match(last) is not None
                        # machine remotes, connection strings, versions and scopes
                        scheme = text.rfind("://", text.rfind("\n", 0, start) + 1, start)
                        in_url = scheme > 0 and (text[scheme - 1].isalnum() or text[scheme - 1] == "_") and not any(c in " \t\r/'\"" for c in text[scheme + 3 : start])
                        remote = text[end : end + 1] == ":" and re.match(r":[\w~/]", text[end : end + 2]) is not None
                        before = text[start - 1 : start]
                        bad = in_url or remote or before in ("/", "@", ":", "$", "{", "\\") and not text.endswith("mailto:", 0, start) or text[start:at].lower() == "git"
                        yield Candidate("email", start, end, "spelled" if sign != "@" else "plain", int(ok and not bad))
                    elif start < at:
                        yield Candidate("email", start, after + 1, "no_domain", 0)
                at = text.find(sign, at + 1)

    def numbers(self, text: str) -> Iterator[Candidate]:
        for stretch in NUMERIC.finditer(text):
            start, stop = stretch.start(), stretch.end() + 2
            for m in PHONE.finditer(text, start, stop):
                digits = sum(c.isdigit() for c in m.group())
                yield Candidate("phone", m.start(), m.end(), m.lastgroup if m.lastgroup in PHONES else "us_plain", int(9 <= digits <= 15))
            for m in SSN.finditer(text, start, stop):
                yield Candidate("identity_number", m.start(), m.end(), "ssn" if m.group(1) else "nine", 1 if m.group(1) else None)
        for m in NINO_END.finditer(text):
            head = NINO_START.search(text, max(0, m.start() - 4), m.start())
            if head and head.group(1) == m.group(1):
                yield Candidate("identity_number", head.start(), m.end(), "nino", 1 if head.group()[:2].isupper() and m.group()[-1].isupper() else None)

    def distractors(self, text: str) -> Iterator[Candidate]:
        """Numbers of other kinds, for the judge to learn from."""
        for m in DIGIT_RUN.finditer(text):
            if len(m.group()) != 9 and not PHONE.fullmatch(m.group()) and not SSN.fullmatch(m.group()):
                for kind in ("phone", "identity_number"):
                    yield Candidate(kind, m.start(), m.end(), "other", 0)
        for m in COUNTED.finditer(text):
            if not STREET.match(text, m.start()) and not ROMANCE.match(text, m.start()):
                yield Candidate("street_address", m.start(), m.end(), "other", 0)

    def streets(self, text: str, lower: str) -> Iterator[Candidate]:
        for rx, form in ((STREET, "english"), (ROMANCE, "romance")):
            for m in rx.finditer(text):
                s = m.group()
                words = re.split(r"[ ,]+", s)
                end = m.end()
                if s.endswith(".") and not re.search(r"(?i)\b(?:st|ave|rd|blvd|ln|dr|ct)\.$", s):
                    end -= 1
                name = words[-2] if form == "english" else words[-1]
                capital = name[:1].isupper() or s == s.upper()
                yield Candidate("street_address", m.start(), end, form if capital else f"{form}_lower", 1 if capital else None)
        for marks, rx, form in ((SOUTHERN_STARTS, SOUTHERN, "southern"), (GERMAN_ENDS, GERMAN, "german")):
            if any(x in lower for x in marks):
                for m in rx.finditer(text):
                    capital = m.group()[:1].isupper()
                    yield Candidate("street_address", m.start(), m.end(), form if capital else f"{form}_lower", 1 if capital else None)

    def _known(self, a: str, b: str) -> str:
        """How the two parts are known: gf, fg, g?, ?f, f?, ?g, or ?? ."""
        parts = []
        for w in (a, b):
            pieces = plain_letters(w.lower()).split("-")
            g, f = all(p in self.given for p in pieces), any(p in self.family for p in pieces)
            parts.append("g" if g else "f" if f else "?")
        return "".join(parts)

    def people(self, text: str, lower: str) -> Iterator[Candidate]:
        seen = set()

        def made(start: int, end: int, a: str, b: str, comma: bool, case: str) -> Candidate | None:
            if (start, end) in seen:
                return None
            seen.add((start, end))
            known = self._known(a, b)
            form = f"{known}|{'comma' if comma else 'plain'}|{case}"
            if {a.lower(), b.lower()} & NOT_PEOPLE:
                return Candidate("person_name", start, end, f"{form}|word", 0)
            if known == "??" and min(len(a), len(b)) < 3:
                form += "|short"
            return Candidate("person_name", start, end, form, 1 if known in ("gf", "fg") else None)

        pos = 0
        while m := PAIR.search(text, pos):
            a, b, comma = (m.group(1), m.group(3), False) if m.group(1) else (m.group(4), m.group(5), True)
            if c := made(m.start(), m.end(), a, b, comma, "title"):
                yield c
            pos = m.start() + len(a)
        if not len(self.names):
            return
        for last, name in self.names.iter(lower):
            s = last - len(name) + 1
            if (s and (lower[s - 1].isalnum() or lower[s - 1] in "_.@/$-")) or (last + 1 < len(lower) and (lower[last + 1].isalnum() or lower[last + 1] in "_@")):
                continue
            e = last + 1
            if more := HYPHENED.match(text, e):
                e = more.end()
            word = text[s:e]
            case = "upper" if word.isupper() else "lower" if word.islower() else "title"
            near = []
            if m := NEXT_PART.match(text, e):
                near.append((True, m.group(2), m.group(1), s, m.end()))
            if (begin := part_before(text, s)) is not None:
                other, glue = re.match(r"([^\W\d_]+(?:-[^\W\d_]+)*)(.*)", text[begin:s], re.S).groups()
                near.append((False, other, glue, begin, e))
            for after, other, glue, start, end in near:
                if case == "title" and not other[:1].isupper() or case != "title" and (other.islower() if case == "upper" else not other.islower()):
                    continue
                a, b = (word, other) if after else (other, word)
                if "," in glue:
                    initial = INITIAL.match(text, end)
                    end = initial.end() if initial else end
                if case == "lower" and self._known(a, b) not in ("gf", "fg", "g?", "?f"):
                    continue
                if c := made(start, end, a, b, "," in glue, case):
                    yield c

    def all(self, text: str, distractors: bool = False) -> list[Candidate]:
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = [*self.emails(text), *self.numbers(text), *self.streets(text, lower), *self.people(text, lower)]
        return out + list(self.distractors(text)) if distractors else out


NEAR = re.compile(r"[A-Za-z]{3,}")
LEFT_WORDS = re.compile(r"[A-Za-z]+|\d+|[^\w\s]")


def features(text: str, c: Candidate) -> list[str]:
    """Names of the features of a candidate: what stands before and after it, and the shape of its line.

    What the candidate itself looks like is withheld: its form labels the rows that context is learned from.
    """
    floor = max(0, c.start - CONTEXT)
    begin = text.rfind("\n", floor, c.start) + 1
    left = text[max(begin, floor) : c.start]
    stop = text.find("\n", c.end, c.end + CONTEXT)
    right = text[c.end : stop if stop >= 0 else c.end + CONTEXT]
    lw = [w.lower() if w.isalpha() else "9" if w.isdigit() else w for w in LEFT_WORDS.findall(left)[-4:]]
    rw = [w.lower() if w.isalpha() else "9" if w.isdigit() else w for w in LEFT_WORDS.findall(right)[:3]]
    k = c.kind
    out = [
        k,
        f"{k}:l1={lw[-1] if lw else '^'}",
        f"{k}:l2={' '.join(lw[-2:])}",
        f"{k}:l3={' '.join(lw[-3:])}",
        f"{k}:r1={rw[0] if rw else '$'}",
        f"{k}:r2={' '.join(rw[:2])}",
        f"{k}:lc={left[-1:]!r}",
        f"{k}:rc={right[:1]!r}",
        *[f"{k}:in={w}" for w in set(lw) | set(rw) if w.isalpha() and len(w) > 1],
        *[f"{k}:near={w}" for w in sorted({x.lower() for x in NEAR.findall(left)})],
    ]
    if "@" in right or "[at]" in right or "(at)" in right:
        out.append(f"{k}:mail_after")
    if not left.strip(" \t#/*-;\"'"):
        out.append(f"{k}:opens_line")
    return out


@dataclass(frozen=True)
class Row:
    """Alike candidates: their documents' mark, kind, form, what the form says, the features of their context, and their number."""

    doc: int
    kind: str
    form: str
    sure: int | None
    context: tuple[str, ...]
    n: int = 1


@dataclass
class Judge:
    """Trees over context, the share of details among the candidates of each form, and a threshold for each kind."""

    trees: BoostedTrees
    base: dict[str, float]
    forms: dict[str, float]
    thresholds: dict[str, float]

    def chance(self, kind: str, form: str, sure: int | None, context: float) -> float:
        """The chance that a candidate is a detail: what its context says, weighed by how many of its form are details."""
        share = self.forms.get(f"{kind}|{form}|{sure}")
        if share is None:
            share = self.forms.get(f"{kind}|{sure}", 0.5)
        return _posterior(context, self.base.get(kind, 0.5), share)


def ruled_out(kind: str, sure: int | None) -> bool:
    """Exact checks of format: what is no mail address or telephone number at all is nothing that context could bring back."""
    return sure == 0 and kind in ("email", "phone")


def _posterior(context: float, base: float, share: float) -> float:
    odds = lambda p: p / (1 - p)
    x = odds(min(max(context, 0.01), 0.99)) / odds(base) * odds(min(max(share, 1e-4), 1 - 1e-4))
    return x / (1 + x)


def _share(scores: Sequence[tuple[float, int]], base: float, start: float, weight: float) -> float:
    """The share of details among candidates whose contexts have these scores (each with its number of candidates), drawn towards start by a weight of candidates."""
    share, total = start, sum(n for _, n in scores)
    for _ in range(50):
        share = (sum(n * _posterior(p, base, share) for p, n in scores) + weight * start) / (total + weight)
    return share


def labelled(kind: str, form: str, sure: int | None) -> bool:
    """Whether candidates of a form teach the trees; pairs of two unknown words are mostly identifiers and count as no names."""
    return sure is not None or kind == "person_name" and form.startswith("??")


def learn(rows: Sequence[Row], precision: float = PRECISION) -> Judge:
    """A judge of contexts, forms and thresholds, from candidates whose form is withheld from the trees.

    Rows of settled forms are labelled by them; pairs of two unknown words are mostly identifiers and count
    as no names. Documents are cut in two halves and each is scored by trees fitted on the other one, so no
    score below has seen its own label. From these scores, without labels, follow the share of details
    among the candidates of every form, settled or not (by expectation and maximisation), and the least
    threshold of each kind above which the chances expect the precision. A row of n alike candidates counts
    as n rows.
    """
    taught = [r for r in rows if labelled(r.kind, r.form, r.sure)]
    base, kinds = {}, sorted({r.kind for r in rows})
    for kind in kinds:
        own = [(r.sure or 0, r.n) for r in taught if r.kind == kind]
        base[kind] = (sum(y * n for y, n in own) + 1) / (sum(n for _, n in own) + 2)
    fit = lambda part: BoostedTrees.fit([r.context for r in part], [r.sure or 0 for r in part], [r.n for r in part], features=FEATURES)
    halves = [fit([r for r in taught if r.doc % 2 != side]) for side in (0, 1)]
    scores = [halves[r.doc % 2].score(r.context) for r in rows]
    by_form: dict[str, Counter[float]] = {}
    for r, p in zip(rows, scores):
        for key in (f"{r.kind}|{r.form}|{r.sure}", f"{r.kind}|{r.sure}"):
            by_form.setdefault(key, Counter())[p] += r.n
    forms: dict[str, float] = {}
    for r in rows:
        of_class, of_form = f"{r.kind}|{r.sure}", f"{r.kind}|{r.form}|{r.sure}"
        if of_class not in forms:
            forms[of_class] = _share(sorted(by_form[of_class].items()), base[r.kind], base[r.kind], FEW)
        if of_form not in forms:
            # a settled form counts as much as all contexts it was seen in
            settled = 0 if r.sure is None else by_form[of_form].total()
            forms[of_form] = _share(sorted(by_form[of_form].items()), base[r.kind], forms[of_class], FEW + settled)
    judge = Judge(fit(taught), base, forms, {})
    for kind in kinds:
        chances = sorted(((judge.chance(r.kind, r.form, r.sure, p), r.n) for r, p in zip(rows, scores) if r.kind == kind and not ruled_out(kind, r.sure)), reverse=True)
        total, count, least = 0.0, 0, 0.9
        for p, n in chances:
            if (total + p) / (count + 1) >= precision:
                least = p
            total, count = total + p * n, count + n
        if count and total / count >= precision:
            # where all of them together are precise enough, no threshold is needed
            least = 0.0
        judge.thresholds[kind] = min(max(least, LEAST_CHANCE), 0.9)
    return judge


class Finder:
    """The chosen spans of a text."""

    def __init__(self, generators: Generators, model: Judge) -> None:
        self.generators, self.model = generators, model
        self.asked = model.trees.asked()
        self.memo: dict[frozenset[str], float] = {}

    def chance(self, text: str, c: Candidate) -> float:
        """The calibrated chance that a candidate is a detail."""
        return self._chance(c.kind, c.form, c.sure, features(text, c))

    def _chance(self, kind: str, form: str, sure: int | None, context: Sequence[str]) -> float:
        key = self.asked.intersection(context)
        p = self.memo.get(key)
        if p is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            p = self.memo[key] = self.model.trees.score(key)
        return self.model.chance(kind, form, sure, p)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), not overlapping, in the order of the text."""
        return self.chosen((c.kind, c.start, c.end, c.form, c.sure, features(text, c)) for c in self.generators.all(text))

    def chosen(self, candidates: Iterable[tuple[str, int, int, str, int | None, Sequence[str]]]) -> list[tuple[int, int, str]]:
        """The spans among the candidates (kind, start, end, form, sure, features) of a text."""
        taken = []
        for kind, start, end, form, sure, context in candidates:
            if ruled_out(kind, sure):
                continue
            p = self._chance(kind, form, sure, context)
            if p >= self.model.thresholds.get(kind, 0.5):
                taken.append((TYPES.index(kind), -p, -(end - start), start, end, kind))
        taken.sort()
        free: list[tuple[int, int, str]] = []
        for *_, start, end, kind in taken:
            if all(end <= s or start >= e for s, e, _ in free):
                free.append((start, end, kind))
        return sorted(free)

    def redact(self, text: str) -> str:
        return self.replaced(text, self.spans(text))

    @staticmethod
    def replaced(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for start, end, kind in spans:
            out += [text[at:start], PLACEHOLDERS[kind]]
            at = end
        return "".join([*out, text[at:]])


def sample_rows(generators: Generators, doc: int, text: str) -> Iterator[Row]:
    """The candidates of a document."""
    for c in generators.all(text, distractors=True):
        yield Row(doc, c.kind, c.form, c.sure, tuple(features(text, c)))


@dataclass(frozen=True)
class Met:
    """Documents with all their candidates, generated and written once for learning and finding.

    table has a row for each document: __doc, __text (only if kept), __side (0 or 1, by a hash of the id)
    and __found, a JSON list of (kind, start, end, form, sure, features, piece) whose piece is null for what
    only the judge learns from; other rows hold __counts of features by side and no document.
    """

    table: DataFrame
    given: frozenset[str]
    family: frozenset[str]
    doc_id: str


def meet_candidates(df: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> Met:
    """The candidates of all documents. names is the table of known name parts (name_part, name_kind), a dictionary
    of fixed size; more than NAMES_AT_MOST parts are refused, as they travel with every task.
    """
    parts = names.filter("name_part is not null").select(F.lower("name_part").alias("p"), "name_kind").distinct().limit(NAMES_AT_MOST + 1).collect()
    if len(parts) > NAMES_AT_MOST:
        raise ValueError(f"more than {NAMES_AT_MOST} name parts")
    known = lambda kind: frozenset(r["p"] for r in parts if r["name_kind"] == kind)
    given, family = known("given"), known("family")
    columns = ["__doc", "__text", "__side", "__found", "__counts"]
    count_type = pa.list_(pa.struct([("f", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())]))

    def generate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, id_type = Generators(given, family), (Counter(), Counter()), None

        def counted() -> Iterator[pa.RecordBatch]:
            names = sorted({*counts[0], *counts[1]})
            for i in range(0, len(names), 10_000):
                block = [{"f": f, "n0": counts[0][f], "n1": counts[1][f]} for f in names[i : i + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array([None], type=t) for t in (id_type, pa.string(), pa.int32(), pa.string())] + [pa.array([block], type=count_type)], names=columns)
            for c in counts:
                c.clear()

        for batch in batches:
            id_type, found = batch.schema.field(0).type, []
            sides = batch.column(1).to_pylist()
            for side, t in zip(sides, batch.column(2).to_pylist()):
                rows = []
                if t:
                    usual = own.all(t)
                    for i, c in enumerate([*usual, *own.distractors(t)]):
                        context = features(t, c)
                        rows.append((c.kind, c.start, c.end, c.form, c.sure, PART_MARK.join(context), t[c.start : c.end] if i < len(usual) else None))
                        if labelled(c.kind, c.form, c.sure):
                            counts[side].update(set(context))
                found.append(json.dumps(rows) if rows else None)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2) if keep_text else pa.nulls(n, pa.string()), pa.array(sides, pa.int32()), pa.array(found, pa.string()), pa.nulls(n, count_type)], names=columns)
            if len(counts[0]) + len(counts[1]) > HELD_COUNTS:
                yield from counted()
        if id_type is not None:
            yield from counted()

    side = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(2)).cast("int")
    schema = f"__doc {df.schema[doc_id].dataType.simpleString()}, __text string, __side int, __found string, __counts array<struct<f: string, n0: bigint, n1: bigint>>"
    return Met(cut_lineage(df.select(F.col(doc_id), side, F.col(text).cast("string")).mapInArrow(generate, schema)), given, family, doc_id)


def folded_rows(met: Met) -> list[Row]:
    """The candidates of all documents, alike ones as one row.

    The trees ask for no features but the most frequent of the documents they are fitted on, so others are
    left out, and candidates that differ in nothing else are alike. What reaches the driver grows with the
    different contexts, not with the candidates.
    """
    counts = met.table.filter("__counts is not null").select(F.inline("__counts")).groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = cut_lineage(counts.withColumn("n", F.col("n0") + F.col("n1")).filter("n >= 3"))
    asked = sorted({r["f"] for c in ("n0", "n1", "n") for r in counts.filter(F.col(c) >= 3).orderBy(F.col(c).desc(), "f").limit(FEATURES).collect()})
    at = {f: i for i, f in enumerate(asked)}

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple] = Counter()

        def counted() -> pa.RecordBatch:
            arrays = [*zip(*[(*key, n) for key, n in held.items()])] or [[]] * 6
            types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, type=t) for a, t in zip(arrays, types)], names=["side", "kind", "form", "sure", "context", "n"])

        for batch in batches:
            for side, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, _, _, form, sure, context, _ in json.loads(found):
                    held[side, kind, form, sure, " ".join(map(str, sorted({at[f] for f in context.split(PART_MARK) if f in at})))] += 1
            if len(held) > HELD_COUNTS:
                yield counted()
        yield counted()

    key = ["side", "kind", "form", "sure", "context"]
    rows = met.table.filter("__found is not null").select("__side", "__found").mapInArrow(fold, "side int, kind string, form string, sure int, context string, n bigint")
    alike = rows.groupBy(*key).agg(F.sum("n").alias("n")).collect()
    alike.sort(key=lambda r: (r["side"], r["kind"], r["form"], -1 if r["sure"] is None else r["sure"], r["context"]))
    return [Row(r["side"], r["kind"], r["form"], r["sure"], tuple(asked[int(i)] for i in r["context"].split()), r["n"]) for r in alike]


def finder_of(met: Met) -> Finder:
    """A finder fitted on all candidates of all documents."""
    return Finder(Generators(met.given, met.family), learn(folded_rows(met)))


def make_finder(df: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Finder:
    """A finder fitted on all candidates of all documents of df; see meet_candidates for names."""
    return finder_of(meet_candidates(df, names, doc_id, text))


def _candidates(found: str | None) -> tuple[list[tuple], dict[tuple[int, int], str]]:
    """The candidates of a document as Finder.chosen takes them, and their pieces of text."""
    rows = [x for x in json.loads(found or "[]") if x[6] is not None]
    return [(*x[:5], x[5].split(PART_MARK)) for x in rows], {(x[1], x[2]): x[6] for x in rows}


def find_met(met: Met, finder: Finder) -> DataFrame:
    """As find_personal, of documents whose candidates are met already."""
    model, doc_id = finder.model, met.doc_id
    kind = met.table.schema["__doc"].dataType.simpleString()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Finder(Generators(frozenset(), frozenset()), model)
        for batch in batches:
            out = []
            for d, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                candidates, pieces = _candidates(found)
                out += [(d, k, pieces[s, e]) for s, e, k in own.chosen(candidates)]
            columns = list(zip(*dict.fromkeys(out))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=batch.schema.field(0).type), pa.array(columns[1], type=pa.string()), pa.array(columns[2], type=pa.string())], names=[doc_id, "pii_type", "pii_text"])

    return met.table.filter("__found is not null").select("__doc", "__found").mapInArrow(find, f"`{doc_id}` {kind}, pii_type string, pii_text string").distinct()


def redact_met(met: Met, finder: Finder) -> DataFrame:
    """As redact_personal, of documents whose candidates are met already and whose texts were kept."""
    model, doc_id = finder.model, met.doc_id
    kind = met.table.schema["__doc"].dataType.simpleString()

    def redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Finder(Generators(frozenset(), frozenset()), model)
        for batch in batches:
            texts = [own.replaced(t, own.chosen(_candidates(found)[0])) if t else t for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[doc_id, "text"])

    return met.table.filter("__counts is null").select("__doc", "__text", "__found").mapInArrow(redact, f"`{doc_id}` {kind}, text string")


def _workers_finder(finder: Finder):
    """What a task needs to make the finder again; the automaton is rebuilt in the worker."""
    given, family, model = finder.generators.given, finder.generators.family, finder.model
    made: list[Finder] = []

    def get() -> Finder:
        if not made:
            made.append(Finder(Generators(given, family), model))
        return made[0]

    return get


def find_personal(df: DataFrame, finder: Finder, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_type, pii_text): each different detail of a document once, as it stands in the text.

    Whole texts are searched. Null and empty texts have no details. Rows of one doc_id count as one document.
    """
    get = _workers_finder(finder)
    kind = df.schema[doc_id].dataType.simpleString()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            out = [(d, k, t[s:e]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for s, e, k in own.spans(t)]
            columns = list(zip(*dict.fromkeys(out))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=batch.schema.field(0).type), pa.array(columns[1], type=pa.string()), pa.array(columns[2], type=pa.string())], names=[doc_id, "pii_type", "pii_text"])

    return df.select(doc_id, F.col(text).cast("string")).mapInArrow(find, f"`{doc_id}` {kind}, pii_type string, pii_text string").distinct()


def redact_personal(df: DataFrame, finder: Finder, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with every detail replaced by a typed placeholder; null texts stay null."""
    get = _workers_finder(finder)
    kind = df.schema[doc_id].dataType.simpleString()

    def redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            texts = [own.redact(t) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[doc_id, "text"])

    return df.select(doc_id, F.col(text).cast("string")).mapInArrow(redact, f"`{doc_id}` {kind}, text string")
