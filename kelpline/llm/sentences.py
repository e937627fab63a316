"""Sentence units of prose in many languages, after statistics learned from the documents themselves.

Texts are read once. That pass notes every place where a unit may end, with its surroundings, in a table of its own,
and counts for each language, over all documents, how often each word type
comes with and without a following period, what follows it then, and which words open sentences (they
follow an unmistakable end mark, or begin a paragraph). From these counts:

* sentence starters are the words that by a log-likelihood ratio come at sentence openings more often than
  errors (openings that are none, at which words come as they do elsewhere) would bring them there;
* collocations are pairs over a period whose second word, by such a ratio, follows the first more often than
  OVER times its share of openings, with the error of that share, would make it;
* abbreviations are the types that the ratio shows to attract the period, scaled by
  length, inner periods and occurrences without it, and that go on within a sentence often enough; or those
  that by the ratio go on more often than the language's other types, and mostly do.

The noted places are then classified, without the texts: after an abbreviation, an initial or a number the sentence
ends only if the next word is a starter and the pair is no collocation; after any other word it ends
unless the next word is lower-case and no starter. What stands in quotes or brackets is never divided;
after a closing mark the same statistics tell whether the sentence goes on.

Scripts with end marks of their own (ideographic stops, danda, Arabic question mark) end at them; in Thai,
white space parts sentences unless a number or a Latin word stands beside it.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.prose import TEXT_KINDS, blocks, text_cells
from kelpline.session import materialize

#: Documents of each label that the languages are learned from.
SAMPLE_DOCS = 4096
#: Weight, in words, of the script's common word shares in those of a language.
COMMON_WORDS = 1000.0
NO_ID = -(2**63)
ABBREVIATION_SCORE = 0.3
GOES_ON_SHARE = 0.04
#: Least log-likelihood ratios: of collocations, and of types that go on. That of starters is 2 + 2 ln(openings), as
#: about so many words are judged.
COLLOCATION_RATIO = 7.88
#: Share of the openings that are taken for errors in judging starters.
ERROR_SHARE = 0.01
GOES_ON_RATIO = 30.0
OVER = 3.0
SHORT = 3

#: Tags that stand for no language (ISO 639-2, BCP 47).
NO_LANGUAGE = r"^\s*(und|undetermined|unknown|mul|mis|zxx|q[a-t][a-z]|xx|none|null)\s*([-_].*)?$"

#: Code point ranges of the scripts' letters.
SCRIPTS = [
    ("latn", 0x41, 0x5A), ("latn", 0x61, 0x7A), ("latn", 0xC0, 0x24F), ("grek", 0x370, 0x3FF), ("cyrl", 0x400, 0x4FF), ("arab", 0x600, 0x6FF),
    ("deva", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("grek", 0x1F00, 0x1FFF), ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("hang", 0xAC00, 0xD7AF), ("cjk", 0xF900, 0xFAFF),
]
KANA = re.compile("[\u3040-\u30ff]")
BEYOND_LATIN = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u3040-\uffff]")
#: Pairs of quotes and brackets.
PAIRS = {"(": ")", "[": "]", "{": "}", "„": "“”", "“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "［": "］"}
CLOSERS = set("".join(PAIRS.values()))
ONLY_CLOSERS = CLOSERS - set(PAIRS)
OPENING = "\"'„“‘«‹「『(（[{¿¡【《*_"
CJK_ENDS = "。！？．"
FINAL = set(".!?…।؟۔" + CJK_ENDS)
ENDS = ".!?;\u037e؟।॥۔。！？．‼⁇⁈⁉…"
MARKS = "\"()[]{}" + "„“”«»‹›「」『』（）【】《》"
#: Begins with one character class, which the regex engine can skip to; what it is, the lookbehinds tell.
EVENT = re.compile(
    rf"[{re.escape(ENDS + MARKS)}`$h](?:(?<=[{ENDS}])(?P<end>[{ENDS}]*)|(?<=[{re.escape(MARKS)}])(?P<pair>)|(?<=`)(?P<code>`*)"
    r"|(?<=h)(?P<url>ttps?://(?:(?![.!?][^\W\d_a-z])[^\s<>\"”。，（）()])+(?<![.,;:!?'’*_…]))|(?<=\$)(?P<math>[^\s$](?:[^$\n]*[^\s$])?\$))"
)
WORD = re.compile(r"[^\W\d_][\w'’-]*", re.UNICODE)
BARE = re.compile(r"[^\W\d_][\w'’-]*+(?!\.)", re.UNICODE)
NUMBERS = re.compile(r"(?<![\w.])\d")
AROUND = re.compile(r"[\"„“”«»()\[\]{}¿¡`]")
JOINED = re.compile(r"[^\W\d_]{3}[.!?]((?=[^\W\d_])[^a-z]\S*)$")
NUMERIC = re.compile(r"[-+]?\d[\d.,:/]*$")
INITIAL = re.compile(r"[^\W\d_]$")
SPACE = re.compile(r"\s*")
SPACE_OR_OPENING = re.compile(r"[\s" + re.escape(OPENING) + r"]*")
NEXT = re.compile(r"[\w\u0900-\u0dff\u0e31-\u0e4e'’.-]*[\w\u0900-\u0dff\u0e31-\u0e4e]")
NOT_BREAK = re.compile(r"[^\r\n]")
DATE = re.compile(r"(?<!\d)\d{1,2}$")
AFTER_DATE = re.compile(r"\d{1,2}\.|\d{4}\b")
QUOTED = "##quote##"
NUM = "##number##"


def script_of(text: str) -> str:
    """The script most letters of the text belong to; ideographs and kana count double, as they are words."""
    if not BEYOND_LATIN.search(text):
        return "latn"
    n: Counter = Counter()
    for c, k in Counter(text).items():
        n[script_of_letter(c)] += k
    n["cjk"] *= 2
    del n[""]
    return max(n, key=lambda s: (n[s], s == "latn"), default="latn")


@lru_cache(maxsize=1 << 16)
def script_of_letter(c: str) -> str:
    return next((name for name, lo, hi in SCRIPTS if lo <= ord(c) <= hi), "")


def label_of(lang: Column) -> Column:
    """The first two letters of a language tag, lower-cased; '' if there is none or it names no language."""
    tag = F.lower(F.coalesce(lang, F.lit("")))
    label = F.regexp_extract(tag, r"^\s*([a-z]{2})", 1)
    return F.when(tag.rlike(NO_LANGUAGE), F.lit("")).otherwise(label)


@dataclass
class Languages:
    """Naive Bayes over words, fitted on a bounded sample of each label's rows; told apart only within a script."""

    #: Per script its languages, that with most words first.
    by_script: dict[str, list[str]] = field(default_factory=dict)
    #: Per script the weights of each word, in the order of its languages, and those of an unseen word.
    weights: dict[str, dict[str, tuple[float, ...]]] = field(default_factory=dict)
    unseen: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def of(self, script: str, words: list[str]) -> str:
        known = self.by_script.get(script, [])
        if len(known) < 2:
            return known[0] if known else script
        table, unseen = self.weights[script], self.unseen[script]
        sums = list(map(sum, zip(*[table.get(w, unseen) for w in words]))) if words else unseen
        return known[sums.index(max(sums))]


def fit_languages(rows: list[tuple[str, str, str, int]]) -> Languages:
    """From (label, script, word, n), or the number of documents at word '': each label's script is that of
    most of its documents; those in other scripts don't count. A language's word shares are drawn towards
    those of its script, so that one with few words isn't preferred for words it has never seen."""
    votes: dict[str, Counter] = {}
    for label, script, word, n in rows:
        if not word:
            votes.setdefault(label, Counter())[script] += n
    home = {k: max(v, key=lambda s: (v[s], s)) for k, v in votes.items()}
    counts: dict[str, Counter] = {k: Counter() for k in home}
    for label, script, word, n in rows:
        if word and home[label] == script:
            counts[label][word] += n
    out, size = Languages(), {k: sum(c.values()) for k, c in counts.items()}
    for k in sorted(counts, key=lambda k: (-size[k], k)):
        out.by_script.setdefault(home[k], []).append(k)
    for script, known in out.by_script.items():
        common: Counter = Counter()
        for k in known:
            common.update(counts[k])
        every = sum(common.values()) + 1
        weight = lambda w: tuple(math.log((counts[k][w] + COMMON_WORDS * (common[w] or 1) / every) / (size[k] + COMMON_WORDS)) for k in known)  # noqa: B023, E731
        out.weights[script] = {w: weight(w) for w in common}
        out.unseen[script] = (0.0,) * len(known)
    return out


@dataclass
class Model:
    """What was learned for one language."""

    abbreviations: set[str] = field(default_factory=set)
    starts: set[str] = field(default_factory=set)
    pairs: set[tuple[str, str]] = field(default_factory=set)
    totals: dict[str, int] = field(default_factory=dict)

    def fits_start(self, before: str, word: str) -> bool:
        """Whether ``word`` opens sentences, and doesn't belong to ``before``."""
        return word in self.starts and (before, word) not in self.pairs


def next_word(text: str, at: int, script: str) -> str:
    """The word at or after ``at``, past white space and opening marks: a number as NUM, two characters in
    scripts without spaces, '`' for code; '' at the end."""
    at = SPACE_OR_OPENING.match(text, at).end()
    if at >= len(text):
        return ""
    c = text[at]
    if c == "`":
        return "`"
    if c.isdigit():
        return NUM
    if script == "cjk" and not c.isascii():
        return text[at : at + 2]
    if m := NEXT.match(text, at):
        word = m.group()
        return word if script != "cjk" else word[:2]
    return c


def type_before(text: str, at: int) -> str:
    """The word type ending just before a period at ``at``: lower-cased but for single capitals' case and
    leading capitals of short words, numbers as NUM, '' if none."""
    back = 40
    while back < at and len(text[at - back : at].split(None, 1)) < 2:  # a longer word
        back *= 2
    piece = text[max(0, at - back) : at]
    if not piece or piece[-1].isspace():
        return ""
    t = piece.rsplit(None, 1)[-1]
    if not t.isalnum():
        t = AROUND.split(t)[-1].strip("*_'‘’")
    if not t:
        return ""
    if NUMERIC.match(t):
        return NUM
    if "/" in t or "=" in t:
        return ""
    t = t.rpartition("—")[2]
    if m := JOINED.search(t):  # a sentence begun without a space
        t = m.group(1)
    return t if len(t) <= 3 else t.lower()


@dataclass(slots=True)
class Candidate:
    end: int  # after end mark and closing marks
    kind: str  # 'hard', 'period', 'dots', 'close'
    before: str
    spaced: bool
    mark: int


def candidates(text: str, script: str, greek: bool) -> list[Candidate]:
    """Places outside quotes and brackets where a unit may end. Unpaired marks count as none."""
    events = [(m.start(), m.end(), m.lastgroup, m.group()) for m in EVENT.finditer(text)]
    partner: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    skip_to = -1
    for start, end, kind, c in events:
        if kind == "end" or start < skip_to:
            continue
        if kind == "code":
            close = text.find(c, end)
            while close >= 0 and (text[close - 1] == "`" or text[close + len(c) : close + len(c) + 1] == "`"):
                close = text.find(c, close + len(c))
            if close >= 0:
                skip_to = partner[start] = close + len(c)
        elif kind != "pair":
            skip_to = partner[start] = end
        elif c == '"':
            if any(o == '"' for o, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                partner[stack.pop()[1]] = end
            elif start == 0 or not text[start - 1].isalnum():
                stack.append((c, start))
        elif stack and any(c in PAIRS.get(o, "") for o, _ in stack):
            while c not in PAIRS.get(stack[-1][0], ""):
                stack.pop()
            partner[stack.pop()[1]] = end
        elif c in PAIRS:
            stack.append((c, start))
    out, at = [], 0
    for start, end, kind, mark in events:
        if start < at:
            continue
        if start in partner:
            close = at = partner[start]
            if kind == "pair":
                last = close - 1
                while last > end and (text[last - 1].isspace() or text[last - 1] in CLOSERS or text[last - 1] == '"'):
                    last -= 1
                if last > end and (text[last - 1] in FINAL or (greek and text[last - 1] in ";\u037e")):
                    out.append(Candidate(close, "close", QUOTED, close >= len(text) or text[close].isspace(), close))
            continue
        if kind != "end" or (not greek and set(mark) <= {";", "\u037e"}):
            continue
        while end < len(text) and (text[end] in CLOSERS or text[end] in "*_’") and end not in partner:
            end += 1
        at = end
        if mark == ".":
            kind = "period"
        else:
            kind = "dots" if set(mark) <= {".", "…"} else "hard"
        out.append(Candidate(end, kind, type_before(text, start) if kind == "period" else "", end >= len(text) or text[end].isspace(), start))
    return out


class Place(NamedTuple):
    """All that is asked of a candidate and its surroundings."""

    end: int
    rest: int  # of the next character that isn't white space; -1 at the end
    kind: str
    before: str
    spaced: bool
    mark: str
    ch: str  # at rest
    word: str  # the next word
    dashed: str  # that after a dash at rest
    date: bool  # a number within a date


def places(text: str, script: str) -> list[Place]:
    out = []
    for c in candidates(text, script, script == "grek"):
        rest = SPACE.match(text, c.end).end()
        if rest >= len(text):
            out.append(Place(c.end, -1, c.kind, c.before, c.spaced, "", "", "", "", False))
            continue
        ch = text[rest]
        dashed = next_word(text, rest + 1, script) if ch in "—–-" and c.spaced else ""
        date = c.kind == "period" and c.before == NUM and bool(DATE.search(text, max(0, c.mark - 3), c.mark) and AFTER_DATE.match(text, rest))
        out.append(Place(c.end, rest, c.kind, c.before, c.spaced, text[c.mark], ch, next_word(text, rest, script), dashed, date))
    return out


def ends(c: Place, script: str, model: Model) -> bool:
    """Whether a unit ends at the place."""
    if c.rest < 0:
        return True
    ch, word = c.ch, c.word
    if ch in ",:，：、،؛)]}" or (ch == ";" and script != "grek") or ch in ONLY_CLOSERS:
        return False
    if c.kind == "close" and ch in ".!?…。！？":
        return False
    if ch in "—–-" and not c.spaced:
        return False
    if c.dashed:
        return not c.dashed[:1].islower() and c.kind != "close"
    lower = word[:1].islower() and script != "cjk"
    caseless = script in ("cjk", "deva", "arab", "hang") and not word[:1].isascii()
    if script == "cjk":
        if c.kind == "close":
            return model.fits_start(QUOTED, word)
        if c.kind == "period":
            return c.spaced and not word[:1].islower()
        return True
    if c.kind == "hard":
        if not c.spaced and not caseless and not word[:1].isupper():
            return c.mark in "।؟" + CJK_ENDS
        return not lower or word in model.starts or c.mark in "।؟"
    if c.kind == "dots":
        return (not lower and not caseless and word != "`") or word in model.starts
    if c.kind == "close":
        return model.fits_start(QUOTED, word) if lower or caseless else True
    before = c.before
    if not c.spaced:
        known = len(before) >= 3 and "." not in before or model.totals.get(before, 0) >= 5
        return known and before not in model.abbreviations and before != NUM and word[:1].isupper() and model.fits_start(before, word)
    if c.date:
        return False
    if not before:
        return not lower or word in model.starts
    bound = before in model.abbreviations or INITIAL.match(before)
    if before == NUM:
        bound = True if lower or word == NUM else model.totals.get(NUM, 0) > 0
    if bound or len(before) <= SHORT and (before, word) in model.pairs:
        return model.fits_start(before, word)
    return not lower or word in model.starts


def thai_cuts(text: str) -> list[int]:
    """Where white space parts Thai sentences: not beside a number or a Latin word, not within marks."""
    closed, depth = [], 0
    for m in EVENT.finditer(text):
        if m.lastgroup == "pair" and m.group() in PAIRS and any(x in text[m.end() :] for x in PAIRS[m.group()]):
            depth += 1
            closed.append((m.start(), min(text.find(x, m.end()) for x in PAIRS[m.group()] if x in text[m.end() :])))
    near = re.compile(r"[A-Za-z0-9À-ɏ`$]")
    out = []
    for m in re.finditer(r"\s+", text):
        if not m.start() or m.end() >= len(text) or near.match(text[m.start() - 1]) or near.match(text[m.end()]):
            continue
        if text[m.start() - 1] in ")]" or text[m.end()] in "([" or text[m.start() - 1] in "%:,–—-" or text[m.end()] in "–—-…":
            continue
        if any(a < m.start() < b for a, b in closed):
            continue
        out.append(m.start())
    return out


class Scanned(NamedTuple):
    """A block: where its text begins in the cell, the text's first and last characters that aren't white space, and the
    places where units may end; or, in Thai, where they do."""

    at: int
    start: int
    stop: int
    places: list[Place]
    cuts: list[tuple[int, int]]  # end of a unit, start of the next


def body_of(cell: str, spans: list[tuple[int, int]]) -> str:
    """The text of a block; markers at line starts become white space, so that offsets stay."""
    if len(spans) == 1:
        return cell[spans[0][0] : spans[0][1]]
    parts, at = [], spans[0][0]
    for a, b in spans:
        parts.append(NOT_BREAK.sub(" ", cell[at:a]))
        parts.append(cell[a:b])
        at = b
    return "".join(parts)


def scan(body: str, at: int, kind: str, script: str) -> Scanned:
    start, stop = len(body) - len(body.lstrip()), len(body.rstrip())
    if kind == "h":
        return Scanned(at, start, stop, [], [])
    if script == "thai":
        return Scanned(at, start, stop, [], [(cut, SPACE.match(body, cut).end()) for cut in thai_cuts(body)])
    return Scanned(at, start, stop, places(body, script), [])


def divided(block: Scanned, script: str, model: Model) -> Iterator[tuple[int, int]]:
    """(start, end) of the units of a block, offsets within the cell. A unit ends where a mark stands, so it has no
    white space at its end, and the next one begins at the next character that is none."""
    at = block.start
    for p in block.places:
        if ends(p, script, model):
            if p.end > at:
                yield block.at + at, block.at + p.end
            at = p.rest if p.rest >= 0 else block.stop
    for cut, after in block.cuts:
        if cut > at:
            yield block.at + at, block.at + cut
        at = after
    if block.stop > at:
        yield block.at + at, block.at + block.stop


def units(text: str, spans: list[tuple[int, int]], kind: str, script: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the units of one block, offsets as those of ``spans``; ``text`` is the cell."""
    return list(divided(scan(body_of(text, spans), spans[0][0], kind, script), script, model))


def _cells(text: str | None, cells) -> Iterator[tuple[int, str]]:
    for a, b in text_cells(text, cells) if text else ():
        yield a, text[a:b]


def _prose(cell: str) -> tuple[list, str]:
    found = blocks(cell)
    return found, "\n".join(cell[b.start : b.end] for b in found)


def _language(script: str, prose: str, languages: Languages) -> str:
    """The language of a cell."""
    if script == "cjk":
        return "cjk-kana" if KANA.search(prose) else "cjk-han"
    if len(known := languages.by_script.get(script, ())) < 2:
        return known[0] if known else script
    return languages.of(script, WORD.findall(prose.lower()))


def counted(text: str, kind: str, script: str, found: list[Place], counts: Counter, words: Counter) -> None:
    """Adds one block's statistics to ``counts``, (what, a, b), and its words without a period to ``words``: as
    ``next_word`` would give them."""
    if script == "cjk":
        words.update(map("".join, zip(text, text[1:])))
    else:
        words.update((BARE if script != "deva" else NEXT).findall(text))
        words[NUM] += len(NUMBERS.findall(text))
        words["`"] += text.count("`") // 2
    if kind == "p" and (w := next_word(text, 0, script)):
        counts["s", w, ""] += 1
    for c in found:
        if c.kind == "dots" or c.kind == "period" and not (c.before and c.spaced):
            continue
        if c.kind == "period":
            counts["p", c.before, c.word] += 1
        elif c.kind == "close":
            if c.word and c.rest >= 0 and c.ch not in ",:，：、—–.":
                counts["p", QUOTED, c.word] += 1
        elif c.kind == "hard" and c.word and (c.spaced or script == "cjk") and not (c.end and text[c.end - 1] in CLOSERS):
            counts["s", c.word, ""] += 1


STATS = "lang STRING, what STRING, a STRING, b STRING, n BIGINT"


def scanned(docs: DataFrame, languages: Languages) -> DataFrame:
    """One pass over the texts: partial counts ``lang, what, a, b, n``, and for each document (what = 'd') its blocks with all that
    deciding on them asks, as ``blob``: (offset of the cell, language, script, blocks)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, tuple[Counter, Counter]] = {}
        for df in it:
            ids, blobs = [], []
            for doc, text, cells in zip(df["doc_id"], df["text"], df["cells"]):
                met = []
                for at, cell in _cells(text, cells):
                    found, prose = _prose(cell)
                    if not found:
                        continue
                    script = script_of(prose)
                    lang, done = _language(script, prose, languages), []
                    counts = total.setdefault(lang, (Counter(), Counter()))
                    for b in found:
                        body = body_of(cell, b.spans)
                        done.append(scan(body, b.start, b.kind, script))
                        if b.kind != "h":
                            counted(body, b.kind, script, done[-1].places, *counts)
                    met.append((at, lang, script, [(*d[:3], [tuple(p) for p in d.places], d.cuts) for d in done]))
                if met:
                    ids.append(doc)
                    blobs.append(zlib.compress(pickle.dumps(met, 5), 1))
            yield pd.DataFrame({"lang": None, "what": "d", "a": None, "b": None, "n": 0, "doc_id": ids, "blob": blobs})
            if sum(len(c) + len(w) for c, w in total.values()) > 200_000:
                yield _stat_rows(total)
                total = {}
        yield _stat_rows(total)

    named = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "cells")  # no nulls, so ids stay integers in pandas
    return named.mapInPandas(run, f"{STATS}, doc_id BIGINT, blob BINARY")


def _stat_rows(total: dict[str, tuple[Counter, Counter]]) -> pd.DataFrame:
    rows = [(lang, *k, n) for lang, (c, _) in total.items() for k, n in c.items()]
    rows += [(lang, "w", w, "", n) for lang, (_, c) in total.items() for w, n in c.items()]
    return pd.DataFrame(rows, columns=["lang", "what", "a", "b", "n"]).assign(doc_id=NO_ID, blob=None)


def _likelihood(n_period: int, n_all: int, periods: int, words: int) -> float:
    """Log-likelihood ratio that a type takes the period nearly always, against by chance."""
    p, q = min(max(periods / max(words, 1), 1e-9), 1 - 1e-9), 0.99
    rest = n_all - n_period
    return 2 * (n_period * math.log(q / p) + rest * math.log((1 - q) / (1 - p)))


def ratio(k1: float, n1: float, k2: float, n2: float) -> float:
    """Log-likelihood ratio of two shares, k1 of n1 and k2 of n2, being unlike, against being one."""
    p = (k1 + k2) / max(n1 + n2, 1)
    part = lambda k, n, q: k * math.log(k / (n * q)) if k > 0 else 0.0
    return 2 * (part(k1, n1, p) + part(n1 - k1, n1, 1 - p) + part(k2, n2, p) + part(n2 - k2, n2, 1 - p))


def excess_column(n: Column, expected: Column) -> Column:
    """Log-likelihood ratio of a count having its own rate, against the expected one (Poisson's law)."""
    return 2 * (n * F.ln(n / expected) - (n - expected))


def learn(stats: DataFrame) -> dict[str, Model]:
    """The models of all languages. All counts are summed and judged in Spark; only the decisions that ``ends``
    can ask for are gathered: abbreviations, starters, collocations, and the totals that are looked up."""
    stats = materialize(stats, "statistics")
    opened = stats.where("what = 's'").groupBy("lang").agg(F.sum("n").alias("opened"))
    words = stats.where("what = 'w'").groupBy("lang").agg(F.sum("n").alias("words"))
    sizes = materialize(opened.join(words, "lang", "full"), "sizes")  # a row a language
    opened, words = F.coalesce("opened", F.lit(0)), F.coalesce("words", F.lit(0))
    everywhere = stats.where("what = 'w'").select("lang", "a", F.col("n").alias("n_word"))
    openings = stats.where("what = 's'").select("lang", "a", "n").join(everywhere, ["lang", "a"], "left").join(F.broadcast(sizes), "lang")
    elsewhere = F.greatest(F.coalesce("n_word", F.lit(0)) - F.col("n"), F.lit(0)) + 1
    by_error = ERROR_SHARE * opened * F.least(elsewhere / F.greatest(words - opened, F.lit(1)), F.lit(1.0))
    starts = materialize(openings.where((excess_column(F.col("n"), by_error) >= 2 + 2 * F.ln(F.greatest(opened, F.lit(1)))) & (F.col("n") > by_error)).select("lang", F.col("a").alias("b"), "n"), "starters")
    per_type = stats.where("what = 'p'").groupBy("lang", "a").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("b") != "", F.col("n")).otherwise(0)).alias("total"))
    types = materialize(per_type, "types")
    pairs = (
        stats.where("what = 'p' AND b != ''").select("lang", "a", "b", "n")
        .join(types.select("lang", "a", "total"), ["lang", "a"])
        .join(stats.where("what = 's'").select("lang", F.col("a").alias("b"), F.col("n").alias("n_open")), ["lang", "b"], "left")
        .join(starts.select("lang", "b", F.lit(True).alias("starter")), ["lang", "b"], "left")
        .join(F.broadcast(sizes), "lang")
    )
    n_opened = F.greatest(opened, F.lit(1))
    as_opening = OVER * F.col("total") * (F.coalesce("n_open", F.lit(0)) / n_opened + 0.5 / F.sqrt(n_opened))
    bound = (excess_column(F.col("n"), as_opening) >= COLLOCATION_RATIO) & (F.col("n") > as_opening)
    pairs = materialize(pairs.select("lang", "a", "b", "n", "total", F.coalesce("starter", F.lit(False)).alias("starter"), bound.alias("bound")), "pairs")
    goes_on = pairs.where("NOT starter OR bound").groupBy("lang", "a").agg(F.sum("n").alias("goes_on"))
    lower = F.when(F.length("a") <= 3, F.col("a")).otherwise(F.lower("a"))
    bare = everywhere.groupBy("lang", lower.alias("a")).agg(F.sum("n_word").alias("n_word"))
    of_types = types.join(goes_on, ["lang", "a"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(0)))
    all_types = of_types.groupBy("lang").agg(F.sum("n").alias("periods"), F.sum("goes_on").alias("all_on"), F.sum("total").alias("all_total"))
    judged = of_types.where("goes_on > 0").join(bare, ["lang", "a"], "left").join(F.broadcast(all_types), "lang").join(F.broadcast(sizes), "lang")
    judged = judged.select("lang", "a", "n", F.coalesce("n_word", F.lit(0)).alias("n_word"), words.alias("words"), "periods", "goes_on", "total", "all_on", "all_total")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            yield df.loc[[is_abbreviation(*r) for r in df.drop(columns="lang").itertuples(index=False)], ["lang", "a"]]

    out: dict[str, Model] = {}
    for lang, b in starts.select("lang", "b").collect():
        out.setdefault(lang, Model()).starts.add(b)
    for lang, a in judged.mapInPandas(run, "lang STRING, a STRING").collect():
        out.setdefault(lang, Model()).abbreviations.add(a)
    # a pair whose word is no starter is asked for only after short types
    asked = pairs.where(F.col("bound") & (F.col("starter") | (F.length("a") <= SHORT)))
    for lang, a, b in asked.select("lang", "a", "b").collect():
        out.setdefault(lang, Model()).pairs.add((a, b))
    known = (F.col("total") >= 5) & ((F.length("a") < 3) | F.col("a").contains(".")) | (F.col("a") == NUM)
    for lang, a, total in types.where(known & (F.col("total") > 0)).select("lang", "a", "total").collect():
        out.setdefault(lang, Model()).totals[a] = total
    return out


def is_abbreviation(a: str, n: int, n_word: int, words: int, periods: int, goes_on: int, total: int, all_on: int, all_total: int) -> bool:
    """Whether a type is an abbreviation, by its counts with and without a period, those of its language,
    and how many of its ``total`` next words go on within the sentence, of ``all_on`` of all types."""
    if a in (NUM, QUOTED) or not re.search(r"[^\W\d_]", a) or ("." in a and max(map(len, a.split("."))) > SHORT):
        return False
    bare_length = max(1, len(a.replace(".", "")))
    n_all = n + (n_word if "." not in a else 0)
    score = _likelihood(n, n_all, periods, words or 1) * math.exp(-bare_length) * (a.count(".") + 1) * bare_length ** -float(min(60, n_all - n))
    # a type seen to go on in most places is an abbreviation even if it is long
    share = goes_on / max(1, total)
    often = share >= 0.5 and n >= 0.5 * n_all and ratio(goes_on, total, all_on - goes_on, max(1, all_total - total)) >= GOES_ON_RATIO
    return (score >= ABBREVIATION_SCORE and share >= GOES_ON_SHARE) or often


def sample_rows(docs: DataFrame, size: int = SAMPLE_DOCS) -> list[tuple[str, str, str, int]]:
    """(label, script, word, n) over the whole prose of about ``size`` documents of each label, or all it
    has, chosen by a hash; word '' counts documents. The driver gets words of each label's own script only."""
    labelled = docs.withColumn("label", label_of(F.col("lang"))).where("label != ''")
    h = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30))
    part = labelled.join(F.broadcast(labelled.groupBy("label").agg(F.count("*").alias("n"))), "label").where(h * F.col("n") < F.lit(size << 30))

    def rows_of(total: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in total.items()], columns=["label", "script", "word", "n"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for df in it:
            for label, text, cells in zip(df["label"], df["text"], df["cells"]):
                prose = "\n".join(_prose(c)[1] for _, c in _cells(text, cells))
                if words := Counter(WORD.findall(prose.lower())):
                    script = script_of(prose)
                    total[label, script, ""] += 1
                    for w, n in words.items():
                        total[label, script, w] += n
            if len(total) > 200_000:
                yield rows_of(total)
                total = Counter()
        yield rows_of(total)

    counts = part.select("label", "text", "cells").mapInPandas(run, "label STRING, script STRING, word STRING, n BIGINT")
    counts = materialize(counts.groupBy("label", "script", "word").agg(F.sum("n").alias("n")), "words")
    home = counts.where("word = ''").groupBy("label").agg(F.max_by("script", F.struct("n", "script")).alias("script"))
    return [tuple(r) for r in counts.join(F.broadcast(home), ["label", "script"]).select("label", "script", "word", "n").collect()]


def split_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every sentence unit in the text cells of every document.

    Null or empty texts, and documents without text cells, give no units; repeated rows give their units
    each time. Offsets are code points of ``text``.
    """
    languages = fit_languages(sample_rows(docs))
    passed = materialize(scanned(docs, languages), "scanned")
    learned = learn(passed.where("what <> 'd'").groupBy("lang", "what", "a", "b").agg(F.sum("n").alias("n")))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = Model()
        for df in it:
            ids, starts, stops = [], [], []
            for doc, blob in zip(df["doc_id"], df["blob"]):
                for at, lang, script, met in pickle.loads(zlib.decompress(blob)):
                    model = learned.get(lang, none)
                    for block in met:
                        block = Scanned(*block[:3], [Place(*p) for p in block[3]], block[4])
                        for s, e in divided(block, script, model):
                            ids.append(doc)
                            starts.append(at + s)
                            stops.append(at + e)
            yield pd.DataFrame({"doc_id": ids, "start_pos": starts, "end_pos": stops})

    found = passed.where("what = 'd'").select("doc_id", "blob").mapInPandas(run, "doc_id BIGINT, start_pos INT, end_pos INT")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def unit_faults(units: DataFrame, docs: DataFrame) -> DataFrame:
    """One row, for checking: documents, units that lie in no text cell, that are empty or have outer white space, and that
    begin before another one of the document ended. Ids must be unique."""
    inside = F.exists("cells", lambda c: F.lower(F.trim(c["kind"])).isin(*TEXT_KINDS) & (c["start_pos"] <= F.col("start_pos")) & (c["end_pos"] >= F.col("end_pos")))
    piece = F.substring("text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    before = F.max("end_pos").over(Window.partitionBy("doc_id").orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = units.withColumn("before", before).join(docs.select("doc_id", "text", "cells"), "doc_id")
    return rows.agg(
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_outside"), F.count_if(~piece.rlike(r"(?s)^\S(.*\S)?$")).alias("n_untrimmed"),
        F.count_if(F.col("start_pos") < F.col("before")).alias("n_overlaps"), (F.count("*") > 0).alias("any")).withColumn("n_documents", F.lit(docs.count()))
