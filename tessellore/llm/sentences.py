"""Sentence units of texts in many languages, with abbreviations learned without labels.

Texts are read once. The reading counts, per language, how often each type stands with and without a
final period, in the middle of a sentence or at a certain start (of a paragraph, or behind ! or ?),
and notes every place where a unit could end: certain ones, and *questions* to the model (a type, its
period, and what follows). From the log-likelihood ratios of the counts come the abbreviations and the
sentence starters. The questions about abbreviations are then counted too: they give the collocations
across a period (a type and the next word, a type and the word after a name, a type and a number) and
which abbreviations can end a sentence, by how often a known starter follows. At last the questions
are answered; the texts are not read again.

Blank lines end units, single line breaks only before a list item, whose marker belongs to its first
unit. Quotes and brackets are not cut inside; they close the unit if their last mark ends it. Full
stops of scripts without spaces end units by themselves; in Thai a unit ends at a space between two
Thai characters.

What the reading leaves (counts, and the noted places in blocks) is a table in the shared checkpoint
folder. All thresholds are applied in the engine, so the driver gets only the entries of the model. It
is broadcast while it has at most `MOST_ENTRIES` entries; beyond that it is written to that folder too,
from where each worker reads it once.

Defined results: null, empty and blank texts have no units; positions are code points from 0, the end
exclusive; repeated rows give repeated units; an unmatched quote or bracket is ignored. A declared
language of which no function words are listed here is kept for texts in Latin script, unless the
words of a listed one make up a fifth of the paragraph.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellore.runtime import ensure_checkpoint_dir, stored

MOST_ENTRIES = 200_000
MOST_HELD = 4_000_000  # characters whose places and tokens are held at once
MOST_TYPES = 400_000  # types whose counts are held at once
ABBREVIATION = 0.3  # least abbreviation score
STARTER = 20.0  # least log-likelihood ratio of a sentence starter
FREQUENT = 0.005  # least share of a starter in all starts of its language
COLLOCATION = 7.88  # least log-likelihood ratio of a collocation across a period
TOGETHER = 5  # least number of times that two words of a collocation stand together
TIED = 0.5  # least share of a collocation's second word in what follows a period, of all its uses
NUMBERS = 0.3  # least share of numbers behind a type whose period is followed by a number
MIDDLE = 0.1  # greatest share of a starter's capitalised uses inside sentences
ENDS = 0.2  # least share of starters behind an abbreviation that can end a sentence
LISTED = 0.2  # least share of a listed language's function words against another declared language

LETTER = r"[^\W\d_]"
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
BULLET = re.compile(r"[^\S\n]*([-*+•‣◦–])[^\S\n]+(?=\S)")
NUMBERED = re.compile(r"[^\S\n]*\(?(\d{1,3})[.)][^\S\n]+(?=\S)")
ENDING = ".!?…。！？｡؟।॥۔;\u037e"
# a lone period before a digit or a small letter is no mark; semicolons are marks in Greek only
MARKS = re.compile(rf"(?!\.[0-9a-z])[{ENDING.replace(';', '').replace(chr(0x37e), '')}]+")
GREEK_MARKS = re.compile(rf"(?!\.[0-9a-z])[{ENDING}]+")
OTHER_WHITE = re.compile(r"[^\S ]")
OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "‘": "’"}
CLOSERS = frozenset("”“»›」』)]）】》’\"'")
LEADING = "\"'“„«‹‘¿¡([（「『*_—–- "
ALL_CLOSERS = "".join(sorted(CLOSERS))
TOKEN = re.compile(r"\S+")
STRIP = "\"'“”„«»‹›‘’()[]（）「」『』¿¡*_—–-"
FULL = frozenset("。！？｡")
STRONG = frozenset("!?؟।॥۔。！？｡")
TH = re.compile(r"(?<=[\u0e00-\u0e7f])\s+(?=[\u0e00-\u0e7f])")
NUMBER = "##"
WORD = re.compile(rf"{LETTER}+(?:['’-]{LETTER}+)*")
DOTTED_ON = re.compile(r"\.\w")
WINDOW = 400  # how far a decision looks ahead at first; beyond only if there is nothing but white space
# Frequent function words by which the languages in Latin script are told apart.
FUNCTION_WORDS = {
    "en": "the of and to is in that it for with as on by this are from or when each if",
    "de": "der die das und ist von mit den ein eine nicht auf wird für im am dem zu sich wer",
    "fr": "le la les des et est une dans pour que avec sur du au ne pas il sa avant avez",
    "es": "el la los las y es una en para que con por del se su antes hay cada al no",
}
FUNCTION_SETS = {name: frozenset(f"{words} {words.title()}".split()) for name, words in FUNCTION_WORDS.items()}
SCRIPTS = (
    ("ja", re.compile(r"[\u3040-\u30ff]")), ("ko", re.compile(r"[\uac00-\ud7af\u1100-\u11ff]")), ("zh", re.compile(r"[\u3400-\u9fff]")), ("th", re.compile(r"[\u0e00-\u0e7f]")),
    ("ar", re.compile(r"[\u0600-\u06ff]")), ("hi", re.compile(r"[\u0900-\u097f]")), ("ru", re.compile(r"[\u0400-\u04ff]")), ("el", re.compile(r"[\u0370-\u03ff]")),
)
NOT_LATIN = re.compile(r"[\u0370-\u1cff\u3040-\ud7af]")
LISTED_WORDS = frozenset().union(*FUNCTION_SETS.values())
CODE = re.compile(r"[a-z]{2,3}")
#: Languages whose period is never asked about: their units end at full stops or spaces of their own.
UNASKED = frozenset({"zh", "ja", "th"})
SCRIPT_NAMES = frozenset(name for name, _ in SCRIPTS)
CASELESS = frozenset({"ar", "hi", "ko", "th", "zh", "ja"})
#: A lower-case word as it stands inside sentences; names like iPad, identifiers and file names are not.
PLAIN = re.compile(r"[\"'“„«‹‘(\[]*[^\W\dA-Z_]+(?:['’-][^\W\dA-Z_]+)*[\"'”“»›’)\].,;:!?…]*$")
AFTER_END = re.compile(r"([.!?…؟।])[\"'”“»›)\]’」』]*\s+(\S+)")
PAIRED = re.compile(r"[“”„«»‹›‘’「」『』()\[\]（）【】《》\"']")
ABBREVIATED = re.compile(rf"{LETTER}{{1,3}}(?:\.{LETTER}{{1,3}})+$")


def script_of(text: str) -> str | None:
    """The language of the script that most of a text's letters beyond Latin belong to; with kana it is Japanese."""
    here = [(name, p) for name, p in SCRIPTS if p.search(text)]
    if len(here) < 2 or here[0][0] == "ja":
        return here[0][0] if here else None
    return max(here, key=lambda x: len(x[1].findall(text)))[0]


def language_of(text: str, hint: str | None, latin: bool = False, tokens: list[str] | None = None) -> str:
    """The language of a paragraph: by script, in Latin script by function words, else the hint.

    ``latin`` says that the whole text is known to hold no other script, ``tokens`` are the text split already.
    """
    if not latin and NOT_LATIN.search(text) and (found := script_of(text)):
        return found
    tokens = text.split() if tokens is None else tokens
    there = LISTED_WORDS.intersection(tokens)
    foreign = hint is not None and hint not in FUNCTION_SETS and hint not in SCRIPT_NAMES
    most, best = 0, hint if foreign or hint in FUNCTION_SETS else "en"
    if not there:
        return best
    for name, own in FUNCTION_SETS.items():
        votes = len(there & own)
        if votes > most or votes == most and votes and name == hint:
            most, best = votes, name
    if foreign and sum(t in FUNCTION_SETS[best] for t in tokens) < LISTED * len(tokens):
        return hint
    return best


def hint_of(lang: str | None) -> str | None:
    """The primary part of a language tag, if it looks like one."""
    name = re.split(r"[-_]", lang.strip().lower())[0] if lang else ""
    return name if CODE.fullmatch(name) else None


# --- paragraphs and items --------------------------------------------------------------------------


def pieces_of(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, where the words begin) of every paragraph and list item."""
    at = len(text) - len(text.lstrip())
    for gap in [*BLANK.finditer(text, at), None]:
        end = gap.start() if gap else len(text)
        yield from _items(text, at, end)
        at = gap.end() if gap else end


def _items(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    if text.find("\n", start, end) < 0:  # one line
        marker = None if text[start : start + 1].isalpha() else BULLET.match(text, start, end) or NUMBERED.match(text, start, end)
        if start < end:
            yield start, end, marker.end() if marker else start
        return
    first, begin, words, number, listed = True, start, start, None, False
    at = start
    while at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        bullet = numbered = None
        if not text[at : at + 1].isalpha():
            bullet = BULLET.match(text, at, stop)
            numbered = None if bullet else NUMBERED.match(text, at, stop)
        value = int(numbered[1]) if numbered else None
        fits = numbered and (first or (listed and number is not None and value in (number, number + 1)) or (value == 1 and text[at - 2 : at - 1] == ":"))
        if bullet or fits:
            if not first:
                yield begin, at, words
            begin, words, listed = at, (bullet or numbered).end(), True
            number = value if fits else number
        first, at = False, stop + 1
    if begin < end:
        yield begin, end, words


def protected(text: str) -> list[tuple[int, int]]:
    """The outermost matched quotes and brackets of a piece as (opener, closer) positions."""
    stack: list[tuple[int, str]] = []
    spans: list[tuple[int, int]] = []
    for m in PAIRED.finditer(text):
        i, c = m.start(), m[0]
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
        if c in "'’‘" and before.isalnum() and after.isalnum():
            continue  # an apostrophe
        hit = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][1]), None)
        if c in "\"'":
            opens = (before.isspace() or before in "([«“„‘—–-:") and not after.isspace()
            if hit is not None and not (opens and before.isspace() and c == "'" and not after.isspace()):
                spans.append((stack[hit][0], i))
                del stack[hit:]
            elif opens:
                stack.append((i, c))
        elif hit is not None and not (c in OPENERS and c not in "“‘"):
            spans.append((stack[hit][0], i))
            del stack[hit:]
        elif c in OPENERS:
            stack.append((i, OPENERS[c]))
    spans.sort()
    if not spans:
        return spans
    outer: list[tuple[int, int]] = []
    for a, b in spans:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
        elif b > outer[-1][1]:
            outer[-1] = (outer[-1][0], b)
    return outer


# --- counting --------------------------------------------------------------------------------------


def starts_high(token: str) -> bool:
    """Whether a token could begin a sentence by its first letter: upper case, or of a script without case."""
    for c in token:
        if c.isalpha():
            return c.isupper() or not c.islower()
        if c.isdigit():
            return False
    return False


def type_of(token: str) -> tuple[str, bool]:
    """The type of a token and whether a final period was taken off."""
    core = token.strip(STRIP).rstrip(",;:!?…")
    period = core.endswith(".") and not core.endswith("..")
    core = core[:-1] if period else core
    if core[:1].isdigit() and not any(c.isalpha() for c in core):
        return NUMBER, period
    return core, period


def log_likelihood(k: float, n: float, k2: float, n2: float) -> float:
    """Dunning's ratio for k of n against k2 of n2."""

    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p, p1, p2 = (k + k2) / (n + n2), k / n, k2 / n2 if n2 else 0.0
    if not 0 < p < 1:
        return 0.0
    return 2 * (part(k, n, p1) + part(k2, n2, p2) - part(k, n, p) - part(k2, n2, p))


def abbreviation_score(core: str, with_: int, without: int, all_with: int, everything: int) -> float:
    """How strongly a type is tied to its period: ratio, shortness, inner periods, penalty for uses without."""
    n = with_ + without
    if not with_ or not any(c.isalpha() for c in core):
        return 0.0
    rest = everything - n
    ratio = log_likelihood(with_, n, all_with - with_, rest) if rest > 0 else 0.0
    if with_ / n < all_with / max(1, everything):
        return 0.0
    letters = len(core.replace(".", ""))
    return ratio * math.exp(-letters) * (core.count(".") + 1) * letters ** -min(without, 60)


class Model:
    """What was learned: abbreviations, starters, collocations, and what can end a sentence, per language.

    A collocation is (language, type, next type), (language, type, `##`) for a number, or
    (language, type, `_ word`) for a word behind a name.
    """

    def __init__(self, abbreviations=(), starters=(), ends=(), collocations=()):
        self.abbreviations, self.starters = set(abbreviations), set(starters)
        self.ends, self.collocations = set(ends), set(collocations)

    def size(self) -> int:
        return len(self.abbreviations) + len(self.starters) + len(self.ends) + len(self.collocations)

    def to_json(self) -> str:
        return json.dumps([sorted(self.abbreviations), sorted(self.starters), sorted(self.ends), sorted(self.collocations)])

    @classmethod
    def from_json(cls, text: str) -> Model:
        return cls(*([tuple(x) for x in part] for part in json.loads(text)))

    def is_abbreviation(self, language: str, core: str) -> bool:
        return core == NUMBER or (language, core.lower()) in self.abbreviations or bool(ABBREVIATED.match(core)) or len(core) == 1 and core.isalpha() and core.isupper()

    def starts(self, language: str, core: str) -> bool:
        return (language, core) in self.starters


# --- reading ---------------------------------------------------------------------------------------

#: What a question is about: what follows the period, behind white space or without any.
HIGH, HIGH_DOTTED, DIGIT, LOW, GLUED, GLUED_NAME = "high", "dotted", "digit", "low", "glued", "name"
NO, YES = -2, -1


class Notes:
    """The places found and the tokens seen while texts are read.

    Places are boundaries between units: (where the unit before ends, where the next begins, the number
    of the question that decides, or `YES`). The first and the last of a text stand for its ends.
    """

    def __init__(self):
        self.kinds: dict[str, tuple[str, bool]] = {}
        self.types: dict[tuple[str, str], list[int]] = {}
        self.clear()

    def clear(self) -> None:
        """Forget the places and tokens; counts of types stay."""
        self.rows, self.sizes, self.chars = [], [], 0
        self.ends, self.begins, self.asks = [], [], []
        self.questions: dict[tuple[str, ...], int] = {}
        self.tokens: dict[str, list[str]] = defaultdict(list)
        self.starts: dict[str, list[str]] = defaultdict(list)
        self.behind: dict[str, list[str]] = defaultdict(list)
        self.numbered: dict[str, list[str]] = defaultdict(list)

    def type_of(self, token: str) -> tuple[str, bool]:
        found = self.kinds.get(token)
        if found is None:
            if len(self.kinds) > MOST_TYPES:
                self.kinds.clear()
            found = self.kinds[token] = type_of(token)
        return found

    def ask(self, form: str, language: str, own: str, core: str, second: str = "") -> int:
        key = (form, language, own, core, second)
        found = self.questions.get(key)
        if found is None:
            found = self.questions[key] = len(self.questions)
        return found

    def read(self, row: int | None, text: str, hint: str | None) -> None:
        """Note the places of a text, and its tokens."""
        ends, begins, asks = self.ends, self.begins, self.asks
        already, before = len(ends), 0
        latin = NOT_LATIN.search(text) is None
        quoted = PAIRED.search(text) is not None
        flat = OTHER_WHITE.sub(" ", text)
        for start, end, words in pieces_of(text):
            while start < end and flat[start].isspace():
                start += 1
            piece = flat[words:end]
            tokens = piece.split()
            if start == end:
                continue
            ends.append(before)
            begins.append(start)
            asks.append(YES)
            before = end if not flat[end - 1].isspace() else start + len(flat[start:end].rstrip())
            if not tokens:
                continue
            language = language_of(piece, hint, latin, tokens)
            spans = protected(piece) if quoted else []
            counted = language not in UNASKED
            if counted:
                self.tokens[language] += tokens
                self.starts[language].append(tokens[0])
                if spans:  # what stands in quotes and brackets counts as well
                    self._count_pairs(piece, tokens, language)
            if spans:
                self._read_around(piece, words, spans, language)
                continue
            behind, last = self.behind[language], len(piece.rstrip())
            for m in (GREEK_MARKS if language == "el" else MARKS).finditer(piece):
                at, cut = m.span()
                if cut >= last:
                    break  # the piece ends here anyway
                if cut - at == 1 and piece[at] == "." and piece[cut : cut + 1] == " " and piece[cut + 1 : cut + 2].isupper():
                    token = piece[piece.rfind(" ", 0, at) + 1 : at]
                    if len(token) > 1 and token.isalpha():  # most periods are like this
                        following, second = self._following(piece, cut + 1, token)
                        core, dotted = self.type_of(following)
                        behind.append(following)
                        ends.append(words + cut)
                        begins.append(words + cut + 1)
                        asks.append(self.ask(HIGH_DOTTED if dotted else HIGH, language, token, core, second) if counted else YES)
                        continue
                answer = self.weigh(piece, m[0], at, cut, language, counted)
                if answer != NO:
                    while cut < len(piece) and piece[cut] in CLOSERS:
                        cut += 1
                    self._bound(piece, words, cut, answer)
            if language == "th":
                self._thai(piece, words, already)
        if len(ends) > already:
            ends.append(before)
            begins.append(len(text))
            asks.append(YES)
            self.rows.append(row)
            self.sizes.append(len(ends) - already)
        self.chars += len(text)

    @staticmethod
    def _following(piece: str, at: int, token: str) -> tuple[str, str]:
        """The token at ``at``, and the one behind it where ``token`` is short or has inner periods."""
        stop = piece.find(" ", at)
        if stop < 0:
            return piece[at:], ""
        if len(token) > 4 and "." not in token:
            return piece[at:stop], ""
        next_ = piece[stop + 1 : stop + 41].lstrip().split(" ", 1)[0]
        word = WORD.match(next_)
        return piece[at:stop], word[0] if word and word[0].islower() else ""

    def _count_pairs(self, piece: str, tokens: list[str], language: str) -> None:
        for a, b in zip(tokens, tokens[1:]):
            if a[-1] == "." and a[-2:] not in (".", "..") and self.type_of(b)[0] == NUMBER and (core := self.type_of(a)[0]):
                self.numbered[language].append(core.lower())
        for mark, token in AFTER_END.findall(piece):
            (self.behind if mark in ".…" else self.starts)[language].append(token)

    def _bound(self, piece: str, words: int, cut: int, answer: int) -> None:
        begin = cut
        while begin < len(piece) and piece[begin] == " ":
            begin += 1
        if begin < len(piece) and words + cut > self.begins[-1]:
            self.ends.append(words + cut)
            self.begins.append(words + begin)
            self.asks.append(answer)

    def _thai(self, piece: str, words: int, already: int) -> None:
        """Add the spaces between Thai characters to the places of this piece."""
        first = len(self.ends) - 1
        while first > already and self.begins[first] > words:
            first -= 1
        own = {e: b for e, b in zip(self.ends[first + 1 :], self.begins[first + 1 :])} | {words + m.start(): words + m.end() for m in TH.finditer(piece)}
        del self.ends[first + 1 :], self.begins[first + 1 :], self.asks[first + 1 :]
        for cut in sorted(own):
            if cut > self.begins[-1]:
                self.ends.append(cut)
                self.begins.append(own[cut])
                self.asks.append(YES)

    def _read_around(self, piece: str, words: int, spans: list[tuple[int, int]], language: str) -> None:
        """Note the places of a piece with quotes or brackets, which are not cut inside."""
        events: list[tuple[int, object]] = [(b, (a, b)) for a, b in spans]
        opened = {a for a, _ in spans}
        outside = iter((*spans, None))
        span = next(outside)
        for m in (GREEK_MARKS if language == "el" else MARKS).finditer(piece):
            while span is not None and span[1] < m.start():
                span = next(outside)
            if span is None or span[0] >= m.start():
                events.append((m.start(), m))
        events.sort(key=lambda e: e[0])
        begin = 0
        for _, event in events:
            if isinstance(event, tuple):
                if closes_unit(piece, *event, begin, language):
                    begin = event[1] + 1
                    self._bound(piece, words, begin, YES)
            elif (answer := self.weigh(piece, event[0], event.start(), event.end(), language, False)) != NO:
                begin = event.end()
                while begin < len(piece) and piece[begin] in CLOSERS and begin not in opened:
                    begin += 1
                self._bound(piece, words, begin, answer)
        if language == "th":
            self._thai(piece, words, len(self.ends) - 1)

    def weigh(self, piece: str, text: str, at: int, end: int, language: str, counted: bool) -> int:
        """Whether the marks outside quotes and brackets end a unit: `YES`, `NO` or the number of a question."""
        if text == "." and piece[end : end + 1].islower():
            return NO
        while end < len(piece) and piece[end] in CLOSERS and not (piece[end] in "\"'“" and end + 1 < len(piece) and piece[end + 1] != " "):
            end += 1
        if text[0] in ";;" and language != "el":
            return NO
        spaced = piece[end : end + 1] == " "
        begin = end
        while begin < len(piece) and piece[begin] == " ":
            begin += 1
        if begin == len(piece):
            return YES
        if text[0] in FULL or any(c in FULL for c in text):
            return YES
        token = piece[piece.rfind(" ", 0, at) + 1 : at]
        following, second = self._following(piece, begin, token)
        if counted and spaced and text[-1] in ".!?…؟।":
            (self.behind if text[-1] in ".…" else self.starts)[language].append(following)
        bare = following.lstrip(LEADING) or piece[begin : begin + WINDOW].lstrip(LEADING)
        first = bare[:1]
        core, dotted = self.type_of(following)
        if not spaced:
            return self._glued(text, token, following, first == piece[end] and first.isalpha(), first, language)
        low = first.islower() and language not in CASELESS
        if low and PLAIN.match(TOKEN.match(bare)[0]):
            return NO
        if any(c in STRONG for c in text) or text[0] in ";;":
            return YES
        if "…" in text or len(text) > 1:
            return NO if low else YES
        own, _ = self.type_of(token + ".")
        if counted and core == NUMBER and own:
            self.numbered[language].append(own.lower())
        if "." in own and not ABBREVIATED.match(own) and own.rpartition(".")[2].isalpha():
            own = own.rpartition(".")[2]  # a missing space before it
        if not own:
            return YES if first.isupper() else NO
        form = DIGIT if first.isdigit() else LOW if low else HIGH_DOTTED if dotted else HIGH
        if language in UNASKED:
            return YES if answered(form, language, own, core, second, UNLEARNED) else NO
        return self.ask(form, language, own, core, second)

    def _glued(self, text: str, token: str, following: str, letter: bool, first: str, language: str) -> int:
        """The same where no white space follows the marks."""
        if text[0] in ";;" or "…" in text or not letter:
            return NO
        if any(c in "/@=&\\" for c in token + following) or "://" in token:
            return NO
        if any(c in STRONG for c in text):
            return YES if token[-1:].isalnum() and (first.isupper() or not first.islower()) else NO
        if text != ".":
            return NO
        own = token.strip(STRIP)
        begins = WORD.match(following)
        if len(own) < 2 or begins is None or len(begins[0]) < 2:
            return NO
        begun = begins[0]
        high = begun[0].isupper() and begun[1:].islower()
        if not WORD.fullmatch(own):
            name = False
        elif not own[0].isupper():
            name = high or not (begun[0].isupper() or begun[0].islower())
        else:  # a name in front: not inside a dotted identifier
            name = len(own) > 3 and begun[0].isupper() and (high and not DOTTED_ON.match(following, len(begun)) or bool(ABBREVIATED.match(following.rstrip(".,;:"))))
        form = GLUED_NAME if name else GLUED
        if language in UNASKED:
            return YES if answered(form, language, own, begun, "", UNLEARNED) else NO
        return self.ask(form, language, own, begun)

    # what is left of it

    def count(self) -> None:
        """Move the tokens into the counts of types: with a period and without; at a certain start, in the
        middle, behind a period; with a number behind the period."""
        types = self.types
        for language, tokens in self.tokens.items():
            starts, behind = Counter(self.starts[language]), Counter(self.behind[language])
            for token, n in Counter(tokens).items():
                core, period = self.type_of(token)
                if not core:
                    continue
                small = core.lower()
                own = types.get((language, small)) or types.setdefault((language, small), [0] * 6)
                own[0 if period else 1] += n
                if not period and starts_high(core):
                    own = own if small == core else types.get((language, core)) or types.setdefault((language, core), [0] * 6)
                    start, after = starts.get(token, 0), behind.get(token, 0)
                    own[2] += start
                    own[3] += max(0, n - start - after)
                    own[4] += after
            for core, n in Counter(self.numbered[language]).items():
                types.setdefault((language, core), [0] * 6)[5] += n
        self.tokens.clear()

    def block(self) -> pa.RecordBatch:
        """The places as one row of flat arrays."""
        rows = np.array([0 if r is None else r for r in self.rows], dtype=np.int64)
        named = np.array([r is not None for r in self.rows], dtype=bool)
        often = np.bincount(np.array([a for a in self.asks if a >= 0], dtype=np.int64), minlength=len(self.questions)).astype(np.int64)
        arrays = (rows, named, *(np.array(x, dtype=np.int32) for x in (self.sizes, self.ends, self.begins, self.asks)), often)
        asked = "\n".join("\t".join(q) for q in self.questions)
        return _batch(READ, {"asked": [asked], **{name: [a.tobytes()] for name, a in zip(ARRAYS, arrays)}})

    def counts(self) -> pa.RecordBatch:
        """The counts of types, a row each; they are forgotten then."""
        columns = zip(*self.types.values()) if self.types else ([] for _ in COUNTS)
        out = {"language": [k[0] for k in self.types], "type": [k[1] for k in self.types], **{name: list(x) for name, x in zip(COUNTS, columns)}}
        self.types = {}
        return _batch(READ, out)


def answered(form: str, language: str, own: str, core: str, second: str, model: Model) -> bool:
    """Whether a period ends a unit: the answer to a question."""
    small = own.lower()
    abbreviation = model.is_abbreviation(language, own)
    if form in (GLUED, GLUED_NAME):
        if abbreviation and (language, small) not in model.ends:
            return False
        return model.starts(language, core) or form == GLUED_NAME
    if not abbreviation:
        return form != DIGIT or (language, small, NUMBER) not in model.collocations
    if form == DIGIT:
        return False
    if form == LOW:
        return (language, small) in model.ends
    if (language, small, core) in model.collocations:
        return False
    if form == HIGH and model.starts(language, core):
        return True
    if len(own) == 1 and own.isupper():
        return False
    return (language, small) in model.ends and (language, small, f"_ {second}") not in model.collocations


UNLEARNED = Model()


def closes_unit(piece: str, a: int, b: int, begin: int, language: str) -> bool:
    """Whether a closed quote or bracket at (a, b) ends the unit that began at ``begin``."""
    inner = piece[max(a + 1, b - WINDOW) : b].rstrip().rstrip(ALL_CLOSERS).rstrip()
    if inner[-1:] not in STRONG and inner[-1:] not in "." or not inner:
        return False
    rest = piece[b + 1 : b + 1 + WINDOW]
    after = rest.lstrip() or piece[b + 1 :].lstrip()
    if not after:
        return True
    bare = after.lstrip(LEADING)
    first = bare[:1]
    if not rest[:1].isspace():
        if language not in ("zh", "ja") or after[0] in "，、；：,;:。！？.!?…":
            return False
        led = piece[begin:a].strip()
        return led.endswith(("：", ":")) or not led and piece[a] in "(（[【"
    if not first.isalnum():
        return False
    return not first.islower() or language in CASELESS or not PLAIN.match(TOKEN.match(bare)[0])


def units_of(text: str | None, hint: str | None, model: Model) -> list[tuple[int, int]]:
    """The sentence units of a text as (start, end)."""
    notes = Notes()
    if text is not None:
        notes.read(0, text, hint)
    yes = [answered(*q, model) for q in notes.questions]
    kept = [i for i, ask in enumerate(notes.asks) if ask == YES or yes[ask]]
    return [(notes.begins[i], notes.ends[j]) for i, j in zip(kept, kept[1:])]


# --- Spark -----------------------------------------------------------------------------------------

COUNTS = ("with_", "without", "start", "middle", "behind", "number")
ARRAYS = ("rows", "named", "sizes", "ends", "begins", "asks", "often")
READ = pa.schema([("language", pa.string()), ("type", pa.string()), *((c, pa.int64()) for c in COUNTS), ("asked", pa.string()), *((c, pa.binary()) for c in ARRAYS)])
READ_SCHEMA = f"language string, type string, {', '.join(f'{c} bigint' for c in COUNTS)}, asked string, {', '.join(f'{c} binary' for c in ARRAYS)}"
THEN_SCHEMA = "language string, type string, next string, second string, n bigint"


def _batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    """Columns as a batch; those that are missing are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks and counts of a partition; passed on before what is held grows large."""
    notes = Notes()
    for batch in batches:
        for row, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
            notes.read(row, text, hint_of(lang))
            if notes.chars > MOST_HELD:
                notes.count()
                yield notes.block()
                notes.clear()
                if len(notes.types) > MOST_TYPES:
                    yield notes.counts()
    notes.count()
    yield notes.block()
    yield notes.counts()


def _questions(asked: str) -> list[list[str]]:
    return [q.split("\t") for q in asked.split("\n")] if asked else []


def _then(model: Model):
    """How often what follows the periods of abbreviations; beside them, what follows a name behind any other type."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for asked, often in zip(batch.column("asked").to_pylist(), batch.column("often").to_pylist()):
                for (form, language, own, core, second), n in zip(_questions(asked), np.frombuffer(often, dtype=np.int64).tolist()):
                    if form not in (HIGH, HIGH_DOTTED):
                        continue
                    if model.is_abbreviation(language, own):
                        found[language, own.lower(), core + "." * (form == HIGH_DOTTED), second] += n
                    elif second and not model.starts(language, core):
                        found[language, "", "", second] += n
        keys = list(zip(*found)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(list(found.values()), pa.int64())], names=["language", "type", "next", "second", "n"])

    return then


def _deciding(model: Model):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, *blobs in zip(*(batch.column(c).to_pylist() for c in ("asked", *ARRAYS[:-1]))):
                kinds = (np.int64, bool, np.int32, np.int32, np.int32, np.int32)
                rows, named, sizes, ends, begins, asks = (np.frombuffer(b, dtype=k) for b, k in zip(blobs, kinds))
                yes = np.array([answered(*q, model) for q in _questions(asked)] + [False, True], dtype=bool)  # the last two for NO and YES
                owner = np.repeat(np.arange(len(rows)), sizes)
                kept = np.nonzero(yes[asks])[0]
                a, b = kept[:-1], kept[1:]
                inside = owner[a] == owner[b]
                a, b = a[inside], b[inside]
                ids = pa.array(rows[owner[a]], mask=~named[owner[a]])
                yield pa.RecordBatch.from_arrays([ids, pa.array(begins[a].astype(np.int64)), pa.array(ends[b].astype(np.int64))], names=["doc_id", "start_char", "end_char"])

    return decide


def log_likelihood_of(k: Column, n: Column, k2: Column, n2: Column) -> Column:
    """`log_likelihood` of columns."""

    def part(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)

    p = (k + k2) / (n + n2)
    p1, p2 = k / n, F.when(n2 > 0, k2 / n2).otherwise(0.0)
    ratio = 2 * (part(k, n, p1) + part(k2, n2, p2) - part(k, n, p) - part(k2, n2, p))
    return F.when((n > 0) & (p > 0) & (p < 1), ratio).otherwise(0.0)


def _entries(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Learned entries as a table; broadcast while they are few."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MOST_ENTRIES else table


def _abbreviation_score(t: dict[str, Column]) -> Column:
    """`abbreviation_score` of columns."""
    n, uses, letters = F.col("with_") + F.col("without"), t["with_"] + t["without"], F.length(F.replace("type", F.lit("."), F.lit("")))
    ratio = log_likelihood_of(F.col("with_"), n, t["with_"] - F.col("with_"), uses - n)
    dots = F.length("type") - letters + 1
    score = ratio * F.exp(-letters) * dots * F.pow(letters, -F.least("without", F.lit(60)))
    return F.when((F.col("with_") / n >= t["with_"] / uses) & F.col("type").rlike(r"\p{L}"), score).otherwise(0.0)


def learn_from(notes: DataFrame) -> Model:
    """The model of what a reading left. Only what passes the thresholds is collected."""
    spark = notes.sparkSession
    counts = notes.filter("type IS NOT NULL").groupBy("language", "type").agg(*(F.sum(c).alias(c) for c in COUNTS))
    counts = stored(counts, "sentence-types")
    totals = counts.groupBy("language").agg(*(F.sum(c).alias(f"all_{c}") for c in COUNTS))  # a row per language, of which there are 18,278 at most
    t = {c: F.col(f"all_{c}") for c in COUNTS}
    c = {x: F.col(x) for x in COUNTS}
    seen, everything = c["start"] + c["middle"] + c["behind"], t["start"] + t["middle"] + t["behind"]
    # many certain starts, and at the head of a sentence (behind a period counts) far oftener than inside,
    # if the language has capitals inside sentences at all
    head, heads = c["start"] + c["behind"], t["start"] + t["behind"]
    starter = (
        (c["start"] >= F.greatest(F.lit(3.0), FREQUENT * t["start"])) & (c["middle"] <= MIDDLE * seen) & (seen < everything)
        & ((head / seen > heads / everything) & (log_likelihood_of(head, seen, heads - head, everything - seen) >= STARTER) | (heads == everything))
    )
    behind = F.least("number", "with_")
    numbered = (c["number"] > 0) & (c["number"] >= NUMBERS * c["with_"]) & (log_likelihood_of(behind, F.greatest(F.lit(1), c["with_"]), t["number"] - c["number"], t["with_"] - c["with_"]) >= COLLOCATION)
    abbreviation = (c["with_"] > 0) & (c["with_"] >= c["without"]) & (F.length("type") <= 14) & (F.col("type") != NUMBER)
    marked = counts.join(F.broadcast(totals), "language").select(
        "language", "type", F.when(abbreviation, _abbreviation_score(t) >= ABBREVIATION).otherwise(False).alias("tied"), F.coalesce(starter, F.lit(False)).alias("starts"), F.coalesce(numbered, F.lit(False)).alias("numbered")
    )
    abbreviations, starters, collocations = [], [], []
    for r in marked.filter("tied OR starts OR numbered").toLocalIterator():
        key = (r["language"], r["type"])
        if r["tied"]:
            abbreviations.append(key)
        if r["starts"]:
            starters.append(key)
        if r["numbered"]:
            collocations.append((*key, NUMBER))
    model = Model(abbreviations, starters, (), collocations)
    then = stored(notes.filter("asked IS NOT NULL").mapInArrow(_with_model(notes, model, _then), THEN_SCHEMA).groupBy("language", "type", "next", "second").agg(F.sum("n").alias("n")), "sentence-followers")
    begins = _entries(spark, starters, "language string, next string").withColumn("begins", F.lit(1))
    then = then.join(begins, ["language", "next"], "left")
    tied = then.filter("type <> ''")
    high = tied.groupBy("language", "type").agg(F.sum("n").alias("high"), F.coalesce(F.sum(F.col("n") * F.col("begins")), F.lit(0)).alias("starter"))
    high = high.filter((F.col("starter") + 0.5) / (F.col("high") + 1) >= ENDS).select("language", "type", (F.col("high") - F.col("starter")).alias("others"))
    model.ends = {(r["language"], r["type"]) for r in high.select("language", "type").toLocalIterator()}
    # collocations matter behind abbreviations that can end a sentence, and before what is no starter
    able = _entries(spark, sorted(model.ends), "language string, type string")
    tied = tied.filter("begins IS NULL").join(able, ["language", "type"])
    together = tied.groupBy("language", "type", F.rtrim("next", F.lit(".")).alias("next")).agg(F.sum("n").alias("k")).filter(F.col("k") >= TOGETHER)
    uses = counts.select("language", F.col("type").alias("next"), (F.col("start") + F.col("middle") + F.col("behind")).alias("uses"))
    own = counts.select("language", "type", F.col("with_").alias("own"))
    pairs = together.join(uses, ["language", "next"]).join(own, ["language", "type"]).join(F.broadcast(totals.select("language", (F.col("all_with_") + F.col("all_without")).alias("tokens"))), "language")
    k, others = F.least("k", "own"), F.greatest(F.lit(0), F.col("uses") - F.col("k"))
    pairs = pairs.filter((F.col("k") >= TIED * F.col("uses")) & (log_likelihood_of(k, F.col("own"), others, F.col("tokens") - F.col("own")) >= COLLOCATION))
    model.collocations |= {(r["language"], r["type"], r["next"]) for r in pairs.select("language", "type", "next").toLocalIterator()}
    plain = then.filter("type = ''").groupBy("language", "second").agg(F.sum("n").alias("k2"))
    plain_all = plain.groupBy("language").agg(F.sum("k2").alias("n2"))
    apart = tied.filter("second <> ''").groupBy("language", "type", "second").agg(F.sum("n").alias("k")).filter(F.col("k") >= TOGETHER)
    apart = apart.join(high, ["language", "type"]).join(plain, ["language", "second"], "left").join(F.broadcast(plain_all), "language", "left").na.fill(0, ["k2", "n2"])
    apart = apart.filter((F.col("k") / F.col("others") > F.try_divide(F.col("k2"), F.col("n2")) + 0.0) | (F.col("n2") == 0))
    apart = apart.filter((F.col("k") >= ENDS * F.col("others")) & (log_likelihood_of(F.col("k"), F.col("others"), F.col("k2"), F.col("n2")) >= STARTER))
    model.collocations |= {(r["language"], r["type"], f"_ {r['second']}") for r in apart.select("language", "type", "second").toLocalIterator()}
    return model


def read_texts(texts: DataFrame) -> DataFrame:
    """What one reading of all texts (doc_id, text, lang) leaves, stored in the shared folder."""
    return stored(texts.filter("text IS NOT NULL").mapInArrow(_read, READ_SCHEMA), "sentence-notes")


def learn(texts: DataFrame) -> Model:
    """The model of all texts; ``texts`` has text and lang."""
    return learn_from(read_texts(texts.select(F.lit(None).cast("bigint").alias("doc_id"), "text", "lang")))


def _with_model(df: DataFrame, model: Model, make):
    """A function of batches that has the model: in its closure if that is small, else from the shared folder."""
    if model.size() <= MOST_ENTRIES:
        return make(model)
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/sentence-model-{abs(hash(model.to_json()))}"
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    def read(batches):
        import pyarrow.fs as fs

        system, inner = fs.FileSystem.from_uri(path)
        parts = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".txt")]
        with system.open_input_stream(parts[0]) as source:
            found = Model.from_json(source.read().decode("utf-8"))
        yield from make(found)(batches)

    return read


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per sentence unit: doc_id, start_char, end_char."""
    notes = read_texts(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    model = model or learn_from(notes)
    blocks = notes.filter("asked IS NOT NULL").select("asked", *ARRAYS[:-1])
    return blocks.mapInArrow(_with_model(notes, model, _deciding), "doc_id bigint, start_char bigint, end_char bigint")
