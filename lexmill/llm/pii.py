"""Problem 7: personal data inside free text, found and replaced by typed placeholders.

Method: a skip-chain conditional random field. Text near a sign of personal data is cut into tokens (numbers,
identity numbers and mail addresses are one token each), and so is the text around every other place of the whole text where a name found there, or a
spelling one letter from it, stands again. Token shapes, word lists and cues beside a token are the features of the node
potentials, neighbouring labels have the chain potentials, and repeated tokens of one text (case aside) and similar name tokens share skip
potentials, however far apart. Marginals come from loopy message passing until the messages settle: exact forward-backward sweeps along the chains
alternate with damped messages along the skip links, batched over the texts of a block.

The weights are fitted here (``fit``): the placeholders that an earlier masker left in stored verdicts label the tokens they stand for; other words there are a
name, an address or other, other numbers may be anything (it left data behind): those labels stay latent, and up to ``SAMPLE`` such rows are made as likely as possible under a normal prior (deviation ``DEVIATION``) round the weights in ``FEATURES``,
``CHAIN`` and ``SKIP``. Without such rows those weights hold.

Signs are searched in whole texts; a token that is neither near a sign nor a repeat has no feature of personal data, so its label is other. Null and empty texts
have no item; numbers needn't pass check digits; placeholders of an earlier masker are no items. A text's links join each occurrence to the nearest before it that has
evidence of a name (to the first that has where none is before it), else to the one before: a token repeated n times has n - 1 links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ("other", "name", "address", "phone", "identity", "account", "email")
O, N, A, P, I, C, E = range(7)
MARKS = {N: "[NAME]", A: "[ADDRESS]", P: "[PHONE]", I: "[IDENTITY]", C: "[ACCOUNT]", E: "[EMAIL]"}
#: Labels that the ends of a link share: an address is a run of different words, and a word that may stand in one says little of the next.
SHARED = [N, P, I, C, E]
#: Characters round a sign and round a repeat of a name that are cut into tokens; rounds of messages at most, and when they have settled.
REACH, AROUND, ROUNDS, SETTLED, DAMPING = 170, 60, 40, 1e-3, 0.5
#: Rows the weights are fitted on at most, steps and width of the prior.
SAMPLE, STEPS, DEVIATION = 400, 8, 0.5

# Word lists (fixed values).
TITLES = frozenset("mr mrs ms miss dr shri sri smt kumari kum adv prof श्री श्रीमती कुमारी डॉ".split())
HOUSE = frozenset("flat plot house door hno c/o sector block floor shop villa tower wing".split())
ROADS = frozenset("road street lane marg gali chowk row colony enclave cross layout nagar apartments residency heights bazaar sector block phase society bagh puram avenue".split())
STOP = frozenset(
    "the a an and or of to in on at by for from with is am are was were be been has have had my your our their his her its this that i we you he she it they not no nor if as but so who whom which "
    "wants want asked refused said says told will shall must may can signed appeared having residing holder held live lives called mail number phone telephone mobile call email id pan aadhaar other account "
    "hai hain ka ki ke ko se ne ya aur tha thi pe me mein pata naam mera meri number बोला है हैं का की के को से ने और था थी में पर नहीं क्या मुझे माझी माझे उठाएगा".split()
)
ROLES = frozenset(
    "officer registrar inspector secretary authority tribunal court board committee society act section schedule clause rule order government ministry department company firm bank police state office desk "
    "complainant landlord tenant lessor lessee licensor licensee employer employee contractor guarantor borrower lender promoter allottee buyer seller agent nominee apprentice carrier consignor consignee subscriber distributor "
    "caretaker principal holder provider successor title registered claims welfare rent managing competent inspecting service franchise owner co-owner borrower party annexure copy page date place january february march april may june july august september october november december rs inr pin".split()
)
_BEFORE_NAME = re.compile(
    r"(?:\bname\s(?:is|of)|\bname:|\bnaam|नाम|\bcontact(?:\sperson)?(?:\sis|:)|\bcomplainant|\bpresence\sof|\bbetween|\bfirst\sparty\),\s+and|\blandlord,|\bsister|\bbrother|\bwife|\bhusband|\bfilled\swith|\bowner\sis|\bregards,|\bsincerely,|\bfaithfully,|"
    r"\bi\sam|\bdear|मकान\sमालिक|\bson\sof|\bdaughter\sof|\bwife\sof|\bs/o|\bd/o|\bw/o)\s+",
    re.I,
)
_AFTER_NAME = re.compile(r"\s*(?:,\s*(?:residing|holder\sof|having\s(?:pan|id|identity|aadhaar|passport)|son\sof|telephone|wants\sme)\b|\bsigned\sas\b|\bappeared\sin\b|\(the\s(?:first|second)\sparty\))", re.I)
_CUES = {
    P: re.compile(r"\b(?:phone|call|telephone|mobile|number hai|mera number|my number|reach me|whatsapp|dial|tel)\b|फ़ोन|फोन|नंबर", re.I),
    I: re.compile(r"\b(?:pan|id|identity|aadhaar|aadhar|passport|voter|licen[cs]e no|produced|asked for|proof)\b|पहचान|आधार", re.I),
    C: re.compile(r"\b(?:account|khate|khata|a/c|refund should go|ifsc|deposit(?:ed)? in)\b|खाता|खाते", re.I),
}
# Signs that personal data may be near: literals found by one automaton, and groups of digits.
_LITERALS = (
    "@", "＠", "(at)", "[at]", "(dot)", "[dot]", "[.]", " dot ", "ame is", "ame of", "ame:", "naam ", "ontact is", "ontact person", "ontact:", "omplainant", "presence of", "presence\nof", "sister ", "brother ",
    "wife ", "husband ", "filled with", "wner is", "egards,", "incerely,", "aithfully,", "as witness", "as\nwitness", "andlord, ", "I am ", "Dear ", "Shri ", "Sri ", "Smt", "Mr.", "Ms.", "Mrs", "Dr.", "Adv.", "Kum.", "Kumari", "Prof.",
    "नाम ", "मकान मालिक", "श्री", "Flat ", "flat ", "Plot ", "plot ", "PIN ", "H.No", "h.no", "oor no", "C/o", "c/o", "S/o", "D/o", "W/o", "son of", "daughter of", "ector ", " Road", " Street", " Lane", " Marg", " Gali", " Chowk", " Row",
    " Colony", " Enclave", " Layout", " Cross", " Nagar", "residing", "shifted from", "(the first party)", "having PAN",
)
_NUMBERS = re.compile(r"\d(?:\d{5,}|\d{2,}[ .\n)(-]{1,3}\d{3,}|\d{3}[ /\n-]{0,2}[A-Za-z]\b)")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in _LITERALS:
        found.add_word(w, len(w))
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def signs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the signs of a text, in order."""
    out = [(end + 1 - n, end + 1) for end, n in _AUTOMATON.iter(text)]
    out += [m.span() for m in _NUMBERS.finditer(text)]
    return sorted(out)


_TOKEN = regex.compile(
    r"(?P<mark>\[[A-Z_]{3,}\])"
    r"|(?P<mail>[A-Za-z0-9][\w.+]*(?:-\n?[\w.+]+)*(?:[ \n]{0,2}[@＠][ \n]{0,2}|[ \n]?[\[(][ ]?at[ ]?[\])][ \n]?|[ \n]at[ \n](?=[a-z0-9-]+(?:\.[a-z]{3}|[ ]?[\[(]|[ ]dot[ ])))(?:[A-Za-z0-9-]+)(?:(?:\.|[ ]?[\[(][ ]?(?:\.|dot)[ ]?[\])][ ]?|[ \n]dot[ \n])[A-Za-z]{2,})+)"
    r"|(?P<money>(?:(?<![\p{L}])(?:Rs\.?|INR)|₹)[ \n]?[\d०-९][\d०-९,]*(?:\.\d+)?)"
    r"|(?P<ident>(?<![\p{L}\d])(?:[A-Za-z]{5}(?:-[ \n]{0,2}|[ \n]{1,2}|/)?\d{4}(?:-[ \n]{0,2}|[ \n]{1,2}|/)?[A-Za-z]|[A-Z]{3}(?:-[ \n]{0,2}|[ \n]{1,2}|/)?\d{7}|[a-z]{3}\d{7}|[A-Z](?:-[ \n]{0,2}|[ \n]{1,2}|/)?\d{7}|[A-Za-z]{2}(?:-[ \n]{0,2}|[ \n]{1,2}|/)?\d{2}(?:-[ \n]{0,2}|[ \n]{1,2}|/)?(?:19|20)\d\d(?:-[ \n]{0,2}|[ \n]{1,2}|/)?\d{7})(?![\p{L}\d]))"
    r"|(?P<unit>(?<![\p{L}\d])\d{1,4}[A-Za-z](?![\p{L}\d]))"
    r"|(?P<num>(?:\+|(?<!\p{L})\()?\p{Nd}+\)?(?:(?:-[ \n]{0,2}|\.|[ ]{1,2}|\n(?!\W*\p{Nd}+\W*(?:\n|\Z)))\(?\p{Nd}+\)?)*(?:[/-]\p{Nd}+)*)"
    r"|(?P<init>(?<!\p{L})[A-Z]\.)"
    r"|(?P<house>(?<!\p{L})(?:[Hh]\.[Nn]o\.?|[Dd]oor no\.?|[CcSsDdWw]/[Oo]))"
    r"|(?P<word>\p{L}[\p{L}\p{M}]*(?:['’-]\n?\p{L}[\p{L}\p{M}]*)*)"
    r"|(?P<gap>\n[ ]*\n)"
    r"|(?P<other>\S)"
)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_DIGITS = str.maketrans("०१२३४५६७८९০১২৩৪৫৬৭৮৯௦௧௨௩௪௫௬௭௮௯", "0123456789" * 3)

#: Features of the node potentials with their prior weights by label.
FEATURES = {
    "mail": {E: 6}, "ident": {I: 6}, "mark": {O: 5}, "comma": {O: 0.5, A: 0.8}, "sign": {O: 6}, "house": {A: 4},
    "mobile": {P: 5}, "landline": {P: 5}, "twelve": {I: 4, C: 2.5}, "grouped": {I: 2}, "long": {C: 5}, "number": {O: 3}, "small": {A: 2.5},
    "cue phone": {P: 1}, "cue identity": {I: 2.5}, "cue account": {C: 3}, "behind house": {A: 4},
    "house word": {A: 4}, "road word": {A: 3}, "pin": {A: 3}, "stop word": {O: 8}, "capital": {A: 0.6, N: 0.3}, "plain": {O: 4},
    "road": {A: 2}, "address part": {A: 3}, "address capital": {A: 1.5}, "address near": {A: 5}, "address comma": {A: 1.2},
    "title": {N: 4}, "name run": {N: 5}, "name before": {N: 5},
}
_AT = {name: k for k, name in enumerate(FEATURES)}
_CUE_NAMES = {P: "cue phone", I: "cue identity", C: "cue account"}


class Model:
    """Weights: node (features x labels), chain (label, next label) and skip (of equal labels of ``SHARED`` at the ends of a link)."""

    __slots__ = ("chain", "node", "skip")

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: float) -> None:
        self.node, self.chain, self.skip = node, chain, skip


def prior() -> Model:
    """The weights that hold before any row is seen."""
    node = np.zeros((len(FEATURES), 7))
    for name, by in FEATURES.items():
        for lab, w in by.items():
            node[_AT[name], lab] = w
    chain = np.full((7, 7), -1.5)
    chain[O, O] = 0.5
    for k in range(1, 7):
        chain[k, O], chain[O, k] = 0.0, -0.5
    chain[N, N], chain[A, A], chain[N, A], chain[A, N] = 1.0, 2.0, -1.0, -2.0
    for k in (P, I, C, E):
        chain[k, k] = -2.0
    return Model(node, chain, 2.5)


def number_features(raw: str, cue: int | None) -> list[str]:
    """Features of a number by its digits, grouping and the last cue before it."""
    d = "".join(c for c in raw.translate(_DIGITS) if c.isdigit())
    n = len(d)
    plus = raw.lstrip("(").startswith("+") or d.startswith("0091") and n == 14
    if plus and n in (12, 14) and d[n - 10] in "6789" or n == 10 and d[0] in "6789" or n == 11 and d[0] == "0" and d[1] in "6789":
        out = ["mobile"]
    elif raw.startswith("(0") and n in (10, 11) or n in (10, 11) and re.match(r"0\d{2,4}[- ]\d{4}[- ]?\d{3,4}$", raw):
        out = ["landline"]
    elif n == 12:
        out = ["twelve", "grouped"] if re.fullmatch(r"\d{4}[ .\n-]\d{4}[ .\n-]\d{4}", raw.translate(_DIGITS)) else ["twelve"]
    elif n == 11 or 13 <= n <= 18:
        out = ["long"]
    else:
        return ["number", "small"] if n <= 6 else ["number"]
    return out if cue is None else [*out, _CUE_NAMES[cue]]


def alike(a: str, b: str) -> bool:
    """Whether two lower-case words are the same or, from five letters on, one letter apart."""
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class _Doc:
    """The tokens of a text near signs of personal data."""

    __slots__ = ("after", "chain", "cued", "features", "kinds", "links", "named", "places", "spans", "text", "tokens")

    def __init__(self, text: str, found: list[tuple[int, int]]) -> None:
        self.text = text
        spans: list[list[int]] = []
        for a, b in found:
            a, b = max(a - REACH, 0), min(b + REACH, len(text))
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        self._read(spans)
        more = self._repeats(spans)
        if more:  # a name stands again away from all signs: that text is read too
            merged: list[list[int]] = []
            for a, b in sorted([*map(list, spans), *more]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            self._read(merged)
        self.links = self._links()

    def _read(self, spans: list[list[int]]) -> None:
        text = self.text
        self.tokens: list[str] = []
        self.kinds: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.chain: list[int] = []  # 1 where a new chain begins
        self.cued: set[int] = set()  # places behind a cue for a name
        self.after: set[int] = set()  # places before one
        self.places: list[int] = []  # token of each feature
        self.features: list[int] = []
        self.named: set[int] = set()  # tokens with evidence of a name
        for a, b in spans:
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            first = 1
            self.cued.update(m.end() for m in _BEFORE_NAME.finditer(text, a, b))
            self.after.update(m.start() for m in _AFTER_NAME.finditer(text, a, b))
            for m in _TOKEN.finditer(text, a, b):
                kind = m.lastgroup
                if kind == "gap":
                    first = 1
                    continue
                self.tokens.append(m.group())
                self.kinds.append("num" if kind == "unit" else kind)
                self.spans.append(m.span())
                self.chain.append(first)
                first = 0
        self._evidence()

    def _add(self, k: int, name: str) -> None:
        self.places.append(k)
        self.features.append(_AT[name])

    def _name_words(self) -> list[str]:
        """The words of names, in lower case."""
        low = {self.tokens[k].lower() for k in self.named if self.kinds[k] == "word" and len(self.tokens[k]) > 3}
        return sorted(w for w in low if w not in STOP and w not in ROLES and w not in TITLES)

    def _repeats(self, spans: list[list[int]]) -> list[list[int]]:
        """Spans round the places outside all spans where a name's word, or one like it, stands again."""
        out: list[list[int]] = []
        for w in self._name_words():
            for head in {w[:4], w[:4].capitalize(), w[:4].upper()}:
                at = self.text.find(head)
                while at >= 0:
                    if not any(a <= at < b for a, b in spans) and not self.text[at - 1 : at].isalpha():
                        m = _WORD.match(self.text, at)
                        if m and alike(m.group().lower(), w):
                            out.append([max(at - AROUND, 0), min(m.end() + AROUND, len(self.text))])
                    at = self.text.find(head, at + 1)
        return out

    def _links(self) -> list[tuple[int, int]]:
        """Links of repeated numbers, mail addresses and names' words (or words like them): to the occurrence before, or to one with evidence of a name."""
        names = self._name_words()
        groups: dict[str, list[int]] = {}
        for k, (t, kind) in enumerate(zip(self.tokens, self.kinds)):
            if len(t) < 4:
                continue
            if kind in ("num", "ident", "mail"):
                w = "".join(t.lower().split())
            elif kind == "word" and names:
                low = t.lower()
                w = low if low in names else next((x for x in names if x[0] == low[0] and alike(low, x)), "")
            else:
                continue
            if w:
                groups.setdefault(w, []).append(k)
        out = []
        for at in groups.values():
            hub = next((k for k in at if k in self.named), at[0])
            for k in at:
                if k != hub and abs(k - hub) > 1:
                    out.append((min(hub, k), max(hub, k)))
                if k in self.named or hub not in self.named:
                    hub = k  # the nearest before with evidence, else the nearest
        return out

    def _evidence(self) -> None:
        n = len(self.tokens)
        add = self._add
        low = [t.lower().replace("\n", "") for t in self.tokens]
        for k in range(n):
            kind, t = self.kinds[k], self.tokens[k]
            if kind == "mail":
                add(k, "mail")
            elif kind == "ident":
                add(k, "ident")
            elif kind == "num":
                before = self.text[max(self.spans[k][0] - 60, 0) : self.spans[k][0]]
                last = {c: max((m.end() for m in p.finditer(before)), default=-1) for c, p in _CUES.items()}
                for name in number_features(t, max(last, key=last.get) if max(last.values()) >= 0 else None):
                    add(k, name)
                if k and (low[k - 1].rstrip(".") in HOUSE or self.kinds[k - 1] == "house" or low[k - 1] == "pin"):
                    add(k, "behind house")
            elif kind == "house":
                add(k, "house")
            elif kind == "word":
                w = low[k]
                if w in HOUSE and k + 1 < n and self.kinds[k + 1] == "num":
                    add(k, "house word")
                elif w in ROADS and t[:1].isupper():
                    add(k, "road word")
                elif w == "pin" or w in ("near",) and k and self.tokens[k - 1] == ",":
                    add(k, "pin")
                elif w in STOP:
                    add(k, "stop word")
                elif t[:1].isupper() and w not in ROLES and w not in TITLES:
                    add(k, "capital")
                else:
                    add(k, "plain")
            elif kind in ("money", "mark"):
                add(k, "mark")
            elif kind == "other":
                if t in ",-":
                    add(k, "comma")
                else:
                    add(k, "sign")
        self._addresses(low)
        self._names(low)

    def _addresses(self, low: list[str]) -> None:
        """Support for tokens between a house or road word and the town or PIN code behind it."""
        n = len(low)
        for k in range(n):
            if self.kinds[k] != "word" or low[k] not in ROADS:
                continue
            near = range(max(k - 8, 0), min(k + 9, n))
            if not any(self.kinds[j] == "num" or self.kinds[j] == "house" for j in near):
                continue
            self._add(k, "road")
            for step in (-1, 1):
                j = k + step
                while 0 <= j < n and abs(j - k) <= 9 and not (self.chain[max(j, j - step)] and step > 0 and self.chain[j]):
                    kind, t, w = self.kinds[j], self.tokens[j], low[j]
                    if kind == "num" and len(re.sub(r"\D", "", t)) <= 6 or kind == "house" or w in HOUSE or w in ROADS or w in ("pin", "near"):
                        self._add(j, "address part")
                    elif kind == "word" and w not in STOP and (t[:1].isupper() or low[k] == self.tokens[k] or self._beside_near(low, j)):
                        self._add(j, "address capital" if t[:1].isupper() else "address near")
                    elif t in ",-" and kind == "other":
                        self._add(j, "address comma")
                    else:
                        break
                    j += step

    @staticmethod
    def _beside_near(low: list[str], j: int) -> bool:
        return "near" in low[max(j - 2, 0) : j]

    def _names(self, low: list[str]) -> None:
        """Support for name-shaped runs behind or before a cue, or with a title."""
        n = len(low)

        def shaped(j: int, loose: bool) -> bool:
            kind, w, t = self.kinds[j], low[j], self.tokens[j]
            if kind == "init":
                return True
            if kind != "word" or w in STOP or w in ROLES and t[:1].islower() or w in ROADS or w in HOUSE:
                return False
            return loose or t[:1].isupper() or not t.isascii()

        k = 0
        while k < n:
            title = self.kinds[k] == "word" and low[k] in TITLES
            start = self.spans[k][0]
            cue = not title and start in self.cued and self.kinds[k] in ("word", "init")
            if title or cue:
                j = k
                if title:
                    self._add(k, "title")
                    j += 1
                    if j < n and self.tokens[j] == ".":
                        self._add(j, "title")
                        j += 1
                elif low[k] in ROLES and not (k + 1 < n and shaped(k + 1, False)):
                    k += 1
                    continue
                got, words = j, 0
                while j < n and not (self.chain[j] and j > k) and words < 4 and shaped(j, cue):
                    if self.kinds[j] == "word" and (low[j] in TITLES):
                        j += 1
                        if j < n and self.tokens[j] == ".":
                            j += 1
                        continue
                    words += 1
                    j += 1
                if words == 1 and self.kinds[j - 1] == "word" and j + 1 < n and self.tokens[j] == "," and self._single(j + 1, low, shaped):
                    j += 2  # surname first: "Surname, Given"
                    while j < n and self.kinds[j] == "init":
                        j += 1
                if words and not self.tokens[got].isascii() and (words < 2 or j >= n or low[j] not in ("है", "ने", "को", "का", "से", "और", "यांनी", "आहे")):
                    k += 1  # after a cue of an Indic script a name has two words and a particle behind it
                    continue
                if words and (words > 1 or title or self.kinds[got] == "word"):
                    if cue and all(self.tokens[x][:1].islower() and self.tokens[x].isascii() for x in range(k, j)) and words < 2:
                        k += 1
                        continue
                    for x in range(k, j):
                        self._add(x, "name run")
                    self.named.update(range(k, j))
                    k = j
                    continue
            k += 1
        for k in range(n):  # a cue behind the run
            if self.kinds[k] in ("word", "init") and self.spans[k][1] in self.after and k not in self.named and shaped(k, True):
                if low[k] in ROLES:
                    continue
                j = k
                while j >= 1 and k - j < 3 and not self.chain[j] and shaped(j - 1, self.tokens[k][:1].islower()) and (low[j - 1] not in ROLES):
                    j -= 1
                if j == k and j >= 2 and self.tokens[j - 1] == "," and shaped(j - 2, False) and (j < 3 or self.tokens[j - 3] in ".?!\n" or self.chain[j - 2]):
                    j -= 2
                if k - j >= 1:
                    for x in range(j, k + 1):
                        self._add(x, "name before")
                    self.named.update(range(j, k + 1))

    def _single(self, j: int, low: list[str], shaped) -> bool:
        """Whether token j alone can be the given name behind a comma."""
        if not shaped(j, False) or low[j] in ROLES or low[j] in TITLES:
            return False
        k = j + 1
        while k < len(low) and self.kinds[k] == "init":
            k += 1
        if k >= len(low):
            return True
        # a road name or a house number may follow a comma too: then it is no given name
        return not (self.kinds[k] == "word" and (low[k] in ROADS or self.tokens[k][:1].isupper())) and self.kinds[k] != "num"


class _Net:
    """The tokens, chains and links of several texts."""

    def __init__(self, docs: list[_Doc]) -> None:
        self.sizes = [len(d.tokens) for d in docs]
        base = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.n = int(base[-1])
        self.places = np.concatenate([np.asarray(d.places, np.int64) + x for d, x in zip(docs, base)]) if docs else np.zeros(0, np.int64)
        self.features = np.concatenate([np.asarray(d.features, np.int64) for d in docs]) if docs else np.zeros(0, np.int64)
        begin = np.concatenate([np.asarray(d.chain, bool) for d in docs]) if docs else np.zeros(0, bool)
        self.starts = np.flatnonzero(begin)
        self.lengths = np.diff(np.append(self.starts, len(begin)))
        links = np.array([(a + x, b + x) for d, x in zip(docs, base) for a, b in d.links], np.int64).reshape(-1, 2)
        self.a, self.b = links[:, 0], links[:, 1]
        chain_of = np.cumsum(begin) - 1
        self.linked = np.unique(chain_of[links.ravel()]) if len(links) else np.zeros(0, np.int64)

    def unary(self, node: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.places, node[self.features, lab], self.n) for lab in range(7)], 1)


def _shared(cavity: np.ndarray, same: float) -> np.ndarray:
    """Message of one end of a link to the other: only equal labels of ``SHARED`` are rewarded, so occurrences without evidence never outvote one with it."""
    p = np.exp(cavity - cavity.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[:, [O, A]] = 0
    return np.log(1 + (same - 1) * p)


def beliefs(net: _Net, unary: np.ndarray, model: Model, pairs: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Log label beliefs of all tokens by loopy message passing, and the expected number of links of equal labels of ``SHARED``; pairs: takes the expected label pairs."""
    order = np.argsort(net.lengths, kind="stable")
    belief = np.zeros((net.n, 7))
    _sweep(belief, unary, net.starts, net.lengths, order, model.chain, None if len(net.a) else pairs)
    if not len(net.a):
        return belief, 0.0
    same, message = np.exp(model.skip), np.zeros((2, len(net.a), 7))
    linked = net.linked[np.argsort(net.lengths[net.linked], kind="stable")]  # only their chains are swept again
    for _ in range(ROUNDS):
        new = np.stack([_shared(belief[net.a] - message[1], same), _shared(belief[net.b] - message[0], same)])
        change = np.abs(new - message).max()
        message = new if change < SETTLED else DAMPING * message + (1 - DAMPING) * new
        into = np.zeros_like(unary)
        np.add.at(into, net.b, message[0])
        np.add.at(into, net.a, message[1])
        _sweep(belief, unary + into, net.starts, net.lengths, linked, model.chain, None)
        if change < SETTLED:
            break
    if pairs is not None:
        _sweep(belief, unary + into, net.starts, net.lengths, order, model.chain, pairs)
    x, y = (np.exp(c - c.max(1, keepdims=True)) for c in (belief[net.a] - message[1], belief[net.b] - message[0]))
    agree = (x * y)[:, SHARED].sum(1)
    return belief, float((same * agree / ((same - 1) * agree + x.sum(1) * y.sum(1))).sum())


def _sweep(belief: np.ndarray, unary: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray, chain: np.ndarray, pairs: np.ndarray | None) -> None:
    """Exact log beliefs (up to a constant a token) of the chains in ``order``, in batches of like length."""
    trans = np.exp(chain)
    for at in range(0, len(order), 1024):
        rows = order[at : at + 1024]
        size = int(lengths[rows].max())
        pos = starts[rows][:, None] + np.arange(size)[None, :]
        ok = np.arange(size)[None, :] < lengths[rows][:, None]
        pos = np.where(ok, pos, 0)
        phi = np.where(ok[:, :, None], unary[pos], 0.0)
        phi = np.exp(phi - phi.max(2, keepdims=True))
        fwd, bwd = np.empty_like(phi), np.ones_like(phi)
        fwd[:, 0] = phi[:, 0]
        for t in range(1, size):
            x = (fwd[:, t - 1] @ trans) * phi[:, t]
            fwd[:, t] = x / x.sum(1, keepdims=True)
        for t in range(size - 2, -1, -1):
            x = (phi[:, t + 1] * bwd[:, t + 1]) @ trans.T
            x /= x.sum(1, keepdims=True)
            bwd[:, t] = np.where(ok[:, t + 1][:, None], x, 1.0)
        belief[pos[ok]] = np.log(fwd[ok] * bwd[ok] + 1e-30)
        if pairs is not None:
            for t in range(1, size):
                x = fwd[:, t - 1, :, None] * trans * (phi[:, t] * bwd[:, t])[:, None, :]
                pairs += (x / x.sum((1, 2), keepdims=True))[ok[:, t]].sum(0)


_MASKED = {"[EMAIL]": E, "[PHONE]": P, "[ACCOUNT]": C, "[AADHAAR]": I, "[PAN]": I}
_PLACE = re.compile("|".join(map(re.escape, _MASKED)))


def weak_labels(text: str, stored: str) -> list[tuple[int, int, int]]:
    """(label, start, end) of what the placeholders of the stored text stand for; none if the texts don't match otherwise."""
    kinds = [_MASKED[m] for m in _PLACE.findall(stored)]
    m = re.fullmatch("(.+?)".join(map(re.escape, _PLACE.split(stored))), text, re.S) if kinds else None
    return [(lab, *m.span(k)) for k, lab in enumerate(kinds, 1)] if m else []


def fit(labelled: list[tuple[str, str]]) -> Model:
    """Weights fitted to (text, the same text as an earlier masker stored it)."""
    start, docs, known = prior(), [], []
    for text, stored in labelled[:SAMPLE]:
        spans = weak_labels(text, stored)
        if spans:
            d = _Doc(text, signs(text))
            docs.append(d)
            known.append([next((lab for lab, a, b in spans if x < b and a < y), -1 if kind in ("num", "ident", "mail") else -2) for (x, y), kind in zip(d.spans, d.kinds)])
    if not sum(len(d.tokens) for d in docs):
        return start
    net = _Net(docs)
    label = np.array([x for k in known for x in k], np.int64)
    clamp = np.zeros((net.n, 7))
    clamp[np.ix_(label == -2, [P, I, C, E])] = -40.0
    clamp[label >= 0] = -40.0
    clamp[np.flatnonzero(label >= 0), label[label >= 0]] = 0.0
    now = Model(start.node.copy(), start.chain.copy(), start.skip)
    size = [np.zeros_like(start.node), np.zeros_like(start.chain), 0.0]
    for _ in range(STEPS):
        unary, moved = net.unary(now.node), []
        for extra in (clamp, 0.0):
            pairs = np.zeros((7, 7))
            belief, equal = beliefs(net, unary + extra, now, pairs)
            p = np.exp(belief - belief.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            seen = np.stack([np.bincount(net.features, p[net.places, lab], len(FEATURES)) for lab in range(7)], 1)
            moved.append((seen, pairs, equal))
        for k, (name, first) in enumerate((("node", start.node), ("chain", start.chain), ("skip", start.skip))):
            w = getattr(now, name)
            slope = moved[0][k] - moved[1][k] - (w - first) / DEVIATION**2
            size[k] = size[k] + slope**2
            setattr(now, name, w + 0.2 * slope / np.sqrt(size[k] + 1e-9))
    return now


def fitted(texts: DataFrame, stored: DataFrame, key_col: str, text_col: str, stored_col: str) -> Model:
    """Weights fitted to at most SAMPLE rows of stored texts with placeholders (those of the smallest hashes) and the texts they were made of."""
    h = F.xxhash64("k")
    marked = stored.select(F.col(key_col).alias("k"), F.col(stored_col).cast("string").alias("s")).where(F.col("k").isNotNull() & F.col("s").rlike(_PLACE.pattern))
    chosen = marked.groupBy("k").agg(F.min("s").alias("s")).orderBy(h, "k").limit(SAMPLE)
    whole = texts.select(F.col(key_col).alias("k"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    rows = whole.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t"), F.min("s").alias("s")).orderBy(h, "k").collect()  # at most SAMPLE rows
    return fit([(r.t, r.s) for r in rows])


def items(texts: list[str | None], model: Model | None = None) -> list[list[tuple[int, int, int]]]:
    """(label, start, end) of the items of each text, in order."""
    model = model or prior()
    docs = [_Doc(t, at) if t and (at := signs(t)) else None for t in texts]
    net = _Net([d for d in docs if d is not None])
    label = beliefs(net, net.unary(model.node), model)[0].argmax(1).tolist() if net.n else []
    out, at = [], 0
    for d in docs:
        n = len(d.tokens) if d is not None else 0
        out.append(_runs(d, label[at : at + n]) if n else [])
        at += n
    return out


def _runs(d: _Doc, label: list[int]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    k, n = 0, len(label)
    while k < n:
        lab = label[k]
        if lab == O:
            k += 1
            continue
        j = k + 1
        if lab in (N, A):
            while j < n and label[j] == lab and not d.chain[j]:
                j += 1
        a, b = k, j
        k = j
        while b > a and d.tokens[b - 1] in ",-.":
            b -= 1
        while a < b and d.tokens[a] in ",-.":
            a += 1
        if a == b:
            continue
        low = [t.lower() for t in d.tokens[a:b]]
        if lab == A:
            road = any(w in ROADS or w in HOUSE for w in low) or "house" in d.kinds[a:b]
            if not road or not any(x == "num" for x in d.kinds[a:b]):
                continue
        if lab == N and not any(x == "word" and w not in TITLES for x, w in zip(d.kinds[a:b], low)):
            continue
        out.append((lab, d.spans[a][0], d.spans[b - 1][1]))
    return out


def counted(df: DataFrame, key_col: str, text_col: str, model: Model | None = None) -> DataFrame:
    """(row_key, kind, nth): one row an item, numbered in each text by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4000):
                b = big.slice(at, 4000)
                keys, kinds, nths = [], [], []
                for key, got in zip(b.column(0).to_pylist(), items(b.column(1).to_pylist(), model)):
                    seen: dict[int, int] = {}
                    for lab, _, _ in got:
                        seen[lab] = seen.get(lab, 0) + 1
                        keys.append(key)
                        kinds.append(LABELS[lab])
                        nths.append(seen[lab])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(nths, pa.int32())], ["row_key", "kind", "nth"])

    rows = df.where(F.col(key_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "row_key long, kind string, nth int")


def masked_text(text: str | None, got: list[tuple[int, int, int]]) -> str | None:
    """The text with its items replaced by placeholders."""
    if text is None:
        return None
    out, at = [], 0
    for lab, a, b in got:
        out += [text[at:a], MARKS[lab]]
        at = b
    return "".join([*out, text[at:]])


def masked(text: Column, model: Model | None = None) -> Column:
    """The text with typed placeholders for its personal data."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        return pd.Series([masked_text(t, g) for t, g in zip(values, items(values, model))], index=texts.index, dtype=object)

    return run(text)
