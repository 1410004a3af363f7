r"""Personal data: fixed patterns and a semi-Markov conditional random field.

Base spans come from four patterns (email, ip, card, phone), leftmost and non-overlapping by kind, each
read from its own trigger character so that the time is linear in the text.

Method: a semi-Markov CRF over tokens. A segmentation cuts the tokens into entities of at most `MOST_TOKENS`
tokens and single outside tokens. Each candidate entity is scored as a whole span (shape, checksums, digit counts,
length, the words in front), once per kind, and each pair of neighbouring segments by their kinds; dynamic
programming picks boundaries and kinds together. Weights are fitted here, by gradient ascent on the exact
log-likelihood (forward-backward over segments and kinds) of generated sentences. Candidates are values without
blanks (of letters, digits and inner signs) that hold a digit or `@` or are assigned to a word like "password",
groups of digits, account numbers, and addresses written with "at" and "dot".

Decoding runs in islands: every candidate holds or follows a trigger (a digit, `@`, an assignment, a spelled "dot" or
"at"), and an island reaches from a trigger as many tokens to both sides as a candidate and its context can have.
All other tokens are outside tokens in every segmentation, so decoding the whole text gives the same spans (a test
compares both).

The model adds, beside values like those of the base kinds: phones without + behind a word like "phone" or "call";
spelled addresses; secrets of 12 characters or more behind a word like "token" or "password", hexadecimal, mixed,
dotted or (assigned) of letters only; IBANs with a valid check number; numbers like 123-45-6789 behind "ssn" or
"social security"; dates behind "born" or "birth". Names and postal addresses are not modelled. A span that
overlaps a base span is left out, base spans always stay.

Defined results: null or empty text has no spans; repeated rows each give a row; offsets are code points,
end exclusive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import batch, bounded_batches, documents, strings, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn", "birth")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
            at = end - 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {"email": list(_emails(text)) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the semi-Markov CRF -----------------------------------------------------------------------------

#: Runs of letters and digits, and single signs.
_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_HEX = re.compile(r"[0-9a-fA-F]+")
_VALUE = re.compile(r"[A-Za-z0-9_+/-]+")
_DOTTED = re.compile(r"[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){1,2}")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_SPELLED = re.compile(r"(?i)[a-z0-9_%+-]+(?:(?:\.| dot )[a-z0-9_%+-]+)*(?: at (?=.* dot )| ?[\[(]at[\])] ?)[a-z0-9-]+(?:(?:\.| dot | ?[\[(]dot[\])] ?)[a-z0-9-]+)+")
# Last labels of common domains.
_ENDINGS = frozenset("com org net edu gov info io de fr es it uk eu ch at nl pl tr hu br us ca au jp cn in".split())
_FOUR = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"\+?[0-9(][ ().0-9-]+[0-9]")
_CONTEXT = {
    "secret": frozenset("token key secret password passwd pwd apikey auth bearer credential".split()),
    "phone": frozenset("phone tel call mobile fax cell telephone".split()),
    "email": frozenset("mail email contact write".split()),
    "card": frozenset("card visa mastercard credit payment".split()),
    "ip": frozenset("ip host server address from".split()),
    "iban": frozenset("iban account bank".split()),
    "ssn": frozenset("ssn social security".split()),
    "birth": frozenset("born birth birthday dob".split()),
}
MOST_TOKENS = 16
_BEFORE = 5
#: Tokens of an island on each side of a trigger: a candidate, what is read in front of it, and the next token.
_REACH = MOST_TOKENS + _BEFORE + 2
SHORTEST_SECRET = 12


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Tokens:
    """Tokens of a stretch of text with their places."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
        self.words = [text[a:b] for a, b in self.spans]
        self.glued = [k > 0 and self.spans[k][0] == self.spans[k - 1][1] for k in range(len(self.spans))]
        # up to which token (not included) no blank comes, from each token on
        self.run = [0] * len(self.spans)
        for k in range(len(self.spans) - 1, -1, -1):
            self.run[k] = self.run[k + 1] if k + 1 < len(self.spans) and self.glued[k + 1] else k + 1
        self.before = [frozenset(w.lower() for w in self.words[max(0, k - _BEFORE) : k]) for k in range(len(self.words))]

    def assigned(self, i: int) -> bool:
        """Whether token i comes behind a word like "password" and a colon or equals sign."""
        k = i - 1
        if k >= 0 and self.words[k] in "\"'`":
            k -= 1
        if k < 1 or self.words[k] not in ":=":
            return False
        k -= 1
        if k >= 1 and self.words[k] in "\"'`":
            k -= 1
        return self.words[k].lower() in _CONTEXT["secret"]

    def shape(self, s: str, blank: bool, i: int) -> list[str] | None:
        digits = sum(map(s.count, "0123456789"))
        if "@" in s:
            return None if blank else ["address" if _ADDRESS.fullmatch(s) else "odd_address"]
        if not digits or blank:
            if ("dot" in (low := s.lower()) or "at]" in low or "at)" in low) and _SPELLED.fullmatch(s):
                return ["spelled_address", "known_ending" if re.split(r"[^a-z]+", low)[-1] in _ENDINGS else "other_ending"]
        if not blank and not digits and not self.assigned(i):
            return None
        if blank and not digits:
            return None
        if s[0].isupper() and _IBAN.fullmatch(s):
            return ["iban" if iban_ok(s) else "no_iban"]
        if blank or s[0] in "+(" or s.replace("-", "").isdigit() or "(" in s:
            if not blank and _DATE.fullmatch(s):
                return ["date"]
            if not blank and _SSN.fullmatch(s):
                return ["three_two_four", "plain"]
            if _NUMBER.fullmatch(s):
                valid = 13 <= digits <= 19 and luhn(re.sub("[^0-9]", "", s))
                return ["checked_number" if valid else "card_sized" if 13 <= digits <= 19 else "phone_sized" if 9 <= digits <= 12 else "other_number", "grouped" if digits < len(s) else "plain"]
            if _DIALLED.fullmatch(s):
                return ["plus" if s[0] == "+" else "no_plus", "phone_digits" if 9 <= digits <= 15 else "few_digits"]
            return None
        if (m := _FOUR.fullmatch(s)) is not None:
            return ["four_parts" if all(int(x) <= 255 for x in m.groups()) else "parts_over"]
        if _DATE.fullmatch(s):
            return ["date"]
        if _DIALLED.fullmatch(s):
            return ["no_plus", "phone_digits" if 9 <= digits <= 15 else "few_digits"]
        if len(s) < SHORTEST_SECRET:
            return None
        if _VALUE.fullmatch(s):
            return ["hex_value" if digits and _HEX.fullmatch(s) else "mixed_value" if digits else "letters_value", "long_value" if len(s) >= 24 else "mid_value" if len(s) >= 16 else "short_value"]
        return ["dotted_value"] if _DOTTED.fullmatch(s) else None

    def features(self, i: int, j: int) -> list[str] | None:
        """Of the whole span of tokens i..j-1; None where it can't be an entity."""
        a, b = self.spans[i][0], self.spans[j - 1][1]
        s = self.text[a:b]
        if not s[-1].isalnum() or "\n" in s or (out := self.shape(s, j > self.run[i], i)) is None:
            return None
        if (i and self.glued[i] and (self.words[i - 1][-1].isalnum() or self.words[i - 1] in "._-@+")) or (j < len(self.words) and self.glued[j] and (self.words[j][0].isalnum() or (self.words[j] in "@_-." and j + 1 < len(self.words) and self.glued[j + 1] and self.words[j + 1][0].isalnum()))):
            out.append("cut_word")
        out += [f"near_{kind}" for kind, ws in _CONTEXT.items() if ws & self.before[i]]
        if self.assigned(i):
            out.append("assigned")
        if i and self.words[i - 1] in "\"'":
            out.append("quoted")
        return [*out, *(f"{out[0]}&{x}" for x in out[1:])]

    def segments(self) -> Iterator[tuple[int, int, list[str]]]:
        n = len(self.spans)
        for i, w in enumerate(self.words):
            if not ((w[0].isalnum() and w[0].isascii()) or w in "+("):
                continue
            most = min(i + MOST_TOKENS, n)
            # a span that goes on behind a blank is a group of digits, an account number or a spelled address
            if not (w[0].isdigit() or w in "+(" or (len(w) == 4 and w[2:].isdigit() and w.isupper()) or self.spelled(i, most)):
                most = min(most, self.run[i])
            for j in range(i + 1, most + 1):
                if (f := self.features(i, j)) is not None:
                    yield i, j, f

    def spelled(self, i: int, most: int) -> bool:
        part = [w.lower() for w in self.words[i:most]]
        return "at" in part and ("dot" in part or any(part[k - 1] in "[(" and part[k] == "at" for k in range(1, len(part))))


_OUT = "outside"


def _sum(values: list[float]) -> float:
    """log of a sum of exponentials."""
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class SemiCRF:
    """Weights by (feature, kind), with a bias by kind, and by (kind, next kind), where either may be outside; the
    score of an outside token behind an outside token is 0."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.w = weights

    def score(self, features: list[str], kind: str) -> float:
        w = self.w
        return w.get(("bias", kind), 0.0) + sum([w.get((f, kind), 0.0) for f in features])

    def then(self, kind: str, following: str) -> float:
        return self.w.get((f"then_{following}", kind), 0.0)

    def decode(self, t: Tokens) -> list[tuple[int, int, str]]:
        """The best segmentation's entities, as (first token, end token, kind)."""
        n = len(t.spans)
        then = {(a, b): self.then(a, b) for a in (_OUT, *KINDS) for b in (_OUT, *KINDS)}
        ending: dict[int, list[tuple[int, float, str]]] = {}
        for i, j, f in t.segments():
            ending.setdefault(j, []).extend((i, self.score(f, k), k) for k in KINDS)
        # best[j]: by kind of the last segment that ends at j: score, start of that segment, kind before it
        best: list[dict[str, tuple[float, int, str]]] = [{_OUT: (0.0, 0, _OUT)}]
        for j in range(1, n + 1):
            before = best[j - 1]
            here = {_OUT: max((s + then[k, _OUT], j - 1, k) for k, (s, _, _) in before.items())}
            for i, s, kind in ending.get(j, ()):
                top, last = max((x + then[k, kind], k) for k, (x, _, _) in best[i].items())
                if top + s > here.get(kind, (-math.inf,))[0]:
                    here[kind] = (top + s, i, last)
            best.append(here)
        out, j = [], n
        kind = max(best[n], key=lambda k: (best[n][k][0], k == _OUT))
        while j > 0:
            _, i, last = best[j][kind]
            if kind != _OUT:
                out.append((i, j, kind))
            j, kind = i, last
        return out[::-1]

    def gradient(self, t: list[tuple[int, int, list[str]]], n: int, gold: set[tuple[int, int, str]]) -> tuple[float, dict[tuple[str, str], float]]:
        """Log-likelihood of the gold segmentation and its gradient, by forward-backward over segments and
        kinds."""
        scored = [(i, j, f, k, self.score(f, k)) for i, j, f in t for k in KINDS]
        then = {(a, b): self.then(a, b) for a in (_OUT, *KINDS) for b in (_OUT, *KINDS)}
        ends: dict[int, list] = {}
        starts: dict[int, list] = {}
        for x in scored:
            ends.setdefault(x[1], []).append(x), starts.setdefault(x[0], []).append(x)
        into = lambda at, kind: _sum([v + then[k, kind] for k, v in at.items()])
        forward: list[dict[str, float]] = [{_OUT: 0.0}]
        for j in range(1, n + 1):
            here: dict[str, list[float]] = {_OUT: [into(forward[j - 1], _OUT)]}
            for i, _, _, k, s in ends.get(j, ()):
                here.setdefault(k, []).append(into(forward[i], k) + s)
            forward.append({k: _sum(v) for k, v in here.items()})
        # backward[i]: by kind of the segment that ended at i, all that may follow
        backward: list[dict[str, float]] = [{}] * n + [dict.fromkeys(forward[n], 0.0)]
        for i in range(n - 1, -1, -1):
            backward[i] = {last: _sum([then[last, _OUT] + backward[i + 1][_OUT], *(then[last, k] + s + backward[j][k] for _, j, _, k, s in starts.get(i, ()))]) for last in forward[i]}
        whole = _sum(list(forward[n].values()))
        value, slope = -whole, {}

        def add(key: tuple[str, str], d: float) -> None:
            slope[key] = slope.get(key, 0.0) + d

        for i, j, f, k, s in scored:
            p = 0.0
            for last, v in forward[i].items():
                q = math.exp(v + then[last, k] + s + backward[j][k] - whole)
                p += q
                add((f"then_{k}", last), -q)
            hit = (i, j, k) in gold
            value += s * hit
            for name in ("bias", *f):
                add((name, k), hit - p)
        for j in range(1, n + 1):
            for last, v in forward[j - 1].items():
                if last != _OUT:
                    add((f"then_{_OUT}", last), -math.exp(v + then[last, _OUT] + backward[j][_OUT] - whole))
        at, last = 0, _OUT
        for i, j, k in [*sorted(gold), (n, n, "")]:
            if i > at:
                value += then[last, _OUT] if last != _OUT else 0.0
                add((f"then_{_OUT}", last), 1.0 if last != _OUT else 0.0)
                last = _OUT
            if k:
                value += then[last, k]
                add((f"then_{k}", last), 1.0)
                at, last = j, k
        slope.pop((f"then_{_OUT}", _OUT), None)
        return value, slope


def generated_sentences(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with marked entities and with look-alikes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "to", "li", "sa", "mo", "qu", "re", "en", "da"]) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789_-") for _ in range(k - 2)) + r.choice("abcXYZ") + digits(1)

    def card(valid: bool) -> str:
        while True:
            d = digits(r.choice([13, 15, 16, 16, 16, 19]))
            if luhn(d) == valid:
                return "-".join(re.findall(".{1,4}", d)) if r.random() < 0.3 else d

    def iban(valid: bool) -> str:
        body, land = digits(18), r.choice(["DE", "FR", "GB", "ES"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        s = f"{land}{(check if valid else (check + 7) % 97):02d}{body}"
        return " ".join(re.findall(".{1,4}", s)) if r.random() < 0.5 else s

    date = lambda: r.choice([f"{r.randint(1930, 2024)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1930, 2024)}"])
    plain_phone = lambda: r.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(r.randint(8, 10))}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
    triple = lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"
    spelled = lambda: r.choice([f"{word()} dot {word()} at {word()} dot com", f"{word()} at {word()} dot org", f"{word()} [at] {word()}.com", f"{word()}.{word()}(at){word()}(dot)net", f"{word()} (at) {word()} (dot) org"])
    secret = lambda: r.choice([hexes(r.choice([32, 40, 40, 64])), mixed(r.choice([16, 20, 20, 32])), ".".join(mixed(r.choice([16, 24])) for _ in range(3))])
    letters = lambda: "".join(word() for _ in range(8))[: r.randint(12, 24)]
    call = ["call ", "phone ", "tel: ", "mobile ", "fax: "]
    assigned = ["token = \"", "api key: ", "password = \"", "secret=\"", "pwd: ", "token: "]
    entity = [
        ("email", ["mail ", "", ""], lambda: f"{word()}{r.choice(['.', '_', '', '+'])}{digits(r.randint(0, 2))}{word()}@{word()}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'example.com'])}"),
        ("email", ["mail ", "contact ", ""], spelled),
        ("ip", ["host ", "", ""], lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))),
        ("card", ["card ", "", ""], lambda: card(True)),
        ("phone", ["call ", "phone ", ""], lambda: r.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(11)}"])),
        ("phone", call, plain_phone),
        ("secret", [*assigned, "key ", "bearer "], secret),
        ("secret", assigned, letters),
        ("iban", ["iban ", "account ", ""], lambda: iban(True)),
        ("ssn", ["ssn ", "ssn: ", "social security number "], triple),
        ("birth", ["born ", "born on ", "date of birth: ", "birthday "], date),
    ]
    decoys = [
        lambda: digits(r.randint(1, 8)), date, lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: card(False), lambda: f"{digits(2)}.{digits(3)}", lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)),
        lambda: f"{digits(3)} ({digits(1)})", lambda: digits(10), plain_phone, plain_phone, lambda: hexes(8), lambda: f"{digits(2)}:{digits(2)}", lambda: f"{word()}{digits(2)}", lambda: iban(False), triple,
        lambda: mixed(r.choice([14, 20])), lambda: f"{word()}-{word()}-{digits(4)}-{word()}", lambda: hexes(r.choice([12, 16])), lambda: f"{r.choice(['token', 'key', 'secret', 'password'])}: {word()[:8]}", lambda: f"{word()}: {letters()}",
        lambda: f"call {digits(r.randint(1, 4))}", lambda: f"born in {digits(4)}", lambda: f"look at {word()} dot {word()}", lambda: f"{word()} at the {word()} dot and", lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(3)}, {digits(3)} {digits(3)}",
    ]
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(2, 4)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.55:
                kind, heads, make = r.choice(entity)
                text += (head := r.choice(heads))
                e = make()
                gold.append((len(text), len(text) + len(e), kind))
                text += e + ('"' if '"' in head else r.choice(["", ".", ","])) + " "
            else:
                text += " ".join(word() for _ in range(_BEFORE)) + " " + r.choice(decoys)() + r.choice(["", ".", ","]) + " "
            if r.random() < 0.5:
                text += " ".join(word() for _ in range(_BEFORE)) + " "
        out.append((text + word(), gold))
    return out


def train(sentences: int = 220, rounds: int = 24, rate: float = 0.5, decay: float = 1e-3) -> SemiCRF:
    """Adagrad on the log-likelihood of generated sentences; deterministic."""
    data = []
    for text, gold in generated_sentences(sentences):
        t = Tokens(text, 0, len(text))
        first, last = {a: k for k, (a, _) in enumerate(t.spans)}, {b: k + 1 for k, (_, b) in enumerate(t.spans)}
        segments = list(t.segments())
        known = {(i, j) for i, j, _ in segments}
        marked = {(first[a], last[b], kind) for a, b, kind in gold if (first.get(a), last.get(b)) in known}
        data.append((segments, len(t.spans), marked))
    model, seen = SemiCRF({}), {}
    for k in KINDS:
        model.w["bias", k] = -2.0
    for _ in range(rounds):
        total: dict[tuple[str, str], float] = {}
        for segments, n, gold in data:
            for key, d in model.gradient(segments, n, gold)[1].items():
                total[key] = total.get(key, 0.0) + d
        for key, d in total.items():
            d -= decay * len(data) * model.w.get(key, 0.0)
            seen[key] = seen.get(key, 0.0) + d * d
            model.w[key] = model.w.get(key, 0.0) + rate * d / math.sqrt(seen[key] + 1e-9)
    return model


_model: list[SemiCRF] = []


def trained() -> SemiCRF:
    if not _model:
        _model.append(train())
    return _model[0]


#: What every candidate holds or follows.
_TRIGGER = re.compile(r"[0-9@]|[:=]|[dD](?:ot|OT)|[aA][tT][\])]")


def _back(text: str, at: int) -> int:
    """Where the token _REACH tokens before a place begins."""
    reach = 8 * _REACH
    while True:
        a = max(0, at - reach)
        starts = [m.start() for m in _TOKEN.finditer(text, a, at)]
        if a == 0 or len(starts) > _REACH:  # the first one may be the rest of a token
            return starts[-_REACH] if len(starts) > _REACH else 0
        reach *= 2


def _ahead(text: str, at: int) -> int:
    """Where the token _REACH tokens behind the one at a place ends."""
    end = at
    for k, m in enumerate(_TOKEN.finditer(text, at)):
        end = m.end()
        if k == _REACH:
            break
    return end


def _is_trigger(text: str, m: re.Match) -> bool:
    """A colon or equals sign counts behind a word like "password" only."""
    if m[0] not in ":=":
        return True
    w = re.search(r"([^\W_]+)[\"'`]?\s*$", text[max(0, m.start() - 24) : m.start()])
    return w is not None and w[1].lower() in _CONTEXT["secret"]


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of whole tokens that hold all candidates with what is read around them."""
    start, end, trigger, done = -1, -1, -1, 0
    while (m := _TRIGGER.search(text, done)) is not None:
        done = m.end()
        if not _is_trigger(text, m):
            continue
        word = _TOKEN.match(text, m.start())
        done = max(done, word.end() if word else done)
        if m.start() <= end:  # still inside; where it ends is worked out once that matters
            trigger = m.start()
            continue
        if trigger >= 0:
            end = max(end, _ahead(text, trigger))
            trigger = -1
        a = _back(text, m.start())
        if a > end:
            if end >= 0:
                yield start, end
            start = a
        end = max(end, _ahead(text, m.start()))
    if trigger >= 0:
        end = max(end, _ahead(text, trigger))
    if end >= 0:
        yield start, end


def model_spans(text: str, model: SemiCRF, stretches: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    for a, b in stretches:
        t = Tokens(text, a, b)
        for i, j, kind in model.decode(t):
            yield t.spans[i][0], t.spans[j - 1][1], kind


def find(text: str, model: SemiCRF) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The base spans, and these with the model's spans beside them; by kind, in order of start."""
    base = base_spans(text)
    spans = {k: list(base.get(k, [])) for k in KINDS}
    taken = sorted(s for x in base.values() for s in x)
    starts, furthest = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    for a, b, kind in model_spans(text, model, islands(text)):
        k = bisect_left(starts, b)  # base spans that begin before its end
        if k == 0 or furthest[k - 1] <= a:
            spans[kind].append((a, b))
    return base, {k: sorted(set(v)) for k, v in spans.items()}


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def _scan(batches: Iterable[pa.RecordBatch], model: SemiCRF) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [find(t, model) for t in strings(b["text"])]
        counts = {f"n_{k}": [len(x[k]) for x, _ in found] for k in BASE_KINDS}
        yield batch(_FOUND, doc_id=b["doc_id"], **counts, base_sha256=[hashlib.sha256(joined(x).encode()).hexdigest() for x, _ in found], spans=[joined(y) for _, y in found], n_spans=[sum(map(len, y.values())) for _, y in found])


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by base kind, digest of the base spans, and all spans."""
    bounded_batches(docs.sparkSession)
    model = trained()
    return documents(docs, id_col, text_col).mapInArrow(lambda it: _scan(it, model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str | None, model: SemiCRF) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    spans = sorted((a, b, k) for k, v in find(text, model)[1].items() for a, b in v)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs, all columns, with personal data in the text replaced by `<kind>`; null stays null."""
    bounded_batches(docs.sparkSession)
    model = trained()

    def change(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            yield b.set_column(k, b.schema.field(k), pa.array([masked(t, model) for t in b[k].to_pylist()], type=b.schema.field(k).type))

    return docs.mapInArrow(change, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
