"""Personal data: plain patterns, and a linear-chain conditional random field for what they miss.

The field labels words (runs of anything but ASCII white space) as outside, beginning or going on with a
kind. Its features are the word's shape, the shapes of two neighbours on either side, and cue words; shapes
are of whole words. It is trained on a small labelled table (see labelled()), a parameter, by gradient
ascent on the likelihood, and decodes each whole text by Viterbi in numpy. Most words of prose are settled
before: a bound over all labels of the words on both sides shows that the best labelling has them outside
(see settled()). What is left between settled words is decoded exactly, many segments at a time, so the
result is that of decoding the whole text at once.

A null text is empty; empty texts and texts without personal data have no spans. Very long texts and very
long words are read whole, in time in proportion to their length. Of labellings that tie, the one with
smaller label numbers is taken; repeated rows are repeated; ids keep their type, null included; extra
columns are ignored. An empty table gives an empty result; an empty labelled table gives plain spans only.
A span of the field that overlaps a plain one is not added.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import kind, prepare, small, text_of, texts

KINDS = "email", "ip", "card", "phone"
#: The base patterns. A run can't be entered in its middle, which the look-behinds say.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest local part before it that no earlier match holds, and a domain behind it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), sorted: kinds are numbered as in KINDS."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return sorted(out)


# ---- words and their features

LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
K = len(LABELS)
BEGINS, INSIDE = np.arange(1, K, 2), np.arange(2, K, 2)
#: A kind can only go on behind its own beginning or going on.
BANNED = np.array([[LABELS[j][0] == "I" and LABELS[i][2:] != LABELS[j][2:] for j in range(K)] for i in range(K)])
BAN = -1e4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What may stand around a span in its first and last word without being part of it.
AROUND = ".,;:!?\"'*%$&#|<>[]{}"
CUES = frozenset("call phone tel telephone fax mobile cell mail email e-mail at dot card visa amex mastercard credit ip host server address contact reach number version license section page".split())
_CLASS = {c: "d" for c in "0123456789"} | {chr(c): "x" for c in range(0x41, 0x5B)} | {chr(c): "x" for c in range(0x61, 0x7B)}
_LETTERS = re.compile("x{2,}")
_DIGITS = re.compile("d{5,}")
_ANY_DIGITS = re.compile("d+")


def shape(word: str) -> str:
    """The whole word: digits as d (runs up to 4, longer ones as five), runs of letters and of others beyond ASCII as x, the rest as it is."""
    if word.isalpha():
        return "x"
    found = "".join([_CLASS.get(c) or ("x" if c > "\x7f" else c) for c in word])
    return _DIGITS.sub("ddddd", _LETTERS.sub("x", found))


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>|*%$&#").lower()


def own(word: str) -> tuple[str, str, str, int]:
    """Shape, shape without what stands around and with one d for each run of digits, cue word, and the number of digits up to 20."""
    if word.isalpha():
        low = word.lower()
        return "x", "x", low if low in CUES else "", 0
    b = bare(word)
    return shape(word), _ANY_DIGITS.sub("d", shape(b)), b if b in CUES else "", min(len(DIGIT.findall(word)), 20)


CORE = "core "


def own_names(o: tuple[str, str, str, int]) -> list[str]:
    """The shape, parts of it, and what the word says by itself."""
    whole, core, cue, digits = o
    marked = f"^{core}$"
    parts = {marked[i : i + k] for k in (2, 3) for i in range(len(marked) - k + 1)}
    dots = f"dots {min(core.count('.'), 5)} colons {min(core.count(':'), 8)} hyphens {min(core.count('-'), 5)} at {min(core.count('@'), 2)}"
    return ["1", f"shape {whole}", f"{CORE}{core}", f"cue {cue}", f"digits {digits}", f"digits {digits} {core}", f"{dots} {'x' in core}", *(f"part {x}" for x in sorted(parts))]


def context_names(at: list[tuple[str, str]]) -> list[str]:
    """Features from (core, cue) of two words before, the word, and two behind."""
    (a2, aq2), (a, aq), (c, _), (b, bq), (b2, _) = at
    return [f"p{a}", f"n{b}", f"pq{aq}", f"nq{bq}", f"pc{a} {c}", f"cn{c} {b}", f"p2{a2} {a} {c}", f"n2{c} {b} {b2}", f"pqc{aq} {c}", f"p2q{aq2} {c}"]


EDGE = "^", ""


def labelled(n: int = 700, seed: int = 5, forms: slice = slice(None), frames: slice = slice(None)) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: sentences as words and their labels, with personal data in many forms and look-alikes.

    forms and frames pick from the forms of each kind and from the kinds of sentences, so that tests can hold some out.
    """
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    octet = lambda: str(rng.randint(0, 255))
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    key = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", k=k))
    user = lambda: name() + rng.choice(["", ".", "_", "-"]) + rng.choice([name(), d(2), ""])
    end = lambda: rng.choice(["com", "org", "net", "de", "fr"])
    host = lambda: name() + rng.choice(["", d(1), f"{d(1)}.example"])
    ip = lambda: ".".join(octet() for _ in range(4))
    cc = lambda: str(rng.randint(1, 99))
    every = {
        "email": [
            lambda: [f"{user()}@{host()}.{end()}"], lambda: [name(), "[at]", host(), "[dot]", end()], lambda: [f"{user()}@{host()}.{end()}"], lambda: [name(), "(at)", host(), "(dot)", end()],
            lambda: [f"{user()}[at]{host()}[dot]{end()}"], lambda: [f"{user()}(at){host()}.{end()}"], lambda: [user(), "@", f"{host()}.{end()}"],
        ],
        "ip": [lambda: [ip()], lambda: [f"{ip()}:{rng.randint(1, 65535)}"], lambda: [ip()], lambda: [f"{ip()}/{rng.randint(8, 30)}"], lambda: [":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))]],
        "card": [lambda: [d(4), d(4), d(4), d(4)], lambda: [d(16)], lambda: [f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"], lambda: [d(4), d(6), d(5)], lambda: [f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"]],
        "phone": [
            lambda: [f"+{cc()}", f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"{d(3)}-{d(3)}-{d(4)}"], lambda: [f"+{cc()}", d(2), d(4), d(4)], lambda: [f"+1-{d(3)}-{d(3)}-{d(4)}"],
            lambda: [f"{d(3)}.{d(3)}.{d(4)}"], lambda: [f"00{cc()}", d(3), d(6)], lambda: [f"({d(3)}){d(3)}-{d(4)}"],
        ],
    }
    others = [
        lambda: ["version", f"{d(1)}.{d(1)}"], lambda: ["License,", "Version", "2.0."], lambda: ["CC", "BY-NC", "4.0."], lambda: [str(rng.randint(1900, 2035))], lambda: [f"{rng.randint(1990, 2035)}-{d(2)}-{d(2)}"], lambda: [f"{d(2)}:{d(2)}"],
        lambda: [f"{d(2)}.{d(2)}.{d(4)}"], lambda: [f"${d(2)}.{d(2)}"], lambda: [d(rng.randint(1, 9))], lambda: [f"{d(3)},{d(3)}"], lambda: [f"v{d(1)}.{d(1)}.{d(1)}"], lambda: [f"{d(2)}%"], lambda: [f"{d(1)}."], lambda: ["@", name()], lambda: [f"@{name()}"],
        lambda: ["token", "=", f'"{hexa(40)}"'], lambda: ["TOKEN", "=", f'"{hexa(40).upper()}"'], lambda: ["pages", f"{d(2)}-{d(2)}"], lambda: [f"{d(1)}.{d(1)}.{d(1)}"], lambda: [f"#{d(4)}"], lambda: [f"{d(2)}/{d(2)}/{d(4)}"], lambda: ["section", f"{d(1)}.{d(2)}"],
        lambda: [f'"{hexa(40)}"'], lambda: [key(rng.randint(12, 40))], lambda: [f"{key(3)}_{key(24)}", key(20)], lambda: [hexa(32)], lambda: [hexa(20)], lambda: [f"{name()}{d(2)}"], lambda: [d(4), d(4)], lambda: [d(22)], lambda: [f"({d(2)})"], lambda: [d(12)],
        lambda: ["AKIA" + key(16).upper()], lambda: [rng.choice(["at", "dot", "call", "de"])] * rng.randint(2, 6),
    ]
    plain = lambda w: w
    pile = lambda w: w + rng.choice(["%%%", "***", "&&&", "$$$", "###", "!!", "?", "~~"])
    kinds = [plain, plain, plain, lambda w: w.capitalize(), lambda w: w.upper() + "!!", pile, lambda w: w.upper(), pile][frames]
    accents = "éèüöñóßçêä"
    out = []
    for _ in range(n):
        frame = rng.choice(kinds)
        words, tags = [], []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 6)):
                w = name() + rng.choice(["", "", "", rng.choice(accents), rng.choice(accents) + name()])
                words.append(frame(rng.choice([w, w, w, w.capitalize(), w + ".", w + ",", rng.choice(sorted(CUES)), "|"])))
                tags.append("O")
            which = rng.choice([*KINDS, None, None, None])
            got = rng.choice(every[which][forms])() if which else rng.choice(others)()
            got = [*got[:-1], got[-1] + rng.choice(["", "", "", ".", ",", ";", ")"])] if frame is plain else [frame(x) if frame is pile or len(got) == 1 else x for x in got]
            words += got
            tags += ["O"] * len(got) if not which else [f"B-{which}"] + [f"I-{which}"] * (len(got) - 1)
        out.append((words, tags))
    return out


def labelled_table(spark: SparkSession, **how) -> DataFrame:
    """labelled() as a table: words, tags."""
    return spark.createDataFrame(labelled(**how), "words array<string>, tags array<string>")


# ---- the field

#: Sentences that are trained on at most; a larger table raises.
MAX_LABELLED = 20_000
STEPS = 28
#: How many words settled() looks further at a time, and the share of words that must be settled by that to go on. The result is the same with any.
LOOK, FEW = 4, 0.01
#: Bytes of text whose words are looked at together: what numpy makes of them stays in a processor's cache.
PART = 1 << 18
#: Pairs of shape and cue word that a labelled table has at most, so that five of them make one number.
SHAPES = 4096


class Field:
    """Weights by feature, transitions, and tables of what words weigh. The text has O before and behind it."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray) -> None:
        self.index, self.weights, self.transitions = index, weights, np.where(BANNED, BAN, transitions)
        self.cores = {n.removeprefix(CORE) for n in index if n.startswith(CORE)}
        t = self.transitions
        c = np.array([max(t[i, b] - t[b0, b] for b in range(K) if not BANNED[i, b]) for b0, i in zip(BEGINS, INSIDE, strict=True)])
        # Bounds for settled(): what a label can gain over O from before, from behind, and where the kind goes on.
        self.before = np.array([max(t[a, y] - t[a, 0] for a in range(K) if not BANNED[a, y]) for y in range(K)])
        self.behind = np.array([max(t[y, b] - t[0, b] for b in (0, *BEGINS)) for y in range(K)])
        self.anew, self.ended = np.full(K, BAN), np.full(K, BAN)
        for k, (b0, i) in enumerate(zip(BEGINS, INSIDE, strict=True)):
            for y in (b0, i):
                self.anew[y], self.ended[y] = t[y, i] - t[0, b0] + c[k], t[y, i] - t[0, 0]
        self.clear()

    def clear(self) -> None:
        self.word_of: dict[str, int] = {}  # word -> number of its own features
        self.own_of: dict[tuple, int] = {}
        self.around_of: dict[tuple[str, str], int] = {EDGE: 0}
        self.own_scores: list[np.ndarray] = []
        self.own_around: list[int] = []
        self.context_scores: dict[int, np.ndarray] = {}
        self.own_table, self.around_table = np.zeros((0, K), np.float32), np.zeros(0, np.int64)

    def sum_of(self, names: list[str]) -> np.ndarray:
        at = [self.index[n] for n in names if n in self.index]
        return self.weights[at].sum(axis=0)

    def number(self, word: str) -> int:
        """The number of a word's own features; shapes that training never saw count as one for its neighbours."""
        o = own(word)
        if o not in self.own_of:
            around = (o[1] if o[1] in self.cores else "?", o[2])
            self.own_of[o] = len(self.own_scores)
            self.own_scores.append(self.sum_of(own_names(o)))
            self.own_around.append(self.around_of.setdefault(around, len(self.around_of)))
        if len(word) <= 64:  # longer ones are looked at anew each time, with the same result
            self.word_of[word] = self.own_of[o]
        return self.own_of[o]

    def emissions(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Label scores of each word of the texts one after another, two edges before, between and behind; and where words are."""
        if len(self.own_scores) + len(self.word_of) > 300_000 or len(self.context_scores) > 300_000:
            self.clear()
        get, number = self.word_of.get, self.number
        ids: list[int] = [-1, -1]
        for words in found:
            some = list(map(get, words))
            if None in some:
                some = [number(w) if n is None else n for w, n in zip(words, some, strict=True)]
            ids += some
            ids += (-1, -1)
        at = np.array(ids)
        real = at >= 0
        if len(self.own_table) != len(self.own_scores) + 1:  # edges come last
            self.own_table = np.array([*self.own_scores, np.zeros(K)], np.float32)
            self.around_table = np.array([*self.own_around, 0], np.int64)
        scores, around = self.own_table[at], self.around_table[at]
        if len(self.around_of) > SHAPES:
            raise ValueError("too many shapes in the labelled table")
        n = len(at)
        k = np.zeros(n, np.int64)
        if n > 4:
            for i in range(5):
                k[2:-2] = k[2:-2] * SHAPES + around[i : n - 4 + i]
        keys, inverse = np.unique(k[real], return_inverse=True)
        if len(keys):
            names = list(self.around_of)
            rows = []
            for key in keys.tolist():
                five, rest = [], key
                for _ in range(5):
                    rest, x = divmod(rest, SHAPES)
                    five.append(x)
                five = tuple(five[::-1])
                row = self.context_scores.get(five)
                if row is None:
                    row = self.context_scores[five] = self.sum_of(context_names([names[x] for x in five]))
                rows.append(row)
            scores[real] += np.array(rows, np.float32)[inverse]
        scores[~real] = BAN
        scores[~real, 0] = 0.0
        return scores, real

    def settled(self, e: np.ndarray) -> np.ndarray:
        """Words that the best labelling of the whole text has outside, whatever else it says.

        Say it had label y at word i. With O at i instead, the words before lose before[y] at most; or, for a
        label that goes on with a kind, what its own word and the one before lose if both are O. Behind i,
        if the next label isn't one that goes on with the kind, behind[y] is lost at most. If it is, the kind
        can begin there instead, at the cost of anew[y] and the difference of that word's scores; or that
        word can be O too, at the cost of ended[y], the difference of its scores and what is lost behind it in
        turn. Each round carries both one word further; the bound holds after any number of them. Where the
        sum is below zero for every y, a labelling with O at i is better; what is settled settles words beside it.
        """
        out = np.ones(len(e), bool)
        for b, i in zip(BEGINS, INSIDE, strict=True):
            out &= self._settled_but_for(e[:, b] - e[:, 0], e[:, i] - e[:, 0], [(b, i)[k] for k in (0, 1)])
        return out

    def _settled_but_for(self, begin: np.ndarray, inside: np.ndarray, labels: list[int]) -> np.ndarray:
        """settled() for one kind, whose labels score so much more than O."""
        zero = np.zeros(1, begin.dtype)
        rise, fall = np.append(inside[1:] - begin[1:], zero), np.append(inside[1:], zero)
        behind, anew, ended, before = ([begin.dtype.type(x[y]) for y in labels] for x in (self.behind, self.anew, self.ended, self.before))
        lost = [np.maximum(behind[k], anew[k] + rise) for k in (0, 1)]
        first, gain = begin + before[0], inside + before[1]
        out, done = np.zeros(len(begin), bool), -1.0
        while True:
            out |= np.maximum(first + lost[0], gain + lost[1]) < -1e-3
            if not out.mean() > done + FEW or out.mean() > 1 - FEW:
                return out
            done = out.mean()
            for _ in range(LOOK):
                after = fall + np.append(lost[1][1:], zero)
                lost = [np.maximum(behind[k], np.minimum(anew[k] + rise, ended[k] + after)) for k in (0, 1)]
                gain[1:] = inside[1:] + np.minimum(before[1], np.maximum(first[:-1] + ended[0], gain[:-1] + ended[1]))
            first[out], gain[out], lost[0][out], lost[1][out] = BAN, BAN, BAN, BAN  # the kind doesn't go on from there

    def decode(self, found: list[list[str]]) -> list[list[tuple[int, int, int]]]:
        """For each text, (first word, word behind the last, kind) of each span."""
        e, real = self.emissions(found)
        open_ = real & ~self.settled(e)
        tags = np.zeros(len(e), np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        order = np.argsort(lengths, kind="stable")
        a = 0
        while a < len(order):
            top = lengths[order[a]] * 2
            b = int(np.searchsorted(lengths[order], top, "right"))
            b = max(a + 1, min(b, a + max(1, (1 << 18) // int(top))))
            self._viterbi(e, tags, starts[order[a:b]], lengths[order[a:b]])
            a = b
        out: list[list[tuple[int, int, int]]] = []
        at = 2
        marked = np.flatnonzero(tags % 2 == 1)
        of = np.searchsorted(marked, 0)
        for words in found:
            spans = []
            while of < len(marked) and marked[of] < at + len(words):
                i = int(marked[of])
                j = i + 1
                while tags[j] == tags[i] + 1:
                    j += 1
                spans.append((i - at, j - at, int(tags[i]) // 2))
                of += 1
            out.append(spans)
            at += len(words) + 2
        return out

    def _viterbi(self, e: np.ndarray, tags: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Best labels of segments of like length, with O before and behind each, into tags."""
        n, t, tr = len(starts), int(lengths.max()), self.transitions
        score = tr[0] + e[starts]
        back = np.zeros((t, n, K), np.int8)
        for i in range(1, t):
            z = score[:, :, None] + tr
            back[i] = z.argmax(axis=1)
            live = i < lengths
            score = np.where(live[:, None], z.max(axis=1) + e[starts + np.where(live, i, 0)], score)
        now = (score + tr[:, 0]).argmax(axis=1)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            live = i < lengths
            tags[starts[live] + i] = now[live]
            if i:
                now = np.where(live, back[i, rows, now], now)


def trained(rows: list[tuple[list[str], list[str]]], steps: int = STEPS) -> Field:
    """By Adam on the penalised likelihood, all sentences at once."""
    index: dict[str, int] = {"": 0}  # fills rows up, and weighs nothing
    if not rows:
        return Field(index, np.zeros((1, K)), np.zeros((K, K)))
    lists = []
    for words, _ in rows:
        owns = [own(w) for w in words]
        around = [EDGE, EDGE, *((o[1], o[2]) for o in owns), EDGE, EDGE]
        lists.append([[index.setdefault(f, len(index)) for f in own_names(o) + context_names(around[i : i + 5])] for i, o in enumerate(owns)])
    lengths = np.array([len(x) for x in lists])
    n, t, width = len(lists), int(lengths.max()), max(len(r) for x in lists for r in x)
    x = np.zeros((n, t, width), np.int64)
    y = np.zeros((n, t), np.int64)
    number = {label: i for i, label in enumerate(LABELS)}
    for i, (found, (_, tags)) in enumerate(zip(lists, rows, strict=True)):
        if found:
            x[i, : len(found)] = [r + [0] * (width - len(r)) for r in found]
            y[i, : len(tags)] = [number[tag] for tag in tags]
    live = np.arange(t) < lengths[:, None]
    w, a = np.zeros((len(index), K)), np.zeros((K, K))
    m, v = [np.zeros_like(w), np.zeros_like(a)], [np.zeros_like(w), np.zeros_like(a)]
    flat = x[live].ravel()
    order = np.argsort(flat, kind="stable")
    words_of = order // width  # the word of each feature, features in order
    seen, starts = np.unique(flat[order], return_index=True)
    gold = np.zeros((K, K))
    for i in range(n):
        chain = [0, *y[i, : lengths[i]], 0]
        np.add.at(gold, (chain[:-1], chain[1:]), 1.0)
    last = np.maximum(lengths - 1, 0)
    for step in range(1, steps + 1):
        # Forward and backward in probabilities, scaled at each word.
        e = np.zeros((n, t, K))
        e[live] = w[x[live]].sum(axis=1)
        e = np.exp(e - e.max(axis=2, keepdims=True))
        tr = np.where(BANNED, 0.0, np.exp(a))
        f, b = np.zeros((n, t, K)), np.ones((n, t, K))
        for i in range(t):
            f[:, i] = (f[:, i - 1] @ tr if i else tr[0]) * e[:, i]
            f[:, i] = np.where(live[:, i, None], f[:, i] / f[:, i].sum(axis=1, keepdims=True), f[:, i - 1])
        b[:] = tr[:, 0]
        ga = gold.copy()
        for i in range(t - 2, -1, -1):
            on = live[:, i + 1]
            ahead = e[:, i + 1] * b[:, i + 1]
            b[on, i] = ahead[on] @ tr.T
            b[on, i] /= b[on, i].max(axis=1, keepdims=True)
            z = np.einsum("ni,ij,nj->n", f[:, i], tr, ahead)
            ga -= tr * ((f[on, i] / z[on, None]).T @ ahead[on])
        p = f * b
        p = p / p.sum(axis=2, keepdims=True) * live[:, :, None]
        ga[0] -= p[:, 0].sum(axis=0)
        ga[:, 0] -= p[np.arange(n), last].sum(axis=0)
        diff = -p
        diff[np.arange(n)[:, None], np.arange(t)[None], y] += live
        gw = np.zeros_like(w)
        gw[seen] = np.add.reduceat(diff[live][words_of], starts)
        gw[0] = 0.0
        for j, (param, grad) in enumerate(((w, gw / n - 3e-4 * w), (a, np.where(BANNED, 0.0, ga) / n - 1e-4 * a))):
            m[j] = 0.9 * m[j] + 0.1 * grad
            v[j] = 0.99 * v[j] + 0.01 * grad * grad
            param += 0.15 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-6)
    return Field(index, w, a)


def fit(table: DataFrame) -> Field:
    """The field of a labelled table: words, tags (O, B-email, I-email, ...), at most MAX_LABELLED rows."""
    rows = table.select("words", "tags").filter("size(words) = size(tags) and size(words) > 0").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"over {MAX_LABELLED} labelled sentences")
    return trained(sorted((list(r["words"]), list(r["tags"])) for r in rows))


# ---- spans


def field_spans(found: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """For each text what the field alone finds: (kind, start, end)."""
    words = [WORD.findall(t) for t in found]
    out = []
    for text, spans in zip(found, field.decode(words), strict=True):
        at = [m.span() for m in WORD.finditer(text)] if spans else []
        mine = []
        for first, behind, k in spans:
            a, b = at[first][0], at[behind - 1][1]
            while a < b and text[a] in AROUND:
                a += 1
            while b > a and (text[b - 1] in AROUND or text[b - 1] == ")" and "(" not in text[a:b]):
                b -= 1
            if b > a:
                mine.append((k, a, b))
        out.append(mine)
    return out


def all_spans(found: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans and all spans."""
    out = []
    for text, extra in zip(found, field_spans(found, field), strict=True):
        base = base_spans(text)
        taken, j = sorted((a, b) for _, a, b in base), 0
        new, reach = [], 0
        for x in extra:  # in order, as texts are
            while j < len(taken) and taken[j][0] < x[2]:
                reach = max(reach, taken[j][1])
                j += 1
            if reach <= x[1]:
                new.append(x)
        out.append((base, sorted(base + new)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], index: dict[str, int], weights: np.ndarray, transitions: np.ndarray) -> Iterator[pa.RecordBatch]:
    field = Field(index, weights, transitions)
    for b in small(batches, most=PART):
        found = all_spans(texts(b, "t"), field)
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
        names = [pa.array([joined(x[i]) for x in found], pa.string()) for i in (0, 1)]
        total = pa.array([len(x) for _, x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, *names, total], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_spans"])


def scan(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (plain ones), base, spans (kind:start:end, comma-joined), n_spans.

    table: labelled sentences, as labelled_table() gives them.
    """
    prepare(docs.sparkSession)
    field = fit(table)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    how = partial(_scan, index=field.index, weights=field.weights, transitions=field.transitions)
    return rows.mapInArrow(how, kind(rows.select("doc_id"), **{f"n_{k}": "long" for k in KINDS}, base="string", spans="string", n_spans="long"))
