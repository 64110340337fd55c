"""Problem 1: personal information inside free text.

Method: a linear-chain conditional random field over word-shape features, trained from a small labelled table and
decoded by Viterbi in numpy batches. The labelled table is a bounded sample of rows whose own spans, completed by
high-precision patterns and the name pool, give a type to each token. A token's emission is a sum of per-word scores of
itself and two neighbours on either side, so a word's features are computed once. Tokens that no path through a
personal type can improve are fixed to O first; this changes no result. A number with its groups is one token, whose
features are the sizes of the groups and what joins them. In the labelled table the digits of phone numbers and the
names of streets are partly exchanged for others, so that the field learns forms and not the values of one table. Every
value comes from a run of tags; what follows only trims it and checks digits, the parts of a name and the marks of an address.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.identifiers import NATIONAL
from corpusloom.functions.wordkit import sliced
from corpusloom.session import hash_sample, spread

TAGS = ("O", "PERSON", "PHONE", "EMAIL", "NATIONAL_ID", "ADDRESS")
REACH = 2
#: Rows of the labelled table, by the hash of their ids; parts of it in turn, and rounds over all.
LABELLED_ROWS = 2_000
PARTS = 24
EPOCHS = 10
#: Share of the labelled names' words that are misspelt, as some names of the texts are.
MISSPELT = 0.15
#: Share of tokens whose neighbours are heeded in a step of the training.
HEED = 0.6
#: Share of the labelled tokens from which on a word is a feature of its own.
FREQUENT = 4e-4
PLACEHOLDERS = {k: f"[{k}]" for k in TAGS[1:]}

# Words that make a name one of an organisation.
ORGANISATIONS = frozenset("kommune tingrett legekontor dyreklinikk barneskole bofellesskap idrettslag tilsynskontor transport regnskap fisk bygg anlegg as".split())
# Legacy types of spans.
LEGACY = {"PERSON": "PERSON", "NO_PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL", "GOV_ID": "NATIONAL_ID", "NO_ADDRESS": "ADDRESS"}

#: Tokens: words, whole numbers (groups of digits joined by spaces, hyphens or points, with a country code before and a letter
#: after them), a written-out at sign in brackets, and single marks; each with the white space before it.
TOKEN = re.compile(r"\s*(?:[^\W\d_]+|(?:\(\+\d{1,3}\)[ \xa0]*|\+)?\d+(?:(?:[ \xa0]{1,2}|[ \xa0]?[\-.][ \xa0]?)\d+)*(?:[^\W\d_](?!\w)|[ \xa0][A-HJ-Z](?![\w.]))?|[\[(]\s?[aA][tT]?\s?[\])]|[^\w\s]|_)")
_AT = r"(?:\s{0,2}[\[(]\s?(?:at|a|AT|A)\s?[\])]\s{0,2}|[ \xa0]{0,2}@[ \xa0]{0,2})"
# Patterns that label the small table; none is asked when values are found.
_EMAIL = re.compile(rf"[\w.+\-]+{_AT}[\w\-]+(?:\.[\w\-]+)+")
_PHONE = re.compile(r"(?<![\w.\-/])(?:(?:\(\+\d\d\)|\+\d\d|00\d\d)[ \xa0]*(?:\d[ \xa0\-]*){6,9}\d|[2-9]\d{7}|[2-9]\d{2}[ \xa0\-]{1,2}\d{2}[ \xa0\-]{1,2}\d{3}|[2-9]\d(?:[ \xa0\-]{1,2}\d{2}){3})(?![\w\-/]|\.\d)")
_ID = re.compile(r"(?<![\d.])\d{2}\.?\d{2}\.?\d{2}[ \xa0\-]{0,2}\d{5}(?!\d)")
_STREET = re.compile(r"(?i)(?<!\w)(?:(?:(?:gamle|nedre|øvre|store|lille)[ \xa0]+)?[^\W\d_]+(?:veien|vegen|gata|gaten|stien|tunet|bakken|svingen|lia|plassen)|[^\W\d_]+s[ \xa0]+(?:vei|veg|gate|plass)|postboks|boks)[ \xa0]+\d+(?:[ \xa0]?-[ \xa0]?\d+|[ \xa0]?[a-zæøå])?(?!\w)")
_CUE = re.compile(r"(?:tlf|telefon|telefonen|mobil|ring|nummer|nummeret)[\W]*(?:gjerne [^\n]{0,20})?$")
_CODE = re.compile(r"\(\+\d{2}\)|\+\d{2}|00\d{2}")
# Endings and whole names of streets that stand in for those of the table.
STREET_ENDS = "alléen allé promenaden torget kroken faret ringen hagen kaia brygga løkka stranda gangen tråkket sletta terrasse haugen porten toppen veien gata vegen".split()
STREET_NAMES = ["Torget", "Bryggen", "Storgata", "Kirkeveien", "Nedre Slottsgate", "Øvre Torggate", "Gamle Bygate", "Store Ringveg", "Haralds gate", "Maries plass", "Karl Johans gate", "Bygdøy allé", "Slottsgate", "Strandkaien", "Gamle Drammensvei", "Jernbanetorget", "Rådhusplassen", "Skippergata", "Prinsens gate"]


def valid_id(digits: str) -> bool:
    """Eleven digits with both check digits and a day and month of the series (month raised by 80, a day perhaps by 40)."""
    if len(digits) != 11 or not digits.isdecimal():
        return False
    d = [int(x) for x in digits]
    day, month = int(digits[:2]), int(digits[2:4])
    if not (1 <= day <= 31 or 41 <= day <= 71) or not (1 <= month <= 12 or 41 <= month <= 52 or 81 <= month <= 92):
        return False
    return all(sum(a * b for a, b in zip(w, d)) % 11 == 0 for w in NATIONAL)


_DIGITS = re.compile(r"\d+")
_AT_SIGN = re.compile(r"@|[\[(]\s?[aA][tT]?\s?[\])]")


def shape(word: str) -> str:
    if _AT_SIGN.fullmatch(word):
        return "@"
    if word[-1].isdigit() or (len(word) > 1 and word[-2].isdigit()):  # sizes of the groups and what joins them
        return _DIGITS.sub(lambda m: str(min(m.end() - m.start(), 12)), word.replace("\xa0", " ").replace("  ", " "))[:24]
    if not word.isalpha():
        return word
    return ("A" if len(word) == 1 else "AA") if word.isupper() else ("Aa" if word[1:].islower() or len(word) == 1 else "AaA") if word[0].isupper() else "a"


def word_features(token: str, lists: tuple = ()) -> list[str]:
    """Shape features of a token with the white space before it, and in which of ``lists`` (first names, last names) it stands."""
    w = token.strip()
    lead = "\n" if "\n" in token[: len(token) - len(w)] else " " if len(w) < len(token) else ""
    low = w.lower()
    s = shape(w)
    if not w.isalpha():
        groups = _DIGITS.findall(w)
        out = ["bias", f"s={s}", f"l={lead!r}", f"ls={lead!r}{s}"]
        if groups:
            code = groups[0] if w[0] in "(+" else groups[0][:4] if groups[0].startswith("00") else ""
            total = sum(map(len, groups)) - (len(code) if code else 0)
            kind = "+" if code else "-" if "-" in w else "." if "." in w else " " if len(groups) > 1 else ""
            out += [f"t={min(total, 16)}", f"tk={min(total, 16)}{kind}", f"c={bool(code)}", f"e={w[-1].isalpha()}", f"g={len(groups)}"]
        return out
    out = ["bias", f"s={s}", f"l={lead!r}", f"ls={lead!r}{s}", f"w={low}"]
    if len(low) > 1:
        out += [f"n={min(len(low), 9)}", f"p2={low[:2]}", f"p3={low[:3]}", f"p4={low[:4]}", f"x2={low[-2:]}", f"x3={low[-3:]}", f"x4={low[-4:]}", f"x5={low[-5:]}", f"g4={low[-5:-1]}", f"sx3={s}{low[-3:]}"]
    if len(low) > 2:
        out += [f"in={k}" for k, names in enumerate(lists) if low in names or (low[-1] == "s" and low[:-1] in names)]
    return out


#: What the emission of each tag gains at decoding: a value missed weighs more than one too many, which checks may drop.
LEAN = (0.0, 1.0, 3.0, 2.0, 5.0, 1.5)
class Crf:
    """Weights of features at five offsets, and of transitions with those from and to the ends."""

    def __init__(self, names: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray, lists: tuple = ()):
        self.lists = lists
        self.index = {f: i for i, f in enumerate(names)}
        self.weights, self.trans, self.start, self.end = weights, trans, start, end
        # the least that staying at O on a token gains over any tag there, whatever stands beside it
        t = trans
        o = t[:, 0][:, None, None] + t[0, :][None, None, :]
        other = t[:, 1:, None] + t[None, 1:, :]
        self.bound = float(min((o - other).min(), (start[0] + t[0][None, :] - start[1:, None] - t[1:]).min(), (t[:, 0][:, None] + end[0] - t[:, 1:] - end[1:][None, :]).min(), (start[0] + end[0] - start[1:] - end[1:]).min()))

    def rows(self, token: str) -> np.ndarray:
        """Scores (offset, tag) that a token adds to itself and its neighbours."""
        i = [self.index[f] for f in word_features(token, self.lists) if f in self.index]
        out = self.weights[i].sum(axis=0)
        out[REACH] += LEAN
        return out


class Rows(dict):
    """token -> number of its score row; digits that features don't tell apart share one."""

    def __init__(self, crf: Crf, limit: int = 250_000):
        super().__init__()
        self.crf, self.limit = crf, limit
        self.list: list[np.ndarray] = [np.zeros((2 * REACH + 1, len(TAGS)))]
        self.table = np.zeros((0, 2 * REACH + 1, len(TAGS)), np.float32)
        self.sizes, self.breaks, self.commas = [0], [False], [False]

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self.list)
        self.list.append(self.crf.rows(token))
        self.sizes.append(len(token))
        self.breaks.append("\n" in token)
        self.commas.append(token == ",")
        return n

    def array(self) -> np.ndarray:
        if len(self.table) < len(self.list):
            self.table = np.concatenate((self.table, np.array(self.list[len(self.table) :], np.float32)))
        return self.table


def emissions(ids: np.ndarray, inside: np.ndarray, table: np.ndarray, heed: np.ndarray | None = None) -> np.ndarray:
    """Emission scores of every token; ``inside`` numbers the sequence of each token, ``heed`` weighs its neighbours' part."""
    out = table[ids, REACH].copy()
    if heed is not None:
        near = emissions(ids, inside, table) - out
        return out + near * heed[:, None]
    for k in range(1, REACH + 1):
        same = (inside[k:] == inside[:-k])[:, None]
        out[k:] += table[ids[:-k], REACH + k] * same  # what the token k before says of this one
        out[:-k] += table[ids[k:], REACH - k] * same
    return out


def decode(e: np.ndarray, inside: np.ndarray, crf: Crf) -> np.ndarray:
    """Best tag of every token by Viterbi over the runs of tokens that are not certainly O."""
    n = len(e)
    tags = np.zeros(n, np.int8)
    live = (e[:, 1:].max(axis=1) - e[:, 0]) >= crf.bound
    if not live.any():
        return tags
    brk = np.ones(n + 1, bool)
    brk[1:n] = (inside[1:] != inside[:-1]) | ~live[1:] | ~live[:-1]
    start = np.flatnonzero(live & brk[:n])
    stop = np.flatnonzero(live & brk[1:]) + 1
    size = stop - start
    first = np.concatenate(([True], inside[1:] != inside[:-1]))
    last = np.concatenate((inside[1:] != inside[:-1], [True]))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        rows = order[at : at + 20_000]
        rows = rows[size[rows] <= max(8, 2 * size[rows[0]])]
        at += len(rows)
        a, m = start[rows], size[rows]
        top = int(m.max())
        score = e[a] + np.where(first[a][:, None], crf.start, crf.trans[0])
        back = np.zeros((len(rows), top, len(TAGS)), np.int8)
        final = np.where(last[a + m - 1][:, None], crf.end, crf.trans[:, 0])
        best = np.zeros(len(rows), np.int64)
        for t in range(top):
            if t:
                on = np.flatnonzero(m > t)
                step = score[on][:, :, None] + crf.trans
                back[on, t] = step.argmax(axis=1)
                score[on] = step.max(axis=1) + e[a[on] + t]
            done = np.flatnonzero(m == t + 1)
            best[done] = (score[done] + final[done]).argmax(axis=1)
        tag = best
        for t in range(top - 1, -1, -1):
            on = np.flatnonzero(m > t)
            tags[a[on] + t] = tag[on]
            tag[on] = back[on, t, tag[on]]
    return tags


# --- training -------------------------------------------------------------------------------------------------


def _mark(tags: np.ndarray, ends: np.ndarray, starts: np.ndarray, a: int, b: int, tag: int) -> None:
    i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    if i < j and not tags[i:j].any():
        tags[i:j] = tag


class NameForms:
    """Known names, and words put together from the beginnings and endings of known names of the same part."""

    def __init__(self, names, least: int = 4):
        self.known = frozenset(names)
        heads, tails = {}, {}
        for w in self.known:
            for k in range(2, len(w) - 1):
                heads[w[:k]] = heads.get(w[:k], 0) + 1
                tails[w[k:]] = tails.get(w[k:], 0) + 1
        self.heads, self.tails = ({x for x, c in d.items() if c >= least} for d in (heads, tails))
        self.cache: dict[str, bool] = {}

    def __contains__(self, w: str) -> bool:
        if w in self.known:
            return True
        if w not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[w] = len(w) > 3 and any(w[:k] in self.heads and w[k:] in self.tails for k in range(2, len(w) - 1))
        return self.cache[w]


def annotate(text: str, spans: dict[str, list[str]], first, last) -> tuple[list[str], np.ndarray]:
    """Tokens of a labelled text and their tags: patterns and the name pool first, then the row's own spans."""
    tokens = TOKEN.findall(text)
    ends = np.cumsum([len(t) for t in tokens]) if tokens else np.zeros(0, np.int64)
    starts = ends - np.array([len(t.strip()) for t in tokens], np.int64) if tokens else ends
    tags = np.zeros(len(tokens), np.int8)
    for m in _EMAIL.finditer(text):
        _mark(tags, ends, starts, m.start(), m.end(), 3)
    for m in _ID.finditer(text):
        if valid_id(re.sub(r"\D", "", m.group())):
            _mark(tags, ends, starts, m.start(), m.end(), 4)
    for m in _STREET.finditer(text):
        _mark(tags, ends, starts, m.start(), m.end(), 5)
    own = [(s, LEGACY[k]) for k, v in spans.items() if k in LEGACY for s in (v or []) if s and len(s) > 4]
    digits = {re.sub(r"\D", "", s) for s, k in own if k == "PHONE"}
    for m in _PHONE.finditer(text):  # in groups, with a country code, of this table's series, told by the row's spans or by a word before it
        told = not m.group().isdigit() or m.group()[0] in "40" or m.group() == text.strip() or re.sub(r"\D", "", m.group()) in digits
        if told or _CUE.search(text[max(0, m.start() - 30) : m.start()].lower()):
            _mark(tags, ends, starts, m.start(), m.end(), 2)
    low = [t.strip().lower() for t in tokens]

    def is_last(w: str) -> bool:
        return w in last or (w.endswith("s") and w[:-1] in last)

    i = 0
    while i < len(low):  # first names (also joined or initials), then last names; or last name, comma, first names
        j = i
        while j < len(low) and (low[j] in first or (low[j] == "-" and j > i) or (j == i and len(low[j]) == 1 and low[j].isalpha() and j + 1 < len(low) and low[j + 1] == ".") or (low[j] == "." and j == i + 1 and len(low[i]) == 1)):
            j += 1
        k = j
        while k < len(low) and k > i and (is_last(low[k]) or (low[k] == "-" and k > j and k + 1 < len(low) and is_last(low[k + 1]))):
            k += 1
        if i < j < k:
            if not tags[i:k].any():
                tags[i:k] = 1
            i = k
        elif low[i] in last and i + 2 < len(low) and low[i + 1] == "," and low[i + 2] in first:
            k = i + 3
            while k < len(low) and (low[k] in first or (low[k] == "-" and k + 1 < len(low) and low[k + 1] in first)) and "\n" not in tokens[k]:
                k += 1
            if not tags[i:k].any():
                tags[i:k] = 1
            i = k
        else:
            i += 1
    for s, kind in own:
        if kind == "PERSON" and len(s.split()) < 2:
            continue
        if kind == "NATIONAL_ID" and not valid_id(re.sub(r"\D", "", s)) or kind == "EMAIL" and not re.search(r"@|at|\(a\)", s) or kind == "ADDRESS" and not re.search(r"\d", s) or kind == "PERSON" and re.search(r"\d", s):
            continue
        if kind == "PERSON" and not any(w in first or w in last for w in re.findall(r"[^\W\d_]+", s.lower())):
            continue
        for m in re.finditer(re.escape(s), text):
            _mark(tags, ends, starts, m.start(), m.end(), TAGS.index(kind))
    return tokens, tags


def exchanged(tokens: list[str], tags: np.ndarray, rng: np.random.Generator, share: float = 0.6) -> list[str]:
    """Tokens with the digits of some phone numbers and the names of some streets exchanged for others, and some names misspelt.

    A phone number in one piece is exchanged only where a word before it tells what it is, as it may look like a date; a street keeps its number of words.
    """
    out = list(tokens)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0]))))
    for a, b in zip(edge[:-1], edge[1:]):
        if tags[a] == 1:
            for k in range(a, b):
                w = out[k].strip()
                if len(w) > 4 and w.isalpha() and rng.random() < MISSPELT:
                    at = len(out[k]) - len(w) + int(rng.integers(1, len(w) - 1))
                    out[k] = out[k][:at] + (out[k][at] * 2 if rng.random() < 0.3 else "") + out[k][at + 1 :]
        if tags[a] not in (2, 5) or rng.random() > share:
            continue
        if tags[a] == 2:
            for k in range(a, b):
                w = out[k].strip()
                m = _CODE.match(w)
                if not w[-1:].isdigit() or (w.isdigit() and not m and a and not _CUE.search("".join(tokens[max(0, a - 4) : a]).lower() + " ")):
                    continue  # eight digits in one piece may be a date
                rest = w[m.end() :] if m else w
                x = iter([str(rng.integers(2, 10)), *map(str, rng.integers(0, 10, len(rest)))])
                code = m.group() if m else ""
                if code[-2:].isdigit() and rng.random() < 0.3:
                    code = code[:-2] + str(rng.choice(["46", "45", "49", "48"]))
                out[k] = out[k][: len(out[k]) - len(w)] + code + "".join(next(x) if c.isdigit() else c for c in rest)
        else:
            words = [k for k in range(a, b) if out[k].strip().isalpha() and len(out[k].strip()) > 1]
            if not words or out[words[0]].strip().lower() in ("postboks", "boks"):
                continue
            if len(words) > 1:
                new = str(rng.choice([x for x in STREET_NAMES if " " in x])).split()
            else:
                old = out[words[0]].strip()
                new = [str(rng.choice([x for x in STREET_NAMES if " " not in x])) if rng.random() < 0.4 else old[: max(3, len(old) - 5)] + str(rng.choice(STREET_ENDS))]
            for k, w in zip(words[-len(new) :] if len(words) >= len(new) else words, new[-len(words) :]):
                old = out[k].strip()
                out[k] = out[k][: len(out[k]) - len(old)] + (w.lower() if old.islower() else w.upper() if old.isupper() else w)
    return out


def lines(tokens: list[str]) -> np.ndarray:
    """Number of the line of each token: a token after a line break begins a new sequence every second line, so that a label
    line and its next stay together."""
    new = np.fromiter(("\n" in t for t in tokens), np.int64, len(tokens))
    return np.cumsum(new)


class _Part:
    """A part of the labelled sequences laid out for forward and backward sums side by side."""

    def __init__(self, rows: list[tuple[list[str], np.ndarray]], index: dict[str, int], lists: tuple):
        L = len(TAGS)
        vocab: dict[str, int] = {}
        ids, seq, y, n = [], [], [], 0
        for tokens, tags in rows:
            ids.append(np.fromiter((vocab.setdefault(t, len(vocab)) for t in tokens), np.int64, len(tokens)))
            ln = _sequences(tokens, tags)
            seq.append(ln + n)
            n += int(ln[-1]) + 1
            y.append(tags)
        self.ids, seq, self.y = np.concatenate(ids), np.concatenate(seq), np.concatenate(y).astype(np.int64)
        self.seq = seq = np.cumsum(np.concatenate(([0], (seq[1:] != seq[:-1]).astype(np.int64))))
        self.size_v = len(vocab)
        feats = [[index[x] for x in word_features(t, lists) if x in index] for t in vocab]
        self.fi = np.array([x for f in feats for x in f])
        self.fv = np.repeat(np.arange(len(vocab)), [len(f) for f in feats])
        self.edge = np.searchsorted(self.fv, np.arange(len(vocab)))
        self.order = np.argsort(self.fi, kind="stable")
        self.used, self.cut = np.unique(self.fi[self.order], return_index=True)
        start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        size = np.diff(np.concatenate((start, [len(seq)])))
        order = np.argsort(-size, kind="stable")
        self.start, self.size = start[order], size[order]
        self.alive = [int((self.size > t).sum()) for t in range(int(self.size.max()))]
        self.gold = np.zeros((len(self.y), L))
        self.gold[np.arange(len(self.y)), self.y] = 1
        same = seq[1:] == seq[:-1]
        self.gold_t = np.zeros((L, L))
        np.add.at(self.gold_t, (self.y[:-1][same], self.y[1:][same]), 1)

    def gradients(self, w, trans, s0, s1, l2: float, rng: np.random.Generator) -> list[np.ndarray]:
        L, start, n = len(TAGS), self.start, len(self.start)
        heed = np.where(rng.random(len(self.ids)) < HEED, 1 / HEED, 0.0)  # some tokens are to be told without their neighbours
        table = np.add.reduceat(w[self.fi], self.edge, axis=0)
        e = emissions(self.ids, self.seq, table, heed)
        b = np.exp(e - e.max(axis=1, keepdims=True))
        et, fwd, scale = np.exp(trans), np.zeros_like(b), np.ones(len(b))
        cur = np.exp(s0)[None, :] * b[start]
        for t, a in enumerate(self.alive):
            if t:
                cur = (cur[:a] @ et) * b[start[:a] + t]
            z = cur.sum(axis=1, keepdims=True)
            cur = cur / z
            fwd[start[:a] + t] = cur
            scale[start[:a] + t] = z[:, 0]
        gt, marg = np.zeros((L, L)), np.zeros_like(b)
        bwd = np.tile(np.exp(s1), (n, 1))
        for t in range(len(self.alive) - 1, -1, -1):
            a = self.alive[t]
            at = start[:a] + t
            p = fwd[at] * bwd[:a]
            p /= p.sum(axis=1, keepdims=True)
            marg[at] = p
            if t:
                x = b[at] * bwd[:a]
                x /= np.maximum(scale[at], 1e-300)[:, None]
                prev = fwd[start[:a] + t - 1]
                pair = prev[:, :, None] * et[None] * x[:, None, :]
                gt += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                bwd[:a] = x @ et.T
        g = marg - self.gold
        near = g * heed[:, None]
        gtab = np.zeros_like(table)
        for k in range(-REACH, REACH + 1):
            if k == 0:
                part, to = g, self.ids
            elif k > 0:
                ok = self.seq[k:] == self.seq[:-k]
                part, to = near[k:][ok], self.ids[:-k][ok]
            else:
                ok = self.seq[-k:] == self.seq[:k]
                part, to = near[:k][ok], self.ids[-k:][ok]
            for tag in range(L):
                gtab[:, REACH + k, tag] += np.bincount(to, part[:, tag], minlength=self.size_v)
        gw = l2 * w
        flat = gtab.reshape(self.size_v, -1)[self.fv[self.order]]
        gw[self.used] += np.add.reduceat(flat, self.cut, axis=0).reshape(-1, *w.shape[1:]) / n
        last = start + self.size - 1
        return [gw, (gt - self.gold_t) / n + l2 * trans, (marg[start] - self.gold[start]).mean(axis=0), (marg[last] - self.gold[last]).mean(axis=0)]


def _sequences(tokens: list[str], tags: np.ndarray) -> np.ndarray:
    """Sequence of each token: lines, cut after sentences, as shorter sequences side by side train faster."""
    cut = np.zeros(len(tokens), np.int64)
    for k in range(2, len(tokens)):
        if tokens[k - 1] in ".!?" and len(tokens[k - 2]) > 3 and tokens[k][0] == " " and not tags[k - 2 : k + 1].any():
            cut[k] = 1
    return lines(tokens) + np.cumsum(cut)


def train(rows: list[tuple[list[str], np.ndarray]], lists: tuple = (), epochs: int = EPOCHS, parts: int = PARTS, l2: float = 1e-6) -> Crf:
    """Maximum likelihood by Adam on parts of the sequences in turn."""
    L, K = len(TAGS), 2 * REACH + 1
    rows = [r for r in rows if r[0]]
    if not rows:
        return Crf(["bias"], np.zeros((1, K, L)), np.zeros((L, L)), np.zeros(L), np.zeros(L))
    often: dict[str, int] = {}
    for tokens, _ in rows:
        for t in tokens:
            often[t] = often.get(t, 0) + 1
    total, counts, heard = sum(often.values()), {}, {}
    for t, k in often.items():
        for x in word_features(t, lists):
            counts[x] = counts.get(x, 0) + 1
            if x.startswith("w="):
                heard[x] = heard.get(x, 0) + k
    # a word counts as itself only if it is frequent; names are to be known by their form
    names = [f for f, c in counts.items() if (heard[f] >= FREQUENT * total if f in heard else c > 2)]
    index = {f: i for i, f in enumerate(names)}
    given = [p for k in range(parts) if (p := rows[k::parts])]
    given = [_Part(p, index, lists) for p in given]
    params = [np.zeros((len(names), K, L)), np.zeros((L, L)), np.zeros(L), np.zeros(L)]
    params[1][0, 1:] -= 1
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps, step, rng = epochs * len(given), 0, np.random.default_rng(5)
    for _ in range(epochs):
        for part in given:
            step += 1
            rate = 0.15 if step < steps * 0.5 else 0.06 if step < steps * 0.8 else 0.02
            for p, d, a1, a2 in zip(params, part.gradients(*params, l2, rng), m1, m2):
                a1 *= 0.9
                a1 += 0.1 * d
                a2 *= 0.99
                a2 += 0.01 * d * d
                p -= rate * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-6)
    return Crf(names, *params, lists)


def labelled_table(df: DataFrame, id_col: str, text_col: str, output_col: str, first: NameForms, last: NameForms, rows: int = LABELLED_ROWS) -> list[tuple[list[str], np.ndarray]]:
    """The labelled table: about ``rows`` rows by the hash of their id, each tokenised and tagged; their bare spans follow as
    texts of their own."""
    t = df.select(F.col(text_col).alias("text"), F.col(output_col).alias("output"), F.col(id_col).alias("id"))
    out, rng = [], np.random.default_rng(7)

    def add(text: str, spans: dict[str, list[str]]) -> None:
        tokens, tags = annotate(text, spans, first, last)
        given = [(x, y) for t, y in zip(exchanged(tokens, tags, rng), tags.tolist()) for x in TOKEN.findall(t)]
        out.append(([x for x, _ in given], np.array([y for _, y in given], np.int8)))

    for r in hash_sample(t, "id", rows).where(F.length("text").between(50, 15_000)).orderBy("id").collect():  # about ``rows`` at most
        spans = {k: [s for s in (v or []) if s] for k, v in (r["output"] or {}).items()}
        add(r["text"], spans)
        for k, v in spans.items():  # names also in lower case, in which some are written
            for s in v:
                for x in (s, s.lower()) if k == "PERSON" else (s,):
                    add(x, {})
    return out


# --- finding --------------------------------------------------------------------------------------------------

_AFTER = re.compile(r"[ \xa0]+(?=[^\W\d_]+(?:[ \xa0]|$))(?=[a-zæøå])")
_PARTS = re.compile(r"\s*[;*|<>(){}=/]\s*")
_AT_MARK = re.compile(r"\w\s*(?:@|[\[(]\s?(?:at|a)\s?[\])])\s*\w", re.I)
_GENITIVE = re.compile(r"(?:['’]s?|['’])$")


_STOP = re.compile(r"(?<=[^\W\d_]{2})[.!?:]\s+")


def bounds(kind: str, text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Bounds of what the field found at [a, b) at whole words: names may be cut at sentence ends, addresses of mail reach to the
    ends of their unbroken parts."""
    while a < b and text[a].isspace():
        a += 1
    if kind == "PERSON":
        while a > 0 and (text[a - 1].isalpha() or (text[a - 1] == "-" and a > 1 and text[a - 2].isalpha())):
            a -= 1
        while b < len(text) and (text[b].isalpha() or (text[b] == "-" and b + 1 < len(text) and text[b + 1].isalpha())):
            b += 1
        parts, at = [], a  # a point after a word ends a sentence, one after an initial doesn't
        for m in _STOP.finditer(text, a, b):
            parts.append((at, m.start()))
            at = m.end()
        return [*parts, (at, b)]
    if kind == "EMAIL":
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in "_-" or (text[b] == "." and b + 1 < len(text) and text[b + 1].isalnum())):
            b += 1
    if kind == "PHONE" and a > 0 and text[a - 1] == "(" and ")" in text[a:b]:
        a -= 1
    if kind == "ADDRESS" and (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()):
        return []  # inside a longer word
    return [(a, b)]


def name_endings(last: frozenset[str]) -> frozenset[str]:
    """Endings (three or four letters) of known last names that end in s: their s is no genitive."""
    return frozenset(x[-n:] for x in last if x.endswith("s") for n in (3, 4))


def tidy(kind: str, span: str, endings: frozenset[str], after: str) -> str | None:
    """The value exactly as written, without what does not belong to it; None if it fails the exact check of its kind."""
    s = span.strip()
    if kind == "NATIONAL_ID":
        s = re.sub(r"\s*[^\W\d_]$", "", s.strip(" \xa0.,;:-/()"))
        return s if valid_id(re.sub(r"[.\s\-]", "", s)) else None
    if kind == "PHONE":
        s = re.sub(r"\s*[^\W\d_]$", "", s.strip(" \xa0.,;:-/"))
        if s.startswith("(") and ")" not in s:
            s = s[1:]
        if s.endswith(")") and "(" not in s:
            s = s[:-1]
        d = re.sub(r"\D", "", s)
        if re.search(r"[^\d\s\-.()+/]", s):
            return None
        return s if (10 <= len(d) <= 15 if s[:1] in "(+" or d[:2] == "00" else len(d) == 8) else None
    if kind == "EMAIL":
        m = _AT_MARK.search(s)
        if not m:
            return None
        local, domain = re.search(r"[\w.+\-]*$", s[: m.start() + 1]).group(), re.match(r"[\w.\-]*", s[m.end() - 1 :]).group()
        s = (local + m.group()[1:-1] + domain).strip(".-")
        return s if "." in domain.strip(".-") else None
    if kind == "ADDRESS":
        s = s.strip(" \xa0.,;:()-")
        return s if s[:1].isalpha() and re.search(r"\d", s) and re.search(r"[^\W\d_]{3}", s) and "\n" not in s else None
    s = s.strip(" \xa0.,;:-–<>()[]\"'«»/")
    s = re.sub(r"^[^\W\d_][ \xa0]+(?=[^\W\d_]{2})", "", s)  # a preposition of one letter; an initial has its point
    if re.search(r"[\d@:\n_+]|[^\W\d_]{2}\.|\.[^\W\d_]{2}", s) or after[:1] in "@+_" and after:
        return None
    s = max(_PARTS.split(s), key=len)
    if s[:1].isupper():  # a preposition after the name
        s = _AFTER.split(s)[0].strip(" ,")
    s = _GENITIVE.sub("", s)
    low = s.lower()
    if "," not in s and low.endswith("s") and low[-3:] not in endings and low[-4:] not in endings and after[:1] != ",":
        s = s[:-1]
    parts = [p for p in re.findall(r"[^\W\d_]+", s) if len(p) > 1]
    if any(p.lower() in ORGANISATIONS for p in parts):
        return None
    one_case = all(p[0].isupper() for p in parts) or all(p.islower() for p in parts)
    words = re.split(r"[ \xa0]+", s)
    return s if parts and len(words) >= 2 and one_case and any(len(p) > 2 for p in parts) else None


def _find(crf: Crf, endings: frozenset[str]):
    """A function of texts -> list of (kind, start, end, value) for each text."""
    rows = Rows(crf)

    def run(texts: list[str]) -> list[list[tuple[str, int, int, str]]]:
        nonlocal rows
        if len(rows.list) > rows.limit:
            rows = Rows(crf)
        each = [TOKEN.findall(t) for t in texts]
        lens = np.fromiter(map(len, each), np.int64, len(each))
        out: list[list] = [[] for _ in texts]
        n = int(lens.sum())
        if not n:
            return out
        flat = list(chain.from_iterable(each))
        ids = np.fromiter(map(rows.__getitem__, flat), np.int64, n)
        size = np.array(rows.sizes)[ids]
        doc = np.repeat(np.arange(len(texts)), lens)
        new = np.array(rows.breaks)[ids]
        new[0] = True
        new[1:] |= doc[1:] != doc[:-1]
        inside = np.cumsum(new)
        tags = decode(emissions(ids, inside, rows.array()), inside, crf)
        comma = np.array(rows.commas)[ids]
        k = np.flatnonzero(comma[1:-1] & (tags[:-2] == 1) & (tags[2:] == 1) & ~new[2:]) + 1 if n > 2 else np.empty(0, np.int64)
        k = k[(tags[np.maximum(k - 2, 0)] != 1) | np.fromiter((flat[max(i - 2, 0)] == "-" for i in k), bool, len(k)) | new[k - 1]]
        tags[k] = 1  # last name, comma, first names
        begin = np.cumsum(size) - size
        begin -= np.repeat(begin[np.minimum(np.cumsum(lens) - lens, n - 1)], lens)
        hit = tags > 0
        a = np.flatnonzero(hit & np.concatenate(([True], (tags[1:] != tags[:-1]) | new[1:])))
        b = np.flatnonzero(hit & np.concatenate(((tags[1:] != tags[:-1]) | new[1:], [True])))
        for i, j in zip(a.tolist(), b.tolist()):
            d = int(doc[i])
            t = texts[d]
            p, q = int(begin[i]), int(begin[j] + size[j])
            kind = TAGS[tags[i]]
            for p, q in bounds(kind, t, p, q):
                value = tidy(kind, t[p:q], endings, t[q : q + 2])
                if value:
                    p = t.index(value, p)
                    if not out[d] or out[d][-1][:3] != (kind, p, p + len(value)):
                        out[d].append((kind, p, p + len(value), value))
        return out

    return run


_TRAINED: dict[int, Crf] = {}


def model(df: DataFrame, names: DataFrame, id_col: str, text_col: str, output_col: str, rows: int = LABELLED_ROWS) -> tuple[Crf, frozenset[str]]:
    pool = names.where("name is not null").select(F.lower("name").alias("n"), "name_part").collect()  # a small fixed table
    first, last = (NameForms(r["n"] for r in pool if r["name_part"] == part) for part in ("first", "last"))
    table = labelled_table(df, id_col, text_col, output_col, first, last, rows)
    key = xxhash.xxh3_64_intdigest(repr([(tokens, tags.tolist()) for tokens, tags in table]))
    if key not in _TRAINED:  # queries over one table share its field
        first.cache, last.cache = {}, {}
        _TRAINED.clear()
        _TRAINED[key] = train(table, (first, last))
        first.cache, last.cache = {}, {}
    return _TRAINED[key], name_endings(last.known)


def _entries(df: DataFrame, id_col: str, text_col: str, output_col: str) -> DataFrame:
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.map_entries(output_col).alias("spans")))


def find_personal(df: DataFrame, names: DataFrame, id_col: str, text_col: str, output_col: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """(id, field, kind, span): each distinct personal value of each row, as written, in its text and in the spans of its map.

    A null, empty or blank text or map has none; null lists and spans are skipped. Rows with equal ids are each searched.
    """
    crf, endings = model(df, names, id_col, text_col, output_col, rows)

    def run(batches):
        find = _find(crf, endings)
        for pdf in sliced(batches):
            ids, fields, kinds, values = [], [], [], []
            of_text = find([t or "" for t in pdf["text"]])
            bare, owner = [], []
            for k, entries in enumerate(pdf["spans"]):
                for e in entries if entries is not None else ():
                    for s in e["value"] if e["value"] is not None else ():
                        if s:
                            bare.append(s)
                            owner.append(k)
            kept = list(dict.fromkeys(bare))
            at = dict(zip(kept, find(kept)))
            id_list = pdf["id"].tolist()
            for k, found in enumerate(of_text):
                for kind, value in dict.fromkeys((x[0], x[3]) for x in found):
                    ids.append(id_list[k])
                    fields.append("text_input")
                    kinds.append(kind)
                    values.append(value)
            seen = set()
            for k, s in zip(owner, bare):
                for kind, _, _, value in at[s]:
                    if (k, kind, value) not in seen:
                        seen.add((k, kind, value))
                        ids.append(id_list[k])
                        fields.append("output")
                        kinds.append(kind)
                        values.append(value)
            if ids:
                yield pd.DataFrame({"id": ids, "field": fields, "kind": kinds, "span": values})

    return _entries(df, id_col, text_col, output_col).mapInPandas(run, "id long, field string, kind string, span string")


def _replace(text: str, found: list[tuple[str, int, int, str]], others: dict[str, str]) -> str:
    """Found places, and other places of the same values as whole words, replaced by placeholders."""
    out, last = [], 0
    for kind, a, b, _ in sorted(found, key=lambda x: x[1]):
        if a >= last:
            out += [text[last:a], PLACEHOLDERS[kind]]
            last = b
    text = "".join([*out, text[last:]])
    for v, kind in others.items():
        if v in text:
            text = re.sub(rf"(?<![^\W_]){re.escape(v)}(?![^\W_])", PLACEHOLDERS[kind], text)
    return text


def redact(df: DataFrame, names: DataFrame, id_col: str, text_col: str, output_col: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """(id, text, output): both fields with each personal value replaced by a placeholder of its type, the rest unchanged.

    Nulls and empty texts, maps, lists and spans stay as they are.
    """
    crf, endings = model(df, names, id_col, text_col, output_col, rows)

    def run(batches):
        find = _find(crf, endings)
        for whole in batches:
            for b in (whole.slice(k, 2_000) for k in range(0, whole.num_rows, 2_000)):
                texts, maps = b.column(1).to_pylist(), b.column(2).to_pylist()
                of_text = find([t or "" for t in texts])
                bare = list(dict.fromkeys(s for m in maps for _, v in m or () for s in v or () if s))
                of_span = dict(zip(bare, find(bare)))
                for k, (found, m) in enumerate(zip(of_text, maps)):
                    known = {x[3]: x[0] for x in found}
                    texts[k] = _replace(texts[k], found, known) if texts[k] else texts[k]
                    if m is not None:
                        maps[k] = [(key, None if v is None else [_replace(s, of_span[s], known) if s else s for s in v]) for key, v in m]
                kind = pa.map_(pa.string(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(maps, kind)], ["id", "text", "output"])

    t = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(output_col).alias("output"))
    return spread(t).mapInArrow(run, "id long, text string, output map<string, array<string>>")
