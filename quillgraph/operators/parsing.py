"""A trained tagger and dependency parser, and subject-verb-object triples over the heads that they give.

The tagger is a structured perceptron over words, endings, neighbours and the tag before, decoded by Viterbi. The parser
is arc-eager: linear in the words, one perceptron choosing among shift, reduce and the two arcs. Both are averaged and trained on
SENTENCES, a small hand-made table of English; other languages get what word forms alone tell. Models are a few thousand
weights: they are trained on the driver and broadcast, and phrases are read in Arrow batches. Everything behind the heads is
array functions.

Defined cases: null and empty phrases have no words; a word that nothing takes as its dependent hangs on the root (head 0);
repeated words are words of their own; very long phrases take time in proportion to their words.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tagging

#: word/tag/head, heads counted from 1, 0 for the root. For training and for the cross-validation in the tests.
SENTENCES = """
the/DT/2 cat/NN/3 sat/VBD/0 on/IN/3 the/DT/6 mat/NN/4
dogs/NNS/2 chase/VBP/0 cats/NNS/2
a/DT/3 small/JJ/3 dog/NN/4 chased/VBD/0 the/DT/7 black/JJ/7 cat/NN/4
she/PRP/2 reads/VBZ/0 long/JJ/4 books/NNS/2
he/PRP/2 wrote/VBD/0 a/DT/4 letter/NN/2 to/TO/2 his/PRP$/7 mother/NN/5
Paris/NNP/2 is/VBZ/0 the/DT/4 capital/NN/2 of/IN/4 France/NNP/5
John/NNP/2 works/VBZ/0 in/IN/2 London/NNP/3
the/DT/2 company/NN/3 builds/VBZ/0 electric/JJ/5 cars/NNS/3 in/IN/3 Germany/NNP/6
birds/NNS/3 can/MD/3 fly/VB/0 quickly/RB/3
the/DT/2 river/NN/3 flows/VBZ/0 through/IN/3 the/DT/7 old/JJ/7 city/NN/4
scientists/NNS/3 have/VBP/3 discovered/VBN/0 a/DT/6 new/JJ/6 planet/NN/3
Mary/NNP/2 gave/VBD/0 the/DT/4 boy/NN/2 an/DT/6 apple/NN/2
the/DT/2 president/NN/4 will/MD/4 visit/VB/0 China/NNP/4 in/IN/4 May/NNP/6
many/JJ/2 people/NNS/3 like/VBP/0 sweet/JJ/5 music/NN/3
the/DT/2 house/NN/5 was/VBD/5 recently/RB/5 sold/VBN/0 by/IN/5 the/DT/8 owner/NN/6
water/NN/2 contains/VBZ/0 hydrogen/NN/2 and/CC/3 oxygen/NN/3
we/PRP/2 visited/VBD/0 the/DT/5 national/JJ/5 museum/NN/2
farmers/NNS/2 grow/VBP/0 wheat/NN/2 near/IN/2 the/DT/6 village/NN/4
the/DT/3 tall/JJ/3 man/NN/4 opened/VBD/0 the/DT/6 door/NN/4 slowly/RB/4
children/NNS/3 are/VBP/3 playing/VBG/0 in/IN/3 the/DT/6 park/NN/4
Rome/NNP/2 lies/VBZ/0 on/IN/2 the/DT/5 Tiber/NNP/3
the/DT/2 engine/NN/3 uses/VBZ/0 less/JJR/5 fuel/NN/3
her/PRP$/2 brother/NN/3 plays/VBZ/0 the/DT/5 piano/NN/3 very/RB/7 well/RB/3
two/CD/2 students/NNS/3 solved/VBD/0 the/DT/6 hard/JJ/6 problem/NN/3
Amazon/NNP/2 bought/VBD/0 the/DT/4 company/NN/2 for/IN/2 ten/CD/7 dollars/NNS/5
it/PRP/3 is/VBZ/3 raining/VBG/0 in/IN/3 Berlin/NNP/4
the/DT/2 book/NN/6 on/IN/2 the/DT/5 table/NN/3 belongs/VBZ/0 to/TO/6 Anna/NNP/7
bees/NNS/2 make/VBP/0 honey/NN/2 from/IN/2 flowers/NNS/4
the/DT/2 teacher/NN/4 has/VBZ/4 explained/VBN/0 the/DT/6 rule/NN/4 clearly/RB/4
big/JJ/2 ships/NNS/3 carry/VBP/0 heavy/JJ/5 goods/NNS/3 across/IN/3 the/DT/8 ocean/NN/6
Einstein/NNP/2 developed/VBD/0 the/DT/4 theory/NN/2 of/IN/4 relativity/NN/5
they/PRP/3 should/MD/3 leave/VB/0 the/DT/5 room/NN/3
the/DT/2 sun/NN/3 heats/VBZ/0 the/DT/5 earth/NN/3
a/DT/2 doctor/NN/3 treats/VBZ/0 sick/JJ/5 people/NNS/3 in/IN/3 hospitals/NNS/6
the/DT/3 famous/JJ/3 writer/NN/6 from/IN/3 Spain/NNP/4 won/VBD/0 a/DT/8 prize/NN/6
our/PRP$/2 team/NN/4 never/RB/4 lost/VBD/0 a/DT/6 game/NN/4
trains/NNS/2 connect/VBP/0 large/JJ/4 cities/NNS/2
the/DT/2 bank/NN/3 lends/VBZ/0 money/NN/3 to/TO/3 small/JJ/7 firms/NNS/5
I/PRP/2 saw/VBD/0 a/DT/4 bird/NN/2 with/IN/4 red/JJ/7 wings/NNS/5
Microsoft/NNP/2 released/VBD/0 new/JJ/4 software/NN/2
the/DT/3 old/JJ/3 bridge/NN/5 was/VBD/5 destroyed/VBN/0 in/IN/5 the/DT/8 war/NN/6
plants/NNS/2 need/VBP/0 light/NN/2 and/CC/3 water/NN/3
he/PRP/3 often/RB/3 drinks/VBZ/0 strong/JJ/5 coffee/NN/3
the/DT/2 city/NN/3 has/VBZ/0 beautiful/JJ/5 gardens/NNS/3
workers/NNS/3 were/VBD/3 repairing/VBG/0 the/DT/5 road/NN/3
Tom/NNP/4 and/CC/1 Ann/NNP/1 live/VBP/0 near/IN/4 the/DT/7 sea/NN/5
the/DT/2 government/NN/3 raised/VBD/0 taxes/NNS/3 on/IN/4 imported/VBN/7 cars/NNS/5
this/DT/2 machine/NN/3 produces/VBZ/0 clean/JJ/5 energy/NN/3
wild/JJ/2 horses/NNS/3 run/VBP/0 over/IN/3 green/JJ/6 hills/NNS/4
the/DT/2 committee/NN/4 will/MD/4 discuss/VB/0 the/DT/7 annual/JJ/7 report/NN/4 tomorrow/NN/4
"""
WORD = re.compile(r"[^\W_]+")
NOMINAL = [*tagging.NOUNS, "PRP"]
#: Tags of words before a noun that belong to its name.
WITHIN = ["JJ", "JJR", "JJS", "CD", "VBN", "VBG", *tagging.NOUNS]
#: Phrases of one pass of the tagger.
AT_ONCE = 256
MOVES = SHIFT, REDUCE, LEFT, RIGHT = tuple(range(4))

Sentence = list[tuple[str, str, int]]


def sentences(text: str = SENTENCES) -> list[Sentence]:
    return [[(w, t, int(h)) for w, t, h in (token.split("/") for token in line.split())] for line in text.strip().split("\n")]


class Averaged:
    """Weights by (feature, label), and the mean of all states they have had."""

    def __init__(self) -> None:
        self.now: dict[tuple, float] = defaultdict(float)
        self.sums: dict[tuple, float] = defaultdict(float)
        self.since: dict[tuple, int] = defaultdict(int)
        self.steps = 0

    def add(self, features: list[str], label, amount: float) -> None:
        for f in features:
            key = (f, label)
            self.sums[key] += (self.steps - self.since[key]) * self.now[key]
            self.since[key] = self.steps
            self.now[key] += amount

    def mean(self) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for (f, label), w in self.now.items():
            total = self.sums[f, label] + (self.steps - self.since[f, label]) * w
            if total:
                out.setdefault(f, {})[label] = total / max(1, self.steps)
        return out

    def current(self) -> dict[str, dict]:
        out: dict[str, dict] = defaultdict(dict)
        for (f, label), w in self.now.items():
            out[f][label] = w
        return out


#: The word-list tagger's closed classes, as what the trained one sees of a word and its neighbours.
CLOSED = {w: t for t, own in tagging.LEXICON.items() for w in reversed(own.split())}


def kind_of(low: str) -> str:
    return CLOSED.get(low) or ("s" if low[-1:] == "s" else "ed" if low.endswith("ed") else "ly" if low.endswith("ly") else "o")


def word_features(words: list[str]) -> list[list[str]]:
    """What the tagger sees of each word without other tags."""
    lows = ["^", *(w.lower() for w in words), "$"]
    kinds = ["-", "-", *map(kind_of, lows[1:-1]), "-"]
    out = []
    for i, w in enumerate(words):
        before, low, after = lows[i : i + 3]
        k2, k1, k0, k3 = kinds[i : i + 4]
        shape = "digit" if w[0].isdigit() else "upper" if w[0].isupper() and i else "first" if w[0].isupper() else "lower"
        own = ["b", f"w={low}", f"1={low[-1:]}", f"2={low[-2:]}", f"3={low[-3:]}", f"p={before}", f"n={after}", f"n2={after[-2:]}", f"s={shape}", f"s={shape} p={before}"]
        out.append([*own, f"k={k0}", f"kp={k1}", f"kn={k3}", f"kk={k1}|{k0}", f"kkk={k1}|{k0}|{k3}", f"k2={k2}|{k1}|{k0}", f"ks={k0}|{shape}"])
    return out


def scored(weights: dict[str, dict], features: list[str], labels: list) -> list[float]:
    out = dict.fromkeys(labels, 0.0)
    for f in features:
        for label, w in weights.get(f, {}).items():
            out[label] += w
    return [out[label] for label in labels]


class Tables:
    """A tagger's weights as vectors over the tags: one for each feature, and the step from tag to tag."""

    def __init__(self, weights: dict[str, dict], tags: list[str]) -> None:
        self.tags = tags
        self.of = {f: np.array([own.get(t, 0.0) for t in tags]) for f, own in weights.items()}
        none = np.zeros(len(tags))
        self.step = np.stack([self.of.get(f"t={t}", none) for t in tags])
        self.first = self.of.get("t=^", none)

    def path(self, words: list[str]) -> list[str]:
        """The best path of tags, by Viterbi; the first of equals."""
        if not words:
            return []
        marks = np.zeros((len(words), len(self.tags)))
        for row, features in zip(marks, word_features(words), strict=True):
            for f in features:
                if f in self.of:
                    row += self.of[f]
        best, back = marks[0] + self.first, []
        for own in marks[1:]:
            every = best[:, None] + self.step
            came = every.argmax(0)
            best = every[came, np.arange(len(best))] + own
            back.append(came)
        at = int(best.argmax())
        found = [at]
        for came in reversed(back):
            at = int(came[at])
            found.append(at)
        return [self.tags[k] for k in reversed(found)]


class Reader:
    """The tagger and the parser over many phrases at a time, with the results of path() and attach() to the last bit.

    What the tagger sees of a word is added up feature by feature in word_features()'s order, for all words at once; Viterbi goes from place to place through all
    phrases. The parser's scores rest on a state's tags and on those of its two words that the weights know, so equal states are scored once.
    Both memories are emptied when they are full.
    """

    MOST = 100_000
    SHAPES = ("digit", "upper", "first", "lower")

    def __init__(self, tagger: Tables, parser: dict[str, dict]) -> None:
        self.tagger, self.parser = tagger, parser
        self.kinds = sorted({"-", "s", "ed", "ly", "o", *CLOSED.values()})
        self.kind_at = {k: i for i, k in enumerate(self.kinds)}
        self.rows: list[np.ndarray] = [np.zeros(len(tagger.tags))]
        self.row_of: dict[tuple[str, ...], int] = {}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.marks: dict[tuple, list[float]] = {}
        self.spelled = {f.split("=", 1)[1].split("|")[0] for f in parser if f.startswith(("sw=", "bw=", "swb="))} | {f.split("|", 1)[1] for f in parser if f.startswith("sbw=")}
        k = self.kinds
        self.by_kind = [
            self._table([f"k={a}" for a in k]), self._table([f"kp={a}" for a in k]), self._table([f"kn={a}" for a in k]), self._table([f"kk={a}|{b}" for a in k for b in k]),
            self._table([f"kkk={a}|{b}|{c}" for a in k for b in k for c in k]), self._table([f"k2={a}|{b}|{c}" for a in k for b in k for c in k]), self._table([f"ks={a}|{b}" for a in k for b in self.SHAPES]),
        ]
        self.by_shape = self._table([f"s={a}" for a in self.SHAPES])

    def _table(self, features: list[str]) -> np.ndarray:
        return np.stack([self.tagger.of.get(f, self.rows[0]) for f in features])

    def _row(self, *features: str) -> int:
        """The place of the sum of these features, in order."""
        known = tuple(f for f in features if f in self.tagger.of)
        if not known:
            return 0
        if known not in self.row_of:
            total = np.zeros(len(self.tagger.tags))
            for f in known:
                total += self.tagger.of[f]
            self.row_of[known] = len(self.rows)
            self.rows.append(total)
        return self.row_of[known]

    def _word(self, low: str) -> tuple[int, ...]:
        if low not in self.seen:
            kind = self.kind_at["-" if low in "^$" else kind_of(low)]
            own = self._row("b", f"w={low}", f"1={low[-1:]}", f"2={low[-2:]}", f"3={low[-3:]}")
            self.seen[low] = (own, self._row(f"p={low}"), self._row(f"n={low}"), self._row(f"n2={low[-2:]}"), kind, *[self._row(f"s={x} p={low}") for x in self.SHAPES])
        return self.seen[low]

    def tags(self, phrases: list[list[str]]) -> list[list[int]]:
        """The tags of each phrase by their places in the tagger's list."""
        out: list[list[int]] = [[] for _ in phrases]
        order = sorted((i for i, words in enumerate(phrases) if words), key=lambda i: -len(phrases[i]))
        if len(self.seen) > self.MOST:
            self.seen.clear()
        if not order:
            return out
        word, lows, shapes, starts, edge = self._word, [], [], [], (self._word("^"), self._word("$"))
        for i in order:
            lows.append(edge[0])
            starts.append(len(lows))
            for j, w in enumerate(phrases[i]):
                lows.append(word(w.lower()))
                shapes.append(0 if w[0].isdigit() else (1 if j else 2) if w[0].isupper() else 3)
            lows.append(edge[1])
        table, rows = np.array(lows), np.stack(self.rows)
        lengths, starts = np.array([len(phrases[i]) for i in order]), np.array(starts)
        first = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(starts - first, lengths)
        shape, kind, n = np.array(shapes), table[:, 4], len(self.kinds)
        k1, k0, k3 = kind[at - 1], kind[at], kind[at + 1]
        k2 = kind[np.maximum(at - 2, 0)]
        k2[first] = self.kind_at["-"]
        marks = rows[table[at, 0]]
        for own in (rows[table[at - 1, 1]], rows[table[at + 1, 2]], rows[table[at + 1, 3]], self.by_shape[shape], rows[table[at - 1, 5 + shape]]):
            marks += own
        by = (k0, k1, k3, k1 * n + k0, (k1 * n + k0) * n + k3, (k2 * n + k1) * n + k0, k0 * len(self.SHAPES) + shape)
        for own, places in zip(self.by_kind, by, strict=True):
            marks += own[places]
        best, back, step = marks[first] + self.tagger.first, [], self.tagger.step.T
        ends: list[np.ndarray] = [np.zeros(0)] * len(order)
        for place in range(1, int(lengths[0]) + 1):
            alive = int(np.searchsorted(-lengths, -place))  # longer ones stand first
            for i in range(alive, len(best)):
                ends[i] = best[i]
            if not alive:
                break
            every = best[:alive, None, :] + step
            came = every.argmax(2)
            best = np.take_along_axis(every, came[:, :, None], 2)[:, :, 0] + marks[first[:alive] + place]
            back.append(came.tolist())
        for i, k in enumerate(order):
            t = int(ends[i].argmax())
            found = [t]
            for place in range(int(lengths[i]) - 2, -1, -1):
                t = back[place][i][t]
                found.append(t)
            out[k] = found[::-1]
        return out

    def heads(self, words: list[str], tags: list[str]) -> list[int]:
        n, spelled, memory = len(words), self.spelled, self.marks
        known = ["-", *[w if (w := x.lower()) in spelled else None for x in words], "-", "-", "-"]
        ahead = ["ROOT", *tags, "-", "-", "-"]
        stack, at, heads, kids = [0], 1, [-1] * (n + 2), {}
        while at <= n:
            able = moves(stack, at, n, heads)
            if len(able) == 1:
                at = apply(able[0], stack, at, heads, kids)
                continue
            s, s1 = stack[-1], stack[-2] if len(stack) > 1 else -1
            own, next_ = kids.get(s, ()), kids.get(at)
            left, right = (ahead[own[0]] if own and own[0] < s else "-"), (ahead[own[-1]] if own and own[-1] > s else "-")
            key = (ahead[s], s > 0 and heads[s] >= 0, ahead[at], ahead[at + 1], ahead[at + 2], ahead[s1] if s1 >= 0 else "-", known[s], known[at], left, right, min(at - s, 4), ahead[next_[0]] if next_ else "-")
            marks = memory.get(key)
            if marks is None:
                if len(memory) > self.MOST * 5:
                    memory.clear()
                marks = memory[key] = scored(self.parser, state_features(words, tags, stack, at, heads, kids), MOVES)
            at = apply(max(able, key=marks.__getitem__), stack, at, heads, kids)
        return [max(h, 0) for h in heads[1 : n + 1]]


def state_features(words: list[str], tags: list[str], stack: list[int], at: int, heads: list[int], kids: dict[int, list[int]]) -> list[str]:
    """What the parser sees: the stack's top, what is ahead, and what hangs on the top already."""
    tag = lambda i: "ROOT" if i == 0 else tags[i - 1] if 0 < i <= len(tags) else "-"
    word = lambda i: words[i - 1].lower() if 0 < i <= len(words) else "-"
    s, s1 = stack[-1] if stack else -1, stack[-2] if len(stack) > 1 else -1
    a, b, c, d = tag(s), tag(at), tag(at + 1), tag(at + 2)
    has = "h" if s > 0 and heads[s] >= 0 else "n"
    own = kids.get(s, ())
    left, right = (tag(own[0]) if own and own[0] < s else "-"), (tag(own[-1]) if own and own[-1] > s else "-")
    near = min(at - s, 4) if s >= 0 else 0
    return ["b", f"s={a}{has}", f"b={b}", f"sb={a}{has}|{b}", f"sbc={a}{has}|{b}|{c}", f"bcd={b}|{c}|{d}", f"s1sb={tag(s1)}|{a}|{b}", f"sw={word(s)}", f"bw={word(at)}", f"swb={word(s)}|{b}", f"sbw={a}|{word(at)}", f"k={a}|{left}|{right}|{b}", f"d={a}|{b}|{near}", f"kb={a}|{b}|{tag(kids[at][0]) if kids.get(at) else '-'}"]


def moves(stack: list[int], at: int, n: int, heads: list[int]) -> list[int]:
    """Those allowed."""
    out = [SHIFT] if at <= n else []
    if stack and stack[-1] > 0:
        if heads[stack[-1]] >= 0:
            out.append(REDUCE)
        elif at <= n:
            out.append(LEFT)
    if stack and at <= n:
        out.append(RIGHT)
    return out


def apply(move: int, stack: list[int], at: int, heads: list[int], kids: dict[int, list[int]]) -> int:
    """Changes the state; gives the next word ahead."""
    if move == LEFT:
        s = stack.pop()
        heads[s] = at
        kids.setdefault(at, []).insert(0, s)
        return at
    if move == REDUCE:
        stack.pop()
        return at
    if move == RIGHT:
        heads[at] = stack[-1]
        kids.setdefault(stack[-1], []).append(at)
    stack.append(at)
    return at + 1


def right_move(gold: list[int], stack: list[int], at: int, heads: list[int]) -> int:
    """The move that leads to the given tree."""
    s = stack[-1] if stack else -1
    if s > 0 and gold[s] == at and heads[s] < 0:
        return LEFT
    if s >= 0 and gold[at] == s:
        return RIGHT
    if s > 0 and heads[s] >= 0 and any(gold[k] == at or gold[at] == k for k in stack[:-1]):
        return REDUCE
    return SHIFT


def attach(weights: dict[str, dict], words: list[str], tags: list[str]) -> list[int]:
    """The head of each word."""
    n = len(words)
    stack, at, heads, kids = [0], 1, [-1] * (n + 2), {}
    while at <= n:
        able = moves(stack, at, n, heads)
        marks = scored(weights, state_features(words, tags, stack, at, heads, kids), MOVES) if len(able) > 1 else None
        at = apply(max(able, key=marks.__getitem__) if marks else able[0], stack, at, heads, kids)
    return [max(h, 0) for h in heads[1 : n + 1]]


@dataclass(frozen=True)
class Model:
    tagger: Tables
    parser: dict[str, dict]

    def tag(self, words: list[str]) -> list[str]:
        return self.tagger.path(words)

    def heads(self, words: list[str], tags: list[str]) -> list[int]:
        return attach(self.parser, words, tags)


def train(own: list[Sentence] | None = None, rounds: int = 10, seed: int = 5) -> Model:
    """Both models from sentences."""
    own = sentences() if own is None else own
    rng, tags = random.Random(seed), sorted({t for s in own for _, t, _ in s})
    tagger, parser = Averaged(), Averaged()
    for _ in range(rounds):
        rng.shuffle(own := list(own))
        for s in own:
            words, gold = [w for w, _, _ in s], [t for _, t, _ in s]
            tagger.steps += 1
            found = Tables(tagger.current(), tags).path(words)
            if found != gold:
                seen = word_features(words)
                for path, amount in ((gold, 1.0), (found, -1.0)):
                    for i, t in enumerate(path):
                        tagger.add([*seen[i], f"t={path[i - 1] if i else '^'}"], t, amount)
            trees = [0, *(h for _, _, h in s), -2]
            stack, at, heads, kids = [0], 1, [-1] * (len(s) + 2), {}
            while at <= len(s):
                parser.steps += 1
                features = state_features(words, gold, stack, at, heads, kids)
                able = moves(stack, at, len(s), heads)
                sums = [sum(parser.now[f, m] for f in features) for m in range(4)]
                best, want = max(able, key=lambda m: sums[m]), right_move(trees, stack, at, heads)
                if best != want:
                    parser.add(features, want, 1.0)
                    parser.add(features, best, -1.0)
                at = apply(want, stack, at, heads, kids)
    return Model(Tables(tagger.mean(), tags), parser.mean())


def parse(phrases: DataFrame, model: Model | None = None, column: str = "phrase", name: str = "parsed") -> DataFrame:
    """phrases with the words of a phrase in order, each with its tag and head (from 1; 0 for the root)."""
    shared = phrases.sparkSession.sparkContext.broadcast(model or train())
    kind = pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string()), ("head", pa.int32())]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader, names = Reader(own.tagger, own.parser), own.tagger.tags
        for whole in batches:
            for batch in (whole.slice(low, AT_ONCE) for low in range(0, len(whole), AT_ONCE)):
                read = [WORD.findall(phrase or "") for phrase in batch.column(column).to_pylist()]
                tagged = [[names[t] for t in path] for path in reader.tags(read)]
                heads = [h for words, tags in zip(read, tagged, strict=True) for h in reader.heads(words, tags)]
                columns = [pa.array([w for words in read for w in words], pa.string()), pa.array([t for tags in tagged for t in tags], pa.string()), pa.array(heads, pa.int32())]
                offsets = pa.array(np.append(0, np.cumsum([len(words) for words in read])), pa.int32())
                parsed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([*batch.columns, parsed], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in phrases.schema)
    return phrases.mapInArrow(step, f"{fields}, {name} array<struct<word:string,tag:string,head:int>>")


def noun_phrase(tokens: Column, at: Column) -> Column:
    """The noun at that place (from 1) with the unbroken run of its own adjectives, numbers and nouns before it, as spelled."""
    fits = lambda i: (F.get(tokens, i - 1)["head"] == at) & F.get(tokens, i - 1)["tag"].isin(WITHIN)
    before = F.when(at > 1, F.sequence(at - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    breaks = F.filter(before, lambda i: ~fits(i))
    first = F.coalesce(F.get(breaks, F.lit(0)) + 1, F.lit(1))
    return F.array_join(F.transform(F.slice(tokens, first, at - first + 1), lambda t: t["word"]), " ")


def svo(tokens: Column) -> Column:
    """subject, relation, object of each verb that has both, by place: objects of the verb itself, then those of its prepositions (relation: verb and preposition)."""
    every = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))
    t = lambda i: F.get(tokens, i - 1)
    nominal = F.filter(every, lambda i: t(i)["tag"].isin(NOMINAL) & (t(i)["head"] > 0))
    verb_of = lambda i: t(t(i)["head"])
    subjects = F.filter(nominal, lambda i: (i < t(i)["head"]) & verb_of(i)["tag"].startswith("VB"))
    direct = F.transform(F.filter(nominal, lambda i: (i > t(i)["head"]) & verb_of(i)["tag"].startswith("VB")), lambda i: F.struct(t(i)["head"].alias("verb"), F.lit(0).alias("by"), i.alias("at")))
    by = lambda i: t(i)["head"]
    through = F.filter(nominal, lambda i: (i > by(i)) & t(by(i))["tag"].isin("IN", "TO") & (t(by(i))["head"] > 0) & (by(i) > t(by(i))["head"]) & t(t(by(i))["head"])["tag"].startswith("VB"))
    indirect = F.transform(through, lambda i: F.struct(t(by(i))["head"].alias("verb"), by(i).alias("by"), i.alias("at")))
    objects = F.concat(direct, indirect)
    relation = lambda o: F.when(o["by"] == 0, t(o["verb"])["word"]).otherwise(F.concat_ws(" ", t(o["verb"])["word"], t(o["by"])["word"]))
    of = lambda s: F.transform(F.filter(objects, lambda o: o["verb"] == t(s)["head"]), lambda o: F.struct(noun_phrase(tokens, s).alias("subject"), relation(o).alias("relation"), noun_phrase(tokens, o["at"]).alias("object")))
    return F.flatten(F.transform(subjects, of))


#: DuckDB SQL of svo() over a table parsed(id, place, word, tag, head): id, subject, relation, object.
SVO_SQL = f"""
with w as (select * from parsed), n as (select * from w where tag in ({", ".join(repr(t) for t in NOMINAL)}) and head > 0),
f as (select n.id, n.place, coalesce(max(b.place), 0) + 1 as first from n left join w b on b.id = n.id and b.place < n.place and not (b.head = n.place and b.tag in ({", ".join(repr(t) for t in WITHIN)})) group by n.id, n.place),
p as (select f.id, f.place, string_agg(w.word, ' ' order by w.place) as name from f join w on w.id = f.id and w.place between f.first and f.place group by f.id, f.place),
v as (select * from w where tag like 'VB%'),
s as (select n.id, n.place, n.head as verb from n join v on v.id = n.id and v.place = n.head where n.place < n.head),
o as (select n.id, n.place, n.head as verb, v.word as relation from n join v on v.id = n.id and v.place = n.head where n.place > n.head
  union all select n.id, n.place, v.place, v.word || ' ' || b.word from n join w b on b.id = n.id and b.place = n.head and b.tag in ('IN', 'TO') join v on v.id = n.id and v.place = b.head where n.place > b.place and b.place > v.place)
select s.id, x.name as subject, o.relation, y.name as object from s join o on o.id = s.id and o.verb = s.verb join p x on x.id = s.id and x.place = s.place join p y on y.id = o.id and y.place = o.place
"""
