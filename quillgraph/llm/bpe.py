"""Byte-pair encoding from a public tokenizer file: merges, pair validity, prefix tables and a streaming transducer.

A token sequence is what the merge list yields if and only if every token yields itself and every two neighbours
yield just themselves. So each prefix of a text has one encoding, found from those of its shorter prefixes by a
dynamic programme over the last token. How far behind a boundary the merges must look to settle it is computed from the
merge list alone (``Merges.lookahead``).
"""

from __future__ import annotations

import codecs
import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import regex

from .common import ON_RELEASE

#: White space as Unicode defines it (Python's own classes also hold U+001C to U+001F).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: The rank of pairs that no merge joins.
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Merges:
    """The merge list and vocabulary of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {p: i for i, p in enumerate(pairs)}
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = byte_alphabet()
        self.to_symbols = {i: c for i, c in enumerate(self.alphabet)}
        self.bytes_of = {c: i for i, c in enumerate(self.alphabet)}
        self.longest = max(len(t.removesuffix(self.suffix) if self.suffix else t) for t in self.ids)
        self.raw = {i: bytes(self.bytes_of[c] for c in t) for t, i in self.ids.items() if all(c in self.bytes_of for c in t)}
        self.raw |= {i: t.encode() for t, i in self.special.items()}
        self._valid: dict[tuple[str, str], bool] = {}
        self._spines: tuple[dict, dict] = {}, {}
        self._joins: dict[str, dict[str, int]] = {}
        for (left, right), rank in self.ranks.items():
            self._joins.setdefault(left, {})[right] = rank

    @cached_property
    def lookahead(self) -> int:
        """Bytes behind a boundary that settle it, whatever follows them: computed from the merge list.

        A merge (left, right) crosses a boundary only if right has formed behind it and is still whole at that rank.
        Whether it is depends on the merges of lower rank that could have taken one of its last parts before it was
        complete, and so on: ranks fall along such a chain, so the longest one is found merge by merge.
        """
        made: dict[str, list[tuple[str, int]]] = {}  # last part and rank of each merge that makes a token
        for (left, right), rank in self.ranks.items():
            made.setdefault(left + right, []).append((right, rank))
        ranks: dict[str, list[int]] = {}  # of the merges with that left part
        reach: dict[str, list[int]] = {}  # the longest way of any of them so far
        most = 0
        for (left, right), rank in self.ranks.items():
            further, parts = 0, [(right, rank)]
            while parts:  # right, its last part, the last part of that ...
                part, limit = parts.pop()
                at = bisect_left(ranks.get(part, ()), limit)
                if at:
                    further = max(further, reach[part][at - 1])
                parts += [(p, r) for p, r in made.get(part, ()) if r < limit]
            way = self._size(right) + further
            most = max(most, way)
            ranks.setdefault(left, []).append(rank)
            own = reach.setdefault(left, [])
            own.append(max(way, own[-1]) if own else way)
        return most

    def _size(self, token: str) -> int:
        return len(token.removesuffix(self.suffix) if self.suffix else token)

    @cached_property
    def ending(self) -> dict[str, int]:
        """The longest token that ends with a symbol."""
        out: dict[str, int] = {}
        for t in self.whole:
            out[t[-1]] = max(out.get(t[-1], 0), len(t))
        return out

    def symbols(self, raw: bytes) -> str:
        """One character of the vocabulary's alphabet for each byte."""
        return raw.decode("latin-1").translate(self.to_symbols)

    def symbols_of(self, text: str) -> str:
        """symbols() of the text's UTF-8; printable ASCII stands for itself but for the blank."""
        if text.isascii() and text.isprintable():
            return text.replace(" ", self.alphabet[32])
        return self.symbols(text.encode("utf-8", "surrogatepass"))

    def merged(self, parts: list[str], steps: int = NEVER) -> list[str] | None:
        """The lowest-ranked pair is joined, leftmost first, until no pair has a rank, or so often; None if it can't be done once."""
        rank_of = self.ranks.get
        ranks = [rank_of(pair, NEVER) for pair in zip(parts, parts[1:])]
        if steps == 1 and min(ranks) == NEVER:
            return None
        while ranks and steps and (best := min(ranks)) < NEVER:
            steps -= 1
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), NEVER)
        return parts

    def parts(self, token: str) -> list[str]:
        """The symbols of a token; the end of word belongs to the last one."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token.removesuffix(self.suffix)
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    @cached_property
    def _built(self) -> dict[str, tuple[str, str] | None]:
        """For each token that the merges make from its symbols, the two that the last merge joins; None for single symbols."""
        out: dict[str, tuple[str, str] | None] = {}
        for t in self.ids:
            parts = self.parts(t)
            if len(parts) == 1:
                out[t] = None
                continue
            while len(parts) > 2 and (got := self.merged(parts, 1)) is not None:
                parts = got
            if len(parts) == 2 and tuple(parts) in self.ranks:
                out[t] = tuple(parts)
        return out

    @cached_property
    def whole(self) -> frozenset[str]:
        """Tokens that the merges make from their symbols: others never occur in an encoding."""
        return frozenset(self._built)

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """Parts that stand at that end of the token (0 left, 1 right) while it is made, and the rank at which each is used up."""
        spines = self._spines[side]
        found = spines.get(token)
        if found is None:
            pair = self._built.get(token)
            found = spines[token] = [(token, NEVER)]
            if pair:
                rank = self.ranks[pair]
                found += [(part, min(limit, rank)) for part, limit in self._spine(pair[side], side)]
        return found

    def valid(self, left: str, right: str) -> bool:
        """The two tokens may stand side by side: no merge joins parts that touch while they are made. Of equal ranks the left place goes first."""
        known = self._valid.get((left, right))
        if known is None:
            if len(self._valid) > 200_000:
                self._valid.clear()
            known = self._valid[left, right] = self.judged(left, right)
        return known

    def judged(self, left: str, right: str) -> bool:
        """valid(), without its table."""
        joins, ends = self._joins.get, self._spine(right, 0)
        for part, used in self._spine(left, 1):
            ranks = joins(part)
            if ranks:
                for other, limit in ends:
                    rank = ranks.get(other, NEVER)
                    if rank < used and rank <= limit and rank < NEVER:
                        return False
        return True

    @cached_property
    def trie(self) -> Trie:
        """The bytes of the tokens that the merges make."""
        return Trie({i: self.raw[i] for i in map(self.ids.__getitem__, self.whole) if i in self.raw})

    def last_tokens(self, symbols: str) -> tuple[list[str], list[int]]:
        """For each prefix, without the end of word: its last token and its token count; entry 0 is the empty prefix."""
        last, count = [""], [0]
        self.extend(symbols, last)
        for end in range(1, len(symbols) + 1):
            count.append(count[end - len(last[end])] + 1)
        return last, count

    def extend(self, symbols: str, last: list[str]) -> None:
        """Appends the last token of each prefix that ``last`` doesn't cover yet; entry 0 is the token before, or none."""
        whole, valid, known, ending = self.whole, self.valid, self._valid.get, self.ending
        for end in range(len(last), len(symbols) + 1):
            widest = ending.get(symbols[end - 1], 0)
            for start in range(end - widest if end > widest else 0, end):
                token = symbols[start:end]
                if token in whole:
                    before = last[start]
                    if not before:
                        break
                    ok = known((before, token))
                    if valid(before, token) if ok is None else ok:
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")
            last.append(token)

    def closed(self, symbols: str, last: list[str], count: list[int], end: int) -> int:
        """Tokens of the prefix of that length as a whole word, with its end of word."""
        if not end:
            return 0
        if not self.suffix:
            return count[end]
        for start in range(max(0, end - self.longest), end):
            token = symbols[start:end] + self.suffix
            if token in self.whole and (not start or self.valid(last[start], token)):
                return count[start] + 1
        raise ValueError("no token ends the word")


class Bounded(dict):
    """A table of computed values in two halves: a full one becomes the older, so that what is used often stays."""

    def __init__(self, size: int, longest: int) -> None:
        super().__init__()
        self.size, self.longest, self.older = size, longest, {}

    def make(self, key: str):
        raise NotImplementedError

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            self.keep(key, found)
        return found

    def keep(self, key: str, found) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = found


class Trie:
    """Byte strings with their numbers, in arrays, so that many places of a text are read at a time."""

    def __init__(self, strings: dict[int, bytes]) -> None:
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        for number, string in strings.items():
            node = 0
            for byte in string:
                node = edges.setdefault(node << 8 | byte, len(edges) + 1)
            ends[node] = number
        self.number = np.full(len(edges) + 1, -1, np.int32)
        self.number[list(ends)] = list(ends.values())
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edges, self.next = keys[order], np.array(list(edges.values()), np.int32)[order]
        self.size = np.zeros(max(strings) + 1, np.int64)
        self.size[list(strings)] = [len(x) for x in strings.values()]

    def starting(self, raw: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
        """For lengths from 1 on, the number of the string that begins at each byte and has that length, or -1. left: bytes up to the end of its word."""
        at, node, size = np.arange(len(raw)), np.zeros(len(raw), np.int64), 0
        while len(at):
            edge = node << 8 | raw[at + size]
            where = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            found = self.edges[where] == edge
            at, node, size = at[found], self.next[where[found]].astype(np.int64), size + 1
            out = np.full(len(raw), -1, np.int32)
            out[at] = self.number[node]
            yield out
            on = left[at] > size
            at, node = at[on], node[on]


class Transducer:
    """Encodes one pretoken that arrives in pieces. A token is emitted once the text that has been read behind it is as
    long as the merge list's lookahead, for then nothing that follows can change it; the window that is kept is bounded
    by that and the longest token."""

    #: Bytes of a pretoken that is encoded along with others, and pretokens that are at a time.
    SHORT, TOGETHER = 32, 8192
    #: Bits of the number of judged pairs that are kept.
    PAIR_BITS = 20

    def __init__(self, merges: Merges) -> None:
        self.m, self.step = merges, merges.lookahead + merges.longest
        self.fed = 0
        self.reset()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Whole pretokens, as encode() does them one by one: short ones take each of their bytes together."""
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[list[int] | None] = [None if 0 < len(r) <= self.SHORT else self.encode(t) for t, r in zip(texts, raws, strict=True)]
        short = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: -len(raws[i]))
        self.fed += len(short)
        for low in range(0, len(short), self.TOGETHER):
            some = short[low : low + self.TOGETHER]
            for i, ids in zip(some, self._together([raws[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _together(self, raws: list[bytes]) -> list[list[int]]:
        """Tokens of some pretokens, longest first. Byte by byte, each prefix gets its last token: the longest one that may follow the one before."""
        sizes = np.array([len(r) for r in raws])
        start = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(raws), np.uint8)
        trie = self.m.trie
        tokens = list(trie.starting(raw, np.repeat(start + sizes, sizes) - np.arange(len(raw))))
        last = np.full(len(raw), -1, np.int32)
        for end in range(1, len(raws[0]) + 1):
            open_ = start[: np.searchsorted(-sizes, -end, "right")]  # words of that many bytes that have no last token yet
            for size in range(min(end, len(tokens)), 0, -1):
                token = tokens[size - 1][open_ + (end - size)]
                ok = token >= 0
                if size < end:
                    there = np.flatnonzero(ok)
                    ok[there] = self._may_follow(last[open_[there] + (end - size - 1)], token[there])
                last[open_[ok] + (end - 1)] = token[ok]
                open_ = open_[~ok]
            if len(open_):
                raise ValueError(f"no token ends at byte {end}")
        out: list[list[int]] = [[] for _ in raws]
        word, end = np.arange(len(raws)), start + sizes
        while len(word):
            token = last[end - 1]
            for i, t in zip(word.tolist(), token.tolist(), strict=True):
                out[i].append(t)
            end = end - trie.size[token]
            on = end > start[word]
            word, end = word[on], end[on]
        for ids in out:
            ids.reverse()
        return out

    @cached_property
    def _judged(self) -> np.ndarray:
        """Judged pairs, each at a place of its own that later ones may take: the pair's number, and in its last bit whether it is valid."""
        return np.full(1 << self.PAIR_BITS, -1, np.int64)

    @cached_property
    def _names(self) -> dict[int, str]:
        return {i: t for t, i in self.m.ids.items()}

    def _may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merges.valid() of many pairs of tokens."""
        pair = left.astype(np.int64) << 31 | right
        place = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.PAIR_BITS)).astype(np.int64)
        found = self._judged[place]
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            fresh, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            names, judged = self._names, self.m.judged
            known = np.array([judged(names[p >> 31], names[p & 0x7FFFFFFF]) for p in fresh.tolist()], np.int64)
            own = fresh << 1 | known
            self._judged[place[new[first]]] = own
            found[new] = own[back]
        return (found & 1).astype(bool)

    def reset(self) -> None:
        self.window, self.last = "", [""]

    def encode(self, text: str) -> list[int]:
        """A whole pretoken. What it shares with the start of the one before isn't read again: a prefix has the same last tokens wherever it stands."""
        now, shared = self.m.symbols_of(text), 0
        if len(now) > self.step:
            self.reset()
            return [*self.feed(text.encode("utf-8", "surrogatepass")), *self.finish()]
        self.fed += 1
        for a, b in zip(self.window, now):
            if a != b:
                break
            shared += 1
        self.window = now
        del self.last[shared + 1 :]
        self.m.extend(now, self.last)
        return [self.m.ids[t] for t in self._tokens(len(now))]

    def feed(self, raw: bytes) -> Iterator[int]:
        """Token ids that are stable now."""
        m = self.m
        self.fed += 1
        for low in range(0, len(raw), self.step):
            self.window += m.symbols(raw[low : low + self.step])
            m.extend(self.window, self.last)
            if len(self.window) >= 2 * self.step:
                yield from self._emit(len(self.window) - m.lookahead)

    def _tokens(self, end: int) -> list[str]:
        out, last = [], self.last
        while end:
            out.append(last[end])
            end -= len(last[end])
        out.reverse()
        return out

    def _emit(self, settled: int) -> Iterator[int]:
        """settled: boundaries up to there can't change any more."""
        end = len(self.window)
        while end > settled:
            end -= len(self.last[end])
        done = self._tokens(end)
        if done:
            self.window, self.last = self.window[end:], [done[-1], *self.last[end + 1 :]]
            yield from (self.m.ids[t] for t in done)

    def finish(self) -> Iterator[int]:
        """The rest; the transducer is then ready for the next pretoken."""
        done = self._tokens(len(self.window))
        self.reset()
        return map(self.m.ids.__getitem__, done)


class Decoder:
    """Ids to text, in pieces: bytes of an unfinished character wait for the next id."""

    def __init__(self, merges: Merges) -> None:
        self.bytes = merges.raw
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    """One copy of a file's merges in each worker process."""
    return Merges(path)


@lru_cache(maxsize=4)
def special_pattern(path: str):
    """Matches the special strings of a file, longest first; None without any."""
    strings = sorted(load(path).special, key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None


ON_RELEASE += [load.cache_clear, special_pattern.cache_clear]
