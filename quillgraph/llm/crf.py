"""A linear-chain conditional random field over word-shape features, trained and decoded in numpy.

Tokens are runs of non-blank characters. A token's features are its shape (classes of its characters, runs shortened),
how many digits it has, and the shapes of its neighbours; words themselves are no features, so any vocabulary works,
but for the names of fields that announce a secret (``CUES``). Tokens of prose all have one shape, ``PLAIN``.

Decoding is exact over whole texts. Amid prose every token has the same scores, so the field itself tells from how many
plain tokens on (``CRF.reach``) the best path stands at "outside" whatever lies on either side: such stretches need no
decoding and part the text into pieces that are decoded by themselves.
"""

from __future__ import annotations

import re

import numpy as np

#: Labels: outside, and for each kind a first and a further token.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
FEATURES = 1 << 13
#: The shape of prose, and of field names.
PLAIN, CUE = "plain", "cue"
CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "ssn", "passphrase")
#: Characters of a token that is too long for prose.
LONG = 24

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'`#*$%&!?,;()[]{}<>|."
_MARKED = re.compile(r"[0-9@=_:]")
_CUE = re.compile(rf"(?:{'|'.join(CUES)})[:=]?", re.I)
#: Wherever this isn't found, tokens are prose.
SPECIAL = re.compile(rf"[0-9@=_:]|[^\x20\x09-\x0D]{{{LONG}}}|{'|'.join(CUES)}", re.I)
_RUN = re.compile(r"(.)\1+", re.S)
_UPPER, _LOWER, _OTHER = re.compile(r"[A-Z]+"), re.compile(r"[^\W\d_A-Z9]+"), re.compile(r"[^\x00-\x7f]+")
_DIGITS = re.compile(r"[0-9]+")
_HEX, _KEY = re.compile(r"[0-9A-Fa-f]{16,}"), re.compile(r"[0-9A-Za-z_+/=-]{20,}")


def token_shape(token: str) -> str:
    """PLAIN for prose, CUE for the name of a secret's field, H or K for long keys, else its characters' classes and the number of its digits."""
    core = token.strip(_EDGES)
    if _CUE.fullmatch(core):
        return CUE
    if not _MARKED.search(core) and len(core) < LONG:
        return PLAIN
    value = core.rpartition("=")[2].strip(_EDGES) if "=" in core.rstrip("=") else core
    lead = "" if value is core else "="
    digits = sum(map(len, _DIGITS.findall(value)))
    letters = len(value) - digits
    if _HEX.fullmatch(value) and digits and letters:
        return lead + "H"
    if _KEY.fullmatch(value) and letters and (digits >= 3 or re.search("[a-z]", value) and re.search("[A-Z]", value[1:]) or "_" in value):
        return lead + "K"
    shape = _RUN.sub(r"\1", _OTHER.sub("u", _LOWER.sub("a", _UPPER.sub("A", _DIGITS.sub("9", value)))))
    return f"{lead}{shape}/{min(digits, 20)}" if digits else lead + shape


def slot(name: str) -> int:
    """Feature number: a fixed hash, so that workers agree."""
    value = 2166136261
    for byte in name.encode("utf-8", "surrogatepass"):
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return (value ^ value >> 15) % FEATURES


def slots(before: str, own: str, after: str) -> tuple[int, ...]:
    """Feature numbers of a token between its neighbours' shapes; an empty shape is the edge of the text."""
    names = ("bias", f"s:{own}", f"p:{before}|{own}", f"n:{own}|{after}", f"d:{own.rpartition('/')[2] if '/' in own else '-'}", f"@:{'@' in own}", f".:{own.count('.')}")
    return tuple(map(slot, names))


def features(tokens: list[str]) -> np.ndarray:
    """(tokens, 7) feature numbers of a whole text."""
    shapes = ["", *map(token_shape, tokens), ""]
    return np.array([slots(*shapes[i : i + 3]) for i in range(len(tokens))], np.int64).reshape(len(tokens), 7)


class Scores:
    """A worker's tables: shapes of tokens, and the score rows of a token between its neighbours' shapes. Bounded."""

    SIZE, LONGEST = 100_000, 48

    def __init__(self, field: CRF) -> None:
        self.field, self.shapes = field, {}
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple[str, str, str], int] = {}
        self.rows: list[np.ndarray] = []

    def shape(self, token: str) -> str:
        found = self.shapes.get(token)
        if found is None:
            found = token_shape(token)
            if len(token) <= self.LONGEST:
                if len(self.shapes) >= self.SIZE:
                    self.shapes.clear()
                self.shapes[token] = found
        return found

    def of(self, shapes: list[str]) -> np.ndarray:
        """Numbers of the score rows; shapes has the neighbours of the first and last token, too."""
        out = []
        for key in zip(shapes, shapes[1:], shapes[2:]):
            number = self.numbers.get(key)
            if number is None:
                number = self.numbers[key] = len(self.rows)
                self.rows.append(self.field.emission[list(slots(*key))].sum(axis=0))
            out.append(number)
        return np.array(out, np.int32)


#: A further token can't start a sequence or follow another kind; such steps are shut.
SHUT = -1e9
START = np.array([SHUT if name[0] == "I" else 0.0 for name in LABELS])
ALLOWED = np.array([[b[0] != "I" or a[2:] == b[2:] for b in LABELS] for a in LABELS])
#: Cells of a padded batch, and time steps whose scores are spread out at once.
CELLS, BLOCK = 1 << 16, 4096


class CRF:
    """Emission weights by feature and label, and transition weights."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray) -> None:
        self.emission, self.transition = emission, transition
        self._scores: Scores | None = None
        self.reach = self._reach()
        self._check_prose()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scores": None}

    @property
    def scores(self) -> Scores:
        """This process's tables."""
        if self._scores is None:
            self._scores = Scores(self)
        return self._scores

    def _check_prose(self) -> None:
        """Texts of nothing but prose hold nothing; beyond this length the middle is settled by ``reach``."""
        for n in range(1, 4 * self.reach + 8):
            numbers = self.scores.of(["", *[PLAIN] * n, ""])
            if self._viterbi([numbers], np.array(self.scores.rows))[0].any():
                raise ValueError("the field finds personal data in prose")

    def _reach(self, most: int = 16) -> int:
        """Plain tokens on either side of one that settle it as outside, whatever its surroundings: checked for all labels that may stand there."""
        own = self.emission[list(slots(PLAIN, PLAIN, PLAIN))].sum(axis=0)
        ways = self.transition  # best score from the label before a run to its last label, the run's own scores in it
        for reach in range(1, most + 1):
            ways = (ways[:, :, None] + self.transition[None]).max(axis=1) + own if reach > 1 else self.transition + own
            from_left = (ways[:, :, None] + self.transition[None]).max(axis=1) + own  # (label before, label of the token)
            to_right = self.transition + 0.0
            for _ in range(reach):
                to_right = (self.transition[:, :, None] + (own[:, None] + to_right)[None]).max(axis=1)  # (label of the token, label behind)
            total = from_left[:, None, :] + to_right.T[None, :, :]  # before, behind, own
            open_ = total.max(axis=2) > SHUT / 2
            if (total.argmax(axis=2)[open_] == 0).all():
                return reach
        raise ValueError("the field doesn't tell prose from personal data")

    def decode(self, numbers: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
        """Viterbi over a batch of pieces (numbers of score rows), padded to the longest of those that go together."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(numbers)
        order = sorted(range(len(numbers)), key=lambda i: len(numbers[i]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(numbers[order[-1]]) <= CELLS and 2 * len(numbers[order[-n - 1]]) >= len(numbers[order[-1]]):
                n += 1
            some, order = order[len(order) - n :], order[: len(order) - n]
            for i, path in zip(some, self._viterbi([numbers[i] for i in some], rows), strict=True):
                out[i] = path
        return out

    def _viterbi(self, numbers: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
        lengths = np.array([len(x) for x in numbers])
        longest, n, k = int(lengths.max()), len(numbers), len(LABELS)
        padded = np.zeros((n, longest), np.int32)
        for i, x in enumerate(numbers):
            padded[i, : len(x)] = x
        back = np.zeros((longest, n, k), np.int8)
        best = np.zeros((n, k))
        into = self.transition.T[None]  # (label, label before)
        for low in range(0, longest, BLOCK):
            scores = rows[padded[:, low : low + BLOCK]]
            for t in range(low, min(low + BLOCK, longest)):
                if not t:
                    best = scores[:, 0] + START
                    continue
                step = best[:, None, :] + into
                back[t] = at = step.argmax(axis=2)
                here = np.take_along_axis(step, at[:, :, None], 2)[:, :, 0] + scores[:, t - low]
                best = np.where((t < lengths)[:, None], here, best)
        paths = np.zeros((n, longest), np.int8)
        y = best.argmax(axis=1)
        every = np.arange(n)
        for t in range(longest - 1, -1, -1):
            paths[:, t] = y
            if t:
                y = np.where(t < lengths, back[t, every, y], y)
        return [p[:length] for p, length in zip(paths, lengths, strict=True)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def labelled(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[str], np.ndarray]:
    """Tokens of a labelled row, and the labels of its spans."""
    found, labels, before = list(TOKEN.finditer(text)), [], None
    for m in found:
        own = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
        labels.append(LABELS.index(f"{'I' if own == before else 'B'}-{own[2]}") if own else 0)
        before = own
    return [m[0] for m in found], np.array(labels)


def train(table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 30, rate: float = 0.2, decay: float = 1e-4, batch: int = 25) -> CRF:
    """Maximum likelihood by gradient steps over batches of (text, spans) rows; forward-backward in log space, rows padded."""
    emission, transition = np.zeros((FEATURES, len(LABELS))), np.where(ALLOWED, 0.0, SHUT)
    rows = [(features(tokens), labels) for tokens, labels in (labelled(*r) for r in table) if tokens]
    rows.sort(key=lambda r: len(r[1]))
    batches = []
    for low in range(0, len(rows), batch):
        some = rows[low : low + batch]
        longest = len(some[-1][1])
        feats = np.zeros((len(some), longest, 7), np.int64)
        gold, real = np.zeros((len(some), longest), np.int64), np.zeros((len(some), longest), bool)
        for i, (f, y) in enumerate(some):
            feats[i, : len(y)], gold[i, : len(y)], real[i, : len(y)] = f, y, True
        used, place = np.unique(feats[real], return_inverse=True)
        batches.append((feats, gold, real, used, place.reshape(-1)))
    ge, gt = np.full_like(emission, 1e-8), np.full_like(transition, 1e-8)
    for epoch in range(epochs):
        for number in np.random.default_rng(epoch).permutation(len(batches)):
            feats, gold, real, used, place = batches[number]
            s = emission[feats].sum(axis=2)
            n, length, k = s.shape
            alpha, beta = np.zeros((n, length, k)), np.zeros((n, length, k))
            alpha[:, 0] = s[:, 0] + START
            for t in range(1, length):
                alpha[:, t] = s[:, t] + _log_sum(alpha[:, t - 1, :, None] + transition, 1)
            for t in range(length - 2, -1, -1):
                beta[:, t] = np.where(real[:, t + 1, None], _log_sum(transition + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            last = real.sum(axis=1) - 1
            total = _log_sum(alpha[np.arange(n), last], 1)
            node = np.exp(np.minimum(alpha + beta - total[:, None, None], 0))
            at = np.nonzero(real)
            node[at[0], at[1], gold[at]] -= 1
            de = np.zeros((len(used), k))
            np.add.at(de, place, np.repeat(node[real], 7, axis=0))
            dt = np.zeros_like(transition)
            for t in range(1, length):
                here = real[:, t]
                both = np.exp(np.minimum(alpha[:, t - 1, :, None] + transition + (s[:, t] + beta[:, t])[:, None, :] - total[:, None, None], 0))
                dt += both[here].sum(axis=0)
                np.subtract.at(dt, (gold[here, t - 1], gold[here, t]), 1)
            de = de / n + decay * emission[used]
            ge[used] += de**2
            emission[used] -= rate * de / np.sqrt(ge[used])
            dt = np.where(ALLOWED, dt / n + decay * np.where(ALLOWED, transition, 0), 0)
            gt += dt**2
            transition -= rate * dt / np.sqrt(gt)
    return CRF(emission, transition)
