"""Secret scans: base patterns, and a linear-chain conditional random field over tokens.

Tokens are tagged as begin of a secret, inside or outside.  Features are a token's shape (length, digits, capitals, entropy,
alphabet, how word-like its letters are), its neighbours' classes and the text's own mix of tokens.  The field is trained on
windows of a bounded sample of texts (``SAMPLE_TEXTS`` texts of together ``SAMPLE_TOTAL`` characters, ``SAMPLE_WINDOWS`` windows
of each sort).  Labels come from the base patterns and from ``PLANTED`` secrets of several kinds that are set into windows of
the same texts; as many windows get things that only look like secrets (``HARMLESS``), labelled outside.  Decoding is by Viterbi.

Most tokens are plain words whose outside score leads by more than any change of the transitions around them could win back.
On such tokens every best path is outside, so a text falls apart into short runs that are decoded exactly, one by one.

Nulls: a null text has no spans; null doc_ids are kept.  Equal texts get equal spans.  An empty table gives an empty result.
Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import arrow_map, bounded_batches, sampled, text_or_empty

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without any of these, capitals aside, has no assignment.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: Bounds of the training sample: texts, characters of a text, of all texts, windows of a sort; then tokens of a window and
#: training steps.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_TOTAL, SAMPLE_WINDOWS, WINDOW, STEPS = 3_000, 50_000, 12_000_000, 1_300, 12, 90
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Letters of a token up to which it is a word without further looks.
WORD_LETTERS = 15

_PLAIN = re.compile(r"[\"'(]*[^\W\d_]{1,%d}[.,;:!?\"')*#$%%&]*" % WORD_LETTERS)
_KEYWORD = re.compile(r"(?i)passw|pwd|secret|token|api_?key|apikey|auth|credential|bearer|private")
_NUMBER = re.compile(r"[-+()\d.,:/%$€]*\d[-+()\d.,:/%$€]*")
_EDGES = "\"'.,;:()[]{}#*$%&|<>!?"
_PARTS = re.compile(r"[=:\"'@&?,;]+")
PLAIN, KEYWORD, ASSIGNER, NUMBER, LONG_MIXED, SHORT_MIXED, SYMBOLS, OTHER, LETTERS, EDGE = range(10)
CLASSES, FILE = 10, 3
#: Yes-or-no features of a token: patterns of the whole token, then of its longest part.
_WHOLE = tuple(map(re.compile, (r".*[=:]", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+\Z", r"\w+://[^/\s:@]+:[^/\s@]+@", r"(?:https?://|www\.)[^@]*\Z", r"\W*[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\W*\Z", r"[/~.][\w.-]*/|.*\w/[\w.-]+/")))
_PART = tuple(
    map(
        re.compile,
        (
            r"[0-9a-f]+\Z",
            r"[0-9A-F]+\Z",
            r"[0-9a-z]+\Z",
            r"[0-9A-Z]+\Z",
            r"[0-9A-Za-z]+\Z",
            r"[0-9A-Za-z+/=]+\Z",
            r"[A-Z]{3,5}[A-Z0-9]{12}",
            r"[A-Za-z]{2,6}[-_](?:[a-z]+[-_])?[0-9A-Za-z]{16}",
            r"[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}\Z",
            r"[A-Za-z]+(?:[-_./][A-Za-z]*)*[-_./]?\d{0,4}\Z",
            r"[A-Z]{2,6}[-_]?\d+(?:[-_/]\d+)*\Z",
            r"\d{13,}\Z",
            r".*[^0-9A-Za-z_./+=-]",
        ),
    )
)
_BINS = ((4, 8, 12, 16, 20, 24, 32, 48), (0, 0.3, 0.7), (0, 0.5), (2, 3, 3.6, 4.2), (0.2, 0.4), (-3, -6, -10))
_STARTS = list(np.cumsum([CLASSES, *(len(b) + 1 for b in _BINS)]))
SELF = int(_STARTS[-1]) + len(_WHOLE) + len(_PART)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Letters:
    """How usual letter pairs are in words of the sample: mean and spread of their log-probability."""

    def __init__(self, words: Counter):
        pairs = np.full((27, 27), 0.5)
        for word, n in words.items():
            codes = self.codes(word)
            np.add.at(pairs, (codes[:-1], codes[1:]), math.log1p(n))
        self.odds = np.log(pairs / pairs.sum(1, keepdims=True))
        share = pairs / pairs.sum()
        self.mean = float((share * self.odds).sum())
        self.spread = float(np.sqrt((share * (self.odds - self.mean) ** 2).sum())) or 1.0

    @staticmethod
    def codes(word: str) -> np.ndarray:
        codes = np.frombuffer(word.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) - 97
        return np.where((codes >= 0) & (codes < 26), codes, 26)

    def oddness(self, text: str) -> float:
        """How far below that of words the log-probability of a text's letter pairs is, in standard errors; 0 is as usual."""
        runs = [self.codes(run) for run in re.findall(r"[^\W\d_]{2,}", text)]
        values = [self.odds[c[:-1], c[1:]] for c in runs]
        if not values:
            return 0.0
        values = np.concatenate(values)
        return float((values.mean() - self.mean) / (self.spread / math.sqrt(len(values))))


def token_features(token: str, letters: Letters | None = None) -> tuple[int, list[int]]:
    """(class, numbers of the features that are on) of a token."""
    if _PLAIN.fullmatch(token):
        if not _KEYWORD.search(token):
            return PLAIN, [PLAIN]
        return KEYWORD, [KEYWORD]
    core = token.strip(_EDGES)
    part = max(_PARTS.split(core), key=len)
    digits, capitals = sum(map(str.isdigit, part)), sum(map(str.isupper, part))
    n_letters = sum(map(str.isalpha, part))
    if not core:
        kind = ASSIGNER if "=" in token or ":" in token else SYMBOLS
    elif core in ("=", "=>", ":="):
        kind = ASSIGNER
    elif _KEYWORD.search(token):
        kind = KEYWORD
    elif _NUMBER.fullmatch(core):
        kind = NUMBER
    elif digits and n_letters:
        kind = LONG_MIXED if len(part) >= 16 else SHORT_MIXED
    elif n_letters == len(core):
        kind = LETTERS
    else:
        kind = OTHER
    n = max(1, len(part))
    bits = -sum(v / n * math.log2(v / n) for v in Counter(part).values())
    turns = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(part, part[1:], strict=False)) / n
    odd = letters.oddness(part) if letters else 0.0
    values = ([len(part) > k for k in _BINS[0]], [digits / n > r for r in _BINS[1]], [capitals / n > r for r in _BINS[2]], [bits > b for b in _BINS[3]], [turns > r for r in _BINS[4]], [odd < z for z in _BINS[5]])
    on = [kind, *(int(start) + sum(v) for start, v in zip(_STARTS, values, strict=False))]
    tests = [*(bool(p.match(token)) for p in _WHOLE), *(bool(p.match(part)) for p in _PART)]
    return kind, on + [int(_STARTS[-1]) + k for k, yes in enumerate(tests) if yes]


class Tokens(dict):
    """Token to the number of its kind; the kinds' features and classes are kept, looked-up tokens up to a bound."""

    def __init__(self, letters: Letters | None = None):
        super().__init__()
        self.letters = letters
        self.kinds: dict[tuple, int] = {}
        self.features: list[list[int]] = []
        self.classes: list[int] = []

    def __reduce__(self):
        return Tokens, (self.letters,)

    def __missing__(self, token: str) -> int:
        kind, on = token_features(token, self.letters)
        number = self.kinds.get((kind, *on))
        if number is None:
            number = self.kinds[(kind, *on)] = len(self.features)
            self.features.append(on)
            self.classes.append(kind)
        if len(self) > 300_000:
            self.clear()
        self[token] = number
        return number


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LOWER = _ALNUM[26:52]
_NAMES = "pwd pass passphrase key secret_key private_key credential auth access client_secret signing_key conn".split()


def _drawn(rng: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(least, most)))


def _named(rng: random.Random, value: str) -> str:
    quote = rng.choice(["", "", '"', "'"])
    gap, name = rng.choice(["=", "=", ":", " = ", ": "]), rng.choice(_NAMES)
    return f"{name.upper() if rng.random() < 0.3 else name}{gap}{quote}{value}{quote}"


def _short_password(rng: random.Random, words: list[str]) -> str:
    return rng.choice(words)[:8].capitalize() + rng.choice("!&%#$_-") + _drawn(rng, _ALNUM, 4, 10)


#: Secrets that are set into training texts, by kind: (generator, words) to text.
PLANTED = {
    "prefixed": lambda rng, words: _drawn(rng, _LOWER, 2, 5) + rng.choice("_-") + rng.choice(["", "", "live_", "test_", "proj-"]) + _drawn(rng, _ALNUM, 20, 48),
    "named_hex": lambda rng, words: _named(rng, _drawn(rng, "0123456789abcdef", 12, 40)),
    "named_mixed": lambda rng, words: _named(rng, _drawn(rng, _ALNUM, 10, 40)),
    "named_short": lambda rng, words: _named(rng, _short_password(rng, words)),
    "base64": lambda rng, words: _drawn(rng, _ALNUM + "+/", 24, 88) + rng.choice(["", "=", "=="]),
    "key_id": lambda rng, words: _drawn(rng, _ALNUM[:26], 3, 5) + _drawn(rng, _ALNUM[:26] + "0123456789" * 2, 12, 24),
    "capital_hex": lambda rng, words: _drawn(rng, "0123456789ABCDEF", 24, 64),
    "mixed": lambda rng, words: _drawn(rng, _ALNUM, 20, 64),
    "lower_mixed": lambda rng, words: _drawn(rng, _LOWER + "0123456789" * 2, 20, 48),
    "letters": lambda rng, words: _drawn(rng, rng.choice([_LOWER, _ALNUM[:52], _ALNUM[:26]]), 20, 40),
    "url_password": lambda rng, words: f"{rng.choice(['https', 'postgres', 'mysql', 'redis', 'amqp', 'ftp'])}://{rng.choice(words).lower()}:{_drawn(rng, _ALNUM, 8, 24)}@{rng.choice(words).lower()}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['', '/db', ':5432/x'])}",
    "web_token": lambda rng, words: "eyJ" + _drawn(rng, _ALNUM, 16, 40) + "." + _drawn(rng, _ALNUM + "-_", 24, 120) + "." + _drawn(rng, _ALNUM + "-_", 20, 43),
    "bearer": lambda rng, words: "Bearer " + _drawn(rng, _ALNUM + "-_.", 20, 60),
}


def _some(rng: random.Random, words: list[str], most: int) -> list[str]:
    return [w.lower() for w in rng.choices(words, k=rng.randint(2, most))]


#: Things that look like secrets and are none, by kind.
HARMLESS = {
    "uuid": lambda rng, words: "-".join(_drawn(rng, "0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)),
    "order": lambda rng, words: f"{_drawn(rng, _ALNUM[:26], 2, 4)}-{rng.randint(2000, 2030)}-{_drawn(rng, '0123456789', 4, 8)}",
    "number": lambda rng, words: _drawn(rng, "0123456789", 8, 24),
    "phone": lambda rng, words: rng.choice(["", "+1 ", "(017) "]) + f"{rng.randint(100, 999)}-{_drawn(rng, '0123456789', 4, 7)}",
    "day": lambda rng, words: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}" if rng.random() < 0.5 else f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1900, 2030)}",
    "host": lambda rng, words: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
    "amount": lambda rng, words: f"{rng.choice('$€')}{rng.randint(1, 9999)}.{_drawn(rng, '0123456789', 2, 2)}",
    "short_mail": lambda rng, words: f"{_drawn(rng, _LOWER, 1, 4)}.{_drawn(rng, _LOWER, 1, 6)}@{_drawn(rng, _LOWER, 1, 8)}.{rng.choice(['org', 'com', 'net'])}",
    "short_hash": lambda rng, words: _drawn(rng, "0123456789abcdef", 7, 11),
    "mail": lambda rng, words: f"{rng.choice(words).lower()}.{_drawn(rng, '0123456789', 0, 4)}@{rng.choice(words).lower()}{rng.randint(0, 99)}.example.com",
    "url": lambda rng, words: f"https://www.{rng.choice(words).lower()}.com/{rng.randint(1990, 2030)}/{'-'.join(_some(rng, words, 6))}-{rng.randint(1, 99999)}.html",
    "query": lambda rng, words: f"https://{rng.choice(words).lower()}.org/{rng.choice(words).lower()}?id={rng.randint(1, 10**7)}&page={rng.randint(1, 99)}",
    "path": lambda rng, words: f"/{'/'.join(_some(rng, words, 5))}-{rng.randint(0, 20)}.{rng.randint(0, 20)}.tar",
    "slug": lambda rng, words: rng.choice("-_").join(_some(rng, words, 6)) + rng.choice(["", "_2", "-v3", "2024"]),
    "joined_words": lambda rng, words: "".join(_some(rng, words, 4)),
    "camel": lambda rng, words: "".join(w.capitalize() for w in _some(rng, words, 4)) + rng.choice(["", "2", "V10"]),
    "version": lambda rng, words: f"{rng.choice(words).lower()}-{rng.randint(0, 30)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}-rc{rng.randint(1, 9)}",
    "setting": lambda rng, words: f"{rng.choice(words).lower()}{rng.choice(['=', ': ', ' = '])}{rng.choice([rng.choice(words).lower(), str(rng.randint(0, 10**6)), 'true'])}",
    "stamp": lambda rng, words: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}.{rng.randint(100, 999)}Z",
    "address": lambda rng, words: ":".join(_drawn(rng, "0123456789abcdef", 2, 2) for _ in range(6)),
    "tag": lambda rng, words: rng.choice("#@") + rng.choice(words).lower() + rng.choice(["", "_"]) + str(rng.randint(1, 2030)),
    "loud": lambda rng, words: "".join(w.upper() for w in _some(rng, words, 4)),
}


def file_bucket(classes: np.ndarray) -> int:
    """The text's share of tokens that are not plain words: little, some, much."""
    share = float((classes != PLAIN).mean()) if len(classes) else 0.0
    return 0 if share < 0.02 else 1 if share < 0.2 else 2


def neighbours(classes: np.ndarray) -> np.ndarray:
    """Columns: the class one before, two before, one after; EDGE outside the text."""
    edged = np.r_[EDGE, EDGE, classes, EDGE]
    return np.stack([edged[1:-2], edged[:-3], edged[3:]], 1)


class Field:
    """Weights of the field: per token kind, neighbour class and file bucket, and between tags."""

    def __init__(self, weights: np.ndarray, change: np.ndarray, letters: Letters | None = None):
        self.letters = letters
        self.own, rest = weights[:SELF], weights[SELF:]
        self.near, self.file = rest[: 3 * CLASSES].reshape(3, CLASSES, 3), rest[3 * CLASSES :]
        self.change = change
        # how much a path can lose at most around one token when its tag becomes OUTSIDE
        loss = [change[:, None, y] + change[None, y, :] - change[:, None, 0] - change[None, 0, :] for y in (BEGIN, INSIDE)]
        self.margin = float(max(np.max(x) for x in loss))
        self.known, self.kinds = None, np.zeros((0, 3))

    def tokens(self) -> Tokens:
        """An empty store of tokens for this field."""
        return Tokens(self.letters)

    def scores(self, tokens: Tokens, numbers: np.ndarray) -> np.ndarray:
        if self.known is not tokens or len(self.kinds) < len(tokens.features):  # each store numbers its kinds in its own order
            self.known = tokens
            self.kinds = np.stack([self.own[on].sum(0) for on in tokens.features])
            self.classes = np.array(tokens.classes)
        classes = self.classes[numbers]
        around = neighbours(classes)
        return self.kinds[numbers] + self.near[0][around[:, 0]] + self.near[1][around[:, 1]] + self.near[2][around[:, 2]] + self.file[file_bucket(classes)]

    def viterbi(self, scores: np.ndarray, before: bool, after: bool) -> list[int]:
        """The best tags of a run; ``before`` and ``after``: an outside token stands next to it."""
        best, back = scores[0] + (self.change[OUTSIDE] if before else 0), []
        for row in scores[1:]:
            paths = best[:, None] + self.change
            back.append(paths.argmax(0))
            best = paths.max(0) + row
        tags = [int((best + (self.change[:, OUTSIDE] if after else 0)).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def tags(self, scores: np.ndarray) -> dict[int, int]:
        """Token number to tag, for tokens that are not outside."""
        open_ = np.flatnonzero(scores[:, 0] - scores[:, 1:].max(1) <= self.margin)
        found: dict[int, int] = {}
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            if len(run):
                tags = self.viterbi(scores[run], run[0] > 0, run[-1] + 1 < len(scores))
                found |= {int(k): t for k, t in zip(run, tags, strict=True) if t}
        return found


def tagged(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], np.ndarray]:
    """The tokens of a text and their tags by the given spans, of which the first to reach a token counts."""
    places = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text)]
    tags = np.zeros(len(places), int)
    starts = [p[0] for p in places]
    for _, start, end in spans:
        inside = list(range(max(0, bisect_right(starts, start) - 1), bisect_left(starts, end)))
        if inside and not tags[inside].any():
            tags[inside] = INSIDE
            tags[inside[0]] = BEGIN
    return [p[2] for p in places], tags


def training_windows(texts: list[str], planted: dict, harmless: dict, seed: int) -> tuple[list[tuple[list[str], np.ndarray]], Counter]:
    """Windows (tokens, tags) around base secrets, planted secrets, harmless things, unusual tokens and plain words; word counts."""
    rng, words = random.Random(seed), Counter()
    sorts: dict[str, list] = {name: [] for name in ("base", "planted", "harmless", "unusual", "plain")}
    pieces = []
    for text in texts:
        tokens, tags = tagged(text, base_spans(text))
        if not tokens:
            continue
        for t in rng.sample(tokens, min(len(tokens), 50)):
            if _PLAIN.fullmatch(t) and len(w := t.strip(_EDGES)) > 2:
                words[w] += 1

        def window(centre: int) -> tuple[list[str], np.ndarray]:
            a = min(max(0, centre - rng.randrange(WINDOW)), max(0, len(tokens) - WINDOW))
            return tokens[a : a + WINDOW], tags[a : a + WINDOW]

        sorts["base"] += map(window, np.flatnonzero(tags == BEGIN).tolist())
        odd = [k for k, t in enumerate(tokens) if not tags[k] and not _PLAIN.fullmatch(t)]
        sorts["unusual"] += map(window, rng.sample(odd, min(6, len(odd))))
        plain = window(rng.randrange(len(tokens)))
        sorts["plain"].append(plain)
        if not plain[1].any():
            pieces.append(plain[0])
    pool = [w for w, n in words.items() if w.isalpha()] or ["word"]
    for name, kinds in (("planted", planted), ("harmless", harmless)):
        for k in range(SAMPLE_WINDOWS if kinds else 0):
            piece = rng.choice(pieces) if pieces else []
            at = rng.randint(0, len(piece))
            made = list(kinds.values())[k % len(kinds)](rng, pool)
            before, after = " ".join(piece[:at]), " ".join(piece[at:])
            text = f"{before} {rng.choice(['', '', '(', chr(34)]) if name == 'planted' else ''}{made}{rng.choice(['', '', '', '.', ','])} {after}"
            start = text.index(made, len(before))
            spans = [("crf", start, start + len(made))] if name == "planted" else base_spans(text)
            tokens, tags = tagged(text, spans)
            a = max(0, min(at, len(tokens) - WINDOW) - rng.randrange(3))
            sorts[name].append((tokens[a : a + WINDOW], tags[a : a + WINDOW]))
    return [w for rows in sorts.values() for w in (rows if len(rows) <= SAMPLE_WINDOWS else rng.sample(rows, SAMPLE_WINDOWS))], words


def train_field(texts: list[str], planted: dict = PLANTED, harmless: dict = HARMLESS, seed: int = 17) -> Field | None:
    """Fit the field to windows of the texts; None without any secret to learn from."""
    windows, words = training_windows(texts, planted, harmless, seed)
    letters = Letters(words)
    tokens = Tokens(letters)
    if not any(tags.any() for _, tags in windows):
        return None
    size = SELF + 3 * CLASSES + FILE
    batches = []  # windows of one length together: features, tags as one-hot rows
    for length in sorted({len(w) for w, _ in windows}):
        rows = [(w, tags) for w, tags in windows if len(w) == length]
        x, y = np.zeros((len(rows), length, size), np.float32), np.zeros((len(rows), length, 3))
        for i, (window, tags) in enumerate(rows):
            numbers = [tokens[t] for t in window]
            classes = np.array([tokens.classes[k] for k in numbers])
            around, bucket = neighbours(classes), file_bucket(classes)
            for t, k in enumerate(numbers):
                x[i, t, tokens.features[k]] = 1
                x[i, t, SELF + around[t] + CLASSES * np.arange(3)] = 1
            x[i, :, SELF + 3 * CLASSES + bucket] = 1
            y[i, np.arange(length), tags] = 1
        batches.append((x.reshape(-1, size), y, np.einsum("nta,ntb->ab", y[:, :-1], y[:, 1:])))
    weights, change = np.zeros((size, 3)), np.zeros((3, 3))
    change[OUTSIDE, INSIDE] = -3.0
    moment = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(change), np.zeros_like(change)]

    def lse(a, axis):
        top = a.max(axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)

    def slopes(flat, y, seen_pairs):
        n, length, _ = y.shape
        scores = (flat @ weights.astype(np.float32)).reshape(n, length, 3).astype(float)
        ahead, behind = [scores[:, 0]], [np.zeros((n, 3))]
        for t in range(1, length):
            ahead.append(scores[:, t] + lse(ahead[-1][:, :, None] + change, 1))
        for t in range(length - 1, 0, -1):
            behind.append(lse(change + (scores[:, t] + behind[-1])[:, None, :], 2))
        ahead, behind = np.stack(ahead, 1), np.stack(behind[::-1], 1)
        total = lse(ahead[:, -1], 1)
        single = np.exp(ahead + behind - total[:, None, None])
        pairs = np.exp(ahead[:, :-1, :, None] + change + (scores + behind)[:, 1:, None, :] - total[:, None, None, None]).sum((0, 1))
        return flat.T @ (y - single).reshape(-1, 3).astype(np.float32), seen_pairs - pairs

    for step in range(1, STEPS + 1):
        found = [slopes(*b) for b in batches]
        for k, value in enumerate((weights, change)):
            slope = sum(f[k] for f in found) / len(windows) - 1e-3 * value
            m, v = moment[2 * k], moment[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(weights, change, letters)


def field_spans(text: str, tokens: Tokens, field: Field) -> list[tuple[str, int, int]]:
    """Spans (kind crf) that the field tags: from a begin tag to the end of its inside tags, edges stripped."""
    words = text.split()
    if not words:
        return []
    tags = field.tags(field.scores(tokens, np.array(list(map(tokens.__getitem__, words)))))
    if not tags:
        return []
    places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    found = []
    for k in sorted(tags):
        start, end = places[k]
        if tags[k] == INSIDE and found and found[-1][2] == k - 1:
            found[-1] = (found[-1][0], end, k)
        else:
            found.append((start, end, k))
    out = []
    for start, end, _ in found:
        piece = text[start:end]
        start += len(piece) - len(piece.lstrip(_EDGES))
        end -= len(piece) - len(piece.rstrip(_EDGES))
        if start < end:
            out.append(("crf", start, end))
    return out


def beyond(text: str, span: tuple[str, int, int], base: list[tuple[str, int, int]]) -> bool:
    """Whether a span has letters or digits that no base span covers."""
    _, at, end = span
    for _, start, stop in base:
        if start < end and stop > at:
            if any(map(str.isalnum, text[at:start])):
                return True
            at = stop
    return any(map(str.isalnum, text[at:end]))


def all_spans(text: str, tokens: Tokens, field: Field | None) -> tuple[list, list]:
    """(base spans, all spans): the field adds, whole, the spans that cover more than the base spans do."""
    base = base_spans(text)
    more = [s for s in field_spans(text, tokens, field) if beyond(text, s, base)] if field else []
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hint() -> Column:
    """Whether a text has what any base span has: such texts are sampled apart from the others, so rare secrets are in the sample."""
    low, found = F.lower("__text"), F.col("__text").contains("AKIA")
    for word in ASSIGN_HINTS:
        found = found | low.contains(word.decode())
    return found | F.col("__text").rlike("[0-9a-f]{24}")


def train(docs: DataFrame) -> Field | None:
    """Train on a bounded sample of ``docs`` (doc_id, text): half of it texts that may have base spans, half others."""
    rows = docs.select(text_or_empty().alias("__text")).where((F.length("__text") <= SAMPLE_CHARS) & (F.length("__text") > 0))
    drawn = sampled(rows, [F.col("__text")], SAMPLE_TEXTS // 2, F.length("__text"), SAMPLE_TOTAL // 2, by=_hint())
    return train_field(sorted(r[0] for r in drawn.select("__text").collect()))


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) of ``docs`` (doc_id, text)."""
    field = field or train(docs)
    tokens = field.tokens() if field else Tokens()

    def rows(ids, texts) -> Iterator[tuple]:
        for doc, text in zip(ids, texts, strict=True):
            base, spans = all_spans(text, tokens, field)
            counts = Counter(s[0] for s in spans)
            yield doc, counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), counts["crf"]

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_or_empty()), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def mask(text: str, spans: list[tuple[str, int, int]], word: str = "[SECRET]") -> str:
    """The text with each secret replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], word]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with every secret of its texts replaced; ``n_chars``, where there is one, follows the text."""
    tokens, names = field.tokens() if field else Tokens(), docs.columns
    place = names.index("text")
    bounded_batches(docs.sparkSession)
    counted = names.index("n_chars") if "n_chars" in names else None

    def apply(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = [t if t is None else mask(t, all_spans(t, tokens, field)[1]) for t in columns[place].to_pylist()]
            if counted is not None:
                old = zip(columns[counted].to_pylist(), columns[place].to_pylist(), texts, strict=True)
                columns[counted] = pa.array([n if a == b else len(b) for n, a, b in old], columns[counted].type)
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(apply, docs.schema)
