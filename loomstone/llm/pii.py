"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (email, ip, card, phone) give the base spans, which always stay. The model then labels whole segments of
tokens: a candidate segment of up to MAX_TOKENS tokens is scored by features of the whole span (its shape, digit count,
check sum, the words before it), neighbouring segments by their kinds, and dynamic programming over segments of bounded
length chooses boundaries and kinds jointly. Its spans that touch no base span are added; one kind, `secret`, has no
pattern. A span may have any number of characters.

A segment of a kind other than "none" consists of tokens with a digit or an @, and "none" segments are single tokens.
Other words have no kind and end a stretch of such tokens, so the best labelling of a text is made of the best
labellings of its stretches, and only these are decoded: exact, and linear in the text.

The weights are trained here, by gradient ascent on the conditional likelihood (forward and backward sums over
segments) of TRAIN_LINES generated lines; the number of lines is the bound of the sample and a parameter.

Defined cases: null text counts as empty (no spans); repeated rows give repeated rows; null ids stay null. Offsets are
code points, the end exclusive. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: What follows the kinds in the model: tokens of no kind, and the begin of a stretch.
NONE, START = len(KINDS), len(KINDS) + 1
MAX_TOKENS = 6
TRAIN_LINES = 600
EPOCHS = 12
SEED = 42

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_BEFORE = re.compile(r"([^\x20\x09-\x0D]*)[\x20\x09-\x0D]*\Z")
_SIGNAL = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (x * 2 if x < 5 else x * 2 - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        elif start < at:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    if not _SIGNAL.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- the model


#: Words before a span that tell its kind.
CUES = {
    "email": ("email", "e-mail", "mail", "mailto", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "iban", "account", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "password", "key", "apikey", "api_key", "bearer", "="),
}
_EDGES = "\"'`.,;:!?()[]{}<>|=#$%&*"


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without quotes and punctuation at its ends (an opening bracket of a phone number stays)."""
    while start < end and text[start] in _EDGES and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    while end > start and text[end - 1] in _EDGES:
        end -= 1
    return start, end


def features(text: str, start: int, end: int, tokens: int) -> list[str]:
    """Features of the whole span, once trimmed."""
    body = text[start:end]
    digits = sum("0" <= c <= "9" for c in body)
    letters = sum(c.isalpha() for c in body)
    out = ["bias", f"tokens={tokens}", f"digits={min(digits, 20)}", f"letters={'0' if not letters else '<half' if letters * 2 < len(body) else '>half'}"]
    only = "".join(c for c in body if "0" <= c <= "9")
    if body.count("@") == 1:
        local, _, domain = body.partition("@")
        out.append("at")
        if local and "." in domain and domain[0] != "." and not any(c.isspace() for c in body):
            out.append("mailbox")
    parts = body.split(".")
    if len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 for p in parts):
        out += ["quad", "octets" if all(int(p) < 256 for p in parts) else "no-octets"]
    if letters == 0 and re.fullmatch(r"[0-9 -]+", body):
        out.append("groups")
        if 13 <= digits <= 19:
            out += ["card-long", "check" if luhn(only) else "no-check"]
    if re.fullmatch(r"\+?[0-9() .\-/]+", body) and 7 <= digits <= 15:
        out += ["dial", "plus" if body[0] == "+" else "no-plus"]
        if re.search(r"[() \-.]", body):
            out.append("dial-split")
    if re.fullmatch(r"[0-9a-fA-F]+", body) and len(body) >= 20:
        out += ["hex", "hex-even" if len(body) in (32, 40, 64, 128) else "hex-odd"]
    if len(body) >= 16 and letters and digits >= 3 and re.fullmatch(r"[A-Za-z0-9_\-+/=]+", body):
        out.append("dense")
    out.append(f"length={min(len(body).bit_length(), 8)}")
    before = _BEFORE.search(text, max(0, start - 40), start)
    words = [w.strip(_EDGES).lower() for w in text[max(0, start - 40) : start].split()[-3:]]
    if before and "=" in text[max(0, start - 3) : start]:
        words.append("=")
    for kind, cues in CUES.items():
        if any(w in cues for w in words):
            out.append(f"cue={kind}")
    return out


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that have a digit or an @."""
    run: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        if run and (m.start() - run[-1][1] > 4 or not text[run[-1][1] : m.start()].strip("\x20\x09\x0a\x0b\x0c\x0d") == ""):
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


class SemiCrf:
    """Weights by (kind, feature) for whole segments, and by (kind before, kind) for neighbouring ones.

    Kind NONE is a single token; its segment scores 0, its transitions do not. START is what a stretch begins with.
    """

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def candidates(self, text: str, run: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int, np.ndarray]]:
        """By (first token, number of tokens): the trimmed span and its feature numbers."""
        out = {}
        for i in range(len(run)):
            for n in range(1, min(MAX_TOKENS, len(run) - i) + 1):
                start, end = trimmed(text, run[i][0], run[i + n - 1][1])
                if start < end:
                    ids = [self.index[f] for f in features(text, start, end, n) if f in self.index]
                    out[i, n] = (start, end, np.array(ids, np.int64))
        return out

    def scores(self, cands: dict) -> dict[tuple[int, int], np.ndarray]:
        return {k: self.weights[:, ids].sum(axis=1) for k, (_, _, ids) in cands.items()}

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best segmentation of each stretch: over segments ending at each token, by the kind of the last one."""
        out = []
        for run in stretches(text):
            cands = self.candidates(text, run)
            scores = self.scores(cands)
            best = np.full((len(run) + 1, START + 1), -np.inf)
            best[0, START] = 0.0
            back: list[list[tuple[int, int]]] = [[(0, START)] * (START + 1) for _ in range(len(run) + 1)]
            into = [best[0][:, None] + self.moves]
            for j in range(1, len(run) + 1):
                for n in range(1, min(MAX_TOKENS, j) + 1):
                    arrive = into[j - n]
                    s = scores.get((j - n, n))
                    kinds = [*(range(NONE) if s is not None else ()), *([NONE] if n == 1 else ())]
                    for kind in kinds:
                        before = int(arrive[:, kind].argmax())
                        value = arrive[before, kind] + (s[kind] if kind < NONE else 0.0)
                        if value > best[j, kind]:
                            best[j, kind], back[j][kind] = value, (n, before)
                into.append(best[j][:, None] + self.moves)
            j, kind, found = len(run), int(best[len(run)].argmax()), []
            while j > 0:
                n, before = back[j][kind]
                if kind < NONE:
                    start, end, _ = cands[j - n, n]
                    found.append((KINDS[kind], start, end))
                j, kind = j - n, before
            out += found[::-1]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(scores: dict, n_tokens: int, moves: np.ndarray) -> tuple[float, dict[tuple[int, int], np.ndarray], np.ndarray]:
    """log of the sum over all segmentations, each segment's probability by kind, and the expected number of each move."""
    emit = {(i, n): np.append(s, 0.0 if n == 1 else -np.inf) for (i, n), s in scores.items()}
    for i in range(n_tokens):
        emit.setdefault((i, 1), np.append(np.full(NONE, -np.inf), 0.0))
    fwd, bwd = np.full((n_tokens + 1, START + 1), -np.inf), np.full((n_tokens + 1, START + 1), -np.inf)
    fwd[0, START], bwd[n_tokens] = 0.0, 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        arrive = [_logsum(fwd[0][:, None] + moves, 0)]
        for j in range(1, n_tokens + 1):
            ends = [arrive[j - n] + emit[j - n, n] for n in range(1, min(MAX_TOKENS, j) + 1) if (j - n, n) in emit]
            fwd[j, :START] = _logsum(np.stack(ends), 0)
            arrive.append(_logsum(fwd[j][:, None] + moves, 0))
        after = [np.zeros(0)] * n_tokens
        for j in range(n_tokens - 1, -1, -1):
            starts = [emit[j, n] + bwd[j + n, :START] for n in range(1, min(MAX_TOKENS, n_tokens - j) + 1) if (j, n) in emit]
            after[j] = _logsum(np.stack(starts), 0)
            bwd[j] = _logsum(moves + after[j][None, :], 1)
        z = float(_logsum(fwd[n_tokens], 0))
        probs = {(i, n): np.exp(arrive[i] + e + bwd[i + n, :START] - z) for (i, n), e in emit.items()}
        steps = sum(np.exp(fwd[j][:, None] + moves + after[j][None, :] - z) for j in range(n_tokens))
    return z, probs, steps


def training_lines(count: int = TRAIN_LINES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated lines with their spans; half of the pieces with digits are no personal data."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = num(15)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        return full if r.random() < 0.5 else r.choice(" -").join(full[i : i + 4] for i in range(0, 16, 4))

    makers = {
        "email": lambda: f"{word()}{r.choice(['.', '_', ''])}{r.choice([word(), num(2)])}@{word()}{r.choice(['', num(1)])}.{r.choice(['com', 'org', 'example.net'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"]),
        "secret": lambda: r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), "".join(r.choice(letters + letters.upper() + "0123456789") for _ in range(r.randint(24, 44))) + "7a1"]),
    }
    plain = [lambda: num(r.randint(1, 5)), lambda: f"{num(4)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{num(2)}:{num(2)}", lambda: f"{word()}{num(2)}", lambda: f"{num(3)}.{num(2)}", lambda: num(r.randint(9, 24)), lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"@{word()}", lambda: f"{num(2)} {num(3)}"]
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(4, 14)):
            roll = r.random()
            if roll < 0.25:
                kind = r.choice(KINDS)
                if r.random() < 0.4:
                    cue = r.choice(CUES[kind])
                    text += f"{cue} {'= ' if kind == 'secret' and cue != '=' and r.random() < 0.7 else ''}"
                quote = '"' if kind == "secret" and r.random() < 0.5 else ""
                body = makers[kind]()
                spans.append((kind, len(text) + len(quote), len(text) + len(quote) + len(body)))
                text += quote + body + quote + r.choice(["", "", ".", ","]) + " "
            elif roll < 0.45:
                text += r.choice(plain)() + r.choice(["", ".", ","]) + " "
            else:
                text += word() + " "
            if r.random() < 0.8:
                text += word() + " "
        out.append((text, spans))
    return out


_trained: dict[tuple[int, int, int], SemiCrf] = {}


def train(count: int = TRAIN_LINES, epochs: int = EPOCHS, seed: int = SEED) -> SemiCrf:
    """The model of these parameters, which alone decide it; a driver fits it once."""
    if (count, epochs, seed) not in _trained:
        _trained[count, epochs, seed] = fit(count, epochs, seed)
    return _trained[count, epochs, seed]


def fit(count: int, epochs: int, seed: int) -> SemiCrf:
    """Adaptive gradient ascent on the conditional likelihood with a small L2 penalty."""
    lines = training_lines(count, seed)
    names: set[str] = set()
    for text, _ in lines:
        for run in stretches(text):
            for i in range(len(run)):
                for n in range(1, min(MAX_TOKENS, len(run) - i) + 1):
                    start, end = trimmed(text, run[i][0], run[i + n - 1][1])
                    if start < end:
                        names.update(features(text, start, end, n))
    index = {f: i for i, f in enumerate(sorted(names))}
    model = SemiCrf(index, np.zeros((len(KINDS), len(index))), np.zeros((START + 1, START)))
    items = []
    for text, spans in lines:
        gold = {(s, e): KINDS.index(k) for k, s, e in spans}
        for run in stretches(text):
            cands = model.candidates(text, run)
            if cands:
                truth = sorted((k, gold[c[:2]]) for k, c in _cover(cands, gold))
                items.append((len(run), cands, truth, _moves(len(run), truth)))
    square, moved, rng = np.full_like(model.weights, 1e-8), np.full_like(model.moves, 1e-8), random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(items)
        for n_tokens, cands, truth, seen in items:
            _, probs, steps = gradient(model.scores(cands), n_tokens, model.moves)
            step = -1e-4 * model.weights
            for k, (_, _, ids) in cands.items():
                if probs[k][:NONE].max() > 1e-6:
                    step[:, ids] -= probs[k][:NONE, None]
            for k, kind in truth:
                step[kind, cands[k][2]] += 1
            square += step * step
            model.weights += 0.3 * step / np.sqrt(square)
            step = seen - steps - 1e-4 * model.moves
            moved += step * step
            model.moves += 0.3 * step / np.sqrt(moved)
    return model


def _moves(n_tokens: int, truth: list[tuple[tuple[int, int], int]]) -> np.ndarray:
    """How often each kind follows each other one, tokens outside `truth` being of no kind."""
    out, before, at = np.zeros((START + 1, START)), START, 0
    for (i, n), kind in [*truth, ((n_tokens, 0), -1)]:
        for k in [NONE] * (i - at) + [kind] * (kind >= 0):
            out[before, k] += 1
            before = k
        at = i + n
    return out


def _cover(cands: dict, gold: dict) -> Iterator[tuple[tuple[int, int], tuple]]:
    """The candidate segments that are gold spans, each with its fewest tokens."""
    done: set[tuple[int, int]] = set()
    for k in sorted(cands, key=lambda k: (k[1], k[0])):
        span = cands[k][:2]
        if span in gold and span not in done:
            done.add(span)
            yield k, cands[k]


def all_spans(text: str, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base spans and the model's other spans), each by kind as listed, then start."""
    base = base_spans(text)
    taken = [(s, e) for _, s, e in base]
    more = [x for x in model.decode(text) if all(x[2] <= s or x[1] >= e for s, e in taken)] if _SIGNAL.search(text) else []
    return base, sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_personal_data(docs: DataFrame, model: SemiCrf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of every row's whole text."""
    model = model or train()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text, model)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).mapInArrow(find, OUT)
