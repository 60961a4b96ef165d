"""Personal data: exact patterns, and spans that a character-level BiLSTM-CRF adds to them.

The network is trained in numpy, each time, on a bounded number of labelled windows: prose of the corpus into which
spans are put that the patterns need not find (addresses spelt with "at" and "dot", spaced or bracketed separators,
numbers without their plus, cards in odd groups or with letters in place of digits, keys and passwords), beside harmless
numbers, long ones too, and names. All texts are cut into overlapping windows; each window is decoded with the Viterbi
algorithm, and every character takes its tag from the window that holds it farthest from its ends, so the tags of a
text are reconciled before spans are read off, and a span may be longer than a window.

Pattern spans stay. Of the network's spans, those are added that lie clear of them, are sure (the odds of their path
against no span there) and hold what their kind needs at least. Secrets are a kind that only the network knows.

Defined results: a null text is empty and has no spans; a table without texts trains on made-up prose alone; null ids
stay null; repeated rows get equal results, each its own; a text of any length is read whole; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import give_back, text_groups, text_table

#: The kinds of the patterns; the network also knows secrets.
PATTERN_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*PATTERN_KINDS, "secret"]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > end and _LOCAL.match(text[left - 1]):
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the exact patterns, by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 14 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_AT, _DOT = r"(?:\s*@\s*|\s*[(\[]\s*at\s*[)\]]\s*|\s+at\s+)", r"(?:\s*\.\s*|\s*[(\[]\s*(?:dot|\.)\s*[)\]]\s*|\s+dot\s+)"
_SPELT = re.compile(rf"(?!at\b|dot\b)[a-z0-9_%+-]+(?:{_DOT}[a-z0-9_%+-]+)*{_AT}(?!at\b|dot\b)[a-z0-9-]+(?:{_DOT}(?!at\b|dot\b)[a-z0-9-]+)*{_DOT}(?!at\b|dot\b)[a-z][a-z0-9-]+", re.IGNORECASE)
_LOOKS = str.maketrans("OoIl", "0011")


def plausible(kind: str, piece: str) -> bool:
    """Whether what the network found holds what its kind needs, in whatever spelling.

    An address has a name, a host and an ending, with signs or words for at and dot between; numbers of an ip go up to
    255; a card's digits pass the check digit, letters that look like digits read as such; a phone number has ten digits
    or more in groups, or a plus or 00 before seven or more, and no more than fifteen.
    """
    if kind == "email":
        return bool(_SPELT.search(piece))
    if kind == "ip":
        numbers = re.findall("[0-9]+", piece)
        listed = re.search(r"[0-9]\.\s", piece)  # 1. 2. 3. 4. counts something
        return len(numbers) == 4 and not listed and all(len(x) < 4 and int(x) <= 255 for x in numbers)
    if kind == "card":
        digits = _NOT_DIGIT.sub("", piece.translate(_LOOKS))
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and _luhn(digits)
    if kind == "phone":
        digits, groups = len(_NOT_DIGIT.sub("", piece)), len(re.findall("[0-9]+", piece))
        return 7 <= digits <= 15 and (bool(re.match(r"\s*(?:\+|00)", piece)) or digits >= 10 and groups >= 3)
    return len(piece) >= 10 and any(c.isdigit() for c in piece)


# ---------------------------------------------------------------- labelled spans that the patterns need not find


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randrange(1, 10)) + "".join(str(rng.randrange(10)) for _ in range(n - 1))


def _letters(rng: random.Random, a: int, b: int, pool: str = string.ascii_lowercase) -> str:
    return "".join(rng.choices(pool, k=rng.randint(a, b)))


def _look_alike(rng: random.Random, text: str) -> str:
    return "".join({"0": "O", "1": "l"}.get(c, c) if rng.random() < 0.5 else c for c in text)


def _email(rng: random.Random) -> str:
    local = _letters(rng, 2, 9) + rng.choice(["", "." + _letters(rng, 2, 8), "." + _digits(rng, 2), _digits(rng, 2), "_" + _letters(rng, 1, 5)])
    at, dot = rng.choice([("@", "."), ("@", "."), (" @ ", "."), (" at ", " dot "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), (" @ ", " . ")])
    return local + at + _letters(rng, 3, 10) + rng.choice(["", _digits(rng, 1)]) + dot + rng.choice(["", _letters(rng, 3, 8) + dot]) + rng.choice(["com", "org", "net", "de", "fr", "es", "info", "io"])


def _address(rng: random.Random) -> str:
    return rng.choice([".", ".", ".", "[.]", " . ", " dot ", "(.)"]).join(str(rng.randrange(256)) for _ in range(4))


def _card(rng: random.Random) -> str:
    """Digits with their check digit, in spellings that the pattern often doesn't know."""
    raw = rng.choice("3456") + _digits(rng, rng.choice([11, 13, 14, 14, 14, 14, 17]))
    raw = next(raw + d for d in "0123456789" if _luhn(raw + d))
    if rng.random() < 0.8:
        raw = rng.choice([" ", "-", ".", "  ", "/", " - ", "_"]).join(raw[i : i + 4] for i in range(0, len(raw), 4))
    return _look_alike(rng, raw) if rng.random() < 0.25 else raw


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    body = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}{c}"])
    return rng.choice(["", "+1 ", "+1 ", f"+{_digits(rng, 2)} ", f"00{_digits(rng, 2)} ", "1-"]) + body


def _secret(rng: random.Random) -> str:
    mixed = string.ascii_letters + string.digits
    value = rng.choice([_letters(rng, 12, 40, "0123456789abcdef"), _letters(rng, 12, 40, "0123456789abcdef"), _letters(rng, 12, 40, mixed), _letters(rng, 10, 20, mixed + "!_-#%")])
    value += "" if any(c.isdigit() for c in value) else _digits(rng, 3)
    if rng.random() < 0.3:
        return rng.choice([_letters(rng, 4, 4, string.ascii_uppercase) + _letters(rng, 15, 16, string.ascii_uppercase + string.digits) + _digits(rng, 1), _letters(rng, 2, 4) + "_" + _letters(rng, 30, 36, mixed) + _digits(rng, 1), "ey" + _letters(rng, 16, 30, mixed) + _digits(rng, 1) + "." + _letters(rng, 12, 20, mixed)])
    name, sep, mark = rng.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "auth_token", "API_KEY", "SECRET"]), rng.choice(["=", " = ", ": ", ":"]), rng.choice(["", "", '"', "'"])
    return name + sep + mark + value + mark


def _harmless(rng: random.Random) -> str:
    """What looks like the above, but isn't."""
    n, word = rng.randrange, _letters(rng, 3, 9)
    long = _digits(rng, rng.randint(9, 19))
    if rng.random() < 0.2:  # long numbers without a meaning: what isn't labelled as a card or phone must not pass as one
        while len(long) > 12 and _luhn(long):
            long = _digits(rng, rng.randint(9, 19))
        grouped = rng.choice([" ", "-", "."]).join(long[i : i + 4] for i in range(0, len(long), 4))
        return rng.choice(["order number ", "item ", "order ", "invoice no. ", "ref. ", "id ", "isbn ", ""]) + rng.choice([long, long, grouped, _digits(rng, 8)])
    if rng.random() < 0.08:
        return rng.choice([" ".join([rng.choice(["at", "At", "dot", "AT"])] * rng.randint(2, 8)), f"{word} at {word} at {word}", f"{n(400) + 256}.{n(900)}.{n(900)}.{n(900)}", f"at {word}. At {word}"])
    return rng.choice([
        str(1900 + n(150)), f"{n(1000)}.{n(100)}", f"{n(100)}:{n(60):02d}", f"20{n(30):02d}-{n(12) + 1:02d}-{n(28) + 1:02d}", f"{n(28) + 1}.{n(12) + 1}.20{n(30):02d}", f"${n(1000)},{n(1000):03d}.{n(100):02d}", f"v{n(20)}.{n(20)}.{n(20)}",
        f"@{word}", f"{n(100)} %", _digits(rng, rng.randint(1, 8)), f"at {word} dot", f"{word} at {word}", f"http://{word}.com/{_letters(rng, 3, 9)}", f"www.{word}.org", f"the password {word}", f"token {word}", f"secret: {word}", f"#{_letters(rng, 6, 6, '0123456789abcdef')}", f"{n(100)}x{n(100)}",
        f"{word}_{word}", f"{word}.{word}()", word.upper(), f"{n(50)}-{n(99)}", f"({n(400)})", f"{n(10)}. {n(10)}. {n(10)}", "=" * rng.randint(3, 30), "-" * rng.randint(3, 30),
    ])


_MADE = {"email": _email, "ip": _address, "card": _card, "phone": _phone, "secret": _secret}


def labelled_text(rng: random.Random, prose: str) -> tuple[str, list[tuple[str, int, int]]]:
    """Prose with up to three pieces put between its words, and their spans; spans of the patterns in the prose count too."""
    spans = [(k, a, b) for k, a, b in pattern_spans(prose)]
    for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
        kind = rng.choice([*KINDS, None, None])
        piece = _MADE[kind](rng) if kind else _harmless(rng)
        gaps = [m.end() for m in re.finditer(r"\s", prose) if all(m.end() <= a or m.end() >= b for _, a, b in spans)] or [len(prose)]
        at, end = rng.choice(gaps), rng.choice([" ", " ", " ", ", ", ". ", "\n"])
        put = (" " if at and not prose[at - 1].isspace() else "") + piece + end
        start, size = at + len(put) - len(piece) - len(end), len(put)
        prose = prose[:at] + put + prose[at:]
        spans = [(k, a + size, b + size) if a >= at else (k, a, b) for k, a, b in spans]
        if kind:
            spans.append((kind, start, start + len(piece)))
    return prose, sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def labelled_windows(prose: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of n windows of labelled texts over the given prose, which is made up where there is none."""
    rng, xs, ys = random.Random(seed), [], []
    while len(xs) < n:
        text = prose[rng.randrange(len(prose))] if prose and rng.random() < 0.9 else " ".join(_letters(rng, 2, 9) for _ in range(12))
        text, spans = labelled_text(rng, text)
        s, y = symbols(text), tags_of(len(text), spans)
        inside = rng.choice(spans) if spans else None
        start = max(0, min((inside[1] if inside else rng.randrange(len(s))) - rng.randrange(TRAIN), len(s) - TRAIN))
        part, tags = s[start : start + TRAIN], y[start : start + TRAIN]
        fill = TRAIN - len(part)
        xs.append(np.concatenate([part, np.zeros(fill, part.dtype)]))
        ys.append(np.concatenate([tags, np.zeros(fill, tags.dtype)]))
        if (t := ys[-1][0]) > _K:
            ys[-1][0] = t - _K  # a window cut inside a span begins it
    return np.stack(xs), np.stack(ys)


# ---------------------------------------------------------------- the network

WINDOW, STRIDE, TRAIN = 512, 480, 80
MARGIN, CLASS = (WINDOW - STRIDE) // 2, 64
_K = len(KINDS)
TAGS = 1 + 2 * _K  # 0, then the begin of each kind, then the inside of each kind
_SYMBOLS = 102


def symbols(text: str) -> np.ndarray:
    """Symbol of each character: its own for printable ASCII, one for white space, letters and others beyond it; 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where((code >= 33) & (code < 127), code - 30, 1).astype(np.int64)
    out[(code == 32) | ((code >= 9) & (code <= 13))] = 2
    out[(code >= 0xC0) & (code < 0x250)] = 98
    return out


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Tags of a text's characters; where spans overlap or touch, the earlier one holds."""
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if not out[max(0, a - 1) : b].any():
            tag = 1 + KINDS.index(kind)
            out[a], out[a + 1 : b] = tag, tag + _K
    return out


def windows_of(length: int) -> np.ndarray:
    """Starts of the overlapping windows of a text."""
    return np.arange(0, max(1, length - 2 * MARGIN), STRIDE)


def allowed_steps() -> np.ndarray:
    """Which tag may follow which: an inside only its own begin or inside, a begin only 0, since spans never touch."""
    ok = np.ones((TAGS, TAGS), bool)
    ok[1:, 1:] = False
    for begin in range(1, 1 + _K):
        ok[:, begin + _K] = False
        ok[[begin, begin + _K], begin + _K] = True
    return ok


class BiLstmCrf:
    """A bidirectional LSTM over characters whose outputs are the emissions of a linear-chain CRF.

    A step of the LSTM reads two neighbouring characters and gives the emissions of both, to which each character adds
    some of its own; tags and the CRF go by single characters.
    """

    def __init__(self, hidden: int = 18, width: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h = hidden
        self.p = {"E": make(_SYMBOLS, width) * 3, "O": make(2 * hidden, 2 * TAGS), "D": np.zeros((_SYMBOLS, TAGS), np.float32), "o": np.zeros(2 * TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"V{d}": make(width, 4 * hidden), f"W{d}": make(width, 4 * hidden), f"U{d}": make(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1
        self.ban = np.where(allowed_steps(), 0, -1e4).astype(np.float32)
        self.tables: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": {}}

    def _inputs(self, d: str, pairs: np.ndarray, scale: np.ndarray, shift: np.ndarray, keep: bool):
        """A function of the step: what the two characters give to the gates. Outside training all pairs have a table, made once."""
        p = self.p
        one, two = (p["E"] @ p[f"V{d}"]) * scale, (p["E"] @ p[f"W{d}"] + p[f"c{d}"]) * scale + shift
        if keep:
            return lambda t, out: np.add(one[pairs[t] // _SYMBOLS], two[pairs[t] % _SYMBOLS], out=out)
        if d not in self.tables:
            self.tables[d] = (one[:, None] + two).reshape(_SYMBOLS * _SYMBOLS, -1)
        table = self.tables[d]
        return lambda t, out: np.take(table, pairs[t], axis=0, out=out, mode="clip")

    def _direction(self, d: str, pairs: np.ndarray, keep: bool):
        """Hidden states (steps x n x h). Gates are in the order input, forget, output (a fifth of the argument and a half, cut at 0 and 1), new (cut at -1 and 1, as are the cells where they are put out)."""
        h_, p = self.h, self.p
        (length, n), real = pairs.shape, p["E"].dtype
        scale, shift = np.ones(4 * h_, real), np.zeros(4 * h_, real)
        scale[: 3 * h_], shift[: 3 * h_] = 0.2, 0.5
        floor = shift * 2 - 1
        floor[: 3 * h_] = 0
        step, read = p[f"U{d}"] * scale, self._inputs(d, pairs, scale, shift, keep)
        h, c = np.zeros((n, h_), real), np.zeros((n, h_), real)
        out, saved = np.empty((length, n, h_), real), []
        z, more = np.empty((n, 4 * h_), real), np.empty((n, 4 * h_), real)
        small = np.empty((n, h_), real)
        i, f, o, g = z[:, :h_], z[:, h_ : 2 * h_], z[:, 2 * h_ : 3 * h_], z[:, 3 * h_ :]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            read(t, z)
            np.matmul(h, step, out=more)
            np.add(z, more, out=z)
            if keep:
                slope = np.where((z > floor) & (z < 1), scale, real.type(0))
            np.maximum(z, floor, out=z)
            np.minimum(z, 1, out=z)
            before, h_before = (c.copy(), h) if keep else (None, None)
            np.multiply(c, f, out=c)
            np.multiply(i, g, out=small)
            np.add(c, small, out=c)
            h = out[t]
            np.maximum(c, -1, out=h)
            np.minimum(h, 1, out=h)
            if keep:
                saved.append((t, *(v.copy() for v in (i, f, o, g)), before, h_before, h.copy(), np.abs(c) < 1, slope))
            np.multiply(h, o, out=h)
        return out, saved

    def _back(self, d: str, x: np.ndarray, saved: list, dout: np.ndarray, grads: dict) -> None:
        """x: one-hot rows of the first and of the second characters of all steps."""
        h_, p = self.h, self.p
        length, n, _ = dout.shape
        dh, dc = np.zeros((n, h_), dout.dtype), np.zeros((n, h_), dout.dtype)
        all_dz = np.empty((length, n, 4 * h_), dout.dtype)
        for t, i, f, o, g, before, h_before, squashed, c_slope, z_slope in reversed(saved):
            dh = dh + dout[t]
            dc = dc + dh * o * c_slope
            dz = np.concatenate([dc * g, dc * before, dh * squashed, dc * i], 1) * z_slope
            grads[f"U{d}"] += h_before.T @ dz
            all_dz[t] = dz
            dh, dc = dz @ p[f"U{d}"].T, dc * f
        flat = all_dz.reshape(n * length, -1)
        for name, one_hot in zip((f"V{d}", f"W{d}"), x):
            table = one_hot.T @ flat
            grads[name] += p["E"].T @ table
            grads["E"] += table @ p[name].T
        grads[f"c{d}"] += flat.sum(0)

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Emissions (length x tags x n) of an even number of characters, hidden states, and what training needs."""
        n, length = x.shape
        pairs = np.ascontiguousarray((x[:, 0::2] * _SYMBOLS + x[:, 1::2]).T)
        forward, sf = self._direction("f", pairs, keep)
        backward, sb = self._direction("b", pairs, keep)
        e = np.matmul(self.p["O"][: self.h].T, forward.transpose(0, 2, 1))
        e += np.matmul(self.p["O"][self.h :].T, backward.transpose(0, 2, 1))
        e += self.p["o"][:, None]
        e = e.reshape(length, TAGS, n)
        e += self.p["D"].T[:, x.T].transpose(1, 0, 2)
        return e, (forward, backward), sf, sb

    def _sums(self, e: np.ndarray):
        """Forward and backward log sums of the CRF, and the log of all paths."""
        step = (self.p["T"] + self.ban)[None]
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0]
        a[0][:, 1 + _K :] -= 1e4  # no text begins inside a span
        for t in range(1, len(e)):
            x = a[t - 1][:, :, None] + step
            m = x.max(1)
            a[t] = m + np.log(np.exp(x - m[:, None]).sum(1)) + e[t]
        for t in range(len(e) - 2, -1, -1):
            x = step + (e[t + 1] + b[t + 1])[:, None]
            m = x.max(2)
            b[t] = m + np.log(np.exp(x - m[:, :, None]).sum(2))
        m = a[-1].max(1)
        return a, b, m + np.log(np.exp(a[-1] - m[:, None]).sum(1))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tag rows y, and its gradients."""
        e, hidden, sf, sb = self.emissions(x, True)
        e = np.ascontiguousarray(e.transpose(0, 2, 1))
        a, b, z = self._sums(e)
        n, length = x.shape
        rows, step = np.arange(n), self.p["T"] + self.ban
        de, dt, loss = np.empty_like(e), np.zeros((TAGS, TAGS), e.dtype), float(z.sum())
        for t in range(length):
            de[t] = np.exp(a[t] + b[t] - z[:, None])
            de[t][rows, y[:, t]] -= 1
            loss -= float(e[t][rows, y[:, t]].sum())
            if t:
                dt += np.exp(a[t - 1][:, :, None] + step[None] + (e[t] + b[t] - z[:, None])[:, None]).sum(0)
                np.subtract.at(dt, (y[:, t - 1], y[:, t]), 1)
                loss -= float(step[y[:, t - 1], y[:, t]].sum())
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = de.reshape(length // 2, 2, n, TAGS).transpose(0, 2, 1, 3).reshape(length // 2, n, 2 * TAGS)
        grads["O"] = np.concatenate([np.tensordot(v, steps, ((0, 1), (0, 1))) for v in hidden])
        grads["o"], grads["T"] = steps.sum((0, 1)), dt
        one_hot = np.zeros((length, n, _SYMBOLS), de.dtype)
        np.put_along_axis(one_hot, x.T[:, :, None], 1, 2)
        grads["D"] = np.tensordot(one_hot, de, ((0, 1), (0, 1)))
        dhidden, halves = steps @ self.p["O"].T, [one_hot[i::2].reshape(-1, _SYMBOLS) for i in (0, 1)]
        self._back("f", halves, sf, dhidden[:, :, : self.h], grads)
        self._back("b", halves, sb, dhidden[:, :, self.h :], grads)
        return loss / n, {k: v / n for k, v in grads.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 100, rate: float = 0.02, seed: int = 6) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, loss = rng.permutation(len(x)), 0.0
            for i in range(0, len(x), batch):
                part = order[i : i + batch]
                value, grads = self.gradients(x[part], y[part])
                loss += value * len(part)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = g * min(1, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            losses.append(loss / len(x))
        self.tables = {}
        return losses

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags (n x length) of emissions (length x tags x n). Only steps that allowed_steps() allows are looked at."""
        length, _, n = e.shape
        trans, begin, inside = self.p["T"], slice(1, 1 + _K), slice(1 + _K, TAGS)
        leave, enter = trans[1:, 0][:, None], trans[0, begin][:, None]
        second, on = np.diagonal(trans[begin, inside])[:, None], np.diagonal(trans[inside, inside])[:, None]
        none, span = e[0, 0].copy(), e[0, 1:].copy()  # scores of 0, and of begins and insides
        span[_K:] = -1e4
        left, stayed = np.zeros((length, n), np.int8), np.empty((length, _K, n), bool)
        ends, b, i = np.empty_like(span), np.empty((_K, n), np.float32), np.empty((_K, n), np.float32)
        for t in range(1, length):
            np.add(span, leave, out=ends)
            np.add(span[:_K], second, out=b)
            np.add(span[_K:], on, out=i)
            np.greater(i, b, out=stayed[t])
            np.maximum(i, b, out=span[_K:])
            np.add(none, enter, out=span[:_K])
            np.add(span, e[t, 1:], out=span)
            none += trans[0, 0]
            best = np.maximum(ends[:_K], ends[_K:])
            best = reduce(np.maximum, best)
            over = np.flatnonzero(best > none)
            if len(over):
                left[t, over] = ends[:, over].argmax(0) + 1
                none[over] = best[over]
            none += e[t, 0]
        last = np.concatenate([none[None], span]).argmax(0)
        tags = np.zeros((length, n), np.int8)
        tags[-1] = last
        some = np.flatnonzero((last > 0) | left.any(0))  # elsewhere the best path never leaves 0
        now, rows = last[some], np.arange(len(some))
        left, stayed = np.ascontiguousarray(left[:, some]), np.ascontiguousarray(stayed[:, :, some])
        for t in range(length - 1, 0, -1):
            kind = np.maximum(now - 1, 0) % _K
            now = np.where(now == 0, left[t], np.where(now <= _K, 0, 1 + kind + _K * stayed[t][kind, rows]))
            tags[t - 1, some] = now
        return tags.T

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of each window, and how much each of them adds to the log odds of the path against 0 in its place."""
        e = self.emissions(x)[0]
        tags, gain = self.viterbi(e), np.zeros(x.shape, np.float32)
        rows = np.flatnonzero(tags.any(1))
        if len(rows):
            own = tags[rows].astype(np.int64)
            e = e[:, :, rows]
            gain[rows] = (np.take_along_axis(e, own.T[:, None], 1)[:, 0] - e[:, 0]).T
            steps = self.p["T"] - self.p["T"][0, 0]
            gain[rows, 1:] += steps[own[:, :-1], own[:, 1:]]
        return tags, gain


def model_spans(model: BiLstmCrf, texts: list[str], sure: float, chunk: int = 250_000) -> list[list[tuple[str, int, int]]]:
    """The network's spans of each text. Every window of every text is decoded; a character has its tag from the window that holds it farthest from its ends.

    sure: how likely the span must be against none, all else equal. chunk: characters of the windows decoded at once.
    """
    least = math.log(sure / (1 - sure))
    ends = np.cumsum([0, *map(len, texts)])
    coded = np.concatenate([*map(symbols, texts), np.zeros(WINDOW, np.int64)])
    begin = [windows_of(len(t)) + a for t, a in zip(texts, ends.tolist()) if t]
    if not begin:
        return [[] for _ in texts]
    of = np.repeat([i for i, t in enumerate(texts) if t], [len(b) for b in begin])
    begin = np.concatenate(begin)
    first, last = ends[of], ends[of + 1]
    low = np.where(begin == first, 0, MARGIN)
    high = np.where(begin + WINDOW >= last, last - begin, WINDOW - MARGIN)
    padded = np.minimum(-(-(last - begin) // CLASS) * CLASS, WINDOW)  # the last window of a text is filled up to its class of length only
    tags, odds = np.zeros(ends[-1], np.int8), np.zeros(ends[-1] + 1, np.float32)
    for length in np.unique(padded).tolist():
        offset, of_class = np.arange(length), np.flatnonzero(padded == length)
        for j in range(0, len(of_class), chunk // length):
            own = of_class[j : j + chunk // length, None]
            at = begin[own] + offset
            got, gain = model.decode(np.where(at < last[own], coded[at], 0))
            mine = (offset >= low[own]) & (offset < high[own])
            tags[at[mine]], odds[at[mine]] = got[mine], gain[mine]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for a in np.flatnonzero((tags > 0) & (tags <= _K)).tolist():
        i = int(np.searchsorted(ends, a, side="right")) - 1
        b, inside, end = a + 1, tags[a] + _K, ends[i + 1]
        while b < end and tags[b] == inside:
            b += 1
        kind = KINDS[int(tags[a]) - 1]
        piece = texts[i][a - ends[i] : b - ends[i]]
        if odds[a : b + 1].sum() >= least and plausible(kind, piece):
            first, last = _SPELT.search(piece).span() if kind == "email" else (0, len(piece))  # of an address, what spells it
            out[i].append((kind, a - int(ends[i]) + first, a - int(ends[i]) + last))
    return out


def train_model(texts: DataFrame, windows: int = 2400, pieces: int = 1500, seed: int = 17) -> BiLstmCrf:
    """A network trained on the given number of labelled windows. Their prose is pieces of at most 200 characters of the texts whose hashes are smallest."""
    key, length = F.xxhash64("text", F.lit(seed)), F.length("text")
    piece = F.col("text").substr((F.pmod(key, F.greatest(length - 200, F.lit(1)).cast("long")) + 1).cast("int"), F.lit(200))
    share = 4 * pieces / max(1, texts.count())  # of all hashes: so that tasks send the driver a few times the pieces between them, not each
    drawn = texts.filter((length > 0) & (F.pmod(key, F.lit(1 << 40)).cast("double") / float(1 << 40) <= share))
    rows = drawn.select(F.pmod(key, F.lit(1 << 40)).alias("key"), piece.alias("piece")).orderBy("key", "piece").limit(pieces).collect()
    prose = sorted({r["piece"] for r in rows})
    # digits that no pattern explains may be unlabelled personal data: such a piece would teach the opposite
    prose = [p for p in prose if all(any(a <= m.start() < b for _, a, b in pattern_spans(p)) for m in re.finditer("[0-9@]", p))]
    model = BiLstmCrf()
    model.train(*labelled_windows(prose, windows, seed))
    return model


def span_recall(model: BiLstmCrf, prose: list[str], n: int, seed: int, sure: float = 0.9) -> tuple[float, float]:
    """Of planted spans that no pattern finds, the share that overlaps a span of the network of the same kind; of the network's spans, the share that overlaps a planted or pattern span."""
    rng = random.Random(seed)
    made = [labelled_text(rng, prose[rng.randrange(len(prose))]) for _ in range(n)]
    found = model_spans(model, [t for t, _ in made], sure)
    meets = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    hard = [any(meets(s, f) for f in got) for (text, spans), got in zip(made, found) for s in spans if not any(meets(s, b) for b in pattern_spans(text))]
    right = [any(f[1] < s[2] and s[1] < f[2] for s in spans) for (_, spans), got in zip(made, found) for f in got]
    return sum(hard) / max(1, len(hard)), sum(right) / max(1, len(right))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", windows: int = 2400, sure: float = 0.9, model: BiLstmCrf | None = None) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, pattern), by start, then kind as listed; code points, end exclusive.

    windows: how many labelled windows the network is trained on, where no model is given. pattern: whether an exact
    pattern found the span.
    """
    texts = text_table(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model or train_model(texts, windows))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.bool_())]))

    def run(batches):
        for batch, group in text_groups(batches, limit=2_000_000):
            out: list[list] = []
            for text, more in zip(group, model_spans(shared.value, [t or "" for t in group], sure)):
                base = pattern_spans(text or "")
                clear = [s for s in more if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in clear], key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([dict(zip(("kind", "start", "end", "pattern"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])
        give_back()

    return texts.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,pattern:boolean>>")
