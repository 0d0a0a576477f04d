"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF, trained in numpy from labelled spans."""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# The pieces of the first two, that a text is walked by.
_LOCAL, _HOST, _CHAIN = re.compile(r"[A-Za-z0-9._%+-]++"), re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+"), re.compile(r"[0-9]++(?:\.[0-9]++)*+")
#: The most characters of a span by the model; a tagged run that is longer is none.
LONGEST = 320
#: A window of characters, and the step from one to the next.
WINDOW, STEP = 96, 48
#: Labelled examples that the default model learns from.
EXAMPLES = 2400
ROUNDS = 360
#: Characters on either side of a tagged run in which the whole of what it belongs to is looked for.
BESIDE = 64
#: What each kind of span has somewhere, also where it is written out: a digit, an @, a point in words, or brackets about at and dot.
_TRIGGER = re.compile(r"[0-9@]|\bdot\b|[(\[{] ?(?:at|dot)\b", re.I)
_PLAIN = re.compile("[0-9@]")
# What a span that the model finds must look like besides, looser than the base patterns.
PLAUSIBLE = {
    "email": re.compile(r"[\w.%+-]+(?: ?(?:[(\[{] ?dot ?[)\]}]|\bdot\b) ?[\w-]+)*+ ?(?:@|[(\[{] ?(?:at|@) ?[)\]}]|\bat\b) ?[\w-]+(?: ?(?:\.|[(\[{] ?(?:dot|\.) ?[)\]}]|\bdot\b) ?[\w-]+)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}( ?[.,] ?| ?[(\[{]\.[)\]}] ?| dot )[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}", re.I),
    "card": re.compile(r"[0-9](?:[\x20./_-]{0,3}[0-9])+"),
    "phone": re.compile(r"(?:\+|00)?[\x20(]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9])+"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """What a match of a kind's pattern has to hold besides."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in text.split(".")))
    digits = "".join(c for c in text if "0" <= c <= "9")
    return 9 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and luhn(digits)


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the model finds can be what it says, also in forms that the base patterns don't know."""
    if not PLAUSIBLE[kind].fullmatch(text):
        return False
    if kind == "email":
        return len(text) <= 254 and sum(map(str.isalpha, text)) >= 4
    if kind == "ip":
        return all(int(n) <= 255 for n in re.findall("[0-9]+", text))
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    # a bare run of digits is no phone, nor are groups of any sizes, but a number with a prefix, with an area code in brackets or after a 0, or in groups of 3, 3 and 4
    groups, head = [len(g) for g in re.findall("[0-9]+", text)], text.lstrip()
    area = head.startswith(("+", "(", "00")) or (head[0] == "0" and len(digits) >= 10 and head.lstrip("0123456789")[:1] in ("/", " "))
    return 9 <= len(digits) <= 15 and digits != text and (area or groups == [3, 3, 4])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches that do not overlap, for each kind by itself; those that are not valid are dropped, and not tried again."""
    if not _PLAIN.search(text):
        return []
    return [(k, a, b) for k, found in (("email", _emails(text)), ("ip", _dotted(text)), *((k, (m.span() for m in PATTERNS[k].finditer(text))) for k in ("card", "phone"))) for a, b in found if valid(k, text[a:b])]


def _emails(text: str):
    """Matches of the pattern, in time that grows with the text: each run of characters before an @ is walked once, whatever stands in it."""
    at = 0
    for run in _LOCAL.finditer(text):
        start, end = max(run.start(), at), run.end()
        if start < end and text.startswith("@", end) and (host := _HOST.match(text, end + 1)):
            at = host.end()
            yield start, at


def _dotted(text: str):
    """Matches of the pattern, likewise: each chain of numbers and points is walked once and taken four numbers at a time."""
    for chain in _CHAIN.finditer(text):
        at, numbers = chain.start(), chain[0].split(".")
        for k in range(0, len(numbers) - 3, 4):
            size = sum(map(len, numbers[k : k + 4])) + 3
            yield at, at + size
            at += size + 1


#: Characters with a class of their own. 0 is padding; other ASCII, letters beyond ASCII and the rest share one each.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ \n\t.,;:!?@+-_()[]{}<>|/\\#%&*=\"'$~"
N_CLASSES = 4 + len(ALPHABET)
_ONE = np.eye(N_CLASSES)


def _look() -> np.ndarray:
    look = np.full(1 << 16, 3, np.int64)
    look[:128] = 1
    look[[c for c in range(128, 1 << 16) if chr(c).isalpha()]] = 2
    look[[ord(c) for c in ALPHABET]] = 4 + np.arange(len(ALPHABET))
    return look


_LOOK: list[np.ndarray] = []


def _classes(texts: list[str], width: int) -> np.ndarray:
    """The class of each character, 0 where a text has ended."""
    if not _LOOK:
        _LOOK.append(_look())
    out = np.zeros((len(texts), width), np.int64)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, : len(c)] = _LOOK[0][np.minimum(c, (1 << 16) - 1)]
    return out


class Tagger:
    """Tags (none, email, ip, card, phone) by emissions of a BiLSTM and transitions of a linear-chain CRF."""

    def __init__(self, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        h, k = hidden, len(KINDS) + 1
        self.hidden = h
        g = lambda *s: r.normal(0, 0.3, s)
        self.p = {f"E{d}": g(N_CLASSES, 4 * h) for d in "fb"} | {f"R{d}": g(h, 4 * h) for d in "fb"} | {"O": g(2 * h, k), "o": np.zeros(k), "T": np.eye(k) * 1.0}
        for d in "fb":
            self.p[f"E{d}"][:, h : 2 * h] += 1.0  # forget gates begin open

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (steps, rows, hidden) in one direction; with keep, also what the backward pass needs."""
        h, steps, rows = self.hidden, x.shape[1], len(x)
        E, R = self.p[f"E{d}"], self.p[f"R{d}"]
        zeros = lambda *size: np.zeros(size, E.dtype)
        out, cells, gates = zeros(steps, rows, h), zeros(steps, rows, h), zeros(steps, rows, 4 * h) if keep else None
        state, cell = zeros(rows, h), zeros(rows, h)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = E[x[:, t]] + state @ R
            s = 1 / (1 + np.exp(-z[:, : 3 * h]))
            g = np.tanh(z[:, 3 * h :])
            real = (x[:, t] > 0)[:, None]
            cell = np.where(real, s[:, h : 2 * h] * cell + s[:, :h] * g, 0)
            state = np.where(real, s[:, 2 * h :] * np.tanh(cell), 0)
            out[t], cells[t] = state, cell
            if keep:
                gates[t, :, : 3 * h], gates[t, :, 3 * h :] = s, g
        return out, cells, gates

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, b = self._lstm(x, "f", keep), self._lstm(x, "b", keep)
        both = np.concatenate([f[0], b[0]], axis=2)
        return both @ self.p["O"] + self.p["o"], both, f, b

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each row (Viterbi); 0 in the padding."""
        e = self.emissions(x)[0]
        steps, rows, k = e.shape
        score, back = e[0], np.zeros((steps, rows, k), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + self.p["T"]
            back[t] = all_.argmax(1)
            score = np.where((x[:, t] > 0)[:, None], all_.max(1) + e[t], score)
            back[t][x[:, t] == 0] = np.arange(k)
        out = np.zeros((rows, steps), np.int8)
        tag = score.argmax(1)
        for t in range(steps - 1, -1, -1):
            out[:, t] = tag
            tag = back[t][np.arange(rows), tag]
        return np.where(x > 0, out, 0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the negative log likelihood of the tags, by forward-backward over the CRF and back through both LSTMs."""
        e, both, f, b = self.emissions(x, keep=True)
        steps, rows, k = e.shape
        T, real = self.p["T"], (x > 0).T
        soft = lambda a, axis: (m := a.max(axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = np.where(real[t][:, None], soft(alpha[t - 1][:, :, None] + T, 1) + e[t], alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(real[t + 1][:, None], soft(T + (beta[t + 1] + e[t + 1])[:, None, :], 2), beta[t + 1])
        z = soft(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None]) * real[:, :, None]
        gold = np.eye(k, dtype=e.dtype)[y.T] * real[:, :, None]
        de -= gold
        both_real = real[1:] & real[:-1]
        pair = np.exp(alpha[:-1, :, :, None] + T + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]) * both_real[:, :, None, None]
        dT = pair.sum((0, 1)) - np.einsum("tri,trj->ij", gold[:-1], gold[1:])
        g = {"T": dT, "o": de.sum((0, 1)), "O": np.einsum("trh,trk->hk", both, de)}
        d_both, h, one = de @ self.p["O"].T, self.hidden, _ONE.astype(T.dtype)
        for d, (out, cells, gates), part in (("f", f, d_both[:, :, :h]), ("b", b, d_both[:, :, h:])):
            E, R = np.zeros_like(self.p[f"E{d}"]), np.zeros_like(self.p[f"R{d}"])
            order = list(range(steps)) if d == "f" else list(range(steps - 1, -1, -1))
            dh, dc = np.zeros((2, rows, h), E.dtype)
            for n in range(steps - 1, -1, -1):
                t = order[n]
                before = order[n - 1] if n else None
                c_before = cells[before] if n else np.zeros((rows, h), E.dtype)
                h_before = out[before] if n else np.zeros((rows, h), E.dtype)
                i_, f_, o_, g_ = (gates[t, :, j * h : (j + 1) * h] for j in range(4))
                tc = np.tanh(cells[t])
                on = real[t][:, None]
                dht = (part[t] + dh) * on
                dct = (dc + dht * o_ * (1 - tc * tc)) * on
                dz = np.concatenate([dct * g_ * i_ * (1 - i_), dct * c_before * f_ * (1 - f_), dht * tc * o_ * (1 - o_), dct * i_ * (1 - g_ * g_)], axis=1)
                E += one[x[:, t]].T @ dz
                R += h_before.T @ dz
                dh, dc = dz @ self.p[f"R{d}"].T, dct * f_
            g[f"E{d}"], g[f"R{d}"] = E, R
        return {key: (v / rows).astype(T.dtype) for key, v in g.items()}

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS, rows: int = 48, rate: float = 0.025, seed: int = 3) -> Tagger:
        """Adam over shuffled batches of (text, spans)."""
        texts = [t[:WINDOW] for t, _ in examples]
        x = _classes(texts, WINDOW)
        y = np.zeros_like(x)
        for i, (_, spans) in enumerate(examples):
            for kind, a, b in spans:
                y[i, a:b] = KINDS.index(kind) + 1
        r = np.random.default_rng(seed)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for n in range(1, rounds + 1):
            pick = r.choice(len(x), min(rows, len(x)), replace=False)
            for k, g in self.gradients(x[pick], y[pick]).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                self.p[k] -= rate * min(1, 2 * (1 - n / (rounds + 1))) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v2[k] / (1 - 0.99**n)) + 1e-8)
        return self


def _luhn_digits(r, n: int) -> str:
    d = "".join(str(x) for x in r.integers(0, 10, n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def written(kind: str, r, word, plain: bool) -> str:
    """One piece of data of a kind: plain as the base patterns have it, else in a form that they don't know."""
    pick = lambda xs: xs[r.integers(len(xs))]
    digits = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    if kind == "email":
        name, host = pick([word(), f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}.{word()}"]), pick([f"mail{digits(1)}.{word()}", word(), word()])
        end = pick(["com", "org", "net", "de", "example", "io"])
        if plain:
            return f"{name}@{host}.{end}"
        at, dot = pick([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), ("[at]", "."), (" @ ", " . "), (" (at) ", ".")])
        return (name + at + host).replace(".", dot) + dot + end
    if kind == "ip":
        return pick(["."] if plain else ["[.]", "(.)", " . ", " dot "]).join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        d = _luhn_digits(r, 16)
        if plain and r.random() < 0.4:
            return d
        return pick(["-", " "] if plain else [".", "/", "  ", " - ", "_"]).join(d[k : k + 4] for k in (0, 4, 8, 12))
    d = digits(10)
    if plain:
        return pick([f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"+{digits(2)} {d[:3]} {d[3:6]} {d[6:]}", f"+1.{d[:3]}.{d[3:6]}.{d[6:]}"])
    return pick([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits(2)} {d[:3]} {d[3:6]} {d[6:]}", f"0{d[:3]}/{d[3:]}", f"({d[:3]}){d[3:6]} {d[6:]}", f"+1/{d[:3]}/{d[3:]}"])


def labelled_examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled spans to learn from where no others are given: invented words in which data of each kind stands, often side by side, in the forms of the base patterns and in others."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[r.integers(len(xs))]
    digits = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    word = lambda: "".join(pick("aaeeiioouulnrstdhmcgbpfvwykzjxqéüñèßó") for _ in range(r.integers(2, 10)))
    ascii_word = lambda: "".join(pick("aaeeiioulnrstdhmcgbpfvwyk") for _ in range(r.integers(3, 9)))
    # what looks like data and is none
    other = [
        lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', lambda: digits(r.integers(1, 8)), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f"at {word()} {word()}", lambda: f"{word()} at {digits(2)}:{digits(2)}", lambda: f"a dot on {word()}", lambda: f"#{digits(6)}",
        lambda: f"{digits(5)}-{digits(4)}", lambda: f"https://{ascii_word()}.org/{digits(4)}", lambda: f"{digits(1)}. {word()}", lambda: f"{digits(3)} {word()} {digits(4)}", lambda: f"[{digits(1)}] {word()} ({digits(4)})", lambda: digits(r.integers(9, 13)),
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            u = r.random()
            if u < 0.3:
                plain = r.random() < 0.4
                kind = pick(KINDS if plain else ("email", "email", "email", *KINDS))  # addresses in words are the hardest to learn
                s = written(kind, r, ascii_word, plain)
                if len(text) + len(s) > WINDOW:
                    break
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + pick([" ", " ", " ", ", ", ". ", "\n", " | ", "!! "])
            elif u < 0.4:
                text += pick(other)() + pick([" ", ", ", ". "])
            else:
                w = word()
                u = r.random()
                text += (w.capitalize() if u < 0.15 else w.upper() if u < 0.2 else w) + pick([" ", " ", " ", " ", ", ", ". ", ".\n", "!! "])
        out.append((text[:WINDOW], spans))
    return out


_MODELS: dict[tuple, Tagger] = {}


def default_model(examples: int = EXAMPLES, rounds: int = ROUNDS) -> Tagger:
    """The model of the default examples; it is the same in each run and trained once in a driver."""
    if (examples, rounds) not in _MODELS:
        _MODELS[examples, rounds] = Tagger().fit(labelled_examples(examples), rounds)
    return _MODELS[examples, rounds]


def save_model(spark: SparkSession, model: Tagger, path: str) -> None:
    """Writes the model as a table of its arrays, for load_model: so that it is learned once and not in each driver."""
    rows = [(k, list(v.shape), v.astype(np.float64).reshape(-1).tolist()) for k, v in sorted(model.p.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Tagger:
    """What save_model wrote; a dozen rows, as large as the model."""
    model = Tagger(0)
    model.p = {r["name"]: np.array(r["numbers"], np.float32).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
    model.hidden = len(model.p["Rf"])
    return model


def model_spans(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans by the model: windows are decoded, and each character takes its tag from the window in whose middle it lies most.

    A span holds a digit, an @, or words or brackets that stand for it, so the windows over such a place, and one more on either side,
    are decoded; those are all that a span reaches into which goes on for at most 48 characters from it. A tagged run without such a place is no span.
    Runs go on over the borders of windows, as tags are put together first.
    """
    where, pieces = [], []
    for i, t in enumerate(texts):
        seen = -1
        for m in _TRIGGER.finditer(t):
            # the windows over this place, those that begin at a multiple of STEP, and their neighbours
            last = min(m.start() // STEP + 1, max(0, len(t) - 1) // STEP)
            for w in range(max(seen + 1, (m.start() - WINDOW) // STEP, 0), last + 1):
                where.append((i, w * STEP))
                pieces.append(t[w * STEP : w * STEP + WINDOW])
                seen = w
    side = (WINDOW - STEP) // 2
    hits: list[list[np.ndarray]] = [[] for _ in texts]
    for a in range(0, len(pieces), 2048):
        got = model.decode(_classes(pieces[a : a + 2048], WINDOW))
        for r in np.flatnonzero(got.any(1)).tolist():
            i, at = where[a + r]
            # a window speaks for its middle, at the text's ends also for its side
            lo = 0 if at == 0 else side
            hi = len(pieces[a + r]) if at + WINDOW >= len(texts[i]) else WINDOW - side
            j = lo + np.flatnonzero(got[r, lo:hi])
            if len(j):
                hits[i].append(np.stack([at + j, got[r, j]]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, found in enumerate(hits):
        if not found:
            continue
        p, tag = np.concatenate(found, axis=1)
        first = np.argsort(p, kind="stable")
        p, tag = p[first], tag[first]
        once = np.r_[True, p[1:] != p[:-1]]
        p, tag = p[once], tag[once]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1] + 1) | (tag[1:] != tag[:-1])])
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(p)]):
            s, e = int(p[a]), int(p[b - 1]) + 1
            while s < e and not (texts[i][s].isalnum() or texts[i][s] in "+("):
                s += 1
            while e > s and not texts[i][e - 1].isalnum():
                e -= 1
            if s < e <= s + LONGEST and _TRIGGER.search(texts[i], s, e):
                out[i].append((KINDS[int(tag[a]) - 1], s, e))
    return out


def completed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """A tagged run (of LONGEST characters at most) that is not plausible as it stands, widened (or cut) to the plausible piece of text that shares most with it, if there is one."""
    if not plausible(kind, text[a:b]):
        low = max(0, a - BESIDE)
        near = [(min(e, b) - max(s, a), -s, s, e) for s, e in ((low + m.start(), low + m.end()) for m in PLAUSIBLE[kind].finditer(text[low : b + BESIDE])) if s < b and a < e]
        if near and 2 * max(near)[0] >= b - a:
            return max(near)[2:]
    return a, b


def all_spans(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. The model's spans are added where they are whole words, plausible for their kind, and clear of base spans."""
    out = []
    for text, found in zip(texts, model_spans(model, texts)):
        base = base_spans(text)
        taken: list[tuple[int, int]] = []  # by base spans, those that overlap as one
        for s, e in sorted((s, e) for _, s, e in base):
            if taken and s < taken[-1][1]:
                taken[-1] = taken[-1][0], max(e, taken[-1][1])
            else:
                taken.append((s, e))
        more = []
        for kind, a, b in {(k, *completed(k, text, a, b)) for k, a, b in found}:
            whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            at = bisect.bisect_left(taken, (b, b))
            if whole and plausible(kind, text[a:b]) and (at == 0 or taken[at - 1][1] <= a):
                more.append((kind, a, b))
        out.append((base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def _text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """-> doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, n_spans (of all); one row for each input row.

    The base are four patterns. The model adds what they don't know, such as phone numbers without a plus, addresses with "at" and "dot" in words, or
    numbers in other groups, and what they ran past. Spans are kind:start:end in code points. Null texts are empty and have none; null doc_ids and repeated rows stand as they
    are; other columns are ignored. Nothing is shuffled. ``model``: by default one trained on labelled_examples().
    """
    model = model or default_model()

    def run(batch):
        got = all_spans(model, [t or "" for t in batch.column("text").to_pylist()])
        out = {"doc_id": batch.column("doc_id"), "base_sha256": [hashlib.sha256(_text(b).encode()).hexdigest() for b, _ in got], "spans": [_text(s) for _, s in got], "n_spans": [len(s) for _, s in got]}
        return out | {f"n_{k}": [sum(s[0] == k for s in b) for b, _ in got] for k in KINDS}

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", pieces=2 << 20)
