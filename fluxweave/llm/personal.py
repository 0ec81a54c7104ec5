"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds spans they miss."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffers, chunks, with_fields

# Kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

#: The tagger's kinds: secrets (keys, tokens, passwords) have no pattern.
TAGGED = (*KINDS, "secret")
#: Characters in a window that is learned from.
WINDOW = 64
#: Characters in a window that is read, and from one window's start to the next's.
READ, STEP = 256, 224
#: A text longer than this is tagged in stretches of about so many characters.
LONG = 1 << 19
EMBED, HIDDEN, EPOCHS, BATCH, RATE, N_TRAIN = 12, 16, 11, 64, 0.012, 3400
TAGS = 1 + 2 * len(TAGGED)  # outside, then begin and inside of each kind
#: By how much, in the logarithm of its likelihood, a span must be likelier than none.
KEEP = 4.0
#: Characters around those that may be in a span; windows whose emissions are made at once, so few that a product of matrices stays on one core.
AROUND, AT_ONCE = 8, 256


def luhn(digits: str) -> bool:
    """The check-digit rule of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def holds(kind: str, found: str) -> bool:
    """What a match of a pattern must fulfil besides."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    digits = re.sub(r"[^0-9]", "", found)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind and end of what the patterns find: leftmost, without overlap within a kind, failing matches dropped."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for k, kind in enumerate(KINDS[1:], 1):
        if kind == "phone" and "+" not in text:
            continue
        out += [(m.start(), k, m.end()) for m in _SEARCH[kind].finditer(text) if holds(kind, m[0])]
    return sorted(out)


#: The same matches in time linear in the text: a run of digits is entered at its start only.
_SEARCH = {"ip": re.compile("(?<![0-9])" + PATTERNS["ip"].pattern.replace("+", "++")), "card": PATTERNS["card"], "phone": PATTERNS["phone"]}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from their at signs, so that long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at)):
            start = at
            while start > done and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def symbols(text: str) -> np.ndarray:
    """A small alphabet: ASCII as it is, digits as one sign, the rest as one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < 128, codes, 127)
    return np.where((out >= 48) & (out <= 57), 48, out).astype(np.int64)


def labelled(n: int = N_TRAIN, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their spans, made by rule: invented prose around invented personal data and around numbers that are none."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    num = lambda k: "".join(str(d) for d in r.integers(0, 10, k))
    syllables = ["an", "the", "re", "tion", "ou", "er", "in", "st", "ent", "de", "la", "con", "ung", "schen", "né", "ío", "ly", "ha", "ß", "ço", "ä"]
    letters = "aaaeeeeiiioouunnrrssttllddhcmgpbfvkwzyxjqéèàöüñçó"
    hexa = lambda k: "".join("0123456789abcdef"[d] for d in r.integers(0, 16, k))
    base64 = lambda k: "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[d] for d in r.integers(0, 62, k))

    def word() -> str:
        some = syllables if r.random() < 0.3 else list(letters)
        made = "".join(r.choice(some, r.integers(1, 5 if some is syllables else 11)))
        return pick(made, made, made, made, made.capitalize(), made.upper())

    def name() -> str:
        return pick(f"{word()}{pick('.', '_', '-', '')}{pick(word(), num(int(r.integers(1, 4))))}", word())

    def made(kind: int) -> tuple[str, str, str]:
        """What stands before, the span and what stands after."""
        if kind == 0:
            at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("(at)", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "[dot]"))
            return pick("", "mail ", "<"), f"{name()}{at}{word().lower()}{pick('', num(1))}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'example' + dot + 'com')}", ""
        if kind == 1:
            return pick("", "", "ip "), pick(".", ".", ".", " . ", "[.]").join(str(int(x)) for x in r.integers(0, 256, 4)), pick("", "", ":80")
        if kind == 2:
            body = pick("4", "5", "37", "6") + num(int(r.integers(11, 15)))
            full = body + next(d for d in "0123456789" if luhn(body + d))
            sep = pick("-", " ", ".", "/", "_")
            return pick("", "card "), sep.join(full[i : i + 4] for i in range(0, len(full), 4)), ""
        if kind == 3:
            a, b, c = num(3), num(3), num(4)
            return pick("", "", "tel "), pick(f"+{pick('1', '44', '49', '33')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"00{num(2)}-{a}-{b}-{c}", f"+{num(1)}/{a}/{b}/{c}", f"({a}) {b}.{c}", f"{a}-{b}-{c}"), ""
        label = pick("token", "key", "api_key", "secret", "password", "TOKEN", "access_token")
        quote = pick('"', '"', "'")
        return f"{label}{pick(' = ', '=', ': ')}{quote}", pick(hexa(40), hexa(32), hexa(40), base64(int(r.integers(20, 41))), hexa(40).upper()), quote

    def other() -> str:
        return pick(num(int(r.integers(1, 8))), num(16), num(int(r.integers(9, 21))), f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(2)}.{num(1)}", f"@{word()}", f"${num(3)}.{num(2)}", f"{num(2)}:{num(2)}", f"v{num(1)}.{num(1)}", f"{num(3)}%", f"({num(4)})", f"{num(12)}abc{num(5)}", f'"{word()}"', f'{word()} = "{word()}"', f"{word()}@", "CC BY-NC 4.0.", "version 3.", f"{word()} at {word()}", f"({word()}) {word()}", hexa(6))

    out = []
    for _ in range(n):
        text, spans, empty, style = "", [], r.random() < 0.35, pick(" ", " ", " ", " ", " | ", "!! ", "### ", "$$$ ", "\n")
        while len(text) < WINDOW * 1.2:
            roll = r.random()
            if roll < 0.16 and not empty:
                kind = int(r.integers(len(TAGGED)))
                before, found, after = made(kind)
                spans.append((len(text) + len(before), kind, len(text) + len(before) + len(found)))
                text += before + found + after
            else:
                text += other() if roll < 0.32 and roll > 0.3 * empty else word()
            text += pick(style, style, " ", ", ", ". ", "; ")
        cut = int(r.integers(0, 24))  # a window begins anywhere, also within a span
        out.append((text[cut : cut + WINDOW], [(max(s - cut, 0), k, min(e - cut, WINDOW)) for s, k, e in spans if e - cut > 0 and s - cut < WINDOW]))
    return out


class Tagger:
    """Embedding, one LSTM each way, emissions, CRF transitions. Windows of a batch have one length; mask tells real characters."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        put = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": put(128, EMBED) * 3, "O": put(2 * HIDDEN, TAGS), "b": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            self.p |= {f"{way}X": put(EMBED, 4 * HIDDEN), f"{way}H": put(HIDDEN, 4 * HIDDEN), f"{way}c": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def _run(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: time, windows, 4 * HIDDEN inputs. The states by time, and what the gradients need."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, kept = np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            a = h @ self.p[way + "H"]
            a += x[t]
            a[:, : 3 * HIDDEN] *= 0.5  # a sigmoid is half a tanh of the half, plus a half
            np.tanh(a, out=a)
            s = a[:, : 3 * HIDDEN]
            s *= 0.5
            s += 0.5
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], a[:, 3 * HIDDEN :]
            before, was = c, h
            c = f * c
            c += i * g
            tc = np.tanh(c)
            h = out[t]
            np.multiply(o, tc, out=h)
            if keep:
                kept.append((t, was, before, i, f, o, g, tc))
        return out, kept

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """x: windows by characters. Emissions by time, window and tag."""
        e = self.p["E"][x.T]
        f, kf = self._run(self._input(x, "f"), "f", keep)
        b, kb = self._run(self._input(x, "b"), "b", keep)
        s = np.concatenate([f, b], 2)
        return s @ self.p["O"] + self.p["b"], (e, s, kf, kb)

    def _input(self, x: np.ndarray, way: str) -> np.ndarray:
        return (self.p["E"] @ self.p[way + "X"] + self.p[way + "c"])[x.T]

    def read(self, x: np.ndarray) -> np.ndarray:
        """The same emissions by window, tag and character, with nothing kept for gradients: both ways run in step, and each gate of all windows is one block of memory.

        A sigmoid is half a tanh of the half, plus a half; the halves of h are in the weights that it meets.
        """
        n, time = x.shape
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), HIDDEN)
        w = np.stack([(np.concatenate([self.p[way + "H"] * 0.5, self.p[way + "X"], self.p[way + "c"][None]]) * half).T for way in "fb"]).astype(np.float32)
        w = w.reshape(2, 2, 2 * HIDDEN, -1)
        signs, at = np.ascontiguousarray(self.p["E"].T), np.ascontiguousarray(x.T)
        z, a = np.zeros((2, 1, HIDDEN + EMBED + 1, n), np.float32), np.empty((2, 2, 2 * HIDDEN, n), np.float32)
        z[:, :, -1] = 1
        h, (forward, backward) = z[:, 0, :HIDDEN], z[:, 0, HIDDEN:-1]
        i, f, o, g = (a[:, k // 2, k % 2 * HIDDEN : (k % 2 + 1) * HIDDEN] for k in range(4))
        gates, new = a[:, 0], np.concatenate([a[:, 1, HIDDEN:], a[:, 1, HIDDEN:]], 1)
        c, tc = np.zeros((2, HIDDEN, n), np.float32), np.empty((2, HIDDEN, n), np.float32)
        out = np.empty((time, 2, HIDDEN, n), np.float32)
        for t in range(time):
            signs.take(at[t], 1, forward, "clip")
            signs.take(at[time - 1 - t], 1, backward, "clip")
            np.matmul(w, z, out=a)
            np.tanh(a, out=a)
            new[:, :HIDDEN], new[:, HIDDEN:] = g, c
            gates *= new
            gates += new
            np.add(i, f, out=c)
            c *= 0.5
            np.tanh(c, out=tc)
            o += 1
            np.multiply(o, tc, out=h)
            out[t, 0], out[time - 1 - t, 1] = h
        em = np.matmul(np.ascontiguousarray(self.p["O"].T * np.float32(0.5)), out.reshape(time, 2 * HIDDEN, n))
        return np.ascontiguousarray(em.transpose(2, 1, 0)) + self.p["b"][:, None]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of the tags y (windows by characters) under the CRF, and its gradients."""
        em, (e, s, kf, kb) = self.emissions(x, True)
        time, n, trans = len(em), x.shape[0], self.p["T"]
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0]
        for t in range(1, time):
            alpha[t] = em[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(time - 2, -1, -1):
            beta[t] = lse(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        yt, at = y.T, np.arange(n)
        gold = sum(em[t, at, yt[t]] + (trans[yt[t - 1], yt[t]] if t else 0) for t in range(time))
        d = np.exp(alpha + beta - z[:, None])
        g = {"T": np.zeros_like(trans)}
        for t in range(1, time):
            g["T"] += np.exp(alpha[t - 1][:, :, None] + trans + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.subtract.at(g["T"], (yt[t - 1], yt[t]), 1)
        for t in range(time):
            d[t, at, yt[t]] -= 1
        d /= n * time
        g["T"] /= n * time
        g["O"], g["b"] = s.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, TAGS), d.sum((0, 1))
        ds, de = d @ self.p["O"].T, np.zeros_like(e)
        for way, kept, dh_all in (("f", kf, ds[:, :, :HIDDEN]), ("b", kb, ds[:, :, HIDDEN:])):
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            gx, gh, gc = np.zeros_like(self.p[way + "X"]), np.zeros_like(self.p[way + "H"]), np.zeros_like(self.p[way + "c"])
            for t, was, before, i, f, o, gg, tc in reversed(kept):
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc**2)
                a = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], 1)
                gx += e[t].T @ a
                gh += was.T @ a
                gc += a.sum(0)
                de[t] += a @ self.p[way + "X"].T
                dh, dc = a @ self.p[way + "H"].T, dc * f
            g |= {way + "X": gx, way + "H": gh, way + "c": gc}
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], x.T, de)
        return float((z - gold).mean() / time), g

    def fit(self, texts: list[tuple[str, list]], seed: int = 3) -> Tagger:
        x, y = np.zeros((len(texts), WINDOW), np.int64), np.zeros((len(texts), WINDOW), np.int64)
        for k, (text, spans) in enumerate(texts):
            x[k, : len(text)] = symbols(text)
            for start, kind, end in spans:
                y[k, start:end] = 2 + 2 * kind
                y[k, start] = 1 + 2 * kind
        r, m1, m2, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(x))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                _, g = self.gradients(x[pick], y[pick])
                t += 1
                for n, v in g.items():
                    m1[n], m2[n] = 0.9 * m1[n] + 0.1 * v, 0.999 * m2[n] + 0.001 * v * v
                    self.p[n] = (self.p[n] - RATE * (1 - 0.9 * epoch / EPOCHS) * (m1[n] / (1 - 0.9**t)) / (np.sqrt(m2[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def best(self, em: np.ndarray) -> np.ndarray:
        """Best tags, by time and row, of emissions by time, row and tag, where outside comes before and after."""
        time, n, _ = em.shape
        best, back = em[0] + self.p["T"][0], np.empty((time, n, TAGS), np.int8)
        for t in range(1, time):
            v = best[:, :, None] + self.p["T"]
            back[t] = v.argmax(1)
            best = em[t] + v.max(1)
        tags = np.empty((time, n), np.int64)
        tags[-1] = (best + self.p["T"][:, 0]).argmax(1)
        for t in range(time - 1, 0, -1):
            tags[t - 1] = back[t, np.arange(n), tags[t]]
        return tags


def emitted(codes: list[np.ndarray], model: Tagger) -> list[np.ndarray]:
    """Emissions of each text, tags by characters: every window is read; where two windows overlap, their emissions are averaged, by the distance to the nearer end of each."""
    out = [np.zeros((TAGS, len(c)), np.float32) for c in codes]
    both = READ - STEP
    rising = (np.arange(1, both + 1) / (both + 1)).astype(np.float32)
    windows = [(n, a) for n, c in enumerate(codes) for a in range(0, max(len(c) - both, min(len(c), 1)), STEP)]
    windows.sort(key=lambda w: min(READ, len(codes[w[0]]) - w[1]))
    for i in range(0, len(windows), AT_ONCE):
        some = windows[i : i + AT_ONCE]
        parts = [codes[n][a : a + READ] for n, a in some]
        x = np.zeros((len(some), max(map(len, parts))), np.int64)
        for row, part in zip(x, parts):
            row[: len(part)] = part
        for (n, a), part, e in zip(some, parts, model.read(x)):
            k = len(part)
            if a:
                e[:, :both] *= rising
            if a + k < len(codes[n]):
                e[:, k - both : k] *= rising[::-1]
            out[n][:, a : a + k] += e[:, :k]
    return out


def _stretches(text: str, model: Tagger) -> Iterator[np.ndarray]:
    """The emissions of a text, a stretch of LONG characters or so after the other, as emitted() gives them for the whole: stretches share a window."""
    both, m, k, done = READ - STEP, LONG // STEP, 0, 0
    while done < len(text):
        a = k * STEP
        b = min(a + m * STEP + both, len(text))
        end = b if b == len(text) else a + m * STEP
        yield emitted([symbols(text[a:b])], model)[0][:, done - a : end - a]
        done, k = end, k + m - 1


def tagged(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """start, kind and end of the spans of each text's best tags that are likelier than none by KEEP.

    Tags are the best ones of the whole text by emissions and transitions. A span likely enough has a character where the
    lead of outside is less than transitions within a span make good. So only what lies around such characters is decoded,
    and of a text longer than LONG no more is held than a stretch and the uncertain characters at the end of the one before.
    """
    trans = model.p["T"]
    edges = float(trans[0, 1:].max() + trans[1:, 0].max() - 2 * trans[0, 0])
    need = max(float(trans[1:, 1:].max() - trans[0, 0]), edges - KEEP, 0.0)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts = []  # text, its part's first character, emissions of the part

    def decode() -> None:
        parts.sort(key=lambda x: x[2].shape[1])
        for i in range(0, len(parts), 256):
            some = parts[i : i + 256]
            x = np.full((some[-1][2].shape[1], len(some), TAGS), -1e4, np.float32)
            x[:, :, 0] = 0
            for k, (_, _, e) in enumerate(some):
                x[: e.shape[1], k] = e.T
            for (n, a, e), tags in zip(some, model.best(x).T):
                out[n] += _spans(tags[: e.shape[1]], e.T, a, trans)
        parts.clear()

    short = [n for n, t in enumerate(texts) if len(t) <= LONG]
    for n, e in zip(short, emitted([symbols(texts[n]) for n in short], model)):
        parts += [(n, a, e[:, a:b]) for a, b in _uncertain(e, need)]
    decode()
    for n in sorted(set(range(len(texts))) - set(short)):
        first, rest = 0, np.zeros((TAGS, 0), np.float32)
        for e in _stretches(texts[n], model):
            e = np.concatenate([rest, e], 1)
            size = e.shape[1]
            last, keep = first + size == len(texts[n]), max(size - AROUND, 0)
            for a, b in _uncertain(e, need):
                if last or b <= size - AROUND:  # nothing uncertain that is still to come can be of this part
                    parts.append((n, first + a, e[:, a:b]))
                else:
                    keep = a
            decode()
            first, rest = first + keep, e[:, keep:].copy()
    return [sorted(x) for x in out]


def _uncertain(em: np.ndarray, need: float) -> list[tuple[int, int]]:
    """First and past-last character of the parts around characters where outside does not lead by as much."""
    at = np.flatnonzero(em[0] - em[1:].max(0) < need)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * AROUND)
    return [(max(int(a) - AROUND, 0), min(int(b) + AROUND + 1, em.shape[1])) for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)])]


def _spans(tags: np.ndarray, em: np.ndarray, first: int, trans: np.ndarray) -> list[tuple[int, int, int]]:
    """The spans of a part's tags that are likely enough."""
    found, start = [], None
    for p in [*np.flatnonzero(tags).tolist(), len(tags) + 1]:
        if start is not None and (p != end or tags[p] % 2 or tags[p] != tags[start] + 1):
            path = np.concatenate([[0], tags[start:end], [0]])
            more = (em[np.arange(start, end), tags[start:end]] - em[start:end, 0]).sum() + trans[path[:-1], path[1:]].sum() - (len(path) - 1) * trans[0, 0]
            if more >= KEEP:
                found.append((first + start, int(tags[start] - 1) // 2, first + end))
            start = None
        if p < len(tags):
            start, end = p if start is None else start, p + 1
    return found


def merged(text: str, base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans stay; of the tagger's, without white space and stops at their ends, those that touch no other span join them."""
    base, added, last = sorted(base), [], 0
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    for start, kind, end in sorted(more):
        found = text[start:end]
        start, end = start + len(found) - len(found.lstrip(" .,;\n")), end - len(found) + len(found.rstrip(" .,;\n"))
        before = bisect_left(starts, end)  # base spans that begin before the end
        if end > start >= last and not (before and reach[before - 1] > start):
            added.append((start, kind, end))
            last = end
    return sorted(base + added)


_trained: list[Tagger] = []


def model() -> Tagger:
    """The tagger, trained once in a process from the made texts."""
    if not _trained:
        _trained.append(Tagger().fit(labelled()))
    return _trained[0]


def find(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """documents with base and spans: arrays of struct<start int, kind string, end int> by start, then kind as in TAGGED.

    Offsets are code points, ends exclusive. base has what the patterns find; spans has base and what the tagger
    adds. A null text counts as empty and has no span. Each row is read by itself and whole: repeated rows get
    equal results, no row moves. Columns of documents named base or spans are replaced, all others kept.
    """
    tagger = tagger or model()
    documents = documents.drop("base", "spans")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def rows(spans: list) -> pa.Array:
        return pa.array([[{"start": s, "kind": TAGGED[k], "end": e} for s, k, e in x] for x in spans], kind)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(buffers(batch.column("text"))[1]):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                spans = [merged(*x) for x in zip(texts, base, tagged(texts, tagger))]
                yield pa.RecordBatch.from_arrays([*part.columns, rows(base), rows(spans)], [*part.schema.names, "base", "spans"])

    span = "array<struct<start:int,kind:string,end:int>>"
    return documents.mapInArrow(found, with_fields(documents.schema, base=span, spans=span))
