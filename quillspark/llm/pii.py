"""Personal data and secrets by a character-level bidirectional LSTM with CRF transitions.

Training is in numpy and from labelled spans: a seeded generator writes invented prose in several styles,
with harmless numbers, links and quoted strings, and places e-mail addresses, IP addresses, telephone, card and
account (IBAN) numbers, identity numbers and secrets (also such as have no digit) in it, whose spans are the
labels.  A character's label is outside, or the begin or the inside of one kind, so items side by side stay two.
Back-propagation runs through both directions and the CRF's forward-backward; Adam fits embeddings, both LSTMs,
emissions and transitions.  Gates are piecewise linear (clipped to [0, 1], candidates and outputs to [-1, 1]), which
costs a fraction of the exponential ones.  The model doesn't depend on the data it is applied to, so a process
trains it once.  Names of persons and postal addresses are not among the kinds.

*Decoding.*  A document's characters lie on a grid of cores of ``CORE``; a core's window adds ``CONTEXT``
characters on either side, so neighbouring windows overlap.  Every window goes through both LSTMs.  Where the
emissions prove that the likeliest labelling is outside (``Model.doubtful``), that is the result; Viterbi labels
the stretches between.  Each character takes the label of the window in whose core it lies, and the labels
are reconciled over the whole document: an item starts at a begin label, after an outside one or where the kind
changes, wherever the edges of cores are; a fragment that starts with an inside label belongs to the one of its
kind before, with at most ``GAP`` characters between, none a letter or digit; the ends are trimmed of
white space and marks.

Cases: null and empty texts have no span.  Repeated rows give repeated spans.  Rows with a null ``doc_id``
are searched too.  Texts of any length are searched whole.  Offsets count code points.  Labellings that tie are
settled towards the smaller label.  An empty table gives no span.  ``doc_id`` and ``text`` are read; other columns
may have any name.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import prepare, steps, table
from quillspark.llm.pretokens import codepoints

KINDS = ["email", "ip", "phone", "card", "secret", "iban", "identity"]
LABELS = 1 + 2 * len(KINDS)
CORE, CONTEXT, GAP = 704, 32, 6
HIDDEN, EMBED = 20, 8
#: Items are far rarer in real texts than in the training texts: what the log-odds of a beginning lose for it.
RARITY = 3.0
VOCAB = 100
#: Windows that go through the LSTMs side by side.
LANES = 256
_ASCII = {c: i + 4 for i, c in enumerate(map(chr, range(32, 127)))}


def symbols(cp: np.ndarray) -> np.ndarray:
    """1: control and white space, 2: other letters, 3: other marks, then ASCII."""
    if not _LOOK:
        look = np.full(0x3000, 2, np.uint8)
        look[:32] = 1
        look[0x7F:0xC0] = 3
        look[0x2000:0x2C00] = 3
        for c, i in _ASCII.items():
            look[ord(c)] = i
        _LOOK.append(look)
    return np.where(cp < 0x3000, _LOOK[0][np.minimum(cp, 0x2FFF)], np.uint8(2))


_LOOK: list[np.ndarray] = []


# ---- labelled spans


_SYLLABLES = ["th", "er", "an", "tion", "ing", "ou", "re", "ment", "eau", "é", "è", "ção", "ñ", "ción", "ung", "sch", "ß", "ö", "ü", "heit", "o", "a", "des", "st", "le", "wh", "ble", "x", "k", "z"]
_SOFT, _VOWELS = "bcdfghjklmnpqrstvwxyz", "aeiouyéüó"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


class Writer:
    """Invented texts with labelled items."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)  # noqa: S311 - not for secrets of our own
        self.pick = self.rng.choice

    def digits(self, n: int) -> str:
        return f"{self.rng.randrange(10**n):0{n}d}"

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choices(alphabet, k=n))

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self, most: int = 5) -> str:
        n = self.rng.randrange(1, most)
        if self.chance(0.3):
            w = "".join(self.chars(_SOFT, 1) + self.chars(_VOWELS, 1) + (self.chars(_SOFT, 1) if self.chance(0.3) else "") for _ in range(n))
        else:
            w = "".join(self.pick(_SYLLABLES) for _ in range(n))
        return w.capitalize() if self.chance(0.15) else w

    def prose(self) -> str:
        """A word of a sentence, with the mark and the break after it."""
        w = self.word()
        if self.chance(0.15):
            w += self.pick([".", ".", ".", ",", ",", "!", "?", ";", ":"]) + ("\n" if self.chance(0.25) else "")
        return w

    def harmless(self) -> str:
        d, p = self.digits, self.pick
        r = self.rng.randrange(17)
        if r == 0:
            return str(self.rng.randrange(1900, 2100))
        if r == 1:
            return d(self.rng.randrange(1, 7))
        if r == 2:
            return f"{d(1)}.{d(1)}" + (f".{d(1)}" if self.chance(0.5) else "") + ("." if self.chance(0.4) else "")
        if r == 3:
            return f"{d(2)}:{d(2)}"
        if r == 4:
            return f"{p('$€')}{d(3)}.{d(2)}"
        if r == 5:
            return f"{d(4)}-{d(2)}-{d(2)}"
        if r == 6:
            return f"@{self.word()}"
        if r == 7:
            return f"{self.word()}{d(2)}"
        if r == 8:
            return f"({d(self.rng.randrange(1, 3))})"
        if r == 9:
            return f"{p(['http', 'https'])}://{self.word().lower()}.{p(['com', 'org', 'net'])}/" + "/".join(self.word().lower() for _ in range(self.rng.randrange(0, 3)))
        if r == 10:
            return f'{p(["class", "name", "title", "lang", "type", "id"])} = "{self.word().lower()}"'
        if r == 11:
            return f"{self.word(8)}{self.word(8)}".lower()
        if r == 12:
            return f"{d(1)},{d(3)},{d(3)}"
        if r == 13:
            return self.pick(["IPv4", "IPv6", "UTF-8", "ISO 8601", "IBAN", "CPU", "v2", "A4", "No. 7", "token", "key", "password", "secret", "email", "phone"])
        if r == 14:
            return " ".join(d(self.rng.randrange(1, 3)) for _ in range(self.rng.randrange(2, 5)))
        if r == 15:
            return f"{self.word().upper()}"
        return f'"{self.word()} {self.word()}"'

    def item(self) -> list[tuple[str, int]]:
        """Parts of one item with what each is: kind + 1, negative if its quotes don't belong to it, 0 if harmless."""
        d, p, rng = self.digits, self.pick, self.rng
        kind = p(["email", "email", "ip", "ip", "phone", "phone", "card", "secret", "secret", "iban", "identity"])
        y = KINDS.index(kind) + 1
        if kind == "email":
            local = self.word().lower() if self.chance(0.85) else self.word()
            if self.chance(0.12):
                local += p(["", ".", "_", "-"]) + self.word(9).lower()
            local += p(["", ".", "_", "-", "+"]) + (d(rng.randrange(1, 4)) if self.chance(0.7) else self.word().lower())
            host = p(["mail", "post", "web", "corp", "inbox", self.word().lower()]) + (d(1) if self.chance(0.6) else "")
            return [(f"{local}@{host}.{p(['example.com', 'example.org', 'example.net', 'com', 'org', 'co.uk', 'de', 'fr'])}", y)]
        if kind == "ip":
            return [(".".join(str(rng.randrange(256)) for _ in range(4)), y)]
        if kind == "phone":
            a, b, c = d(3), d(3) if self.chance(0.5) else "555", d(4)
            f = rng.randrange(6)
            if f < 3:
                return [("+" + str(rng.randrange(1, 99) if self.chance(0.3) else 1), y), (f"({a})", y), (f"{b}-{c}", y)]
            if f == 3:
                return [(f"{a}-{b}-{c}", y)]
            if f == 4:
                return [(f"({a})", y), (f"{b}-{c}", y)]
            return [(f"+{d(2)}", y), (d(3), y), (d(3), y), (d(4), y)]
        if kind == "card":
            if self.chance(0.75):
                return [(d(16), y)]
            return [(d(4), y) for _ in range(4)] if self.chance(0.5) else [("-".join(d(4) for _ in range(4)), y)]
        if kind == "iban":
            body = p(["DE", "FR", "GB", "ES", "NL", "IT", "CH", "PT"]) + d(2) + (self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4) if self.chance(0.3) else d(4)) + d(rng.randrange(8, 17))
            return [(body, y)] if self.chance(0.5) else [(body[k : k + 4], y) for k in range(0, len(body), 4)]
        if kind == "identity":
            return [(f"{d(3)}-{d(2)}-{d(4)}", y)]
        f = rng.random()
        n = 40 if self.chance(0.5) else rng.randrange(20, 49)
        if f < 0.6:
            key = self.chars("0123456789abcdef", n)
        elif f < 0.8:
            key = self.chars("0123456789" + _LOWER + _LOWER.upper() + "_-", n)
        elif f < 0.9:
            key = self.chars(_LOWER, n)
        else:
            key = "".join(self.word().lower() for _ in range(6))[:n]
        name = p(["token", "token", "token", "api_key", "secret", "password", "key", "auth_token"])
        eq = p(["=", "=", ":"])
        quote = p('""\'')
        return [(f"{name}{eq}", 9), (f"{quote}{key}{quote}", -y)] if self.chance(0.3) else [(name, 0), (eq, 0), (f"{quote}{key}{quote}", -y)]

    def text(self, length: int) -> tuple[str, np.ndarray]:
        rng = self.rng
        style = rng.randrange(8)
        text: list[str] = []
        label: list[int] = []
        skip = rng.randrange(0, 80)
        dense = self.pick([0.0, 0.0, 0.06, 0.15])
        plain = self.pick([0.02, 0.02, 0.15])
        again: list[tuple[str, int]] | None = None
        while len(text) <= length + skip:
            if again is not None or self.chance(dense):
                parts = self.item() if again is None else again
                again = self.item() if again is None and self.chance(0.12) else None
            elif self.chance(plain):
                parts = [(self.harmless(), 0)]
            else:
                parts = [(self.prose(), 0)]
            for i, (s, y) in enumerate(parts):
                mark = {5: "!!", 6: self.pick(["***", "%%%", "###", "$$$", "&&&"])}.get(style, "")
                gap = " | " if style == 4 else self.pick(["\n", " "]) if self.chance(0.03) else " "
                glued = y == 9
                y = 0 if glued else y
                k = 2 * abs(y)
                first = i == 0 or parts[i - 1][1] != y
                ys = [k] * len(s)
                if y < 0:  # quoted: the quotes don't belong to it
                    ys = [0, k - 1, *[k] * (len(s) - 3), 0]
                elif y > 0 and first:
                    ys[0] = k - 1
                if style == 5 and len(s.upper()) == len(s):
                    s = s.upper()
                goes_on = y > 0 and i + 1 < len(parts)
                end = "" if glued else (" " if goes_on else mark + gap)
                if y > 0 and not goes_on and self.chance(0.15):
                    end = self.pick([".", ",", ")", ";"]) + end
                text += s + end
                label += ys + [k if goes_on else 0] * len(end)
        # neither end cuts an item: windows have context, and real texts end after their items, often with a mark
        free = [k for k in range(skip + 1) if all(label[x] == 0 or label[x] % 2 for x in (k, k + length))]
        full = [k for k in free if text[k + length - 1] in ".!?" or label[k + length - 1]]
        at = self.pick(full) if full and self.chance(0.4) else free[-1] if free else 0
        return "".join(text[at : at + length]), np.array(label[at : at + length])


def example(rng: np.random.Generator, length: int = 112) -> tuple[str, np.ndarray]:
    """A text of ``length`` characters and the label of each: 0 outside, 2k + 1 begin and 2k + 2 inside KINDS[k]."""
    return Writer(int(rng.integers(1 << 62))).text(length)


# ---- model


class Model:
    """Arrays by name: ``w`` (2, 4H, H + EMBED) has the gates (in, forget, out, candidate) of both directions over
    the hidden state and the symbol's embedding, whose last number is always 1; ``wo`` (2, labels, H) the emissions,
    ``trans`` the transitions."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = p
        embed = p["embed"].copy()
        embed[:, -1] = 1
        self.look = np.ascontiguousarray(embed.T)
        t = p["trans"]
        # what an excursion from outside gains at most: at its entry, each inner step and its exit
        self.into, self.inner, self.out = t[0, 1:].max() - t[0, 0], t[1:, 1:].max() - t[0, 0], t[1:, 0].max() - t[0, 0]

    def forward(self, x: np.ndarray, keep: list | None = None, size: np.ndarray | None = None) -> np.ndarray:
        """Hidden states (t + 1, 2, H, n) before each step of the symbols x (2, t, n), each direction in its own order.

        With sizes, columns behind the last one that is longer than a step aren't computed at it; their states are 0.
        """
        _, t, n = x.shape
        live = [n] * t if size is None else (n - np.searchsorted(np.maximum.accumulate(size[::-1]), np.arange(t), side="right")).tolist()
        w = self.p["w"]
        kind = w.dtype
        h = HIDDEN
        b = np.empty((t + 1, 2, h + EMBED, n), kind)
        b[0, :, :h] = 0
        for k in range(2):
            b[:t, k, h:] = np.take(self.look, x[k], axis=1).transpose(1, 0, 2)
        c = np.zeros((2, h, n), kind)
        z = np.empty((2, 4 * h, n), kind)
        zero, one = kind.type(0), kind.type(1)
        m = -1
        for i in range(t):
            if live[i] != m:
                m = live[i]
                part, state, tmp = z[:, :, :m], c[:, :, :m], np.empty((2, h, m), kind)
                gates, new = part[:, : 3 * h], part[:, 3 * h :]
                b[i + 1 :, :, :h, m:] = 0
            np.matmul(w, b[i, :, :, :m], out=part)
            if keep is not None:
                keep.append((z.copy(), c.copy()))
            np.clip(gates, zero, one, out=gates)
            np.clip(new, -one, one, out=new)
            state *= part[:, h : 2 * h]
            np.multiply(part[:, :h], new, out=tmp)
            state += tmp
            np.clip(state, -one, one, out=tmp)
            np.multiply(tmp, part[:, 2 * h : 3 * h], out=b[i + 1, :, :h, :m])
        return b

    def emissions(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(t, labels, n) of symbols x (t, n), of which the first size[j] of column j count."""
        t, n = x.shape
        back = size[None, :] - 1 - np.arange(t)[:, None]
        b = self.forward(np.stack([x, np.take_along_axis(x, np.maximum(back, 0), axis=0)]), size=size)
        e = np.matmul(self.p["wo"][0], b[1:, 0, :HIDDEN])
        other = np.matmul(self.p["wo"][1], b[1:, 1, :HIDDEN])
        for n in np.unique(size).tolist():
            k = np.flatnonzero(size == n)
            k = slice(int(k[0]), int(k[-1]) + 1) if k[-1] - k[0] + 1 == len(k) else k
            e[:n, :, k] += other[n - 1 :: -1, :, k] if n == len(other) else other[:n, :, k][::-1]
        e += self.p["bo"][:, None]
        return e

    def doubtful(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(t, n): where the likeliest labelling isn't proven to be outside.

        At a character a label gains at most ``gain`` over outside, and an excursion its gains with those of
        its transitions.  ``left`` and ``right`` bound the excursions that end and begin at a character; where
        no excursion over a character can gain, going without it is as good.
        """
        t, _, n = e.shape
        gain = e[:, 1:].max(axis=1) - e[:, 0]
        gain[np.arange(t)[:, None] >= size[None, :]] = -np.inf
        some = np.flatnonzero(gain.max(axis=0) + max(self.into + self.out, self.into, self.out, self.inner, 0) > 0)
        found = np.zeros((t, n), bool)
        if not len(some):
            return found
        gain, last = gain[:, some], size[some] - 1
        left, right = gain.copy(), gain.copy()
        left[0] = gain[0] + max(self.into, 0)  # before the first character nothing is known
        for i in range(1, t):
            left[i] += np.maximum(self.into, left[i - 1] + self.inner)
        edge = np.where(last == t - 1, max(self.out, 0), self.out)
        right[t - 1] += edge
        for i in range(t - 2, -1, -1):
            right[i] += np.maximum(np.where(last == i, max(self.out, 0), self.out), right[i + 1] + self.inner)
        with np.errstate(invalid="ignore"):
            found[:, some] = left + right - gain > 0
        return found

    def viterbi(self, e: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Likeliest labels (t, n) of emissions (t, labels, n) of which the first size[j] of column j count, those before
        and after being outside where said; outside beyond the sizes."""
        t, k, n = e.shape
        trans = self.p["trans"][:, :, None]
        back = np.empty((t, k, n), np.int8)
        v = e[0] + np.where(before, trans[0], 0)
        every = np.arange(k, dtype=np.int8)[:, None]
        for i in range(1, t):
            s = v[:, None, :] + trans
            live = i < size
            back[i] = np.where(live, s.argmax(axis=0), every)
            v = np.where(live, s.max(axis=0) + e[i], v)
        v = v + np.where(after, trans[:, 0], 0)
        y = np.empty((t, n), np.int8)
        y[t - 1] = v.argmax(axis=0)
        cols = np.arange(n)
        for i in range(t - 1, 0, -1):
            y[i - 1] = back[i, y[i], cols]
        y[np.arange(t)[:, None] >= size[None, :]] = 0
        return y

    def decode(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Likeliest labels (t, n): Viterbi over the doubtful stretches, each between characters that are outside."""
        t, _, n = e.shape
        y = np.zeros((t, n), np.int8)
        col, at = np.nonzero(self.doubtful(e, size).T)
        if not len(col):
            return y
        lead = np.flatnonzero(np.r_[True, (col[1:] != col[:-1]) | (at[1:] != at[:-1] + 1)])
        col, begin, m = col[lead], at[lead], np.diff(np.r_[lead, len(at)])
        order = np.argsort(m, kind="stable")
        for o in np.array_split(order, -(-len(order) // 128)):
            c, b, w = col[o], begin[o], m[o]
            step = np.arange(int(w[-1]))[:, None]
            pos = b + np.minimum(step, w - 1)
            got = self.viterbi(e[pos, :, c].transpose(0, 2, 1), w, b > 0, b + w < size[c])
            live = step < w
            y[pos[live], np.broadcast_to(c, pos.shape)[live]] = got[live]
        return y

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the labels y (t, n) of symbols x (t, n), and its gradient."""
        p, h = self.p, HIDDEN
        t, n = x.shape
        kept: list = []
        both = np.stack([x, x[::-1]])
        b = self.forward(both, kept)
        hs = b[1:, :, :h]
        e = (np.matmul(p["wo"][0], hs[:, 0]) + np.matmul(p["wo"][1], hs[::-1, 1]) + p["bo"][:, None]).astype(np.float64).transpose(0, 2, 1)  # (t, n, k)
        k = e.shape[2]
        top = e.max(axis=2, keepdims=True)
        q, a = np.exp(e - top), np.exp(p["trans"].astype(np.float64))
        alpha, beta = np.empty((t, n, k)), np.ones((t, n, k))
        v, logz = np.ones((n, k)), top.sum(axis=(0, 2))
        for i in range(t):
            v = (v @ a if i else v) * q[i]
            s = v.sum(axis=1, keepdims=True)
            v = v / s
            logz = logz + np.log(s[:, 0])
            alpha[i] = v
        for i in range(t - 2, -1, -1):
            v = (q[i + 1] * beta[i + 1]) @ a.T
            beta[i] = v / v.sum(axis=1, keepdims=True)
        g = alpha * beta
        g /= g.sum(axis=2, keepdims=True)
        dtrans = np.zeros((k, k))
        for i in range(t - 1):
            right = q[i + 1] * beta[i + 1]
            norm = ((alpha[i] @ a) * right).sum(axis=1, keepdims=True)
            dtrans += a * ((alpha[i] / norm).T @ right)
        np.subtract.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), 1)
        rows, cols = np.arange(t)[:, None], np.arange(n)[None, :]
        gold = e[rows, cols, y].sum() + p["trans"][y[:-1], y[1:]].sum()
        g[rows, cols, y] -= 1
        de = (g / n).astype(p["w"].dtype).transpose(0, 2, 1)  # (t, k, n)
        flat = lambda m: m.transpose(1, 0, 2).reshape(m.shape[1], -1)
        out = {"wo": np.stack([flat(de) @ flat(hs[:, 0]).T, flat(de) @ flat(hs[::-1, 1]).T]), "bo": de.sum(axis=(0, 2)), "trans": (dtrans / n).astype(p["w"].dtype)}
        dh_out = np.stack([np.matmul(p["wo"][0].T, de), np.matmul(p["wo"][1].T, de)[::-1]], axis=1)  # (t, 2, H, n), own order
        dw = np.zeros_like(p["w"])
        dx = np.empty((t, 2, EMBED, n), p["w"].dtype)
        dh, dc = np.zeros((2, h, n), p["w"].dtype), np.zeros((2, h, n), p["w"].dtype)
        wt = p["w"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            z, old = kept[i]
            open_ = (z > np.where(np.arange(4 * h) < 3 * h, 0, -1)[:, None]) & (z < 1)
            gi, gf, go = (np.clip(z[:, j * h : (j + 1) * h], 0, 1) for j in range(3))
            gg = np.clip(z[:, 3 * h :], -1, 1)
            c = gf * old + gi * gg
            dh = dh + dh_out[i]
            dc = dc + dh * go * ((c > -1) & (c < 1))
            dz = np.concatenate([dc * gg, dc * old, dh * np.clip(c, -1, 1), dc * gi], axis=1) * open_
            dw += np.matmul(dz, b[i].transpose(0, 2, 1))
            back = np.matmul(wt, dz)
            dh, dx[i], dc = back[:, :h], back[:, h:], dc * gf
        out["w"] = dw
        dlook = np.zeros_like(p["embed"])
        np.add.at(dlook, both.transpose(1, 0, 2).ravel(), dx.transpose(0, 1, 3, 2).reshape(-1, EMBED))
        dlook[:, -1] = 0
        out["embed"] = dlook
        return float((logz.sum() - gold) / n), out


@cache
def train(steps_: int = 600, batch: int = 96, seed: int = 11) -> Model:
    """Fit on ``steps_`` batches of generated windows."""
    rng = np.random.default_rng(seed)
    r = lambda *s: (rng.normal(size=s) / np.sqrt(s[-1])).astype(np.float32)
    p = {"embed": r(VOCAB, EMBED) * 3, "w": r(2, 4 * HIDDEN, HIDDEN + EMBED), "wo": r(2, LABELS, HIDDEN) * 2, "bo": np.zeros(LABELS, np.float32), "trans": np.zeros((LABELS, LABELS), np.float32)}
    p["w"][:, : 3 * HIDDEN] *= 0.3
    p["w"][:, :, -1] = 0.5
    p["w"][:, HIDDEN : 2 * HIDDEN, -1] = 0.8
    p["w"][:, 3 * HIDDEN :, -1] = 0
    m1, m2 = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}
    for step in range(1, steps_ + 1):
        made = [example(rng) for _ in range(batch)]
        cp, _ = codepoints([x for x, _ in made])
        x = np.ascontiguousarray(symbols(cp).reshape(batch, -1).T)
        _, grad = Model(p).gradient(x, np.stack([y for _, y in made], axis=1))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.01 * min(1.0, step / 20) * (1 - 0.95 * step / steps_)
        for n, g in grad.items():
            g = g * min(1.0, 20 / norm)
            m1[n] = 0.9 * m1[n] + 0.1 * g
            m2[n] = 0.99 * m2[n] + 0.01 * g * g
            p[n] = p[n] - (rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    p["trans"] = p["trans"].copy()
    p["trans"][0, 1::2] -= RARITY
    return Model(p)


# ---- decoding


_FIRST, _LAST = re.compile(r"^[^\w+(]+"), re.compile(r"[^\w)]+$")


def labels_of(cp: np.ndarray, off: np.ndarray, model: Model) -> np.ndarray:
    """The label of every character of the texts cp[off[i]:off[i + 1]]."""
    count = -(-np.diff(off) // CORE)
    owner = np.repeat(np.arange(len(count)), count)
    low = off[owner] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * CORE
    high = np.minimum(low + CORE, off[owner + 1])
    end = np.minimum(high + CONTEXT, off[owner + 1])
    begin = np.maximum(low - CONTEXT, off[owner])
    begin = np.maximum(end - -(-(end - begin) // 64) * 64, off[owner])  # more context, and fewer different sizes
    size = end - begin
    order = np.argsort(-size, kind="stable")  # windows of about one length go together
    sym = symbols(cp)
    labels = np.zeros(len(cp), np.int8)
    for a in range(0, len(order), LANES):
        w = order[a : a + LANES]
        n, start = size[w], begin[w]
        pos = start + np.minimum(np.arange(int(n[0]))[:, None], n - 1)
        y = model.decode(model.emissions(sym[pos], n), n)
        t, k = np.nonzero(y)
        at = start[k] + t
        core = (at >= low[w[k]]) & (at < high[w[k]])
        labels[at[core]] = y[t[core], k[core]]
    return labels


def spans(texts: list[str], model: Model) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """(row, start, end, kind) of the private spans of the texts, in order."""
    cp, off = codepoints(texts)
    none = np.zeros(0, np.int64), [], [], []
    if not len(cp):
        return none
    labels = labels_of(cp, off, model)
    on = np.flatnonzero(labels)
    if not len(on):
        return none
    d = np.searchsorted(off, on, side="right") - 1
    kinds = (labels[on] - 1) // 2
    begins = labels[on] % 2 == 1
    apart = np.r_[True, (on[1:] != on[:-1] + 1) | (kinds[1:] != kinds[:-1]) | (d[1:] != d[:-1])]
    new = np.flatnonzero(apart | begins)
    lo, hi, kind, row, fresh = on[new].tolist(), (on[np.r_[new[1:], len(on)] - 1] + 1).tolist(), kinds[new].tolist(), d[new].tolist(), begins[new].tolist()
    joined: list[list[int]] = []
    for s, e, k, r, b in zip(lo, hi, kind, row, fresh, strict=True):
        base = int(off[r])
        if not b and joined and joined[-1][3] == r and joined[-1][2] == k and s - base - joined[-1][1] <= GAP and not any(c.isalnum() for c in texts[r][joined[-1][1] : s - base]):
            joined[-1][1] = e - base
        else:
            joined.append([s - base, e - base, k, r])
    out = []
    for s, e, k, r in joined:
        if m := _FIRST.match(texts[r][s:e]):
            s += m.end()
        if m := _LAST.search(texts[r][s:e]):
            e -= len(m[0])
        if e > s:
            out.append((r, s, e, k))
    if not out:
        return none
    rows, s, e, k = zip(*out, strict=True)
    return np.array(rows, np.int64), list(s), list(e), list(k)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind) of every private span."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                rows, s, e, k = spans(b.column("text").fill_null("").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array([KINDS[x] for x in k], pa.string())], ["doc_id", "start", "end", "kind"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, start long, end long, kind string")


def mask(texts: list[str | None], model: Model) -> list[str | None]:
    """The texts with <KIND> in place of every private span; null stays null."""
    out = list(texts)
    rows, s, e, k = spans([t or "" for t in texts], model)
    for r, a, z, kind in reversed(list(zip(rows.tolist(), s, e, k, strict=True))):
        out[r] = f"{out[r][:a]}<{KINDS[kind].upper()}>{out[r][z:]}"
    return out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with private spans masked; ``n_chars``, where it is, follows the text."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(train())
    counted = [f.name for f in docs.schema.fields if f.name == "n_chars" and isinstance(f.dataType, T.LongType | T.IntegerType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                texts = b.column("text").to_pylist()
                new = mask(texts, shared.value)
                cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                cols["text"] = pa.array(new, b.column("text").type)
                for c in counted:
                    cols[c] = pa.array([n if t == u else len(u) for t, u, n in zip(texts, new, cols[c].to_pylist(), strict=True)], cols[c].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)
