"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, prepare

#: The kinds that the fixed patterns find, and one that only the model finds: keys, tokens and passwords in an assignment.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Windows of WIDTH characters begin every STRIDE; a span of up to WIDTH - STRIDE characters is whole in one of them.
WIDTH, STRIDE, LEARNED = 320, 256, 80
HIDDEN, MARGIN = 14, 2.0
LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each @ outwards, which is linear where the pattern alone is quadratic."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL_END.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start. Each kind is matched on its own; failing matches are dropped, not retried."""
    if not _TRIGGER.search(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _classes() -> np.ndarray:
    table = np.full(128, 1, np.uint8)  # other symbols
    for i, group in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@", ".", "-", "+", "([{", ")]}", " ", "_%", "\n\t\r", ":/=", ",;!?")):
        for c in group:
            table[ord(c)] = i + 2
    return table


_CLASS = _classes()
N_CLASSES, PAD, WIDE = 18, 0, 17


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], WIDE).astype(np.uint8)


def _lstm(x, wx, wh, keep=False):
    """Hidden states (T, B, H) for classes x (T, B); with keep also what the backward pass needs.

    Gates are clip(z / 4 + 1/2, 0, 1) and cells clip(z, -1, 1), which cost a fraction of exponentials; the 1/4 is in the weights."""
    steps, batch = x.shape
    size = wh.shape[0]
    h = c = np.zeros((batch, size), np.float32)
    hs, kept = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        z = wx[x[t]]
        z += h @ wh
        gates = np.clip(z[:, : 3 * size] + np.float32(0.5), 0, 1)
        g = np.clip(z[:, 3 * size :], -1, 1)
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        old, c = c, f * c + i * g
        th = np.clip(c, -1, 1)
        if keep:
            kept.append((gates, g, old, c, th, h))
        h = o * th
        hs[t] = h
    return hs, kept


def _lstm_back(x, wx, wh, kept, dhs):
    dwx, dwh = np.zeros_like(wx), np.zeros_like(wh)
    size = wh.shape[0]
    dh = dc = np.zeros_like(dhs[0])
    for t in range(len(x) - 1, -1, -1):
        gates, g, old, c, th, before = kept[t]
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        dh = dh + dhs[t]
        dc = dc + dh * o * (np.abs(c) < 1)
        dgates = np.concatenate([dc * g, dc * old, dh * th], axis=1) * ((gates > 0) & (gates < 1))
        dz = np.concatenate([dgates, dc * i * (np.abs(g) < 1)], axis=1)
        np.add.at(dwx, x[t], dz)
        dwh += before.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dwx, dwh


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def _states(x, wx, wh, out):
    """_lstm's hidden states for reading alone, as (T, H, B) into out: gates apart, so that each step works on whole arrays in place."""
    steps, batch = x.shape
    size = wh.shape[0]
    own = np.ascontiguousarray(wx.reshape(-1, 4, size).swapaxes(0, 1))
    turn = np.ascontiguousarray(wh.reshape(size, 4, size).swapaxes(0, 1))
    own[:3] += np.float32(0.5)
    z, h, c, given = (np.zeros(shape, np.float32) for shape in ((4, batch, size), (batch, size), (batch, size), (batch, size)))
    for t in range(steps):
        np.matmul(h, turn, out=z)
        for gate in range(4):
            np.take(own[gate], x[t], 0, out=given, mode="clip")
            z[gate] += given
        np.clip(z[:3], 0, 1, out=z[:3])
        np.clip(z[3], -1, 1, out=z[3])
        np.multiply(z[0], z[3], out=z[0])
        np.multiply(c, z[1], out=c)
        c += z[0]
        np.clip(c, -1, 1, out=h)
        h *= z[2]
        out[t] = h.T


def emissions(model, x):
    """(T, LABELS, B) scores of windows x (T, B)."""
    size = model["wh0"].shape[0]
    hidden = np.empty((len(x), 2 * size, x.shape[1]), np.float32)
    at = x.astype(np.intp)
    _states(at, model["wx0"], model["wh0"], hidden[:, :size])
    _states(at[::-1], model["wx1"], model["wh1"], hidden[::-1, size:])
    return np.matmul(np.ascontiguousarray(model["out"].T), hidden) + model["bias"][:, None]


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label paths (T, B) for scores (T, LABELS, B)."""
    steps, labels, batch = scores.shape
    best, back = scores[0], np.zeros((steps, labels, batch), np.uint8)
    for t in range(1, steps):
        top = best[0] + trans[0][:, None]
        for i in range(1, labels):
            other = best[i] + trans[i][:, None]
            np.copyto(back[t], i, where=other > top)
            np.maximum(top, other, out=top)
        best = top + scores[t]
    path = np.empty((steps, batch), np.uint8)
    path[-1] = best.argmax(0)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t, path[t], rows]
    return path


def doubtful(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Whether a label other than O may stand at each place (T, B) of a best path: not where O in its stead gains, whatever its neighbours."""
    steps = trans - trans[:, :1]  # what a step a -> y gains over a -> O
    turns = trans - trans[:1]  # what a step y -> b gains over O -> b
    return (scores[:, 1:] + (steps.max(0) + turns.max(1))[1:, None]).max(1) >= scores[:, 0]


def stretches(scores: np.ndarray, trans: np.ndarray):
    """(window, first place, scores (n, LABELS), path (n)) of every stretch of doubtful places that has another label than O.

    Each label costs the step into it, and the stretch a step back to O: where no place can pay for both, all is O.
    The places around a stretch are O on every best path, so the stretches of a window are decoded by themselves, with an O
    before and behind."""
    wide, pays = np.zeros((2, scores.shape[2], len(scores) + 1), bool)
    wide[:, :-1] = doubtful(scores, trans).T
    price = trans.max(0) - trans[0, 0] + max(0.0, float(trans[:, 0].max() - trans[0, 0]))
    pays[:, :-1] = ((scores[:, 1:] + price[1:, None]).max(1) >= scores[:, 0]).T
    edge = np.flatnonzero(np.diff(np.concatenate([[False], wide.ravel()]).astype(np.int8)))
    window, first = np.divmod(edge[::2], wide.shape[1])
    size = edge[1::2] - edge[::2]
    if len(size):
        paid = np.add.reduceat(pays.ravel(), edge[::2], dtype=np.int64) > 0  # up to the next stretch, which holds no other payer
        window, first, size = window[paid], first[paid], size[paid]
    for bits in np.unique(np.frexp(size)[1]):
        mine = np.flatnonzero(np.frexp(size)[1] == bits)
        longest = int(size[mine].max())
        for i in range(0, len(mine), 4096):
            some = mine[i : i + 4096]
            at = np.arange(-1, longest + 1)[:, None]
            place, inside = first[some] + at, (at >= 0) & (at < size[some])
            s = scores[np.clip(place, 0, len(scores) - 1), :, window[some]].swapaxes(1, 2)
            plain = np.full((scores.shape[1], 1), -1e9, np.float32)
            plain[0] = 0
            # At a window's ends nothing stands before or behind the stretch.
            s = np.where(inside[:, None, :], s, np.where(((place < 0) | (place >= len(scores)))[:, None, :], 0, plain[None]))
            path = viterbi(s, trans)
            for j in np.flatnonzero((path * inside).any(0)):
                n = size[some[j]]
                yield int(window[some[j]]), int(first[some[j]]), s[1 : n + 1, :, j], path[1 : n + 1, j]


def _step(model, x, y, margin: float = 0.0):
    """Mean CRF loss of a batch and its gradients. With a margin every wrong label starts so much ahead, which keeps the right ones clear."""
    batch = x.shape[1]
    left, kl = _lstm(x, model["wx0"], model["wh0"], True)
    right, kr = _lstm(x[::-1], model["wx1"], model["wh1"], True)
    hidden = np.concatenate([left, right[::-1]], axis=2)
    e, trans = hidden @ model["out"] + model["bias"], model["trans"]
    e = e + np.float32(margin) * (np.arange(LABELS) != y[:, :, None])
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, len(x)):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(len(x) - 2, -1, -1):
        beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - log_z[None, :, None])
    dtrans = np.zeros_like(trans)
    for t in range(1, len(x)):
        dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(0)
        np.add.at(dtrans, (y[t - 1], y[t]), -1)
    at = np.indices(y.shape)
    gold = e[at[0], at[1], y].sum() + trans[y[:-1], y[1:]].sum()
    de[at[0], at[1], y] -= 1
    de, dtrans = de / batch, dtrans / batch
    dh = de @ model["out"].T
    size = left.shape[2]
    g0 = _lstm_back(x, model["wx0"], model["wh0"], kl, dh[:, :, :size])
    g1 = _lstm_back(x[::-1], model["wx1"], model["wh1"], kr, dh[::-1, :, size:])
    grads = {"wx0": g0[0], "wh0": g0[1], "wx1": g1[0], "wh1": g1[1], "out": np.einsum("tbh,tbk->hk", hidden, de), "bias": de.sum((0, 1)), "trans": dtrans}
    return float((log_z.sum() - gold) / batch), grads


def train(x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 24, seed: int = 2) -> dict[str, np.ndarray]:
    """A model from labelled windows: classes x and labels y, both (T, N). Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    w = lambda *shape, scale=0.15: rng.normal(0, scale, shape).astype(np.float32)
    model = {f"{k}{d}": v for d in (0, 1) for k, v in (("wx", w(N_CLASSES, 4 * HIDDEN)), ("wh", w(HIDDEN, 4 * HIDDEN)))}
    for d in (0, 1):
        model[f"wx{d}"][:, HIDDEN : 2 * HIDDEN] += 0.35
    model |= {"out": w(2 * HIDDEN, LABELS, scale=0.4), "bias": np.zeros(LABELS, np.float32), "trans": np.zeros((LABELS, LABELS), np.float32)}
    m, v = {k: np.zeros_like(p) for k, p in model.items()}, {k: np.zeros_like(p) for k, p in model.items()}
    for n in range(1, steps + 1):
        at = rng.integers(0, x.shape[1], batch)
        _, grads = _step(model, x[:, at], y[:, at], MARGIN)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.015 * (1 - 0.95 * n / steps)
        grads["trans"] += 0.02 * model["trans"]  # small transitions: most windows then need no search
        for k, g in grads.items():
            g = g * min(1, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model[k] = (model[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return model


def examples(n: int = 5000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts by templates: running text and junk as crawls have it, personal data in usual and unusual writing, and
    look-alikes that are none: dates, versions, amounts, long numbers, digests outside an assignment."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    drawn = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    word = lambda: drawn("aeionrstlhdcumpgb" if rng.random() < 0.7 else "abcdefghijklmnopqrstuvwxyz\u00e9\u00ea\u00f1\u00fc\u00df\u00f3", rng.integers(1, 11))
    hexes = "0123456789abcdef"

    def card():
        d = pick("3456") + digits(14)
        d += next(x for x in "0123456789" if luhn(d + x))
        return pick(["", "", "", " ", "-", ".", "_", "/"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def email():
        at, dot = pick([("@", "."), ("@", "."), ("@", "."), ("[at]", "."), ("(at)", "."), ("(at)", "(dot)"), ("[at]", "[dot]")])
        hosts = [f"mail{digits(1)}", word(), word() + digits(1)]
        return f"{word()}{pick(['.', '_', '', '-'])}{pick(['', digits(2)])}{at}{pick(hosts)}{dot}{pick(['com', 'org', 'net', 'example.com', 'de', 'co.uk'])}"

    def ip():
        return pick([".", ".", ".", "[.]", "(.)"]).join(str(x) for x in rng.integers(0, 256, 4))

    def phone():
        return pick([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(11)}", f"tel {digits(3)}.{digits(3)}.{digits(4)}"])

    def secret():
        """What stands before the span, the span, what stands after it."""
        name = pick(["token", "token", "api_key", "secret", "password", "key", "access_token", "passwd"])
        name = name.upper() if rng.random() < 0.2 else name
        quote = pick(['"', '"', '"', "'"])
        k = int(rng.integers(20, 65)) if rng.random() < 0.5 else 40
        value = pick([drawn(hexes, k), drawn(hexes, k), drawn(hexes.upper(), k), drawn(hexes + "ghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k)])
        return f"{name}{pick([' = ', ' = ', '=', ': '])}{quote}", value, quote

    found = (lambda: ("", email(), ""), lambda: ("", ip(), ""), lambda: ("", card(), ""), lambda: ("", phone(), ""), secret)
    other = (
        lambda: drawn(hexes, rng.integers(12, 65)), lambda: f"commit {drawn(hexes, 40)}", lambda: f"20{digits(2)}-0{rng.integers(1, 9)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{digits(2)}.{digits(2)}", lambda: digits(rng.integers(1, 9)), lambda: f"{digits(2)}:{digits(2)}", lambda: "@" + word(), lambda: f"{word()}={word()}{digits(5)}", lambda: ".".join(digits(1) for _ in range(6)),
        lambda: digits(rng.integers(20, 30)), lambda: f"version {digits(1)}.", lambda: f"CC BY-NC {digits(1)}.{digits(1)}.", lambda: f'"{word()} {word()}"', lambda: f'{word()} = "{word()}"', lambda: f"({word()})", lambda: f"[{word()}]", lambda: f"{digits(3)}-{digits(4)}", lambda: f"{digits(3)} {digits(3)}",
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        tails, loud, cells = pick([["", "", "", ".", ","], ["", "", "", ".", ","], ["###", "$$$", "&&&", "!!", "***", "%%"]]), rng.random() < 0.08, rng.random() < 0.1
        while len(text) < LEARNED + 60:
            draw = rng.random()
            before = text[-1:] or " "
            if draw < 0.1 or (draw < 0.12 and before.isspace()):
                kind = int(rng.integers(len(KINDS)))
                left, value, right = found[kind]()
                text += left
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + right
            elif draw < 0.22:
                text += pick(other)()
            else:
                own = word()
                text += own.upper() if loud or rng.random() < 0.01 else own.capitalize() if rng.random() < 0.1 else own
            text += pick(tails) + (" | " if cells else "\n" if rng.random() < 0.04 else " ")
        out.append((text, spans))
    return out


def windows_of(labelled: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """One window of LEARNED characters of each labelled text at a random place, as classes and labels (T, N)."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for text, spans in labelled:
        x, y = np.full(max(LEARNED, len(text)), PAD, np.uint8), np.zeros(max(LEARNED, len(text)), np.uint8)
        x[: len(text)] = encode(text)
        for kind, s, e in spans:
            y[s:e] = 2 + 2 * kind
            y[s] = 1 + 2 * kind
        s = rng.integers(0, len(x) - LEARNED + 1)
        xs.append(x[s : s + LEARNED])
        ys.append(y[s : s + LEARNED])
    return np.stack(xs, 1), np.stack(ys, 1)


def proposals(scores: np.ndarray, path: np.ndarray, trans: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, margin) of the spans on one window's label path; the margin is what the path gains over all O there.

    scores (T, LABELS). A span begins at a B label and goes on over I labels of its kind; an I without a B before it is part
    of a span that the window does not show, and is left to the windows that do."""
    out, t = [], 0
    while t < len(path):
        if path[t] % 2 == 0:
            t += 1
            continue
        e = t + 1
        while e < len(path) and path[e] == path[t] + 1:
            e += 1
        own = [0, *path[t:e], 0]
        gain = scores[np.arange(t, e), path[t:e]].sum() - scores[t:e, 0].sum() + sum(trans[a, b] for a, b in zip(own[:-1], own[1:])) - (e - t + 1) * trans[0, 0]
        out.append(((int(path[t]) - 1) // 2, t, e, float(gain)))
        t = e
    return out


def reconciled(found: list[tuple[int, int, int, float]], fixed: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The spans of a text: of all windows' proposals (kind, start, end, mean margin) the set without overlaps, with each other or
    with a fixed span, whose margins have the greatest sum (weighted interval scheduling over the whole text)."""
    fixed, starts = sorted(fixed), sorted(s for s, _ in fixed)
    free = []
    for kind, s, e, w in found:
        i = bisect_right(starts, e - 1)
        if not i or max(b for _, b in fixed[max(0, i - 4) : i]) <= s:
            free.append((e, s, kind, w))
    free.sort()
    ends, best, pick = [x[0] for x in free], [0.0], []
    for i, (_, s, _, w) in enumerate(free):
        before = bisect_right(ends, s, 0, i)
        take = best[before] + w
        pick.append((take > best[i], before))
        best.append(max(best[i], take))
    out, i = [], len(free)
    while i:
        take, before = pick[i - 1]
        if take:
            e, s, kind, _ = free[i - 1]
            out.append((kind, s, e))
        i = before if take else i - 1
    return sorted(out)


def decoded(texts: list[str], model: dict[str, np.ndarray], batch: int = 1024) -> list[list[tuple[int, int, int, float]]]:
    """What the windows of each text propose: (kind, start, end, mean margin over the windows that hold the span whole).

    Every window goes through the network; the label search is left out where it must find O."""
    xs, places = [], []
    for i, t in enumerate(texts):
        x = encode(t)
        starts = np.arange(0, max(1, len(x) - (WIDTH - STRIDE)), STRIDE)
        padded = np.concatenate([x, np.full(WIDTH, PAD, np.uint8)])
        xs.append(padded[starts[:, None] + np.arange(WIDTH)])
        places += [(i, s) for s in starts.tolist()]
    trans = model["trans"]
    sums: list[dict] = [{} for _ in texts]
    for k in range(0, len(places), batch):
        for w, first, scores, path in stretches(emissions(model, _columns(xs, k, batch)), trans):
            i, start = places[k + w]
            size = len(texts[i])
            for kind, s, e, gain in proposals(scores, path, trans):
                s, e = s + start + first, e + start + first
                if e <= size and (e < start + WIDTH or e == size):
                    sums[i][kind, s, e] = sums[i].get((kind, s, e), 0.0) + gain
    out = []
    for found, t in zip(sums, texts):
        last = max(0, -(-(len(t) - (WIDTH - STRIDE)) // STRIDE) - 1) * STRIDE
        whole = lambda s, e: max(1, (min(s, last) // STRIDE) - max(0, -((WIDTH - e) // STRIDE)) + 1)  # noqa: B023,E731
        out.append([(kind, s, e, gain / whole(s, e)) for (kind, s, e), gain in found.items()])
    return out


def _columns(xs: list[np.ndarray], at: int, n: int) -> np.ndarray:
    """Windows at .. at + n of all texts' windows, as columns."""
    ends = np.cumsum([len(x) for x in xs])
    i, out = int(np.searchsorted(ends, at, "right")), []
    while n > 0 and i < len(xs):
        lo = at - (int(ends[i]) - len(xs[i]))
        part = xs[i][lo : lo + n]
        out.append(part)
        at, n, i = at + len(part), n - len(part), i + 1
    return np.ascontiguousarray(np.concatenate(out).T)


def _sums_up(text: str, span) -> bool:
    """Not a card number that fails Luhn."""
    return span[0] != 2 or luhn(_digits(text[span[1] : span[2]]))


def spans_of(texts: list[str], model: dict[str, np.ndarray]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. The model's spans need a mean margin of the model's threshold at least; a card number
    must also pass Luhn, its checksum, which no pattern of labels can tell."""
    out = []
    for t, found in zip(texts, decoded(texts, model)):
        base = base_spans(t)
        able = [x for x in found if x[3] >= model["least"][x[0]] and _sums_up(t, x)]
        out.append((base, sorted(base + reconciled(able, [(s, e) for _, s, e in base]))))
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def thresholds(model: dict, labelled, goal: float = 0.99) -> np.ndarray:
    """For each kind the least margin from which on `goal` of the proposals on labelled texts are labelled spans, but for one; infinite without proposals."""
    seen: list[list] = [[] for _ in KINDS]
    for (text, spans), found in zip(labelled, decoded([t for t, _ in labelled], model)):
        for kind, s, e, gain in found:
            if _sums_up(text, (kind, s, e)):
                seen[kind].append((gain, (kind, s, e) in spans))
    least = np.full(len(KINDS), np.inf)
    for kind, rows in enumerate(seen):
        rows.sort(reverse=True)
        right = np.cumsum([ok for _, ok in rows])
        good = np.flatnonzero(right + 1 >= goal * np.arange(1, len(rows) + 1))
        if len(good):
            least[kind] = rows[good[-1]][0]
    return least


def trained(labelled=None) -> dict[str, np.ndarray]:
    """The model: from the caller's labelled spans [(text, [(kind, start, end)])] or from the templates. Seeds are fixed. A fifth of
    the texts is not fitted on and sets the thresholds."""
    if labelled is None:
        return _from_templates()
    held = max(1, len(labelled) // 5)
    model = train(*windows_of(labelled[held:]))
    return model | {"least": thresholds(model, labelled[:held])}


@cache
def _from_templates() -> dict[str, np.ndarray]:
    return trained(examples())


def _strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _in_parts(texts: list[str], model: dict, most: int = 1 << 20):
    """spans_of in parts of about `most` characters, so that a batch's windows are never all held at once; a longer text is a part."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield from spans_of(part, model)
            part, size = [], 0
    yield from spans_of(part, model)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """doc_id, n_* (base spans by kind), base_sha256, spans (all, by kind and start) and n_added of each row; positions in code points.

    Null texts count as empty; every row of a repeated id is answered. The model (some 4,000 numbers) goes with the task. An
    empty table gives an empty result."""
    prepare(docs.sparkSession)
    model = model or trained()
    raw = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = raw.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = list(_in_parts(_strings(batch.column(1)), model))
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in range(len(BASE_KINDS))]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows], pa.string())
            every = pa.array([written(spans) for _, spans in rows], pa.string())
            added = pa.array([len(spans) - len(base) for base, spans in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, every, added], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"])

    return raw.mapInArrow(run, f"doc_id {kind}, " + "".join(f"n_{k} long, " for k in BASE_KINDS) + "base_sha256 string, spans string, n_added long")


def masked(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= end:
            out += [text[end:s], f"<{KINDS[kind].upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of docs with personal data masked in text, and n_chars renewed. Null texts stay null; every row of a repeated id is
    masked; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    model = model or trained()
    rest = F.struct(F.lit(0).alias("none"), F.struct(*own_columns(docs, "text", "n_chars")).alias("rest")).alias("row")
    raw = docs.select(rest, "text")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [t if t is None else masked(t, spans) for t, (_, spans) in zip(texts, _in_parts([t or "" for t in texts], model))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    out = raw.mapInArrow(run, raw.schema)
    return out.select(*(new[c].alias(c) if c in new else F.col("row.rest")[c].alias(c) for c in docs.columns))
