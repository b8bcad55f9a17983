"""Personal data: exact base patterns, and a character BiLSTM with CRF transitions that adds spans to them.

Base spans come from linear-time scans of every whole text (email, ip, card, phone). The model adds what
patterns miss: phones without a plus sign, spelled-out addresses, keys and tokens. It is trained here, in
numpy, from labelled spans that a seeded generator writes, so training needs no table and is the same on
every cluster.

What the operator adds is by definition a span that holds a digit, an @ or a spelled-out (at), and has the least its kind has
(`plausible`): passwords of letters alone, names and postal addresses are not looked for. Windows of WINDOW characters, half
overlapping, are therefore decoded wherever such a character stands; another window cannot hold such a span. Spans cut by a window's edge give way to the overlapping window that holds them whole, or
are joined with their other half; the remaining candidates of a text are reconciled together by
weighted interval scheduling. Spans that touch a base span are dropped: base spans stay.

Edge cases: null text counts as empty (no spans, digest of ""); repeated rows are scanned each; very long texts are scanned whole,
their windows in blocks; of candidates with equal sums the later one stays out; further columns are left out unless carried; an empty
table gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import map_chunks

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
ORDER = {k: i for i, k in enumerate(KINDS)}
WINDOW, STRIDE = 96, 48

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += DOUBLED[ord(c) - 48] if i & 1 else ord(c) - 48
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns of the contract, by start and then kind as listed."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        # a part of more than 3 digits exceeds 255 unless it starts with zeros
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


# --- the tagger -----------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
CHARS = 131  # ASCII, other letters, anything else, padding
PAD = 130


def char_ids(codes: np.ndarray) -> np.ndarray:
    """Vocabulary numbers: ASCII as is, letters of other scripts together, the rest together."""
    return np.where(codes < 128, codes, np.where((codes >= 0xAA) & (codes < 0x2000) | (codes >= 0x2C00), 128, 129)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Bidirectional LSTM over characters, linear emissions, CRF transitions; float32 numpy throughout."""

    def __init__(self, hidden: int = 24, embed: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = lambda *s, k=1.0: (rng.standard_normal(s) * k / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"E": n(CHARS, embed, k=3.0), "T": np.zeros((TAGS, TAGS), np.float32), "O": n(2 * hidden, TAGS), "ob": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": n(embed, 4 * hidden), f"U{d}": n(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1

    def forward(self, x: np.ndarray, keep: bool = False):
        """Emissions (steps, rows, tags) of characters x (rows, steps)."""
        p, h = self.p, self.hidden
        rows, steps = x.shape
        outs = np.empty((steps, rows, 2 * h), np.float32)
        memo = {}
        for d in "fb":
            proj = p["E"] @ p[f"W{d}"] + p[f"b{d}"]
            state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
            trace = []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                z = proj[x[:, t]] + state @ p[f"U{d}"]
                s = sigmoid(z[:, : 3 * h])
                g = np.tanh(z[:, 3 * h :])
                i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
                new = f * cell + i * g
                tc = np.tanh(new)
                if keep:
                    trace.append((t, i, f, o, g, cell, tc, state))
                cell, state = new, o * tc
                outs[t, :, :h] = state if d == "f" else outs[t, :, :h]
                if d == "b":
                    outs[t, :, h:] = state
            memo[d] = trace
        emit = outs @ p["O"] + p["ob"]
        return (emit, outs, memo) if keep else emit

    def loss_grad(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tag rows y and its gradient (forward-backward, then through time)."""
        p, h = self.p, self.hidden
        rows, steps = x.shape
        emit, outs, memo = self.forward(x, keep=True)
        T = p["T"]
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        lse = lambda a, ax: (m := a.max(axis=ax, keepdims=True)).squeeze(ax) + np.log(np.exp(a - m).sum(axis=ax))
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + T, 1) + emit[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(T[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        logz = lse(alpha[-1], 1)
        r = np.arange(rows)
        gold = sum(emit[t, r, y[:, t]] for t in range(steps)) + sum(T[y[:, t - 1], y[:, t]] for t in range(1, steps))
        d_emit = np.exp(alpha + beta - logz[None, :, None])
        dT = np.zeros_like(T)
        for t in range(1, steps):
            dT += np.exp(alpha[t - 1][:, :, None] + T + (emit[t] + beta[t])[:, None, :] - logz[:, None, None]).sum(axis=0)
            np.add.at(dT, (y[:, t - 1], y[:, t]), -1)
        for t in range(steps):
            d_emit[t, r, y[:, t]] -= 1
        d_emit /= rows
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["T"] = dT / rows
        g["O"] = np.tensordot(outs, d_emit, ([0, 1], [0, 1]))
        g["ob"] = d_emit.sum(axis=(0, 1))
        d_out = d_emit @ p["O"].T
        for d in "fb":
            at = slice(0, h) if d == "f" else slice(h, 2 * h)
            d_state, d_cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
            d_proj = np.zeros((CHARS, 4 * h), np.float32)
            for t, i, f, o, c, cell, tc, state in reversed(memo[d]):
                ds = d_out[t, :, at] + d_state
                dc = d_cell + ds * o * (1 - tc * tc)
                dz = np.concatenate([dc * c * i * (1 - i), dc * cell * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - c * c)], axis=1)
                g[f"U{d}"] += state.T @ dz
                np.add.at(d_proj, x[:, t], dz)
                d_state, d_cell = dz @ p[f"U{d}"].T, dc * f
            g[f"W{d}"] = p["E"].T @ d_proj
            g["E"] += d_proj @ p[f"W{d}"].T
            g[f"b{d}"] = d_proj.sum(axis=0)
        return float((logz - gold).mean()), g

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag rows (rows, steps), and by character how far its tag's emission lies above that of O."""
        emit = self.forward(x)
        steps, rows, _ = emit.shape
        best, back = emit[0], np.empty((steps, rows, TAGS), np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + self.p["T"]
            back[t] = s.argmax(axis=1)
            best = s.max(axis=1) + emit[t]
        tags = np.empty((rows, steps), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        r = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, r, tags[:, t]]
        e = emit.transpose(1, 0, 2)
        return tags, np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]


def sample(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A window of invented text and its labelled spans."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllables = ["th", "er", "on", "an", "re", "ing", "ed", "tion", "ment", "que", "eau", "sch", "ung", "keit", "ción", "ado", "os", "la", "de", "é", "ñ", "ü", "ou", "ha", "ble", "st"]

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
        return w.upper() if rng.random() < 0.1 else w.capitalize() if rng.random() < 0.1 else w

    hexes = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def personal() -> tuple[str, str, str, str]:
        kind = pick(["email", "email", "ip", "card", "phone", "phone", "phone", "secret", "secret", "secret"])
        name, host = word().lower() + pick(["", ".", "_"]) + pick(["", digits(2)]), pick(["mail", "mx", word().lower()]) + pick([".", digits(1) + "."]) + pick(["example.com", "example.org", "net", "com"])
        if kind == "email":
            return kind, "", pick([f"{name}@{host}", f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name}[at]{host}", f"{name} @ {host}"]), ""
        if kind == "ip":
            return kind, "", ".".join(str(int(rng.integers(0, 256))) for _ in range(4)), ""
        if kind == "card":
            d = digits(16)
            return kind, "", pick([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))]), ""
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return kind, pick(["", "", "tel ", "phone: ", "call "]), pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"00{digits(2)} {a} {b}{c}"]), ""
        return kind, pick(['token = "', 'api_key: "', "secret=", "key = '", 'password = "', ""]), pick([hexes(40), hexes(32), hexes(64), "AKIA" + alnum(16).upper(), "sk_live_" + alnum(24), "ghp_" + alnum(36)]), pick(['"', "", "'"])

    def plain() -> str:
        return pick([
            lambda: f"version {digits(1)}.{digits(1)}", lambda: f"{digits(4)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"${digits(2)}.{digits(2)}",
            lambda: f"{digits(1)},{digits(3)}", lambda: f"No. {digits(2)}", lambda: f"@{word()}", lambda: f"{word()}{digits(1)}", lambda: f"page {digits(2)}", lambda: f"{digits(2)}%", lambda: f"{digits(2)}:{digits(2)}", lambda: f"http://{word()}.example.com/{digits(3)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(5)}", lambda: f"{digits(1)}. {word()}",
        ])()

    text, spans = "", []
    while len(text) < WINDOW:
        u = rng.random()
        if u < 0.1:
            kind, before, what, after = personal()
            text += before
            spans.append((len(text), len(text) + len(what), kind))
            text += what + after
        elif u < 0.2:
            text += plain()
        else:
            text += word()
        text += pick([" ", " ", " ", " ", ", ", ".\n", "*** ", "### ", "$$$ ", "!! ", " | ", ". "])
    cut = int(rng.integers(0, len(text) - WINDOW + 1))
    return text[cut : cut + WINDOW], [(max(0, a - cut), b - cut, k) for a, b, k in spans if b > cut and a < cut + WINDOW]


def batch_of(rng: np.random.Generator, rows: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.full((rows, WINDOW), PAD, np.int64), np.zeros((rows, WINDOW), np.int64)
    for r in range(rows):
        text, spans = sample(rng)
        x[r, : len(text)] = char_ids(np.array([ord(c) for c in text], np.uint32))
        for a, b, k in spans:
            y[r, a : min(b, WINDOW)] = 2 + 2 * ORDER[k]
            y[r, a] = 1 + 2 * ORDER[k]
    return x, y


@lru_cache(maxsize=2)
def trained(steps: int = 420, rows: int = 48, seed: int = 11) -> Tagger:
    """The tagger after `steps` Adam steps on generated windows."""
    rng, tagger = np.random.default_rng(seed), Tagger()
    m, v = ({k: np.zeros_like(a) for k, a in tagger.p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        _, g = tagger.loss_grad(*batch_of(rng, rows))
        scale = min(1.0, 5.0 / (sum(float((x * x).sum()) for x in g.values()) ** 0.5 + 1e-9))
        rate = 0.012 * min(1.0, t / 20) * (0.5 * (1 + np.cos(np.pi * t / steps)) + 0.03)
        for k, a in tagger.p.items():
            d = g[k] * scale
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.995 * v[k] + 0.005 * d * d
            a -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.995**t)) + 1e-8)
    return tagger


TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
NAMED = re.compile(r"[A-Za-z_]+[=:]")
TRIM = " \t\r\n.,;:!?\"'()[]{}<>|*#$%&="
TRIGGER_CODES = np.zeros(CHARS, bool)
TRIGGER_CODES[[*range(48, 58), 64, ord("("), ord("[")]] = True


def windows_of(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a trigger: multiples of STRIDE, so each character lies in two of them."""
    at = np.flatnonzero(TRIGGER_CODES[codes]) // STRIDE
    return np.unique(np.concatenate([at, at[at > 0] - 1])) * STRIDE if len(at) else at


def spans_in(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the runs of one tag row."""
    out, at = [], np.flatnonzero(tags)
    for i in at:
        k = (int(tags[i]) - 1) // 2
        if out and out[-1][1] == i and out[-1][2] == k and not tags[i] & 1:
            out[-1][1] = int(i) + 1
        else:
            out.append([int(i), int(i) + 1, k])
    return [tuple(x) for x in out]


def reconcile(cands: list[tuple[int, int, int, float, bool, bool]], text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The best set of disjoint spans of a text. cands: start, end, kind, score, cut at its left, at its right."""
    whole = {}
    cut = sorted(c for c in cands if c[4] or c[5])
    for a, b, k, s, left, right in cands:
        if not left and not right:
            whole[a, b, k] = whole.get((a, b, k), 0.0) + s
    for a, b, k, s, left, right in cut:
        if any(x < b and a < y for x, y, _ in whole):
            continue
        # the halves that two windows saw of one long span
        same = [c for c in cut if c[2] == k and c[0] <= b and a <= c[1]]
        lo, hi = min(c[0] for c in same), max(c[1] for c in same)
        whole[lo, hi, k] = max(whole.get((lo, hi, k), 0.0), sum(c[3] for c in same))
    good = []
    for (a, b, k), s in whole.items():
        while a < b and text[a] in TRIM and not (text[a] in "([" and k in (0, 3)):
            a += 1
        while a < b and text[b - 1] in TRIM:
            b -= 1
        if k == ORDER["secret"] and (named := NAMED.match(text, a, b)):
            a = named.end()
        if s > 0 and plausible(text[a:b], KINDS[k]) and not any(x < b and a < y for x, y, _ in taken):
            good.append((b, a, k, s))
    good.sort()
    best, choice = [0.0], []
    import bisect

    ends = [g[0] for g in good]
    for b, a, _, s in good:
        j = bisect.bisect_right(ends, a, 0, len(choice))
        choice.append((best[j] + s > best[-1], j))
        best.append(max(best[-1], best[j] + s))
    out, i = [], len(good)
    while i:
        use, j = choice[i - 1]
        if use:
            b, a, k, _ = good[i - 1]
            out.append((a, b, KINDS[k]))
            i = j
        else:
            i -= 1
    return out[::-1]


def plausible(s: str, kind: str) -> bool:
    """The least a span of a kind has; what the tagger says below it is noise."""
    n = sum(c.isdigit() for c in s)
    if not TRIGGER.search(s):
        return False
    if kind == "email":
        return bool(re.search(r"\w\s*(?:@|[(\[]at[)\]])\s*\w+", s))
    if kind in ("phone", "card"):
        return (9 if kind == "phone" else 12) <= n <= (15 if kind == "phone" else 19) and n >= 0.6 * len(s) and (kind == "phone" or luhn(NOT_DIGIT.sub("", s)))
    if kind == "ip":
        return n >= 4 and s.count(".") == 3
    return len(s) >= 16 and n >= 2 and not re.search(r"\s", s) and any(c.isalpha() for c in s)


def tag_texts(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, str]]], rows: int = 1024) -> list[list[tuple[int, int, str]]]:
    """The model's additional spans of each text. Windows that base spans explain wholly are decoded as well."""
    where, seen, blocks = [], {}, []
    for i, text in enumerate(texts):
        if not TRIGGER.search(text):
            continue
        codes = char_ids(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        for a in windows_of(codes).tolist():
            w = codes[a : a + WINDOW]
            key = w.astype(np.uint8).tobytes()  # equal windows are decoded once
            if key not in seen:
                seen[key] = len(blocks)
                blocks.append(w if len(w) == WINDOW else np.pad(w, (0, WINDOW - len(w)), constant_values=PAD))
            where.append((i, a, seen[key]))
    found: dict[int, list] = {}
    for s in range(0, len(blocks), rows):
        tags, above = tagger.decode(np.array(blocks[s : s + rows]))
        for r in np.flatnonzero(tags.any(axis=1)):
            found[s + int(r)] = [(a, b, k, float(above[r, a:b].sum())) for a, b, k in spans_in(tags[r])]
    cands: dict[int, list] = {}
    for i, a, block in where:
        for x, y, k, s in found.get(block, ()):
            if a + x < len(texts[i]):
                cands.setdefault(i, []).append((a + x, min(a + y, len(texts[i])), k, s, x == 0 and a > 0, y == WINDOW and a + y < len(texts[i])))
    return [reconcile(cands[i], t, base[i]) if i in cands else [] for i, t in enumerate(texts)]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first one's kind in brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def base_columns(base: list[list[tuple[int, int, str]]]) -> dict[str, list]:
    """The contract's columns of the base spans."""
    out = {f"n_{k}": [sum(s[2] == k for s in b) for b in base] for k in BASE_KINDS}
    return out | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]}


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts and digest of base spans, without the model."""

    def run(rows: dict[str, list]) -> dict:
        return {"id": rows["id"]} | base_columns([base_spans(t or "") for t in rows["text"]])

    got = map_chunks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string")
    return got.withColumnRenamed("id", id_col)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Per row: id, counts and digest of base spans, all spans and how many they are; redact adds the text without them, `carry` passes string columns on."""
    tagger, carry = trained(), carry or []

    def run(rows: dict[str, list]) -> dict:
        texts = [t or "" for t in rows["text"]]
        base = [base_spans(t) for t in texts]
        every = [sorted(b + m, key=lambda s: (s[0], ORDER[s[2]])) for b, m in zip(base, tag_texts(tagger, texts, base), strict=True)]
        out = {"id": rows["id"]} | base_columns(base)
        out |= {"spans": [joined(s) for s in every], "n_added": [len(s) - len(b) for s, b in zip(every, base, strict=True)], "n_spans": [len(s) for s in every]}
        if redact:
            out["clean"] = [None if rows["text"][i] is None else redacted(t, every[i]) for i, t in enumerate(texts)]
        return out | {f"c_{c}": rows[f"c_{c}"] for c in carry}

    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long" + ", clean string" * redact + "".join(f", c_{c} string" for c in carry)
    got = map_chunks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).cast("string").alias(f"c_{c}") for c in carry)), run, schema)
    return got.select(F.col("id").alias(id_col), *(c for c in got.columns if c != "id" and not c.startswith("c_")), *(F.col(f"c_{c}").alias(c) for c in carry))
