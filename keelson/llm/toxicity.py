"""Toxicity by compression distance: zstandard dictionaries trained on each class, and how much shorter one makes each window.

A window is a run of WORDS words, lower-cased, between boundaries of three characters, in UTF-8; one word by default, as with more of
them the rest of a window hides what one word saves. zstandard's own trainer makes every dictionary from windows; windows that stand
there twice or more follow whole, as the trainer keeps frequent segments and not where words end. A window's distance is its compressed
length under the ordinary dictionary less that under a toxic one; a run of one character ends it as it is compressed, so that zstandard
never stores it uncompressed.

Most windows of a toxic text are ordinary, so toxic dictionaries are trained in rounds on windows nearer to toxic text than to ordinary:
toxic training texts fall into two halves, a dictionary of one half's windows measures those of the other half (never its own, which it
holds), and the share of them that lies farthest out trains the next round. Both halves' last dictionaries stay: a window's score is the
smaller of its two distances, as what is toxic by chance is so in one half only. Copies, near copies and shared passages among the
training texts count once.

The ordinary dictionary is trained once. A quarter of both classes' training texts is kept out of all dictionaries and calibrates:
distances become standard scores among ordinary windows of equal length; a text's evidence is the two largest scores of its distinct
windows, how many pass each of CUTS, and how many windows there are; a logistic curve makes a probability of it, so 0.5 is the threshold.

The fit reads at most `sample_docs` labelled texts (whole); all texts are scored on all their windows. Scores of words seen lately are
remembered, which changes no result.
Edge cases: null, empty and wordless texts have no window and score by the curve at zero evidence; very long texts are scored on all
their distinct windows; repeated rows score alike, as do texts of equal evidence; without labels every score is 0; with one class it is
that class's smoothed share. Null labels are not learned from; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import mix
from keelson.llm.quality import labelled_sample, score_rows

WORD = re.compile(r"[^\W\d_]+")
WORDS = 1
BOUND = "~~~"
RUN = "." * 24
#: The trainer's segment and d-mer lengths, and what it makes in bytes: the ordinary dictionary should hold whatever is common.
SEGMENT, DMER = 16, 6
ORDINARY_BYTES, TOXIC_BYTES = 1 << 20, 8192
#: By round, the size of the toxic halves' dictionaries and the share of windows kept.
ROUNDS = ((65536, 0.15), (32768, 0.10), (16384, 0.07), (8192, 0.05), (8192, 0.04))
CALIBRATE = 4
LONGEST = 48
CUTS = (1.5, 2.5, 3.5, 5.0)
REMEMBER = 200_000


def without_copies(texts: list[list[str]]) -> list[int]:
    """The first of each group of texts, given as their words, that share two of four minimal hashes of three-word shingles."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, ws in enumerate(texts):
        h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in ws] or [i], np.uint64)
        h = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) if len(h) > 2 else h
        keys = [(k, int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))]
        if sum(k in seen for k in keys) < 2:
            out.append(i)
        seen.update(keys)
    return out


def windows(words: list[str]) -> list[str]:
    """The distinct windows of a text, in the order of their first places."""
    if WORDS == 1:
        return list(dict.fromkeys(words))
    return list(dict.fromkeys(BOUND.join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)))


def uncopied(words: list[str], seen: set[int]) -> list[str]:
    """The distinct windows of a text at places whose words, with one before and one after, no earlier text has: a passage that texts share counts once."""
    out, here = [], set()
    for i in range(0, len(words), WORDS):
        key = hash(tuple(words[max(0, i - 1) : i + WORDS + 1]))
        if key not in seen:
            out.append(BOUND.join(words[i : i + WORDS]))
        here.add(key)
    seen |= here
    return list(dict.fromkeys(out))


def written(window: str) -> bytes:
    return f"{BOUND}{window}{BOUND}".encode("utf-8", "surrogatepass")


def trained(size: int, made: list[str]) -> bytes:
    """A dictionary of about `size` bytes by zstandard's trainer from these windows, as often as they stand there, and as much again of those that stand there twice or more."""
    samples = [written(w) for w in made]
    try:
        out = zstandard.train_dictionary(size, samples, k=SEGMENT, d=DMER).as_bytes()
    except (ValueError, zstandard.ZstdError):  # too few windows for the trainer
        out = b""
    often = sorted((n, w) for w, n in Counter(samples).items() if n > 1 or not out)
    return out + b"".join(w for _, w in often)[-size:] or BOUND.encode()


@lru_cache(maxsize=3)
def compressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    params = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=17, chain_log=17, search_log=5, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=params).compress


def lengths(dictionary: bytes, made: list[str]) -> np.ndarray:
    """Compressed lengths of windows."""
    packed, end = compressor(dictionary), RUN.encode()
    return np.array([len(packed(written(w) + end)) for w in made], float)


class Scale:
    """Mean and deviation of ordinary windows' distances by window length, drawn to those of all lengths where few have one."""

    def __init__(self, made: list[str], distances: np.ndarray):
        at = np.array([min(len(w), LONGEST) for w in made], np.int64)
        mean = distances.mean() if len(made) else 0.0
        spread = ((distances - mean) ** 2).mean() if len(made) else 1.0
        n, total, squares = (np.bincount(at, x, LONGEST + 1) for x in (np.ones(len(at)), distances, distances * distances))
        self.mean = (total + 20 * mean) / (n + 20)
        self.deviation = np.sqrt(np.maximum(0, (squares + 20 * (spread + mean * mean)) / (n + 20) - self.mean**2)) + 0.3

    def scores(self, made: list[str], distances: np.ndarray) -> np.ndarray:
        at = np.array([min(len(w), LONGEST) for w in made], np.int64)
        return (distances - self.mean[at]) / self.deviation[at]


def evidence(scores: np.ndarray) -> list[float]:
    """A text's evidence from its windows' scores."""
    best = np.sort(np.clip(scores, 0, 12))[::-1][:2]
    return [*np.append(best, np.zeros(2 - len(best))) / 4, *(np.log1p((scores > c).sum()) for c in CUTS), np.log1p(len(scores)) / 4, 1.0]


class DictionaryPair:
    """Both dictionaries, the scale of their distances and the calibrated curve."""

    def __init__(self):
        self.ordinary, self.toxic = BOUND.encode(), (BOUND.encode(), BOUND.encode())
        self.scales, self.curve = (Scale([], np.zeros(0)), Scale([], np.zeros(0))), np.array([0.0] * (3 + len(CUTS)) + [-30.0])
        self._young: dict[str, float] = {}
        self._old: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_young": {}, "_old": {}}

    def window_scores(self, made: list[str]) -> np.ndarray:
        """By window, its standardised distance."""
        young, old = self._young, self._old
        new = [w for w in made if w not in young and w not in old]
        usual = lengths(self.ordinary, new)
        both = [scale.scores(new, usual - lengths(d, new)) for scale, d in zip(self.scales, self.toxic, strict=True)]
        fresh = dict(zip(new, np.minimum(*both).tolist(), strict=True))
        out = np.empty(len(made))
        for i, w in enumerate(made):
            x = young.get(w)
            if x is None:
                x = fresh[w] if w in fresh else old[w]
                young[w] = x
            out[i] = x
        if len(young) > REMEMBER:  # what two fillings did not ask for is forgotten
            self._young, self._old = {}, young
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        made = [windows(WORD.findall((t or "").lower())) for t in texts]
        flat = list(dict.fromkeys(w for x in made for w in x))
        known = dict(zip(flat, self.window_scores(flat).tolist(), strict=True))
        e = np.array([evidence(np.array([known[w] for w in x])) for x in made]).reshape(-1, len(self.curve))
        return 1 / (1 + np.exp(-np.clip(e @ self.curve, -30, 30)))

    def fit(self, texts: list[str | None], labels: list[int]) -> DictionaryPair:
        y = np.array(labels, float)
        if not len(y):
            return self
        if y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            self.curve = np.array([0.0] * (3 + len(CUTS)) + [np.log(share / (1 - share))])
            return self
        names: dict[str, str] = {}  # each word once in memory
        words = [[names.setdefault(w, w) for w in WORD.findall((t or "").lower())] for t in texts]
        first = without_copies(words)
        seen: set[int] = set()
        toxic, ordinary = [uncopied(words[i], seen) for i in first if y[i]], [windows(words[i]) for i in first if not y[i]]
        del words
        apart = min(len(toxic), len(ordinary)) >= 4 * CALIBRATE
        held = [[x for i, x in enumerate(group) if not apart or i % CALIBRATE == 0] for group in (ordinary, toxic)]
        ordinary, toxic = ([x for i, x in enumerate(group) if not apart or i % CALIBRATE] for group in (ordinary, toxic))
        self.ordinary = trained(ORDINARY_BYTES, [w for x in ordinary for w in x])
        kept = halves = [[w for x in toxic[h::2] for w in x] for h in (0, 1)] if len(toxic) > 1 else [toxic[0]] * 2
        calm = list(dict.fromkeys(w for x in held[0] for w in x))
        flat = list(dict.fromkeys([*calm, *halves[0], *halves[1]]))
        usual = dict(zip(flat, lengths(self.ordinary, flat).tolist(), strict=True))

        def measured(dictionary: bytes, made: list[str]) -> np.ndarray:
            each = list(dict.fromkeys(made))
            far = {w: usual[w] - n for w, n in zip(each, lengths(dictionary, each).tolist(), strict=True)}
            return np.array([far[w] for w in made])

        for size, share in ROUNDS:
            new = []
            for h in (0, 1):
                judge = trained(size, kept[1 - h])
                scores = Scale(calm, measured(judge, calm)).scores(halves[h], measured(judge, halves[h]))
                new.append([halves[h][i] for i in np.argsort(-scores, kind="stable")[: max(1, int(share * len(scores)))]])
            kept = new
        self.toxic = tuple(trained(TOXIC_BYTES, k) for k in kept)
        self.scales = tuple(Scale(calm, measured(d, calm)) for d in self.toxic)
        e = np.array([evidence(self.window_scores(x)) for group in held for x in group])
        self.curve = logistic(e, np.repeat([0.0, 1.0], [len(x) for x in held]))
        return self


def logistic(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by Newton steps with a small ridge."""
    w, ridge = np.zeros(e.shape[1]), np.full(e.shape[1], 0.05)
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(e @ w, -30, 30)))
        h = (e * (p * (1 - p) + 1e-6)[:, None]).T @ e + np.diag(ridge)
        step = np.linalg.solve(h, e.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, threshold: float = 0.5) -> DataFrame:
    """labels: doc_id, label (1 toxic). Returns doc_id, held_out, score, predicted."""
    model = DictionaryPair().fit(*labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, sample_docs))
    return score_rows(docs, model.score, threshold)
