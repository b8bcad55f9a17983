"""Vectorised features of lines, for models that read documents line by line."""

from __future__ import annotations

import numpy as np

from keelson.llm.common import codes_of, is_space, mix, runs, span_hashes

NAMES = ["log_words", "log_chars", "mean_word", "symbols", "marks", "upper", "digits", "repeats", "distinct", "seen_line", "ends", "common"]
COMMON = "the of and to in is that was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their la le de les et des en un une du que dans est pour qui sur au der die und das den von zu mit sich auf ist im dem ein el los las y por con para se del al lo como".split()


def _common_hashes() -> np.ndarray:
    codes, offsets = codes_of(list(COMMON))
    return np.sort(span_hashes(codes, offsets[:-1], offsets[1:]))


_COMMON = _common_hashes()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, len(NAMES)), the text of each line, and its length in code points. Lines without a word are left out."""
    codes, offsets = codes_of(texts)
    none = np.zeros((0, len(NAMES)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(codes):
        return none
    codes = codes.astype(np.int64)
    starts, ends, of = runs(codes != 10, offsets)
    space = is_space(codes)
    w_start, w_end, _ = runs(~space, offsets)
    if not len(w_start):
        return none
    w_line = np.searchsorted(starts, w_start, "right") - 1
    n_words = np.bincount(w_line, minlength=len(starts))
    has = n_words > 0
    first = np.concatenate([[0], np.cumsum(n_words)])
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    word = span_hashes(lower, w_start, w_end)
    line = span_hashes(lower, starts, ends)

    def per_line(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[ends] - total[starts]

    letters = np.maximum(1, per_line(~space))
    n = np.maximum(1, n_words)
    symbol = np.zeros(128, bool)
    symbol[[ord(c) for c in "#*$%&|<>"]] = True
    small = np.minimum(codes, 127)
    # words seen before in the same line's text, and next to themselves
    order = np.lexsort((np.arange(len(word)), word, w_line))
    again = np.zeros(len(word), np.int64)
    w, v = word[order], w_line[order]
    again[order[1:]] = (w[1:] == w[:-1]) & (v[1:] == v[:-1])
    beside = np.zeros(len(word), np.int64)
    beside[1:] = (word[1:] == word[:-1]) & (w_line[1:] == w_line[:-1])
    per_word = lambda x: np.add.reduceat(np.append(x, 0), first[:-1]) * has
    order = np.lexsort((np.arange(len(line)), line, of))
    x, y = line[order], of[order]
    same = np.zeros(len(line), bool)
    equal = (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & has[order[1:]]
    same[order[1:]] |= equal
    same[order[:-1]] |= equal
    common = np.isin(word, _COMMON).astype(np.int64)
    f = np.stack([
        np.log1p(n_words), np.log1p(letters), letters / n, per_line(symbol[small] & (codes < 128)) / n, per_line((codes == 33) | (codes == 63)) / n, per_line((codes >= 65) & (codes <= 90)) / letters,
        per_line((codes >= 48) & (codes <= 57)) / letters, per_word(beside) / n, 1 - per_word(again) / n, same, np.isin(codes[ends - 1], [33, 46, 58, 63]), per_word(common) / n,
    ], axis=1).astype(np.float32)
    return f[has], of[has], (ends - starts)[has]
