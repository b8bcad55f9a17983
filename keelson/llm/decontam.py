"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then verification.

Terms are adjacent word pairs (lower case, letters and digits), so a term is rare unless text was copied.
Items longer than SEGMENT words are indexed as several segments. A segment's impacts are divided by its own
score, so `threshold` is the share of a segment that a passage must hold. Passages are windows of WINDOW words,
half overlapping, of every document's whole text.

Every passage is queried. Its upper bound (the sum of its terms' greatest impacts) comes from one prefix sum over
all words of a chunk, which is WAND's first pivot test; passages that pass run block-max WAND over postings,
and all segments at or above the threshold are retrieved, without a limit. A retrieved item is verified
around the passage: its question (all but the last words) must share `question` of its three-word shingles and its
answer (the last words, at most 8) `answer` of its words.

The index is broadcast in blocks of items of about BLOCK_BYTES of text, one scan of documents for each block, so
what is broadcast has a bound however large the benchmark is. Document frequencies, the number of segments and their mean
length are aggregated over all items once, so that scores do not depend on the blocks.

Edge cases: null or empty texts and items match nothing; items of one word have no pair and are not
detected; repeated items, and items of equal scores, are all reported; very long texts are queried in all their passages, very long items
indexed in segments; repeated rows are judged each; further columns are left out unless carried; an empty table gives no rows, and an
empty benchmark leaves every document clean.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import codes_of, map_chunks, materialize, mix, runs, span_hashes

WINDOW, STEP, SEGMENT = 96, 48, 64
BLOCK_BYTES = 8_000_000
POSTINGS = 64
TOP = 0x3000


@lru_cache(maxsize=1)
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    low, inside = np.arange(TOP, dtype=np.uint32), np.zeros(TOP, bool)
    for c in range(TOP):
        s = chr(c)
        inside[c] = s.isalnum()
        if len(s.lower()) == 1:
            low[c] = ord(s.lower())
    return low, inside


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words start (one more entry than texts)."""
    codes, offsets = codes_of(texts)
    low, inside = word_tables()
    small = np.minimum(codes, TOP - 1)
    starts, ends, of = runs(inside[small] | (codes >= TOP), offsets)
    h = span_hashes(np.where(codes < TOP, low[small], codes), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def pairs_of(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : len(words) - n + 1 + k])
    return h


def segments_of(w: np.ndarray) -> list[np.ndarray]:
    """The segments of an item's words, none for items of one word."""
    if len(w) < 2:
        return []
    size = -(-len(w) // -(-len(w) // SEGMENT))
    return [w[s : s + size] if len(w) - s > 1 else w[-2:] for s in range(0, len(w), size)]


def item_terms(batch: dict[str, list]) -> dict:
    """For each item its segments, their words, and the distinct terms of each segment as signed numbers."""
    words, at = word_hashes(batch["text"])
    parts = [segments_of(words[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    terms = [[t for w in p for t in np.unique(pairs_of(w)).view(np.int64).tolist()] for p in parts]
    return {"item_id": batch["item_id"], "segments": [len(p) for p in parts], "words": [sum(len(w) for w in p) for p in parts], "terms": terms}


class Index:
    """Postings of one block of items, with the greatest impact of each run of POSTINGS.

    totals: number of segments, their words, and frequencies of terms that other blocks hold too; those of `items` if not given.
    """

    def __init__(self, items: list[tuple[int, str | None]], k1: float = 1.2, b: float = 0.75, totals: tuple[int, int, dict[int, int]] | None = None):
        items = sorted(items, key=lambda x: x[0])
        words, at = word_hashes([t for _, t in items])
        self.ids, self.words, segments = [], [], []
        for i, (item, _) in enumerate(items):
            w = words[at[i] : at[i + 1]]
            if len(w) > 1:
                segments += [(len(self.ids), x) for x in segments_of(w)]
                self.ids.append(item)
                self.words.append(w)
        self.item_of = [s[0] for s in segments]
        counts = [dict(zip(*(x.tolist() for x in np.unique(pairs_of(w), return_counts=True)), strict=True)) for _, w in segments]
        df: dict[int, int] = {}
        for c in counts:
            for t in c:
                df[t] = df.get(t, 0) + 1
        every, length, shared = totals or (len(segments), sum(len(w) for _, w in segments), {})
        df.update(shared)
        mean = max(1.0, length / max(1, every))
        lists: dict[int, list[tuple[int, float]]] = {}
        for s, c in enumerate(counts):
            norm = k1 * (1 - b + b * len(segments[s][1]) / mean)
            impact = {t: float(np.log1p((every - df[t] + 0.5) / (df[t] + 0.5))) * tf * (k1 + 1) / (tf + norm) for t, tf in c.items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                lists.setdefault(t, []).append((s, x / whole))
        self.terms = np.array(sorted(lists), np.uint64)
        self.postings = [([d for d, _ in lists[t]], [x for _, x in lists[t]]) for t in self.terms.tolist()]
        self.best = np.array([max(x) for _, x in self.postings] + [0.0])
        self.blocks = [[max(x[i : i + POSTINGS]) for i in range(0, len(x), POSTINGS)] for _, x in self.postings]

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of terms, len(self.terms) for unknown ones."""
        n = len(self.terms)
        if not n:
            return np.zeros(len(terms), np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), n - 1)
        return np.where(self.terms[i] == terms, i, n)

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All segments whose score by the query's terms reaches the threshold: block-max WAND."""
        end = 1 << 60
        cursors = [[self.postings[t][0][0], t, 0] for t in query]  # document, term, position
        heapq.heapify(cursors)
        out = []

        def seek(c: list, target: int) -> None:
            docs, i = self.postings[c[1]][0], c[2]
            step = 1
            while i + step < len(docs) and docs[i + step] < target:
                i, step = i + step, 2 * step
            while i < len(docs) and docs[i] < target:
                i += 1
            c[2], c[0] = i, docs[i] if i < len(docs) else end

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] == end:
                    break
                bound += self.best[c[1]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            near, until = 0.0, end
            for c in cursors[: pivot + 1]:
                docs = self.postings[c[1]][0]
                k = c[2] // POSTINGS
                while k < len(self.blocks[c[1]]) and docs[min((k + 1) * POSTINGS, len(docs)) - 1] < doc:
                    k += 1
                if k < len(self.blocks[c[1]]):
                    near += self.blocks[c[1]][k]
                    until = min(until, docs[min((k + 1) * POSTINGS, len(docs)) - 1] + 1)
            if near < threshold:  # no document of these blocks can reach it
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
                target = max(doc + 1, min(until, after))
                for c in cursors[: pivot + 1]:
                    seek(c, target)
            elif cursors[0][0] == doc:
                score = sum(self.postings[c[1]][1][c[2]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    out.append((doc, score))
                for c in cursors[: pivot + 1]:
                    seek(c, doc + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < doc:
                        seek(c, doc)
        return out

    def verified(self, item: int, region: np.ndarray, question: float, answer: float) -> bool:
        w = self.words[item]
        n = min(8, max(1, len(w) // 3))
        q, a = w[:-n], w[-n:]
        part = shingles(q, 3)
        return bool(np.isin(part, shingles(region, min(3, len(q)))).mean() >= question and np.isin(a, region).mean() >= answer)


def contaminated(index: Index, texts: list[str | None], threshold: float, question: float, answer: float) -> list[dict[int, float]]:
    """For each text the verified items and the best score of each; and by position the passages queried."""
    words, at = word_hashes(texts)
    found: list[dict[int, float]] = [{} for _ in texts]
    if len(words) < 2 or not len(index.terms):
        return found
    term = np.append(index.lookup(pairs_of(words)), len(index.terms))
    term[at[1:][at[1:] > 0] - 1] = len(index.terms)  # a pair stays within its text
    sums = np.zeros(len(term) + 1)
    np.cumsum(index.best[term], out=sums[1:])
    n = np.diff(at)
    count = np.maximum(1, -(-(n - (WINDOW - STEP)) // STEP)) * (n > 0)
    of = np.repeat(np.arange(len(texts)), count)
    start = at[of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    stop = np.minimum(start + WINDOW, at[of + 1])
    for p in np.flatnonzero(sums[stop] - sums[start] >= threshold - 1e-9).tolist():
        a, b, i = int(start[p]), int(stop[p]), int(of[p])
        query = np.unique(term[a : b - 1] if b < at[i + 1] else term[a:b])
        query = query[query < len(index.terms)].tolist()
        for s, score in index.search(query, threshold):
            item = index.item_of[s]
            m = len(index.words[item])
            if index.ids[item] not in found[i] and not index.verified(item, words[max(at[i], a - m) : min(at[i + 1], b + m)], question, answer):
                continue
            found[i][index.ids[item]] = max(score, found[i].get(index.ids[item], 0.0))
    return found


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.35, question: float = 0.6, answer: float = 0.6, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_items, items (sorted ids), best_score, contaminated and kept (its opposite); one row for each document row.

    `carry` names string columns to pass on, the text among them if asked for, so that a filter needs no join back.
    """
    carry = carry or []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("string").alias(f"c_{c}") for c in carry if c != "text"))
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    made = materialize(map_chunks(items, item_terms, "item_id long, segments long, words long, terms array<long>"), "items")
    whole = made.agg(F.sum("segments").alias("segments"), F.sum("words").alias("words")).first()
    by_block = made.select(block_of.alias("block"), F.explode("terms").alias("term")).groupBy("block", "term").agg(F.count("*").alias("n"))
    by_term = by_block.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list("block").alias("at")).where(F.size("at") > 1)
    shared = materialize(by_term.select(F.explode("at").alias("block"), "term", "df"), "frequencies")  # terms of several blocks

    def scan(rows_in: DataFrame, block: int, carried: bool) -> DataFrame:
        mine = items.where(block_of == block).collect()  # one block
        common = shared.where(F.col("block") == block).toArrow()  # at most the terms of that block
        df = dict(zip(common["term"].to_numpy().view(np.uint64).tolist(), common["df"].to_pylist(), strict=True))
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in mine], totals=(whole["segments"] or 0, whole["words"] or 0, df)))

        def run(rows: dict[str, list]) -> dict:
            got = contaminated(index.value, rows["text"], threshold, question, answer)
            ids, best = [sorted(g) for g in got], [max(g.values(), default=0.0) for g in got]
            if carried:
                ids = [sorted({*a, *b}) for a, b in zip(ids, rows["items"], strict=True)]
                best = [max(a, b) for a, b in zip(best, rows["best"], strict=True)]
            return rows | {"text": rows["text"] if block + 1 < blocks or "text" in carry else [None] * len(ids), "items": ids, "best": best}

        return map_chunks(rows_in, run, "doc_id long, text string, items array<long>, best double" + "".join(f", c_{c} string" for c in carry if c != "text"))

    out = docs
    for block in range(blocks):
        out = scan(out, block, block > 0)
    return out.select("doc_id", F.size("items").cast("long").alias("n_items"), "items", F.round("best", 6).alias("best_score"), (F.size("items") > 0).alias("contaminated"), (F.size("items") == 0).alias("kept"), *(F.col(c if c == "text" else f"c_{c}").alias(c) for c in carry))
