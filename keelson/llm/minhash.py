"""Near-duplicate documents by HyperMinHash: registers of leading zeros plus mantissa, banded, estimated, verified.

1. One pass over the texts: the set of word shingles as 64-bit hashes, its digest, and one register for
   each bucket: the least value of a random permutation of the set, kept as the count of its leading
   zeros (6 bits) and the 10 bits after the first one. A bucket has its own permutation, not a slice of the
   hash range, so that sets of a few shingles fill every register.
2. Rows with equal sets form a class, known by the set's digest; only one row of it, one with its least doc_id, goes on.
3. Bands of 3 registers meet in groups. A pair with Jaccard similarity 0.8 or more misses all 32 bands
   with probability 1e-10. Groups of up to SMALL documents become pairs; in larger ones every document
   pairs with the group's least, so a group of near copies costs as many pairs as it has members. The
   collision-corrected estimate thins pairs out (5 standard deviations below the threshold), and the
   survivors are compared on whole sets. A least document of many pairs is spread over salts.
4. Members of a large group that are linked with its least are connected already. The others, its rest, are
   compared with all members, block by block; a task emits a spanning forest, never all pairs. A pair is
   looked at in its first common band only: there it is connected by the least or one of it is in the rest.
5. Links become components by star contraction; classes and components join back to all documents.

Edge cases: null or wordless texts have the empty set and link with nothing; a null doc_id keeps its row
with component_id null and kept true; rows that share a doc_id are one document: whatever texts they hold, all of them link, and
each of them gets its component; very long texts are compared on their whole sets; ties in similarity or in least members don't
change components; further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import CHUNK, ascii_lower, codes_of, discard, is_space, map_chunks, materialize, mix, runs, span_hashes
from keelson.operators.graph import components

REGISTERS, ROWS, MANTISSA = 96, 3, 10
SMALL, SPREAD = 8, 256
BLOCK_BYTES, BLOCK_DOCS = 8_000_000, 2048
_rng = np.random.default_rng(20240601)
FACTORS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
MASKS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(3)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct n-word shingles (all words as one if there are fewer)."""
    if len(texts) > 1 and sum(len(t or "") for t in texts) > CHUNK:  # in parts, as arrays of code points are many times a text
        half = len(texts) // 2
        return shingle_sets(texts[:half], n) + shingle_sets(texts[half:], n)
    codes, offsets = codes_of(texts)
    if not len(codes):
        return [np.zeros(0, np.uint64)] * len(texts)
    codes = ascii_lower(codes)
    starts, ends, of = runs(~is_space(codes), offsets)
    words = span_hashes(codes, starts, ends)
    counts = np.bincount(of, minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(counts)])
    whole = np.zeros(len(words), np.uint64)
    for k in range(n):
        whole[: len(words) - k] = mix(whole[: len(words) - k] * np.uint64(0x9FB21C651E98DF25) + words[k:]) if k < len(words) else 0
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS numbers of 16 bits: leading zeros of the least permuted hash, then the bits after its first one."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        np.minimum(low, ((part[None, :] ^ MASKS[:, None]) * FACTORS[:, None]).min(axis=1), out=low)
    width = np.zeros(REGISTERS, np.uint64)
    x = low.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = x >= np.uint64(1 << s)
        width[big] += np.uint64(s)
        x[big] >>= np.uint64(s)
    zeros = np.uint64(63) - width
    bits = np.where(zeros < 63, (low << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA), np.uint64(0))
    return ((zeros << np.uint64(MANTISSA)) | bits).astype(np.uint16)


def estimate(matches, n, m):
    """Jaccard similarity from equal registers, less what chance collisions of compressed registers add."""
    chance = 0.6797 * n * m / (n + m) ** 2 / 2**MANTISSA
    return (matches / REGISTERS - chance) / (1 - chance)


def floor_for(threshold: float) -> float:
    return threshold - 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, the text's hash, n_shingles, digest of the set (null if empty), registers, the keys of the bands."""

    def run(rows: dict[str, list]) -> dict:
        sets = shingle_sets(rows["text"], n)
        digests, sketches, bands = [], [], []
        for s in sets:
            if not len(s):
                digests.append(None), sketches.append(None), bands.append(None)
                continue
            r = registers(s)
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sketches.append(r.tobytes())
            key = np.arange(REGISTERS // ROWS, dtype=np.uint64)
            for k in range(ROWS):
                key = mix(key * np.uint64(1 << 17) + r[k::ROWS].astype(np.uint64))
            bands.append(key.view(np.int64).tolist())
        return {"doc_id": rows["doc_id"], "th": rows["th"], "n_shingles": [len(s) for s in sets], "digest": digests, "registers": sketches, "bands": bands}

    return map_chunks(docs.withColumn("th", F.xxhash64("text")), run, "doc_id long, th long, n_shingles long, digest binary, registers binary, bands array<long>")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _rest_links(rows, n: int, percent: int, band: int) -> list[tuple[int, int]]:
    """Links that span what is linked between a block of a group's rest and a block of all its members. rows: (doc_id, text, registers, is rest, side)."""
    sets = shingle_sets([r[1] for r in rows], n)
    regs = np.array([np.frombuffer(r[2], np.uint16) for r in rows])
    sizes, ids = np.array([len(s) for s in sets]), np.array([r[0] for r in rows])
    rest, side = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.get(i, i) != i:
            parent[i] = parent.get(parent[i], parent[i])
            i = parent[i]
        return i

    out, low, members = [], floor_for(percent / 100), np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        others = members[(ids[members] < ids[i]) | ~rest[members] & (ids[members] != ids[i])]  # two of the rest meet once
        if not len(others):
            continue
        equal = regs[others] == regs[i]
        est = estimate(equal.sum(axis=1), sizes[others], sizes[i])
        shared = equal.reshape(len(others), -1, ROWS).all(axis=2)
        good = np.flatnonzero((est >= low) & shared.any(axis=1) & (shared.argmax(axis=1) == band))
        for j in others[good[np.argsort(-est[good], kind="stable")]]:
            a, b = root(int(ids[i])), root(int(ids[j]))
            if a != b and _similar(sets[i], sets[j], percent):
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, shingle_words: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id is component_id)."""
    import pandas as pd

    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = materialize(sketch(docs, shingle_words), "sketch")
    known = made.where("digest is not null and doc_id is not null")
    one = F.min_by(F.struct("n_shingles", "registers", "bands", "th"), F.struct("doc_id", "th"))
    sketches = materialize(known.groupBy(F.col("digest").alias("cls")).agg(F.min("doc_id").alias("rep"), one.alias("s")).select("cls", "rep", "s.*"), "classes")
    entries = sketches.select("cls", "rep", F.posexplode("bands").alias("band", "key"))
    # written first, so that both sides of the join are plain exchanges, whose hot groups Spark can split
    grouped = materialize(entries.groupBy("band", "key").agg(F.count("*").alias("c"), F.min(F.struct("rep", "cls")).alias("least")).where("c > 1").select("band", "key", "c", F.col("least.cls").alias("least")), "groups")
    met = materialize(entries.join(grouped, ["band", "key"]), "met")

    # pairs of small groups, and of large ones each member with the least; b is the one of smaller (rep, cls)
    listed = met.where(F.col("c") <= SMALL).groupBy("band", "key").agg(F.sort_array(F.collect_set(F.struct("rep", "cls"))).alias("ids"))
    small = listed.select(F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, SMALL), lambda y: F.struct(y["cls"].alias("a"), x["cls"].alias("b")))))).alias("p")).select("p.a", "p.b", F.lit(1).alias("salts"))
    large = met.where(F.col("c") > SMALL)
    stars = large.where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b"), F.ceil(F.col("c") / SPREAD).cast("int").alias("salts"))
    pairs = small.union(stars).groupBy("a", "b").agg(F.max("salts").alias("salts"))
    pairs = materialize(pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")), "pairs")

    def both(rows: DataFrame, side: DataFrame) -> DataFrame:
        """Pairs with what `side` (class, value) has of either; the b of many pairs is spread over salts."""
        spread = rows.groupBy("b").agg(F.max("salts").alias("n")).select("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
        return rows.join(side.toDF("a", "x"), "a").join(spread.join(side.toDF("b", "y"), "b"), ["b", "salt"])

    slim = sketches.select("cls", F.struct("n_shingles", "registers"))
    joined = both(pairs, slim).select("a", "b", "salts", "salt", F.col("x.n_shingles").alias("na"), F.col("x.registers").alias("ra"), F.col("y.n_shingles").alias("nb"), F.col("y.registers").alias("rb"))
    low = floor_for(percent / 100)

    def thin(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array([np.frombuffer(r, np.uint16) for r in pdf["ra"]])
                y = np.array([np.frombuffer(r, np.uint16) for r in pdf["rb"]])
                na, nb = pdf["na"].to_numpy(), pdf["nb"].to_numpy()
                ok = (estimate((x == y).sum(axis=1), na, nb) >= low) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                yield pdf.loc[ok, ["a", "b", "salts", "salt"]]

    likely = materialize(joined.mapInPandas(thin, "a binary, b binary, salts int, salt int"), "likely")

    # one pass over the texts for both comparisons below; a class's text is that of its least doc_id with the hash it was sketched from
    wanted = likely.select(F.explode(F.array("a", "b")).alias("cls")).union(large.select("cls")).distinct().join(sketches.select("cls", F.col("rep").alias("doc_id"), "th"), "cls")
    texts = docs.where("doc_id is not null").withColumn("th", F.xxhash64("text")).join(wanted, ["doc_id", "th"])
    texts = materialize(texts.select("cls", F.col("doc_id").alias("rep"), "text").dropDuplicates(["cls"]), "texts")

    def verify(rows: dict[str, list]) -> dict:
        x, y = shingle_sets(rows["x"], shingle_words), shingle_sets(rows["y"], shingle_words)
        ok = [i for i in range(len(x)) if _similar(x[i], y[i], percent)]
        return {c: [rows[c][i] for i in ok] for c in ("a", "b", "u", "v")}

    sided = both(likely, texts.select("cls", F.struct("text", "rep"))).select("a", "b", F.col("x.text").alias("x"), F.col("y.text").alias("y"), F.col("x.rep").alias("u"), F.col("y.rep").alias("v"))
    verified = materialize(map_chunks(sided, verify, "a binary, b binary, u long, v long", size_by="x"), "verified")
    links = verified.select("u", "v")

    # what a large group's least doesn't link
    apart = large.where("cls <> least").join(verified.select(F.col("a").alias("cls"), F.col("b").alias("least")), ["cls", "least"], "left_anti").select("band", "key", "cls", F.lit(True).alias("rest"))
    apart = materialize(apart, "rest")
    if apart.limit(1).count():
        counts = apart.groupBy("band", "key").agg(F.count("*").alias("n_rest"))
        members = large.select("band", "key", "cls", "c").join(counts.hint("shuffle_hash"), ["band", "key"]).join(apart, ["band", "key", "cls"], "left")
        weighed = members.join(texts.select("cls", F.octet_length("text").alias("bytes")), "cls")
        total = weighed.groupBy("band", "key").agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(F.col("rest"), F.col("bytes")).otherwise(0)).alias("rest_bytes"))
        cut = lambda size, count: F.greatest(F.ceil(F.col(size) / BLOCK_BYTES), F.ceil(F.col(count) / BLOCK_DOCS), F.lit(1)).cast("int")
        keyed = members.join(total.hint("shuffle_hash"), ["band", "key"]).select("band", "key", "cls", F.coalesce("rest", F.lit(False)).alias("rest"), cut("rest_bytes", "n_rest").alias("nx"), cut("all_bytes", "c").alias("ny"))
        at = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = keyed.where("rest").select("band", "key", "cls", "rest", F.lit(0).alias("side"), at("nx").alias("x"), every("ny").alias("y"))
        right = keyed.select("band", "key", "cls", "rest", F.lit(1).alias("side"), every("nx").alias("x"), at("ny").alias("y"))
        dealt = left.union(right).join(texts, "cls").join(sketches.select("cls", "registers"), "cls").drop("cls")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["side", "rep"])
            got = _rest_links(list(zip(pdf["rep"], pdf["text"], pdf["registers"], pdf["rest"], pdf["side"], strict=True)), shingle_words, percent, int(pdf["band"].iloc[0]))
            return pd.DataFrame(got, columns=["u", "v"]).astype("int64")

        links = links.union(dealt.groupBy("band", "key", "x", "y").applyInPandas(compare, "u long, v long"))

    # a doc_id with several sets links the classes of all of them
    several = made.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), (F.count("digest") < F.count("*")).alias("blank")).where("lo <> hi or (blank and lo is not null)").select("doc_id", F.lit(True).alias("several"))
    several = materialize(several, "several")
    classes = sketches.select(F.col("cls").alias("digest"), "rep")
    links = links.union(made.join(several, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "rep"))
    found = components(links)
    discard(grouped, met, pairs, likely, texts, verified, apart)  # the components no longer need them

    member = made.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(several, "doc_id", "left")
    member = member.withColumn("node", F.when(F.col("several"), F.col("doc_id")).otherwise(F.coalesce("rep", "doc_id")))
    out = member.join(found.toDF("node", "component"), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
