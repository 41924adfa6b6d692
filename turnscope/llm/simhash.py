"""SimHash near-duplicates by a positional byte index with count filtering.

A fingerprint is eight bytes. Two fingerprints that differ in at most two bits differ in at
most two bytes, so they share at least six positional bytes: that is the guaranteed minimum of
matches. Of the first six positions such a pair shares at least four, so the inverted index posts every
distinct fingerprint under each set of four of the first six byte positions with the bytes found there (15
sets). Every pair that meets in a posting list is tallied over all eight positions; pairs below the minimum
are dropped, the others are verified by Hamming distance, and a pair that meets in several lists counts in the first.

A key of more than LONG fingerprints, as a sample tells, is posted longer: such a pair shares two more of the
four positions left, so its fingerprints go under each two of these, too (6 sets). A list of six positions
fixes 48 of 64 bits and holds 65,536 distinct fingerprints at most, whatever the corpus. Lists are compared in
the same way at any length, in memory linear in the list. Links between fingerprints are joined into
components; documents with equal fingerprints (exact copies, empty texts) are one node from the start.

Long texts are hashed whole, in blocks of STEP shingles.
Defined cases: null and empty texts, and texts without words, have fingerprint zero and link
with each other and with whatever lies within the distance. A null doc_id never names a
component unless no other id is in it (then component_id is null). Repeated rows each get a row.
Columns besides id and text are ignored, so their names cannot clash. An empty table gives none.

similar_documents() links by the Jaccard similarity of word shingle sets instead. At similarity 0.8
fingerprints lie about 10 of 64 bits apart and up to 17 or so, where no count of shared bytes is
guaranteed. Its candidates therefore also meet by BANDS keys of ROWS min-hashes each, which miss a pair
at similarity 0.8 with probability (1 - 0.8^5)^28 = 1.5e-5 and closer ones less. What meets under a key is compared there, by
a byte of each of its 140 min-hashes: pairs with less than SURE of them equal go (a pair at 0.8 has fewer with probability 1e-8), so
pages of one template, which share keys by chance, don't grow together. A large key is dealt as pairs of blocks, and keys of the
same documents are compared once. Components of what is left are verified exactly on the texts, all pairs that aren't yet connected. Documents of equal shingle sets
are one node; texts without words have the empty set, which is similar to itself only.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release, roots

BYTES, MAX_BITS = 8, 2
MIN_MATCHES = BYTES - MAX_BITS
#: Of so many positions a pair has at least HEAD - MAX_BITS in common.
HEAD = 6
MORE = MIN_MATCHES - (HEAD - MAX_BITS)
#: A posting list expected to be longer than this is dealt by longer keys; one fingerprint in SAMPLE tells.
LONG, SAMPLE = 4_096, 16
STEP = 1 << 15
#: Jaccard similarity: words to a shingle, the least similarity, keys of so many min-hashes each.
WORDS, LEAST = 5, 0.8
BANDS, ROWS = 28, 5
#: Min-hashes of BANDS * ROWS that a candidate pair has in common at least; documents of a key compared at once, rows of small keys in a task.
SURE, KEY_BLOCK, KEY_ROWS = 84, 4_096, 50_000
#: Bytes of text verified at once; larger components are dealt as pairs of blocks of half of that.
BLOCK_BYTES = 4 << 20
#: Sets of four of the first six positions, then each of them with two of the positions left.
SHORT_SETS = list(combinations(range(HEAD), HEAD - MAX_BITS))
LONG_SETS = [(*short, *more) for short in SHORT_SETS for more in combinations([p for p in range(BYTES) if p not in short], MORE)]
_FIXED = np.array([[p in s for p in range(BYTES)] for s in SHORT_SETS + LONG_SETS])
_MIX = np.random.default_rng(17).integers(0, 1 << 64, (2, BANDS, ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included; a shorter text is one shingle, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split() cuts at 20 and 09-0D only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=len(words) - shingle + 1)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint as an unsigned integer; whole text, repeats included."""
    return _majority(shingle_hashes(text, shingle, seed))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        bits = np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


def _tally(x: np.ndarray) -> np.ndarray:
    """Positional bytes that two fingerprints share, given their exclusive or: the zero bytes."""
    for shift in (4, 2, 1):
        x = x | x >> np.uint64(shift)
    return BYTES - np.bitwise_count(x & np.uint64(0x0101010101010101))


def list_pairs(sets: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of whole posting lists, given in order, that pass count filter and check, each in its first list only."""
    edge = np.append(np.nonzero(np.append(True, (sets[1:] != sets[:-1]) | (keys[1:] != keys[:-1])))[0], len(fps))
    end = np.repeat(edge[1:], np.diff(edge))
    left, right = [], []
    at, d = np.arange(len(fps)), 0
    while len(at):
        d += 1
        at = at[at + d < end[at]]
        x = fps[at] ^ fps[at + d]
        met = _tally(x) >= MIN_MATCHES
        hit = met & (np.bitwise_count(x) <= MAX_BITS)
        if hit.any():
            left.append(at[hit])
            right.append(left[-1] + d)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    shared = (fps[i] ^ fps[j]).view(np.uint8).reshape(-1, BYTES) == 0
    # the first list of a pair fixes the first four positions of the head that it shares, and then, if longer, the first two of those left
    own = np.zeros_like(shared)
    head = shared[:, :HEAD]
    own[:, :HEAD] = head & (np.cumsum(head, axis=1) <= HEAD - MAX_BITS)
    rest = shared & ~own
    more = rest & (np.cumsum(rest, axis=1) <= MORE) & (sets[i] >= len(SHORT_SETS))[:, None]
    first = ((own | more) == _FIXED[sets[i]]).all(axis=1)
    return i[first], j[first]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) in place of the links (a, b)."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = ends[roots(len(ends), at[: len(a)], at[len(a) :])]
    return ends[low != ends], low[low != ends]


def _mask(positions: tuple[int, ...]):
    mask = sum(0xFF << (8 * p) for p in positions)
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _postings(distinct: DataFrame, long: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """((set, key, fp), stored table of the hot keys), with set numbering SHORT_SETS and LONG_SETS; keys that a sample shows to be long under their longer ones."""

    def posts(df, first, sets):
        return df.select("fp", F.explode(F.array(*[F.struct(F.lit(first + k).cast("short").alias("set"), F.col("fp").bitwiseAND(_mask(s)).alias("key")) for k, s in enumerate(sets)])).alias("p")).select("p.set", "p.key", "fp")

    short = posts(distinct, 0, SHORT_SETS)
    counted = posts(distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0), 0, SHORT_SETS).groupBy("set", "key").agg(F.count("*").alias("n"))
    hot = materialize(counted.filter(F.col("n") > long // sample).select("set", "key"), "simhash-hot")
    if hot.isEmpty():
        return short, hot
    per = len(LONG_SETS) // len(SHORT_SETS)
    every = F.array(*[F.struct(F.lit(len(SHORT_SETS) + k).cast("short").alias("set"), F.col("fp").bitwiseAND(_mask(s)).alias("key")) for k, s in enumerate(LONG_SETS)])
    longer = short.join(hot, ["set", "key"], "left_semi").select("fp", F.explode(F.slice(every, F.col("set") * per + 1, per)).alias("p")).select("p.set", "p.key", "fp")
    return short.join(hot, ["set", "key"], "left_anti").unionByName(longer), hot


def fingerprint_links(distinct: DataFrame, long: int | None = None, sample: int | None = None) -> DataFrame:
    """(a, b), stored: links that span the components of all pairs within the distance; distinct has column fp, one row each."""
    posts, hot = _postings(distinct, LONG if long is None else long, SAMPLE if sample is None else sample)
    posts = posts.repartition("set", "key").sortWithinPartitions("set", "key")

    def run(batches):
        rest = None
        for b in batches:
            got = [b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
            if not len(got[0]):
                continue
            if rest is not None:
                got = [np.concatenate(x) for x in zip(rest, got)]
            last = np.nonzero((got[0] != got[0][-1]) | (got[1] != got[1][-1]))[0]
            cut = last[-1] + 1 if len(last) else 0
            rest = [x[cut:] for x in got]
            if cut:
                yield links(*(x[:cut] for x in got))
        if rest is not None:
            yield links(*rest)

    def links(sets, keys, fps):
        i, j = list_pairs(sets, keys, fps)
        fps = fps.view(np.int64)
        a, b = _spanning(fps[i], fps[j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = materialize(posts.mapInArrow(run, "a long, b long"), "simhash-links")
    release(hot)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most two bits."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    links = fingerprint_links(nodes.select("fp"))
    found = connected_components(links)
    comps = materialize(found, "simhash-roots")
    members = nodes.join(comps.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    members = materialize(members, "simhash-members")
    lows = materialize(members.groupBy("root").agg(F.min("low").alias("component")), "simhash-lows")
    named = materialize(members.join(lows, "root").select("fp", "component"), "simhash-named")
    release(nodes, links, found, comps, members, lows)
    return prints.join(named, "fp").select("id", "fp", "component")


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(one key per band, a byte of every min-hash) of a set of shingle hashes, none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64), b""
    keys, lows = np.empty(BANDS, np.uint64), np.empty((BANDS, ROWS), np.uint64)
    for k in range(BANDS):
        lows[k] = ((hashes ^ _MIX[0, k]) * _MIX[1, k]).min(axis=1)
        keys[k] = xxhash.xxh64_intdigest(lows[k].tobytes(), k)
    return keys, (lows >> np.uint64(24)).astype(np.uint8).tobytes()


def signature_links(signatures: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of all pairs of rows with SURE equal bytes or more: each row found is compared with all that aren't."""
    free, out = np.arange(len(signatures)), []
    while len(free) > 1:
        queue, free = [free[0]], free[1:]
        for at in queue:  # grows as rows are found
            if not len(free):
                break
            near = (signatures[free] == signatures[at]).sum(axis=1) >= SURE
            out += [(int(at), int(x)) for x in free[near]]
            queue += free[near].tolist()
            free = free[~near]
    return out


def similar_links(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links that span the components of all pairs of sets (sorted, distinct) of Jaccard similarity `least` or more.

    First neighbours in a few min-hash orders are verified, which connects most of a large group. Then every
    set outside the largest component meets all others by an inverted index, so each unconnected pair is tested.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    parent = list(range(m))
    out = []

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def unite(i, j):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    some = [i for i in range(m) if sizes[i]]
    for mix in _MIX.reshape(2, -1)[:, :8].T:
        low = {i: int(((sets[i] ^ mix[0]) * mix[1]).min()) for i in some}
        order = sorted(some, key=low.get)
        for i, j in zip(order, order[1:]):
            if low[i] == low[j] and root(i) != root(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= least * (sizes[i] + sizes[j] - both) - 1e-9:
                    unite(i, j)
    roots = np.array([root(i) for i in range(m)])
    if not some or (roots == roots[0]).all():
        return out
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(m), sizes)[np.argsort(token, kind="stable")]
    edge = np.concatenate([[0], np.cumsum(np.bincount(token))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i in np.nonzero(roots != np.bincount(roots).argmax())[0]:
        own = token[at[i] : at[i + 1]]
        own = own[edge[own + 1] - edge[own] > 1]
        if not len(own):
            continue
        both = np.bincount(np.concatenate([holders[edge[t] : edge[t + 1]] for t in own]), minlength=m)
        for j in np.nonzero((both > 0) & (both >= least * (sizes + sizes[i] - both) - 1e-9))[0]:
            unite(int(i), int(j))
    return out


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, node, fp, keys, signature): node is the digest of the shingle set."""

    def run(batches):
        for b in batches:
            node, fp, keys, signs = [], [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), words)
                own = np.unique(h)
                node.append(xxhash.xxh64_intdigest(own.tobytes()))
                fp.append(_majority(h))
                k, sign = band_keys(own)
                keys.append(k.view(np.int64))
                signs.append(sign)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), *signed, pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["id", "node", "fp", "keys", "signature"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, node long, fp long, keys array<long>, signature binary")


def _key_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between nodes that share a band key and SURE bytes of their signatures, enough to span their components."""
    posts = nodes.select("node", F.explode("keys").alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("mark"))
    # keys of the same nodes count once
    keys = materialize(sizes.filter("n > 1").groupBy("n", "low", "high", "mark").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / KEY_BLOCK).cast("int").alias("parts")), "similar-keys")
    rows = keys.count()
    met = posts.join(keys, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shard = F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(1 + 4 * rows // KEY_ROWS)))
    dealt = met.select((F.col("parts") > 1).alias("cut"), shard.alias("shard"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "node").join(nodes.select("node", "signature"), "node")

    def compare(t: pa.Table) -> pa.Table:
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        signs = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(node), -1)[order]
        edge = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
        sizes, first = np.diff(edge), edge[:-1]
        two = first[sizes == 2]
        two = two[(signs[two] == signs[two + 1]).sum(axis=1) >= SURE]
        a, b = [node[two]], [node[two + 1]]
        for lo, n in zip(first[sizes > 2], sizes[sizes > 2]):
            links = np.array(signature_links(signs[lo : lo + n]), np.int64).reshape(-1, 2) + lo
            a.append(node[links[:, 0]])
            b.append(node[links[:, 1]])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    out = materialize(dealt.groupBy("cut", "shard", "i", "j").applyInArrow(compare, "a long, b long"), "similar-met")
    release(keys)
    return out


def _candidates(nodes: DataFrame) -> DataFrame:
    """(node, root): components of nodes that share a band key and most of their signatures, or whose fingerprints link."""
    met = _key_links(nodes)
    heads = materialize(nodes.filter(F.size("keys") > 0).groupBy("fp").agg(F.min("node").alias("head")), "similar-heads")
    equal = nodes.filter(F.size("keys") > 0).join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    ends = [heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab"]
    links = fingerprint_links(heads.select("fp"))
    close = links.join(ends[0], "a").join(ends[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    found = connected_components(met.unionByName(equal).unionByName(close))
    out = materialize(found, "similar-candidates")
    release(met, heads, links, found)
    return out


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(id, component), stored: component is the smallest id reachable over pairs of Jaccard similarity `least` or more.

    The keys are laid out for a least similarity of about 0.8 and more.
    """
    prints = materialize(_sketches(docs, id_col, text_col, words), "similar-prints")
    nodes = materialize(prints.groupBy("node").agg(F.min("id").alias("low"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("signature").alias("signature")), "similar-nodes")
    comps = _candidates(nodes)
    lows = comps.join(nodes.select("node", "low"), "node")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cand = materialize(lows.join(texts, lows["low"].eqNullSafe(texts["id"])).select("root", "node", "text", F.octet_length("text").cast("long").alias("bytes")), "similar-texts")
    total = cand.agg(F.sum("bytes")).first()[0] or 0
    large = cand.groupBy("root").agg(F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES)).cast("int").alias("parts")).filter("parts > 1")
    dealt = cand.join(large, "root", "left").withColumn("n", F.coalesce(2 * F.col("parts"), F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "n").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    shard = F.when(F.col("n") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(1 + 2 * total // BLOCK_BYTES)))
    dealt = dealt.select((F.col("n") > 1).alias("cut"), shard.alias("shard"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node", "text")

    def verify(t: pa.Table) -> pa.Table:
        sets = {}
        for node, text in zip(t.column("node").to_numpy().tolist(), t.column("text")):
            own = np.unique(shingle_hashes(text.as_py(), words))
            if np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64) == node:  # a repeated id may bring another text
                sets[node] = own
        ids = list(sets)
        found = similar_links(list(sets.values()), least)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    links = dealt.groupBy("cut", "shard", "a", "b").applyInArrow(verify, "a long, b long")
    found = connected_components(links)
    roots = materialize(found, "similar-roots")
    members = materialize(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low"), "similar-members")
    least_ids = materialize(members.groupBy("root").agg(F.min("low").alias("component")), "similar-ids")
    named = materialize(members.join(least_ids, "root").select("node", "component"), "similar-named")
    out = materialize(prints.join(named, "node").select("id", "component"), "similar-found")
    release(prints, nodes, comps, cand, found, roots, members, least_ids, named)
    return out


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
