"""Exact removal of repeated byte strings with suffix arrays built by linear grouping.

A byte goes if a string of WIDTH bytes that covers it also starts earlier: in a document of
smaller id, or earlier in its own. Sorting all suffixes of a corpus on one machine is not an
option, so suffix arrays are built where repeats can be:

1. Anchors. In every window of WIDTH bytes the K-byte string of least hash is its anchor.
   Equal windows have equal anchors, so windows of different anchors never match, and an
   anchor that occurs once rules out all its windows. The windows of one anchor are consecutive;
   their union is its region. Of equal regions only the first can be new, so the others are
   removed where they are met: within a document and a batch at once, the rest after one shuffle by anchor.
2. What is left are anchors with different regions: edges of repeats, edits, chance. A window
   around an anchor holds the SIDE bytes before it or the SIDE bytes after it, so each region is cut in two
   sides, keyed by the anchor with those bytes, and a side whose key occurs once is done. The others are
   laid side by side in blocks, key by key, and each block's suffix array is built by linear grouping: groups of suffixes with equal Lyndon prefix are processed in descending
   order; previous-smaller pointers tell which suffixes of lower groups a group extends, by how
   many repetitions, and these form new groups; then one pass emits the order within groups. No renaming,
   no recursion. Adjacent suffixes that agree in WIDTH bytes are runs of equal windows, all but the
   first of which go.
3. A key of more than HOT sides (a passage on a third of all pages with a different next word each
   time) would make one block unbounded. Its windows hold further bytes before or after what the key has, half of
   the rest at least on one side, so a side is cut in two again, keyed by that much more of its text; this is
   repeated, halving the rest, until keys are no longer hot or are whole windows, of which equal ones fall together.

Removed ranges meet their document in one last join. Equality of windows is by bytes, of regions by two hashes of
64 bits, of whole windows as keys by one of 64 bits and their bytes.

Defined cases: null texts are empty; texts under WIDTH bytes lose nothing. A null doc_id comes
after every other. Rows of equal id and text are one document and get the same answer; rows of
equal id and different text are documents of their own, in order of a hash of the text. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices, table

WIDTH, K = 100, 24
SIDE = (WIDTH - K) // 2
#: A key of more sides than a block holds is keyed by longer context.
HOT = 256
BLOCK_BYTES = 32_000
#: Bytes of sides that a task sorts, and the most tasks.
TASK_BYTES, MOST_TASKS = 4 << 20, 100_000
#: Documents are anchored in pieces of so many windows; pieces overlap, so no window is lost.
PIECE = 1 << 22
LAST = (1 << 63) - 1
#: An odd multiplier for the rolling hash.
_B = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, kept from call to call."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            a = np.full(m, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def anchors(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window, region hash) of the regions of a text, in order.

    The last window comes as 128 times itself plus the anchor's distance from it.
    """
    out = []
    n = len(buf) - WIDTH + 1
    for at in range(0, max(n, 0), PIECE):
        part = buf[at : at + PIECE + WIDTH - 1]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        h = (sums[K:] - sums[:-K]) * down[: len(part) - K + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        # the position in the low bits makes the leftmost of equal ones the least
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        span, low = WIDTH - K + 1, key
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if span > size:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        pos = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(pos[1:] != pos[:-1])[0] + 1])
        last = np.append(first[1:] - 1, len(pos) - 1)
        mem = memoryview(part)
        regions = np.fromiter((xxhash.xxh64_intdigest(mem[a:b], 3) for a, b in zip(first.tolist(), (last + WIDTH).tolist())), np.uint64, len(first))
        out.append((h[pos[first]].view(np.int64), first + at, (last + at) * 128 + pos[first] - last, regions.view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))


def _sort_runs(*keys: np.ndarray, same: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, whether each row in that order differs from the one before in the first `same` keys)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys[:same]:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, new


def _merge(doc, tie, lo, hi):
    """Rows sorted by document and range, touching ranges of a document joined into one."""
    order = np.lexsort((lo, tie, doc))
    doc, tie, lo, hi = doc[order], tie[order], lo[order], hi[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        # ranges of regions never nest, so the one before ends last
        new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (lo[1:] > hi[:-1] + 1)
        start = np.nonzero(new)[0]
        end = np.append(start[1:], len(doc)) - 1
        doc, tie, lo, hi = doc[start], tie[start], lo[start], hi[end]
    return doc, tie, lo, hi


def suffix_array(s: bytes) -> list[int]:
    """Suffix array of s by linear grouping; a suffix that is a prefix of another comes first."""
    text = [c + 1 for c in s] + [0]
    n = len(text)
    sa = sorted(range(n), key=text.__getitem__)
    isa, link, size, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for at, i in enumerate(sa):
        if text[i] != text[sa[start]]:
            start = at
        isa[i], link[i] = at, start
        size[start] += 1
    end = n
    while end:
        group = link[sa[end - 1]]
        members = sa[group:end]
        end = group
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and link[p] >= group:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if not times:
            continue
        if len(times) == len(members):
            levels = [list(times)]
        else:
            by: dict[int, list[int]] = {}
            for p, c in times.items():
                by.setdefault(c, []).append(p)
            levels = [by[c] for c in sorted(by, reverse=True)]
        for level in levels:
            touched: dict[int, int] = {}
            for p in level:  # to the end of its group
                g = link[p]
                e = g + size[g] - 1
                a = isa[p]
                q = sa[e]
                sa[a], sa[e] = q, p
                isa[q], isa[p] = a, e
                size[g] -= 1
                touched[g] = touched.get(g, 0) + 1
            for p in level:
                g = link[p]
                link[p] = g + size[g]
            for g, c in touched.items():
                size[g + size[g]] = c
    out = [-1] * n
    out[0] = n - 1
    slot = list(range(n))
    placed = bytearray(n)
    placed[n - 1] = 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = link[j]
            out[slot[g]] = j
            slot[g] += 1
            j = prev[j]
    return out[1:]


def repeated_windows(regions: list[tuple]) -> list[tuple[int, int]]:
    """(region, offset) of every window that an earlier one equals. regions: (doc, tie, first window, last window, bytes)."""
    text, base, owner, offset = [], 0, [], []
    for k, (_, _, lo, hi, raw) in enumerate(regions):
        text.append(raw)
        owner += [k] * (hi - lo + 1) + [-1] * (len(raw) - (hi - lo))
        offset += range(len(raw) + 1)
        base += len(raw) + 1
    whole = b"\0".join(text)
    out = []
    before, best = None, None
    for p in suffix_array(whole):
        k = owner[p]
        if k < 0:
            continue
        w = whole[p : p + WIDTH]
        own = (regions[k][0], regions[k][1], regions[k][2] + offset[p], k, offset[p])
        if w != before:
            before, best = w, own
        elif own[:3] < best[:3]:
            out.append(best[3:])
            best = own
        elif own[:3] != best[:3]:
            out.append(own[3:])
    return out


_CUT = "ah long, r long, doc long, tie long, lo long, hi long"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, tie, raw): tie is 0 where ids are unique, else a hash of the text that tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    unique = docs.groupBy(doc.alias("doc")).count().filter("count > 1").isEmpty()
    return docs.select(F.col(id_col).alias("id"), doc.alias("doc"), (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("tie"), text.alias("raw"))


def _first_of(ah, r, doc, tie, lo, hi) -> pa.RecordBatch:
    """Rows of one batch: of equal regions the first, the others as removed ranges under spread keys."""
    order, new = _sort_runs(ah, r, doc, tie, lo, same=2)
    old = order[~new]
    if len(old):  # rows of one document twice are one: equal (doc, tie, lo) is the first window itself
        head = order[np.nonzero(new)[0][np.cumsum(new) - 1][~new]]
        old = old[(doc[old] != doc[head]) | (tie[old] != tie[head]) | (lo[old] != lo[head])]
    done = _merge(doc[old], tie[old], lo[old], hi[old] >> 7)
    keep = order[new]
    spread = (done[0] * 31 + done[2]) * np.int64(-7046029254386353131)
    cols = ((ah[keep], spread), (r[keep], np.zeros(len(spread), np.int64)), (doc[keep], done[0]), (tie[keep], done[1]), (lo[keep], done[2]), (hi[keep], -1 - done[3]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["ah", "r", "doc", "tie", "lo", "hi"])


def _candidates(docs: DataFrame) -> DataFrame:
    """Regions to be compared (hi >= 0, as of anchors()) and, already decided, removed ranges of windows (hi < 0: -1 - last window)."""

    def run(batches):
        for b in batches:
            for part in slices(b, 2, 24 << 20):
                cols = [[], [], [], [], [], []]
                for doc, tie, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    ah, lo, hi, r = anchors(raw.as_py())
                    n = len(ah)
                    for c, v in zip(cols, (ah, r, np.full(n, doc), np.full(n, tie), lo, hi)):
                        c.append(v)
                ah, r, doc, tie, lo, hi = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
                yield _first_of(ah, r, doc, tie, lo, hi)

    return docs.select("doc", "tie", "raw").mapInArrow(run, _CUT)


def _decide(rows: DataFrame) -> DataFrame:
    """From regions by anchor: ranges removed (hi < 0), and the first of each of several regions of one anchor (hi >= 0)."""

    def run(batches):
        # what is known of the last anchor: its last region and head, and its first region while it is the only one
        ah0 = r0 = head0 = alone = None
        for b in batches:
            ah, r, doc, tie, lo, hi = (b.column(k).to_numpy() for k in range(6))
            passed = hi < 0
            out = [np.stack([c[passed] for c in (ah, r, doc, tie, lo, hi)])]
            ah, r, doc, tie, lo, hi = (c[~passed] for c in (ah, r, doc, tie, lo, hi))
            n = len(ah)
            if n:
                same_a = np.zeros(n, bool)
                same_a[1:] = ah[1:] == ah[:-1]
                same_a[0] = ah0 is not None and ah[0] == ah0
                new = np.ones(n, bool)
                new[1:] = ~same_a[1:] | (r[1:] != r[:-1])
                new[0] = not (same_a[0] and r[0] == r0)
                # removed: not the first of its region (and not the same window of a document given twice)
                at = np.where(new, np.arange(n), -1)
                at = np.maximum.accumulate(at)
                hd = np.where(at >= 0, doc[at], head0[0] if head0 else 0), np.where(at >= 0, tie[at], head0[1] if head0 else 0), np.where(at >= 0, lo[at], head0[2] if head0 else 0)
                gone = ~new & ((doc != hd[0]) | (tie != hd[1]) | (lo != hd[2]))
                out.append(np.stack([ah[gone], r[gone], doc[gone], tie[gone], lo[gone], -1 - (hi[gone] >> 7)]))
                # heads of regions whose anchor has several
                heads = np.nonzero(new)[0]
                if len(heads):
                    again = same_a[heads].copy()  # an earlier region of the same anchor exists
                    first = ~again
                    nxt = np.append(again[1:], False)
                    told = again | (first & nxt)
                    if again[0] and alone is not None:
                        out.append(np.array(alone, np.int64)[:, None])
                        alone = None
                    pick = heads[told]
                    out.append(np.stack([c[pick] for c in (ah, r, doc, tie, lo, hi)]))
                    k = heads[-1]
                    alone = (ah[k], r[k], doc[k], tie[k], lo[k], hi[k]) if first[-1] else None
                    head0 = (doc[k], tie[k], lo[k])
                ah0, r0 = ah[-1], r[-1]
            got = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in got], names=["ah", "r", "doc", "tie", "lo", "hi"])

    dealt = rows.repartition("ah").sortWithinPartitions("ah", "r", "doc", "tie", "lo")
    return dealt.mapInArrow(run, _CUT)


_SIDE = "e long, doc long, tie long, lo long, hi long, c0 long, c1 long, region binary"
_KINDS = (*(pa.int64(),) * 7, pa.binary())


def _signed(e: int) -> int:
    return e - (1 << 64) if e >> 63 else e


def _sides(raw: bytes, lo: int, packed: int):
    """(key, first window, last window, context, bytes) of the windows around an anchor that hold the bytes before it, and of the others; all windows hold the context."""
    hi = packed >> 7
    a = hi + (packed & 127)
    if lo <= a - SIDE:
        to = min(hi, a - SIDE)
        yield xxhash.xxh64_intdigest(raw[a - SIDE : a + K], 1), lo, to, a - SIDE, a + K, raw[lo : to + WIDTH]
    start = max(lo, a - SIDE + 1)
    if start <= hi:
        yield xxhash.xxh64_intdigest(raw[a : a + K + SIDE], 2), start, hi, a, a + K + SIDE, raw[start : hi + WIDTH]


def _halves(e: int, lo: int, hi: int, c0: int, c1: int, region: bytes):
    """A side cut in two by longer context: windows that hold half of what is left of them before it, and the others, which hold more behind it."""
    left = WIDTH - (c1 - c0)
    before = (left + 1) // 2
    seed = e & ((1 << 64) - 1)
    if lo <= c0 - before:
        to = min(hi, c0 - before)
        yield xxhash.xxh64_intdigest(region[c0 - before - lo : c1 - lo], seed), lo, to, c0 - before, c1, region[: to - lo + WIDTH]
    start, end = max(lo, c0 - before + 1), c1 + left - before + 1
    if start <= hi:
        yield xxhash.xxh64_intdigest(region[c0 - lo : end - lo], seed ^ 1), start, hi, c0, end, region[start - lo :]


def _collapsed(rows) -> pa.RecordBatch:
    """Sides (key, doc, tie, first, last window, context, bytes) as a batch; of equal ones the first stands for all, the others are removed: c0 -1, no bytes."""
    first: dict[tuple, tuple] = {}
    for r in rows:
        known = first.setdefault((r[0], r[7]), r)
        if r[1:4] < known[1:4]:
            first[r[0], r[7]] = r
    if len(first) < len(rows):
        rows = [r if r[1:4] == first[r[0], r[7]][1:4] else (*r[:5], -1, -1, None) for r in rows]
    c = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, _KINDS)], names=["e", "doc", "tie", "lo", "hi", "c0", "c1", "region"])


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sides of the regions that are to be compared, and what of them is removed already (c0 < 0)."""

    def run(batches):
        for b in batches:
            for part in slices(b, 2, 16 << 20):
                rows = []
                for doc, tie, raw, ps in zip(*(part.column(k).to_pylist() for k in range(4))):
                    for q in ps:
                        rows += [(_signed(e), doc, tie, lo, hi, c0, c1, r) for e, lo, hi, c0, c1, r in _sides(raw, q["lo"], q["hi"])]
                yield _collapsed(rows)

    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("ps"))
    once = docs.select("doc", "tie", "raw").join(lists, ["doc", "tie"]).select("doc", "tie", "raw", "ps")
    return once.mapInArrow(run, _SIDE)


def _longer(sides: DataFrame) -> DataFrame:
    """Sides of hot keys by longer keys."""

    def run(batches):
        for b in batches:
            rows = []
            for e, doc, tie, lo, hi, c0, c1, region in zip(*(b.column(k).to_pylist() for k in range(8))):
                rows += [(_signed(n), doc, tie, f, t, x, y, r) for n, f, t, x, y, r in _halves(e, lo, hi, c0, c1, region)]
            yield _collapsed(rows)

    return sides.mapInArrow(run, _SIDE)


def _by_suffix_array(sides: DataFrame) -> DataFrame:
    """Removed ranges (doc, tie, lo, hi) among sides."""

    def run(batches):
        block: list[tuple] = []
        done: list[tuple] = []
        first: dict[bytes, tuple] = {}
        size, last = 0, None

        def flush():
            found = repeated_windows(block) if block else []
            gone = done + [(block[k][0], block[k][1], block[k][2] + o, block[k][2] + o) for k, o in found]
            cols = [np.array(c, np.int64) for c in zip(*gone)] or [np.zeros(0, np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _merge(*cols)], names=["doc", "tie", "lo", "hi"])

        for b in batches:
            for e, doc, tie, lo, hi, raw in zip(*(b.column(k).to_pylist() for k in range(6))):
                if e != last:
                    first = {}
                    if size > BLOCK_BYTES or len(done) > 1 << 16:
                        yield flush()
                        block, done, size = [], [], 0
                last = e
                own = first.setdefault(raw, (doc, tie, lo))
                if own != (doc, tie, lo):  # equal sides: the first stands for all
                    done.append((doc, tie, lo, hi))
                else:
                    block.append((doc, tie, lo, hi, raw))
                    size += len(raw)
        if block or done:
            yield flush()

    total = sides.agg(F.sum(F.octet_length("region"))).first()[0] or 0
    tasks = min(MOST_TASKS, max(sides.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))
    return sides.repartition(tasks, "e").sortWithinPartitions("e", "doc", "tie", "lo").mapInArrow(run, "doc long, tie long, lo long, hi long")


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(doc, tie, lo, hi): ranges of windows that also start earlier; docs as of _keyed()."""
    decided = materialize(_decide(_candidates(docs)), "suffix-decided")
    gc.collect()
    docs.sparkSession._jvm.System.gc()  # shuffle files that nothing needs go when the driver's garbage does
    sides = materialize(_fetch(docs, decided.filter("hi >= 0").select("doc", "tie", "lo", "hi")), "suffix-sides")
    out = [decided.filter("hi < 0").select("doc", "tie", "lo", (F.lit(-1).cast("long") - F.col("hi")).alias("hi"))]
    stored, shared = [decided], None
    while True:
        out.append(sides.filter("c0 < 0").select("doc", "tie", "lo", "hi"))
        stored.append(sides)
        open_ = sides.filter("c0 >= 0")
        # a key of whole windows has one text
        counts = open_.groupBy("e").agg(F.count("*").alias("n"), F.min(F.col("c1") - F.col("c0")).alias("held")).filter("n > 1")
        several = materialize(counts.select("e", ((F.col("n") > HOT) & (F.col("held") < WIDTH)).alias("hot")), "suffix-keys")
        met = materialize(open_.join(several, "e"), "suffix-shared")
        stored += [several, met]
        cold = met.filter("not hot").select("e", "doc", "tie", "lo", "hi", "region")
        shared = cold if shared is None else shared.unionByName(cold)
        hot = met.filter("hot").drop("hot")
        if hot.isEmpty():
            break
        sides = materialize(_longer(hot.select("e", "doc", "tie", "lo", "hi", "c0", "c1", "region")), "suffix-longer")
    out.append(_by_suffix_array(shared))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    got = materialize(whole, "suffix-ranges")
    release(*stored)
    gc.collect()
    docs.sparkSession._jvm.System.gc()
    return got


def spans_of(n: int, los, his) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, from ranges of windows."""
    if not len(los):
        return []
    order = np.argsort(los, kind="stable")
    lo, end = np.asarray(los)[order], np.minimum(np.asarray(his)[order] + WIDTH, n)
    reach = np.maximum.accumulate(end)
    new = np.append(True, lo[1:] > reach[:-1])
    first = np.nonzero(new)[0]
    return list(zip(lo[first].tolist(), reach[np.append(first[1:] - 1, len(lo) - 1)].tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): spans removed as arrays of start and end in bytes, kept the bytes that stay."""
    keyed = _keyed(docs, id_col, text_col)
    ranges = removed_ranges(keyed).groupBy("doc", "tie").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
    joined = keyed.join(ranges, ["doc", "tie"], "left").select("id", "raw", "los", "his")

    def run(batches):
        for b in batches:
            for part in slices(b, 1, 16 << 20):
                sizes, starts, ends, kept = [], [], [], []
                for raw, los, his in zip(part.column(1), part.column(2), part.column(3)):
                    raw = raw.as_py()
                    spans = spans_of(len(raw), los.values.to_numpy(), his.values.to_numpy()) if los.is_valid else []
                    sizes.append(len(raw))
                    starts.append([a for a, _ in spans])
                    ends.append([e for _, e in spans])
                    at, pieces = 0, []
                    for a, e in spans:
                        pieces.append(raw[at:a])
                        at = e
                    kept.append(b"".join([*pieces, raw[at:]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["id", "n_bytes", "starts", "ends", "kept"])

    return joined.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, starts array<long>, ends array<long>, kept binary")


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
