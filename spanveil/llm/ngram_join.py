"""Exact Jaccard self-join of word-shingle sets by universe partitions.

The hash universe is cut into segments; how many depends on a set's size band. Two sets that are similar enough
differ in at most h elements, so of segments with tolerances v (0: equal, 1: one element apart) and sum(v + 1) > h at
least one is within its tolerance. Segments with tolerance 0 are indexed by their subset, those with tolerance 1 by
their subset and all its one-deletion neighbours. Which kind a band gets is decided by cost from the number of
documents in it; either is lossless. Whatever shares an index entry is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .components import components

SHINGLE = 3
#: Documents link when 100 x intersection >= PERCENT x union.
PERCENT = 90
#: Cost model: a verification costs this many index entries; the chance that sets of unlike documents share an element.
VERIFY_COST, SHARED = 4.0, 0.05
#: Known words a Python worker keeps hashes of, and sets a task remembers to have passed on.
WORDS_KEPT, SETS_KEPT = 1_000_000, 1_000_000
#: Bits of a sketch for each element of its set, about; members of an entry that one block of it holds.
SKETCH_BITS, BLOCK = 2, 4096
#: Each component of an entry proposes its nearest pair, and in each further round so many times more pairs.
GROWTH = 32
#: Bytes that an index entry has at least.
ENTRY_BYTES = 5

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, hashes: _WordHash, size: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    span = min(size, n)
    total = np.full(n - span + 1, np.uint64(span))
    for k in range(span):
        total = mix(total * _A + w[k : n - span + 1 + k]) + _B
    return np.unique(total)


def set_digest(found: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a whole set, as signed integers: its name, and the check that tells namesakes apart."""
    totals = [int(np.add.reduce(mix(found ^ salt))) + len(found) * int(_B) for salt in (_C, _A)]
    name, check = mix(np.array([t % 2**64 for t in totals], np.uint64)).view(np.int64).tolist()
    return name, check


def band_tops(largest: int, percent: int = PERCENT) -> list[int]:
    """The largest size of each band. A set's partners that are no smaller lie in its band or the next one."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
    return tops


def difference(top: int, percent: int = PERCENT) -> int:
    """The most elements by which similar sets differ, the smaller of which has at most ``top``."""
    return top * (100 - percent) // percent


def allocation(top: int, docs: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """Segments, their tolerance, and how many may be spared, for pairs whose smaller set is in a band: the cheaper kind.

    With h + 1 + e exact segments at least e + 1 are equal, so a set may leave out e of its entries if it always
    leaves out the costliest: the empty ones, which many unlike sets share. e is set so that few sets have more.
    """
    h = difference(top, percent)
    exact, near = h + 1, (h + 2) // 2
    empty = exact * np.exp(-top / exact)
    spare = int(np.ceil(empty + 4 * np.sqrt(empty))) if h else 0

    def cost(entries: float, segments: float, alike: float) -> float:
        return entries + VERIFY_COST * docs * segments * SHARED**alike

    if cost(exact + spare, exact + spare, top / (exact + spare)) <= cost(near + top, near * (top / near + 1), top / near - 1):
        return exact + spare, 0, spare
    return near, 1, 0


def index_entries(found: np.ndarray, band: int, segments: int, tolerance: int, spare: int = 0) -> np.ndarray:
    """The index entries of a set under a band's partition, as signed integers."""
    which = ((found >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mixed = mix(found ^ _A)
    total = np.zeros(segments, np.uint64)
    there, first = np.unique(which, return_index=True)
    there = there.astype(np.int64)
    total[there] = np.add.reduceat(mixed, first)
    place = mix(np.arange(segments, dtype=np.uint64) + np.uint64(band * int(_B) % 2**64))
    entries = mix(total + place)
    if tolerance:
        at = which.astype(np.int64)
        entries = np.concatenate([entries, mix(total[at] - mixed + place[at])])
    elif segments - len(there) <= spare:
        entries = entries[there]
    return entries.view(np.int64)


def entry_bytes(entries: int) -> int:
    """Bytes of an index entry, among so many: unlike ones are equal by chance for at most one in 256.

    What meets by chance is verified as all else, and no entry that two sets share is lost: fewer bytes only move less.
    """
    return min(7, max(ENTRY_BYTES, -(-(entries.bit_length() + 8) // 8)))


def _measure(shingle: int):
    """Per document its size and its set's digests; the set's sketch comes with the first document of a task that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = _WordHash(), set()
        for batch in batches:
            sizes, names, checks, sketches = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                found = shingle_set(text.as_py(), hashes, shingle)
                name = set_digest(found) if len(found) else (None, None)
                sizes.append(len(found))
                names.append(name[0])
                checks.append(name[1])
                fresh = len(found) and name not in done
                if fresh:
                    if len(done) >= SETS_KEPT:
                        done.clear()
                    done.add(name)
                sketches.append(odd_sketch(found) if fresh else None)
            cells = [pa.array(x, t) for x, t in ((sizes, pa.int64()), (names, pa.int64()), (checks, pa.int64()), (sketches, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], ["doc_id", "row", "n_shingles", "cls", "check", "sketch"])

    return run


def _index(tops: list[int], plans: list[tuple[int, int, int]], shingle: int, renamed: dict[tuple[int, int], int], width: int):
    kept = np.int64((1 << 8 * width) - 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = _WordHash(), set()

        def batch_of(entries: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
            cls = np.repeat(np.array(names, np.int64), [len(e) for e in entries])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(entries) & kept), pa.array(cls)], ["entry", "cls"])

        for batch in batches:
            entries, names, held = [], [], 0
            for text in batch.column(0).cast(pa.binary()):
                found = shingle_set(text.as_py(), hashes, shingle)
                if not len(found) or (digests := set_digest(found)) in done:
                    continue  # equal sets have equal entries: one of them per task is enough
                if len(done) >= SETS_KEPT:
                    done.clear()
                done.add(digests)
                name = renamed.get(digests, digests[0])
                band = int(np.searchsorted(tops, len(found)))
                for k in {band, max(0, band - 1)}:
                    entries.append(index_entries(found, k, *plans[k]))
                    names.append(name)
                    held += len(entries[-1])
                if held > 500_000:
                    yield batch_of(entries, names)
                    entries, names, held = [], [], 0
            if entries:
                yield batch_of(entries, names)

    return index


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (entry, cls): members of entries with two sets or more, their rank and the first one.

    A group streams through; only its first member and the count so far are held.
    """
    last_entry = last_cls = hub = None
    rank, pending = -1, False
    for batch in batches:
        entry, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # Repeats of (entry, cls) come from different tasks.
        fresh = np.ones(len(entry), bool)
        fresh[1:] = (entry[1:] != entry[:-1]) | (cls[1:] != cls[:-1])
        if len(entry) and last_entry is not None and entry[0] == last_entry and cls[0] == last_cls:
            fresh[0] = False
        entry, cls = entry[fresh], cls[fresh]
        if not len(entry):
            continue
        start = np.ones(len(entry), bool)
        start[1:] = entry[1:] != entry[:-1]
        start[0] = last_entry is None or entry[0] != last_entry
        firsts = np.flatnonzero(start)
        out_entry, out_cls, out_rank, out_hub = [], [], [], []
        lead = int(firsts[0]) if len(firsts) else len(entry)
        if lead:  # these continue the last group
            if pending:
                out_entry.append(np.array([last_entry]))
                out_cls.append(np.array([hub]))
                out_rank.append(np.array([0]))
                out_hub.append(np.array([hub]))
            out_entry.append(entry[:lead])
            out_cls.append(cls[:lead])
            out_rank.append(rank + 1 + np.arange(lead))
            out_hub.append(np.full(lead, hub))
            rank, pending = rank + lead, False
        if len(firsts):
            sizes = np.diff(np.append(firsts, len(entry)))
            group = np.repeat(np.arange(len(firsts)), sizes)
            many = np.repeat(sizes > 1, sizes)
            ranks = np.arange(lead, len(entry)) - firsts[group]
            out_entry.append(entry[lead:][many])
            out_cls.append(cls[lead:][many])
            out_rank.append(ranks[many])
            out_hub.append(cls[firsts][group][many])
            hub, rank, pending = int(cls[firsts[-1]]), int(sizes[-1]) - 1, sizes[-1] == 1
        last_entry, last_cls = int(entry[-1]), int(cls[-1])
        if sum(map(len, out_entry)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_entry, out_cls, out_rank, out_hub)], ["entry", "cls", "rank", "hub"])


def odd_sketch(found: np.ndarray) -> bytes:
    """One bit for each residue of the hashes: set if an odd number of elements has it.

    Two sketches differ in no more bits than their sets in elements, and in nearly as many if the bits are several
    times the elements. Their number is a power of two; folding halves upon each other gives the sketch of half as many.
    """
    bits = max(256, SKETCH_BITS << (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets(shingle: int):
    """From (text, cls) the set of each class, once in a task."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = _WordHash(), set()
        for batch in batches:
            names, found_all = [], []
            for text, name in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                if name not in done:
                    if len(done) >= SETS_KEPT:
                        done.clear()
                    done.add(name)
                    names.append(name)
                    found_all.append(shingle_set(text.as_py(), hashes, shingle).view(np.int64))
            if names:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found_all])]).astype(np.int32)
                elements = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found_all)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), elements], ["cls", "elements"])

    return sets


def near_pairs(part: np.ndarray, cls: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: list[bytes], percent: int, most_each: int) -> tuple[np.ndarray, bool]:
    """Pairs of members of different components that may be similar, and whether there are more than these.

    A pair is no candidate only if its sizes, or the bits in which its sketches differ, prove it too far apart. Each
    component proposes its ``most_each`` nearest candidates, so there are at most that many pairs a component. Members of
    one part alone meet each other; those of two parts meet across.
    """
    width = min(map(len, sketches))
    rows = np.empty((len(cls), width), np.uint8)
    for i, sketch in enumerate(sketches):
        bits = np.frombuffer(sketch, np.uint8)
        while len(bits) > width:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        rows[i] = bits
    rows = rows.view(np.uint64)
    across = len(np.unique(part)) > 1
    # Members of the largest component need no test against each other: the others are tested against all.
    _, which, counts = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((which, -counts[which]))
    part, cls, root, n, rows, which = (x[order] for x in (part, cls, root, n, rows, which))
    first = int((which == which[0]).sum())
    # The nearest pairs so far, cut back to what some component may still propose whenever twice as many are held.
    far, one, two = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    waiting, waits, more = [], 0, False

    def cut_back() -> None:
        nonlocal far, one, two, waiting, waits, more
        far, one, two = (np.concatenate([x, *y]) for x, y in zip((far, one, two), zip(*waiting)))
        waiting, waits = [], 0
        near = np.lexsort((cls[two], cls[one], far))
        far, one, two = far[near], one[near], two[near]
        keep = np.zeros(len(far), bool)
        both = np.concatenate([which[one], which[two]])
        at = np.tile(np.arange(len(far)), 2)
        by = np.lexsort((at, both))
        starts = np.flatnonzero(np.concatenate([[True], both[by][1:] != both[by][:-1]]))
        place = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        keep[at[by[place < most_each]]] = True
        more = more or not keep.all()
        far, one, two = far[keep], one[keep], two[keep]

    for i in range(first, len(cls)):
        apart = np.flatnonzero((which[:i] != which[i]) & (part[:i] != part[i])) if across else np.flatnonzero(which[:i] != which[i])
        # Similar sets with s elements together (shared ones twice) differ in d of them: 100 (s - d) >= percent (s + d).
        most = (n[apart] + n[i]) * (100 - percent) // (100 + percent)
        fits = np.abs(n[apart] - n[i]) <= most
        apart, most = apart[fits], most[fits]
        differ = np.bitwise_count(rows[apart] ^ rows[i]).sum(1, dtype=np.int64)
        near = differ <= most
        if near.any():
            waiting.append((differ[near] - most[near], apart[near], np.full(int(near.sum()), i)))
            waits += int(near.sum())
        if waits > 1_000_000:
            cut_back()
    if waiting:
        cut_back()
    return np.stack([np.minimum(cls[one], cls[two]), np.maximum(cls[one], cls[two])]), more


def _near_pairs(percent: int, most_each: int):
    """From rows sorted by (entry, low, high): (entry, a, b, more), the pairs that ``near_pairs`` gives for each block of an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            entry, _, _, part, cls, root, n = (whole.column(k).to_numpy() for k in range(7))
            (a, b), more = near_pairs(part, cls, root, n, whole.column(7).to_pylist(), percent, most_each)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), entry[0])), pa.array(a), pa.array(b), pa.array(np.full(len(a), more))], ["entry", "a", "b", "more"])

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(batch)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if held and [held[-1].column(k)[0].as_py() for k in range(3)] != key[:, start].tolist():
                    yield from finish()
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield from finish()

    return run


def _possible(percent: int):
    """Of rows (a, b, na, nb, sa, sb) the pairs that neither sizes nor sketches prove too far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            most = (na + nb) * (100 - percent) // (100 + percent)
            keep = np.abs(na - nb) <= most
            for i in np.flatnonzero(keep):
                x, y = (np.frombuffer(batch.column(k)[int(i)].as_py(), np.uint8) for k in (4, 5))
                while len(x) != len(y):
                    long = max(x, y, key=len)
                    folded = long[: len(long) // 2] ^ long[len(long) // 2 :]
                    x, y = (folded, y) if long is x else (x, folded)
                keep[i] = int(np.bitwise_count(x ^ y).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, base: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. All joins are plain equi-joins, which adaptive execution splits.

    Sketches go first: sets are made, and move, only for pairs that may be similar.
    """
    small = lambda c, n, k: classes.select(F.col("cls").alias(c), F.col("n").alias(n), F.col("sketch").alias(k))
    sketched = pairs.join(small("a", "na", "sa"), "a").join(small("b", "nb", "sb"), "b")
    pairs = written(sketched.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible(percent), "a bigint, b bigint").distinct(), "possible")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    named = classes.join(wanted, "cls").select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.row").alias("rep_row"))
    texts = base.join(named, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("row") == F.col("rep_row"))).select("text", "cls")
    sets = written(texts.mapInArrow(_sets(shingle), "cls bigint, elements array<bigint>").dropDuplicates(["cls"]), "sets")
    one = sets.select(F.col("cls").alias("a"), F.col("elements").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("x", "y"))
    sizes = F.size("x") + F.size("y")
    fits = F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * percent
    return both.where(F.when(fits, 100 * shared >= percent * (sizes - shared)).otherwise(False)).select("a", "b").distinct()


def _renamed(members: DataFrame) -> dict[tuple[int, int], int]:
    """New names for sets that share a name with another set, by (name, check).

    Of n sets, n^2 / 2^65 pairs are expected to share one: none in most corpora, a few at 10^10 sets.
    """
    named = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    shared = named.where("low < high").select("cls", "low")
    found = members.join(shared, "cls").where("check <> low").select("cls", "check").distinct().collect()
    words = np.array([(r["cls"], r["check"]) for r in found], np.int64).reshape(-1, 2).view(np.uint64)
    fresh = mix(mix(words[:, 0] ^ _B) + words[:, 1]).view(np.int64)
    return {(r["cls"], r["check"]): int(x) for r, x in zip(found, fresh)}


def _with_names(rows: DataFrame, renamed: dict[tuple[int, int], int]) -> DataFrame:
    if not renamed:
        return rows
    table = rows.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "c bigint, k bigint, fresh bigint")
    joined = rows.join(F.broadcast(table), (F.col("cls") == F.col("c")) & (F.col("check") == F.col("k")), "left")
    return joined.withColumn("cls", F.coalesce("fresh", "cls")).drop("c", "k", "fresh")


def _merged_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(a, root) after further links: components over the roots that the links join, carried down to their nodes."""
    named = lambda end: roots.select(F.col("a").alias(end), F.col("root").alias(f"{end}_root"))
    joined = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    tops = components(joined).select(F.col("a").alias("top"), F.col("root").alias("over"))
    moved = roots.join(tops, F.col("root") == F.col("top"), "left").select("a", F.coalesce("over", "root").alias("root"))
    return written(moved.unionByName(tops.select(F.col("top").alias("a"), F.col("over").alias("root"))), "roots")


def similarity_classes(
    docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, cls), verified links (a, b) between classes, and roots (a, root) of linked ones.

    A class is a distinct shingle set. Links between different sets are found hub by hub: first the member of an entry
    that shares most entries is verified against its others. In entries whose members then lie in more than one
    component, members of different components are compared by sketches that bound their difference from below. Each
    component proposes its nearest candidates, which are verified and join components; in each further round it proposes
    more, until no entry holds a candidate that wasn't verified. So pairs are no more than a multiple of an entry's
    members in a round, no pair whose link could join two components stays untested, and components are exact; links
    inside a component need not be complete.
    """
    base = id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.md5("text")).alias("row"), "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    measured = written(base.mapInArrow(_measure(shingle), f"doc_id {kind}, row binary, n_shingles bigint, cls bigint, check bigint, sketch binary"), "measured")
    renamed = _renamed(measured.select("cls", "check"))
    named = _with_names(measured, renamed)
    members = named.select("doc_id", "n_shingles", "cls")
    # A histogram over size bands: bounded by the logarithm of the largest set.
    largest = members.agg(F.max("n_shingles")).first()[0] or 1
    tops = band_tops(int(largest), percent)
    sizes = members.groupBy("n_shingles").count()
    band = F.lit(0)
    for k, top in enumerate(tops[:-1]):
        band = F.when(F.col("n_shingles") > top, k + 1).otherwise(band)
    held = {r["band"]: r["docs"] for r in sizes.groupBy(band.alias("band")).agg(F.sum("count").alias("docs")).collect()}
    plans = [allocation(top, held.get(k, 0) + held.get(k + 1, 0), percent) for k, top in enumerate(tops)]
    most = sum((held.get(k, 0) + held.get(k + 1, 0)) * (segments + tolerance * tops[k]) for k, (segments, tolerance, _) in enumerate(plans))
    entries = base.select("text").mapInArrow(_index(tops, plans, shingle, renamed, entry_bytes(most)), "entry bigint, cls bigint")
    groups = written(
        entries.repartition("entry").sortWithinPartitions("entry", "cls").mapInArrow(_groups, "entry bigint, cls bigint, rank bigint, hub bigint"),
        "groups",
    )
    # Of each class that shares an entry, its size, its sketch and the least document that has it.
    sketches = named.where("sketch IS NOT NULL").select("cls", F.col("n_shingles").alias("n"), "sketch").join(groups.select("cls").distinct(), "cls").dropDuplicates(["cls"])
    reps = named.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("doc_id", "row")).alias("rep"))
    classes = written(sketches.join(reps, "cls"), "classes")
    # The first hub of an entry is the member that shares most entries: the middle of a family of copies.
    shares = groups.groupBy("cls").agg(F.count("*").alias("shares"))
    hubs = groups.select("entry", "cls").join(shares, "cls").groupBy("entry").agg(F.max_by("cls", F.struct("shares", "cls")).alias("hub"), F.count("*").alias("size"))
    hubs = written(hubs, "hubs")
    starred = groups.select("entry", "cls").join(hubs, "entry").where("cls <> hub")
    tested = written(starred.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct(), "pairs")
    links = written(_verified(tested, base, classes, percent, shingle), "links")
    roots = components(links)
    # The star has tested the one pair of an entry of two.
    open_ = hubs.where("size > 2").select("entry")
    most_each = 1
    while True:
        placed = groups.select("entry", "cls").join(open_, "entry").join(roots.withColumnRenamed("a", "cls"), "cls", "left").select("entry", "cls", F.coalesce("root", "cls").alias("root"))
        split = written(placed.groupBy("entry").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size")).where("least < most").select("entry", "size"), "open")
        # An entry of many members is cut into parts, and each two of its parts are a block.
        parts = F.ceil(F.col("size") / BLOCK).cast("int")
        cut = placed.join(split, "entry").select("entry", F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"), parts.alias("parts"), "cls", "root")
        paired = cut.select(
            "entry", "part", "cls", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        ).select("entry", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "cls", "root")
        sketched = paired.join(classes.select("cls", "n", "sketch"), "cls").select("entry", "low", "high", "part", "cls", "root", "n", "sketch")
        near = written(
            sketched.repartition("entry", "low", "high").sortWithinPartitions("entry", "low", "high")
            .mapInArrow(_near_pairs(percent, most_each), "entry bigint, a bigint, b bigint, more boolean"),
            "near",
        )
        fresh = written(near.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        found = written(_verified(fresh, base, classes, percent, shingle), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = _merged_roots(roots, found)
        open_ = written(near.where("more").select("entry").distinct(), "open")
        if open_.isEmpty():
            return members, links, roots
        tested = tested.unionByName(fresh)
        most_each *= GROWTH


def ngram_jaccard_join(
    docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least id reachable by links).

    A null, empty or blank text has no shingles and links with nothing. Rows that repeat an id are one document in
    a component. A null id is larger than any other: it names a component only if all its ids are null. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    members, _, roots = similarity_classes(docs, percent, shingle, id_col, text_col)
    least = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("a", "cls"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    # Both in tables, so that the join deals them itself and adaptive execution can split a large component.
    rooted = written(rooted, "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    by_class = rooted.join(named, "root").select("cls", "component_id")
    linked = members.where("cls IS NOT NULL").join(by_class, "cls").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(members.where("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(
    docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the least id.

    A document is an id and a text. A null id is larger than any other; of documents of one id, as where all ids of a
    component are null, that with the least MD5 of its text stays. Rows that repeat both id and text are one document
    and stay or go together. Rows without words stay. An empty table gives no rows.
    """
    key = lambda of: F.struct(of(id_col).isNull().alias("none"), of(id_col).alias("id"), F.unhex(F.md5(F.coalesce(of(text_col), F.lit("")))).alias("md5"))
    found = ngram_jaccard_join(docs.select(key(lambda c: F.col(f"`{c}`")).alias("row"), F.col(f"`{text_col}`").alias("text")), percent, shingle, "row", "text")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id.none"), F.col("doc_id.id"), F.col("doc_id.md5")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    row = key(lambda c: F.col("d")[c])
    return packed.join(gone, (row["none"] == F.col("none")) & row["id"].eqNullSafe(F.col("id")) & (row["md5"] == F.col("md5")), "left_anti").select("d.*")
